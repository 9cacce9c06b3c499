"""Operators against brute force on small fixtures, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import functools
import hashlib
import itertools
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, bpe, exact_dedup, html_wrap, langid, minhash, packing, pii, suffix_dedup, toxicity
from tidemark.llm.components import components

VOCAB = tokenizer_path("byte_bpe_50k.json")
TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, keep string"


def prose(seed, n, words="river stone lamp green paper winter cloud table seven glass".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    passage = prose(9, 60)
    near = base.split()
    near[5] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "one  two"), (10, passage + " x " + prose(3, 40)), (11, prose(4, 50) + " " + passage), (12, "<|endoftext|> a'll b"), (2, base), (13, prose(5, 9000)), (14, "é中文 " * 40), (None, "no id here")]
    return spark.createDataFrame([(i, t, "s", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_near_duplicates_equal_brute_force(docs, none):
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    got = {(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows, threshold=Fraction(85, 100)).collect()}
    sets = {}
    for i, t in texts(rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    boss = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    boss[a] = boss[b] = min(boss[a], boss[b])
    assert got == {i: (len(s), boss[i], boss[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.near_duplicates(docs).count() == docs.count()


def test_near_duplicates_without_a_common_centre(spark):
    """A chain of texts each like the next only, and a crowd that shares a passage but isn't alike."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 200])) for i in range(12)] + [(100 + i, " ".join(words[:60]) + " " + prose(500 + i, 60)) for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=Fraction(85, 100)).collect()}
    assert {got[i] for i in range(12)} == {0} and all(got[100 + i] == 100 + i for i in range(30))


def test_circulant_bands_miss_no_pair_at_the_threshold():
    """Pairs just at the threshold; one in a million may share no bucket."""
    t, n, size, d = Fraction(85, 100), 4000, 40, 3
    bands, rows = minhash.shape(t)
    base = np.random.default_rng(2).integers(0, 2**63, (n, size + d), dtype=np.int64).view(np.uint64)
    at = np.arange(0, (n + 1) * size, size)
    a, b = (minhash.band_keys(minhash.signatures(np.ascontiguousarray(v).ravel(), at, bands * rows), bands, rows) for v in (base[:, :size], base[:, d:]))
    assert 100 * (size - d) >= 85 * (size + d) and (a == b).any(1).all()


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 3), (2, 4), (None, 5), (6, None), (9, 7), (7, 8)] + [(i, i + 1) for i in range(20, 60)]
    frame = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, node string")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert components(frame.limit(0)).count() == 0


def test_exact_duplicates(docs, none):
    out = exact_dedup.deduplicate(docs)
    assert set(out.columns) == {"doc_id", "score", "keep", "keep_id", "group_size", "kept", "text_sha256"}
    got = out.collect()
    groups = collections.defaultdict(list)
    for i, t in texts(docs):
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t).encode()).hexdigest()].append(i)
    assert sorted((r.text_sha256, r.group_size) for r in got) == sorted((k, len(v)) for k, v in groups.items() for _ in v)
    for k, v in groups.items():
        mine = [r for r in got if r.text_sha256 == k]
        low = min((i for i in v if i is not None), default=None)
        assert {r.keep_id for r in mine} == {low} and [r.doc_id for r in mine if r.kept] == [low]
    assert exact_dedup.deduplicate(none).count() == 0
    # a filter that is far too small changes nothing
    assert sorted(map(str, exact_dedup.deduplicate(docs, most_bits=1024).collect())) == sorted(map(str, got))


def without_repeats(rows, length=400):
    """Brute force: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text."""
    data = [(i, t.encode()) for i, t in rows]
    count = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((str(i), len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 1])
def test_repeated_strings_equal_brute_force(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    notice = prose(77, 70)
    crowd = spark.createDataFrame([(100 + i, prose(200 + i, 5 + i) + " " + notice[i % 3 :] + prose(300 + i, 8), "s", "k") for i in range(40)], SCHEMA)
    rows = docs.union(crowd).withColumn("cuts", F.lit(1)).withColumn("tkey", F.lit("t"))
    out = suffix_dedup.remove_repeats(rows)
    assert {"cuts", "tkey", "score", "keep"} <= set(out.columns)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    want = without_repeats(texts(rows))
    assert got == want and sum(w[2] for w in want) > 0
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("length", [400, 250])
def test_passages_shorter_than_the_length_stay(spark, length):
    """A passage of 51 words in 300 to 399 bytes is kept at 400 bytes, as op8's contract says, and removed at 250."""
    passage = " ".join(f"{i:02d}words"[: 6 + i % 2] for i in range(51))
    assert 300 <= len(passage) < 390
    rows = [(i, f"{i}{prose(600 + i, 20)} {i}|{passage}|{i} {prose(700 + i, 20)}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length=length).collect())
    assert got == without_repeats(rows, length)
    assert [g[3] for g in got] == [int(length == 250)] * 6


@pytest.mark.skipif(not os.path.exists(TABLES), reason="the tables are not here")
def test_repeated_strings_of_the_table(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == without_repeats(texts(rows))


def test_tokens_equal_the_library(docs, none):
    lib = Tokenizer.from_file(VOCAB)
    for leaf in (bpe.LEAF, 64):
        got = bpe.encode_decode(docs.selectExpr("*", "1 AS ids_", "2 AS word_", "3 AS part_ids", "4 AS row_key"), VOCAB, ids=True, leaf=leaf).collect()
        want = sorted((str(i), tuple(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts(docs))
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == want
        assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t) for i, t in texts(docs))
    assert bpe.encode_decode(none, VOCAB).count() == 0


def test_joins_of_endless_words():
    voc, r = bpe.vocabulary(VOCAB), random.Random(3)
    for _ in range(40):
        t = "".join(r.choices("abcdehilnorst", k=r.randint(1500, 4000))) if r.random() < 0.5 else "".join(r.choices([" ", "  ", "\n", "a", "'s", "é", "12"], k=1200))
        data = t.encode()
        parts = [bpe.leaf_part(voc, data, a, b) for a, b in bpe.halves(data, 300)]
        assert bpe.concatenate(voc, data, parts).tolist() == voc.library.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, docs, none):
    lib = Tokenizer.from_file(VOCAB)
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, prose(i, 20 + i * 7 % 300)) for i in range(300)], "doc_id long, text string"))
    rows = packing.pack_documents(many, VOCAB).collect()
    place = collections.defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for v in place.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts(many)}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens for r in rows)
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in texts(many))
    assert sum(r.length for r in rows) / (1024 * len(place)) > 0.97
    assert packing.pack_documents(none, VOCAB).count() == 0


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    """The base patterns written out again."""
    count = lambda s: sum(c in "0123456789" for c in s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: max(map(int, s.split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count(s) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count(s) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


@pytest.mark.skipif(not os.path.exists(TABLES), reason="the tables are not here")
def test_personal_data_of_the_table(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    want = {i: plain_spans(t) for i, t in texts(rows)}
    assert any(want.values())
    for r in pii.detect(rows).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want[r.doc_id]) for k in ("email", "ip", "card", "phone")]
        assert set(want[r.doc_id]) <= set(r.spans.split(","))


def test_personal_data(spark, docs, none):
    t = "mail a.b@c.org, call +1 (632) 555-4827 or 4111-1111-1111-1111 at 10.0.0.1; 300.1.1.1; x [at] y [dot] com; plus one six three two five five five four eight two seven"
    r = pii.detect(spark.createDataFrame([(1, t, "a")], "doc_id long, text string, spans string"), redact=True).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    found = [(k, t[int(a) : int(b)]) for k, a, b in (x.split(":") for x in r.spans.split(","))]
    assert ("email", "x [at] y [dot] com") in found and ("email", "a.b@c.org") in found and ("card", "4111-1111-1111-1111") in found
    assert ("phone", "plus one six three two five five five four eight two seven") in found
    assert "4111" not in r.text and "[CARD]" in r.text and "300.1.1.1" in r.text
    base = plain_spans(t)
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert pii.detect(docs).count() == docs.count() and pii.detect(none).count() == 0


def test_personal_data_partly_in_disguise():
    spans = lambda t: [(k, t[a:b]) for k, v in pii.all_spans(t)[1].items() for a, b in v]
    for t, want in (
        ("call plus four nine 151 23456789 now", ("phone", "plus four nine 151 23456789")),
        ("call plus 49 151 23456789 now", ("phone", "plus 49 151 23456789")),
        ("card 4111 1111 1111 111 one ok", ("card", "4111 1111 1111 111 one")),
        ("host ten one dot two dot 3 dot four end", ("ip", "one dot two dot 3 dot four")),
        ("call +1\u00a0632\u00a0555\u00a04827 now", ("phone", "+1\u00a0632\u00a0555\u00a04827")),
        ("card 4111\u00a01111\u00a01111\u00a01111 ok", ("card", "4111\u00a01111\u00a01111\u00a01111")),
        ("call +49 \u00b9\u00b2\u00b3 45678\u00b9 now", ("phone", "+49 \u00b9\u00b2\u00b3 45678\u00b9")),
        ("write user at seven dot com", ("email", "user at seven dot com")),
        ("write jane at firma dot nl today", ("email", "jane at firma dot nl")),
        ("write jane dot doe at mail dot firma dot it", ("email", "jane dot doe at mail dot firma dot it")),
    ):
        assert spans(t) == [want], t
    assert spans("we arrive at this point in one 2 or three days, 5 plus 6") == []


def test_language(spark, docs, none):
    langs = {"aa": "tion the and of wherever", "bb": "heit und der nicht schon"}
    rows = [(i, prose(i, 80, w.split()), k) for k, w in langs.items() for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_texts(frame.where("doc_id < 20"))
    got = langid.detect(frame.where("doc_id >= 20"), sample).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in langid.detect(docs, sample).collect()}
    assert odd[5] == odd[6] == odd[7] == "und"
    assert langid.detect(none, sample).count() == 0
    assert {r.lang_pred for r in langid.detect(docs, {}).collect()} == {"und"}


def test_language_of_copies(spark):
    """A language with many rows but few texts is in the sample, with each text once."""
    rows = [(f"copy number {i % 5} of few", "cc") for i in range(4000)] + [(f"text number {i}", "dd") for i in range(100)]
    sample = langid.sample_texts(spark.createDataFrame(rows, "text string, lang string"), rows_per_lang=4)
    assert set(sample) == {"cc", "dd"}
    assert all(sample["cc"].count(f"number {i} ") <= 1 for i in range(5)) and sample["cc"].count("copy") == 4


def greedy_phrases(model, text):
    """Longest matches one after the other, by search in the model's texts; a letter that no match begins with is a phrase."""
    learned = {x.lower() for _, t in model for x in t if x.isalpha()}
    sign = lambda x: " " if not x.isalpha() else x.lower() if x.lower() in learned else "?"
    fold = lambda t: re.sub(" +", " ", "".join(map(sign, t)))
    out = []
    for _, known in model:
        s, c, n, at = fold(known), fold(text), 0, 0
        while at < len(c):
            k = 1
            while at + k < len(c) and c[at : at + k + 1] in s:
                k += 1
            at, n = at + k, n + 1
        out.append(n)
    return out


def test_phrases_equal_greedy_search(monkeypatch):
    model = (("a", "the cat sat on the mat and the rat ran far from the tall man"), ("b", "der hund lief und der mann kam nie mehr an den see"))
    r = random.Random(5)
    words = [w for _, t in model for w in t.split()] + ["xyz", "über", "12"]
    many = ["the mat sat der hund xyz", "", None, "a", " ".join(r.choices(words, k=900)), " ".join(r.choices(words, k=7000)), "x" * 500]
    for stretch in (langid.STRETCH, 7):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        got, letters = langid.phrases(many, model)
        for i, t in enumerate(many):
            if t:
                assert got[i].tolist() == greedy_phrases(model, t), i
    assert letters.tolist() == [sum(x.isalpha() for x in t or "") for t in many]


@pytest.mark.parametrize("columns", [0, 3, 44, 1000])
def test_every_letter_has_its_own_code(monkeypatch, columns):
    """Scripts of 600 letters: phrases are those of greedy search, however many letters have a column."""
    monkeypatch.setattr(langid, "COLUMNS", columns)
    langid.machine.cache_clear()
    r = random.Random(7)
    han, hangul = [chr(0x4E00 + i) for i in range(600)], [chr(0xAC00 + i * 7) for i in range(600)]
    write = lambda signs, n: " ".join("".join(r.choices(signs, k=r.randint(1, 4))) for _ in range(n))
    pools = {"a": han[:400], "b": han[200:], "c": hangul, "d": list("abcdefghijklmnop")}
    model = tuple((k, write(p, 400)) for k, p in pools.items())
    assert len(set(langid.machine(model).code[[ord(x) for _, t in model for x in t if x != " "]])) == len({x for _, t in model for x in t} - {" "}) > 700
    known = dict(model)
    many = [known[k][60:160] + write(pools[k], 9) + " \u0416 zz " + known[k][:40] for k in "abcdabcd"] + [known["a"], "\u0416" * 9, known["c"][:1]]
    got, _ = langid.phrases(many, model)
    for i, t in enumerate(many):
        assert got[i].tolist() == greedy_phrases(model, t), i
    assert ["abcd"[x] for x in got[:8].argmin(1)] == list("abcdabcd")
    langid.machine.cache_clear()


def test_language_is_that_with_the_fewest_phrases(spark):
    model = {"a": "the cat sat on the mat and the rat ran", "b": "der hund lief und der mann kam", "c": "le chat est sur la table"}
    rows = [(i, " ".join(random.Random(i).choices(model["abc"[i % 3]].split(), k=3 + i % 40))) for i in range(60)]
    for r in langid.detect(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS was"), model).collect():
        n = greedy_phrases(tuple(sorted(model.items())), r.was)
        low, second = sorted(n)[:2]
        assert r.lang_pred == "abc"[n.index(low)] and abs(r.score - second / (second + low)) < 1e-12


def test_toxicity(spark, docs, none):
    bad = ["stupid", "worthless", "disgusting"]
    rows = [(i, prose(i, 60, "river stone lamp green paper winter".split()) + (" " + bad[i % 3] + " " + prose(i, 5) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame, F.col("doc_id") % 5 != 0)
    got = toxicity.score(frame.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.95
    assert toxicity.restore(["you are s t u p i d ok"], model.logp, {}) == ["you are stupid ok"] and toxicity.restore(["stuuupid"], model.logp, {}) == ["stupid"]
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, frame.limit(0), F.lit(True)) is None


def all_readings(word, logp):
    """Every way to read a disguised word, with its score: what each sign may stand for, written out again."""
    signs = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
    options = []
    for i, ch in enumerate(word):
        run = 1
        while i - run >= 0 and word[i - run] == ch:
            run += 1
        if ch.isalpha():
            options.append([(ch, 0.0)] + ([("", -0.5 if run > 2 else -3.0)] if run > 1 else []))
        elif ch in signs:
            options.append([(y, -0.7) for y in signs[ch]] + [(" ", -4.0), ("", -7.0)])
        else:
            options.append([(" ", -0.5), ("", -1.0)])
    for way in itertools.product(*options):
        text, score, codes = "", 0.0, [0, 0]
        for y, cost in way:
            score += cost
            if y == " " and codes[-1] == 0 or y == "":
                text += " " if y == " " and text and text[-1] != " " else ""
                continue
            code = ord(y) - 96 if y != " " else 0
            score += float(logp[codes[-2], codes[-1], code])
            text, codes = text + y, [*codes, code]
        yield text, score + (float(logp[codes[-2], codes[-1], 0]) if codes[-1] else 0.0)


def test_decoding_equals_all_readings(spark):
    words = "you are worthless idiot stupid shit and the river stone lamp".split()
    logp = toxicity.language_model(spark.createDataFrame([(i, prose(i, 60, words)) for i in range(20)], "doc_id long, text string"))
    for word in ("1d10t", "s.h.1.t", "$tup1d", "stuuupid", "s h ! t", "r1v3r", "l4mp", "aaa", "t-h-3", "0.0", "$$1"):
        best = max(s for _, s in all_readings(word, logp))
        assert toxicity.decode(word, logp) in {x for x, s in all_readings(word, logp) if s > best - 1e-4}, word


def test_scores_equal_those_of_plain_sets(spark):
    bad = ["stupid", "worthless", "disgusting"]
    rows = [(i, prose(i, 40, "river stone lamp green paper winter".split()) + (" " + bad[i % 3] if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(rows, "doc_id long, text string, toxic int"), F.col("doc_id") % 5 != 0)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    probe = [t for _, t, _ in rows[:40]] + ["", "you s t u p i d", "1 2 3", "Stupid, STUPID"]
    got = model.scores(probe, {})
    for t, y in zip(toxicity.restore(probe, model.logp, {}), got, strict=True):
        c = [0] + [ord(x) - 96 for x in re.sub("[^a-z]+", "`", t.lower()).strip("`")] + [0]
        number = lambda cs: functools.reduce(lambda a, b: a * 64 + b, cs)
        found = {number(c[i : i + 4]) | 1 << 30 for i in range(len(c) - 3)} | {number(c[i : i + 5]) for i in range(len(c) - 4)}
        w = [weight[g] for g in found if g in weight]
        z = model.curve @ np.array([1.0, np.log1p(sum(w)), max(w, default=0.0)])
        assert abs(y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9, t


def test_mixed_disguises(spark):
    words = "you are worthless idiot stupid shit and the river stone lamp".split()
    frame = spark.createDataFrame([(i, prose(i, 60, words).translate(str.maketrans("", "", "0123456789"))) for i in range(40)], "doc_id long, text string")
    logp = toxicity.language_model(frame)
    for disguised, plain in (("an i d 1 0 t here", "an idiot here"), ("so s.h.1.t so", "so shit so"), ("$ t u p 1 d", "stupid"), ("y.o.u._.a.r.e._.w.o.r.t.h.l.e.s.s._.i.d.i.o.t", "you are worthless idiot")):
        assert toxicity.restore([disguised], logp, {}) == [plain]
    assert toxicity.restore(["from 1 2 3 to 1.2.3.4"], logp, {}) == ["from 1 2 3 to 1.2.3.4"]
    long = "y.o.u._.a.r.e._." * 2000
    assert toxicity.restore([long], logp, {})[0].split() == ["you", "are"] * 2000


def test_only_gains_replace_text(spark):
    """Disguised words are restored; French, German and Spanish words, addresses, numbers and hashes stay as they are."""
    words = "you are worthless idiot stupid trash and the river stone lamp créée désagréé schifffahrt seeelefant schnee kaffee allée carro arrado a".split()
    logp = toxicity.language_model(spark.createDataFrame([(i, prose(i, 60, words)) for i in range(60)], "doc_id long, text string"))
    plain = ["Schifffahrt", "Seeelefant,", "créée", "A a a", "mail.07@mail2.example.com", '"8249aa8292c8e2d7dc8d8b760c301111bee22a2c"', "3rd 4th b2b", "1 2 3", "10.5.2.1", "…", ""]
    assert toxicity.restore(plain, logp, {}) == plain
    for disguised, word in (("stuuupid", "stupid"), ("$tup1d", "stupid"), ("1d1ot!", None), ("s.t.u.p.i.d", "stupid"), ("w0rthle$s", "worthless"), ("tr4sh", "trash"), ("i d i o t", "idiot")):
        got = toxicity.restore([disguised], logp, {})[0]
        assert got == word if word else got != disguised, disguised
    for w in ("stuuupid", "tr4sh", "s t u p i d", "llll", "a.b"):
        # nothing gains less than what is written; what is written is one of the readings
        assert toxicity._decoded(w, logp)[1] >= toxicity.as_written(w, logp) - 1e-6


def test_main_text(spark):
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class=ad>Buy</div><article><h1>Head {i}</h1><p>One&amp;two  {i}<p>three<br>four</p></article><div class='comments'><p>me too</div><footer>&copy; x</footer></body></html>"
    plain = "<html><body><div class='menu'><a href=1>a</a></div><div id='c'><p>Text number {i} is long enough to count as such.</p><p>And more {i}.</p></div><div class='sidebar'>s</div></body></html>"
    rows = [(i, "http://a.org/x", page.replace("{i}", str(i)), 1) for i in range(5)] + [(10 + i, "http://b.org/x", plain.replace("{i}", str(i)), 1) for i in range(5)] + [(20, None, None, 1), (21, "http://c.org", "", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrap.extract(frame).collect()}
    assert got[2][0] == "Head 2 One&two 2 three four" and got[2][1] == len(got[2][0])
    assert got[12][0] == "Text number 2 is long enough to count as such. And more 2."
    assert got[20] == got[21] == ("", 0)
    assert html_wrap.extract(frame.limit(0)).count() == 0


def test_main_text_of_mixed_templates(spark):
    """A page is judged by its own slots, whatever other templates its host has."""
    one = "<body><nav>menu</nav><article><p>First kind, page {i}.</article></body>"
    two = "<body><div class=menu>menu</div><div id=content><p>Second kind, page {i}.</div></body>"
    three = "<body><div class=menu>menu</div><div id=text-{i}><p>Third kind of page, number {i}, with no telling mark at all.</div></body>"
    rows = [(k * 100 + i, "http://a.org/", t.replace("{i}", str(i))) for k, t in enumerate((one, two, three)) for i in range(6)]
    got = {r.page_id: r.text for r in html_wrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert (got[i], got[100 + i], got[200 + i]) == (f"First kind, page {i}.", f"Second kind, page {i}.", f"Third kind of page, number {i}, with no telling mark at all.")


def test_main_text_without_shared_texts(spark):
    page = "<body><div id=post-{i}><p>We use cookies.</p><p>Story {i}.</p><p>Its end {i}.</p></div></body>"
    rows = [(i, "http://a.org/", page.replace("{i}", str(i))) for i in range(8)] + [(20, "http://b.org/", page)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrap.extract(frame).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i}. Its end {i}." for i in range(8)]
    assert got[20] == "We use cookies. Story {i}. Its end {i}."
    assert html_wrap.blocks(page.replace("{i}", "1"))[0][0] == html_wrap.blocks(page.replace("{i}", "23"))[0][0]


def test_wrappers_align():
    w = html_wrap.align(html_wrap.fold(["a", "b", "b", "c"]), html_wrap.fold(["a", "b", "d", "c"]))
    assert w == ["a", ["+", "b"], ["?", "d"], "c"]


def test_positions_are_those_of_the_cheapest_path():
    """Against all ways to give tokens to positions."""
    r = random.Random(8)
    for _ in range(60):
        pages = [[r.choice("abcd") for _ in range(r.randint(1, 6))] for _ in range(4)]
        w = html_wrap.Wrapper(html_wrap.functools.reduce(html_wrap.align, map(html_wrap.fold, pages)))
        for page in pages:
            got = w.match(page)
            assert [w.labels[i] for i in got] == page  # the wrapper has every page's tokens
            cost = lambda way: w.needed[way[0]] + sum(w.step(p, c) for p, c in zip(way, way[1:]))
            assert cost(got) == min(map(cost, itertools.product(*(w.at[t] for t in page))))


def test_main_text_is_chosen_by_position(spark):
    """Teasers have the path of the story's blocks; only their position in the wrapper tells them apart, and that of a notice its constancy."""
    page = "<body><div><p>We think that cookies are good for you and for us.</p></div><div><p>Story {i} begins with words that matter.</p><p>It goes on, {i} times.</p><p>It ends, {i}.</p></div><div><p><a href=x>See {i} too</a></p><p><a href=y>And {i}</a></p></div></body>"
    rows = [(i, "http://a.org/", page.replace("{i}", str(i * 37)), "h", "w") for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    want = [f"Story {i * 37} begins with words that matter. It goes on, {i * 37} times. It ends, {i * 37}." for i in range(9)]
    got = html_wrap.extract(frame)
    assert {"host", "wrapper", "page_id", "url", "text", "n_chars"} == set(got.columns)
    assert [r.text for r in got.orderBy("page_id").collect()] == want
    names = {c: c for c in html_wrap.PARSED}
    parsed = html_wrap.parse(frame.select("page_id", "url", "html"), "url", "html", names, ["page_id"])
    rule = html_wrap.inferred(parsed, names).first()
    one = parsed.where("page_id = 1").first()
    fixed = html_wrap.constants(one.paths, one.texts, html_wrap._shared(rule.shared))
    flat = html_wrap.json.dumps(list(dict.fromkeys(html_wrap.tokens(one.paths, one.lows, fixed))))  # a set of tokens instead of the wrapper
    assert html_wrap.main_text(one.paths, one.texts, one.lows, rule.wrapper, rule.shared, rule.weights) == want[1]
    assert html_wrap.main_text(one.paths, one.texts, one.lows, flat, rule.shared, rule.weights) != want[1]


def test_main_text_of_odd_pages(spark):
    page = "<body><article><p>Long {i}.</p></article></body>"
    many = "<body><article>" + "".join(f"<p>Block {i}</p>" for i in range(5000)) + "</article></body>"
    rows = [(1, None, page), (1, None, page), (2, "http://a.org", many), (3, "http://a.org", "<p>un<b>closed"), (4, "", "<<>>&amp; x < y"), (None, "http://a.org", page)]
    got = sorted((str(r.page_id), r.text) for r in html_wrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:2] == [("1", "Long {i}.")] * 2 and got[2] == ("2", " ".join(f"Block {i}" for i in range(5000))) and got[3][1] == "unclosed" and len(got) == 6


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [float("nan")] * 24), (5040, [0.0] * 24), (5060, [1.0]), (0, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(frame, "vec_id % 20 = 0").collect()
    d = x.astype(np.float64)
    hits = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1200, 20))
    for q, v in by.items():
        s = d @ d[q]
        s[q] = -9
        want = set(np.argsort(-s, kind="stable")[:20].tolist())
        v.sort()
        hits += len(want & {i for _, i, _ in v})
        assert [k for k, _, _ in v] == list(range(1, 21)) and all(abs(s[i] - y) < 1e-12 for _, i, y in v)
    assert hits / (20 * len(by)) >= 0.9
    assert ann.neighbours(frame.limit(0), "vec_id % 20 = 0").count() == 0


def test_neighbours_with_copies_and_ties(spark):
    """Hundreds of copies of one vector, and many other vectors with equal scores: the smaller vec_ids come first."""
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (1500, 6)).astype(np.float64)
    x[rng.choice(1500, 500, replace=False)] = [1, 1, 0, -1, 1, 0]
    x[~x.any(1)] = 1
    ids = rng.permutation(3000)[:1500]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(frame, "vec_id % 20 = 0", curves=2, windows=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, v in zip(ids, x, strict=True):
        if q % 20 == 0:
            best = sorted((-s, i) for s, i in zip((x @ v).tolist(), ids.tolist(), strict=True) if i != q)[:20]
            assert sorted(got[int(q)]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_neighbours_joins_without_broadcasts(spark, monkeypatch):
    """Files of repeated or simple vectors are small, what tasks make of their rows isn't: no join may go by the files' sizes."""
    plans, written = [], ann.materialize

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(ann, "materialize", lambda df, label: written(plan(df), label))
    x = np.random.default_rng(6).integers(-3, 4, (150, 8)).astype(np.float64)
    x = np.concatenate([x] * 4 + [x[:1]] * 300)
    x[~x.any(1)] = 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in plan(ann.neighbours(frame, "vec_id % 20 = 0", curves=2, windows=2)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sum(p.count("SortMergeJoin") for p in plans) == 4 and not any("Broadcast" in p for p in plans)
    assert set(got) == set(range(0, 900, 20))
    for q in got:
        best = sorted((-s, i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
