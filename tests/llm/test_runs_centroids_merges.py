"""Word runs, centroids and merge replay against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from tidemark.llm import centroids, merge_replay, queries, word_runs

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
TABLES = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words_of(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]


def runs_of(w, least=6, times=4):
    """Every stretch that repeats with q, for every q; the smallest q of each stretch."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda x: (x[0], x[2]))


def expected(w, least=6, times=4):
    r = runs_of(w, least, times)
    gone = {i for a, n, q in r for i in range(a + q, a + n)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(r), *best, 1000 * best[1] // best[2] if r else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in r)), sha(left))


RESULT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(0, 6)):
            n, k = r.choice([0, 1, 5, 6, 30, 120]), r.choice([1, 2, 3, 40])
            w = [r.randrange(k) for _ in range(n)]
            if n > 20 and r.random() < 0.6:
                a, p = r.randrange(n), r.randint(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        size = np.array([len(w) for w in texts], np.int64)
        begin = np.cumsum(size + 1) - size
        flat = [x for i, w in enumerate(texts) for x in (1000 + i, *w)] + [2000]
        got = word_runs.find_runs(np.array(flat, np.int64), begin, size, least, times)
        assert sorted((d, a, b - a, q) for d, a, b, q in got.tolist()) == sorted((i, *x) for i, w in enumerate(texts) for x in runs_of(w, least, times))


def test_extensions_of_long_repeats():
    """Where nothing but blocks, or one long period, is there, the grammar climbs over all of it."""
    for w in (np.zeros(50_000, np.int64), np.tile(np.arange(77), 700), np.r_[np.tile([1, 1, 2], 9000), np.zeros(9000, np.int64)]):
        s = np.r_[10**6, w, 10**6 + 1]
        lone = np.zeros(len(s), bool)
        lone[[0, -1]] = True
        g = word_runs.Grammar(s, lone)
        a = np.random.default_rng(1).integers(1, len(w), 200)
        b = np.random.default_rng(2).integers(1, len(w), 200)
        a, b = a[a != b], b[a != b]
        for back in (False, True):
            for x, y, n in zip(a.tolist(), b.tolist(), g.extension(a, b, back).tolist(), strict=True):
                one, two = (s[:x][::-1], s[:y][::-1]) if back else (s[x:], s[y:])
                m = min(len(one), len(two))
                differ = np.flatnonzero(one[:m] != two[:m])
                assert n == (differ[0] if len(differ) else m)


def test_run_cases(spark):
    line = "to be or not "
    long = " ".join(f"w{i % 13}" for i in range(30_000))
    rows = [(1, line * 5), (2, None), (3, ""), (4, " \t\n"), (5, "a a a a a"), (6, "a\ta\na a  a a"), (7, long), (1, line * 5), (None, "x y " * 9), (8, "a b a b a b a b z a b a b a b a b"), (9, "c c c c c c " + line * 4), (10, "x" * 200_000), (11, "é 中 é " * 8)]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, start long, keep string")
    out = word_runs.repeated_words(docs, spans=True)
    assert out.columns == ["doc_id", "keep", *RESULT, "runs", "collapsed"]
    got = sorted(((r.doc_id, *(r[c] for c in RESULT)) for r in out.collect()), key=str)
    assert got == sorted(((i, *(expected(words_of(t)) if i != 7 else (1, 0, 30_000, 13, 2307692, sha("0,30000,13\n"), sha(" ".join(f"w{i}" for i in range(13)))))) for i, t in rows), key=str)
    tie = out.where("doc_id = 8").first()
    assert [tuple(x) for x in tie.runs] == [(0, 8, 2), (9, 8, 2)] and tie.start == 0 and tie.collapsed == "a b z a b"
    assert word_runs.repeated_words(docs.limit(0)).count() == 0


def test_planted_runs_and_the_query(spark):
    """The whole query on the smallest tables: texts are planted as the contract says, and runs are those of a plain search."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in RESULT) for r in queries.op11_word_runs(spark, TABLES).collect()}
    planted = 0
    for d in docs:
        w = words_of(d.text)
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a, planted = h // 10 % n, planted + 1
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n < 5000:
            assert got[d.doc_id] == expected(w)
    assert planted and len(got) == len(docs)


# centroids


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for i, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (sha(f"3:{x[0]}"), centroids.transform(np.array([x[1]]))[0][centroids.sequency(64)].tolist()))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, at) in zip(kept, where, strict=True) if at == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    where = assign()
    own = {j: sum(d for d, at in where if at == j) for j in range(len(centres))}
    return sorted(((i, at, d, own[at], sum(own.values()), sha(",".join(map(str, centres[at])))) for (i, _), (d, at) in zip(kept, where, strict=True)), key=str)


def test_transform_is_exact():
    x = np.random.default_rng(3).integers(-1024, 1024, (50, 64))
    y = centroids.transform(x)
    assert (centroids.transform(y) == 64 * x).all() and ((y[:, None] - y[None]) ** 2).sum(2).tolist() == (64 * ((x[:, None] - x[None]) ** 2).sum(2)).tolist()
    changes = [(np.diff(np.sign(centroids.transform(np.eye(64, dtype=int)[[i]])[0])) != 0).sum() for i in centroids.sequency(64)]
    assert changes == list(range(64))


@pytest.mark.parametrize("size", [3, 1 << 29])
def test_nearest_keeps_ties(size):
    """Every row and centroid occurs several times: bounds that are equal don't eliminate, and the smaller number wins."""
    r = np.random.default_rng(4)
    y, c = r.integers(-size, size + 1, (200, 64)), r.integers(-size, size + 1, (6, 64))
    c = np.concatenate([c, c[:3], y[:2]])
    label, d = centroids.nearest(y, c)
    full = ((y.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
    assert d.tolist() == full.min(1).tolist() and label.tolist() == [row.tolist().index(min(row)) for row in full]
    assert len(centroids.nearest(y[:0], c)[0]) == 0


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(i % 5, 0.3, 64)]) for i in range(120)]
    rows += [(7, rows[3][1]), (500, rows[8][1]), (501, None), (502, []), (503, [1.0] * 63), (504, [None] + [1.0] * 63), (505, [float("nan")] + [1.0] * 63), (506, [float("inf")] + [1.0] * 63), (507, [0.0] * 64), (None, [0.5] * 64), (508, [1e5] * 64), (508, [1e5] * 64)]
    table = spark.createDataFrame([(i, v, 9, "k") for i, v in rows], "vec_id long, embedding array<double>, cluster int, keep string").repartition(5)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for k, rounds in ((8, 10), (3, 1), (1, 0)):
        out = centroids.cluster(table, k=k, rounds=rounds)
        assert set(out.columns) == {*names, "keep"}
        assert sorted((tuple(x[c] for c in names) for x in out.collect()), key=str) == brute_clusters(rows, k, rounds)
    few = table.where("vec_id in (1, 507)")
    assert sorted((tuple(x[c] for c in names) for x in centroids.cluster(few).collect()), key=str) == brute_clusters([rows[1], (507, [0.0] * 64)], 8, 10)
    assert centroids.cluster(table.where("vec_id between 501 and 506")).count() == 0 and centroids.cluster(table.limit(0)).count() == 0


def test_clusters_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{TABLES}/embeddings.parquet'")
    want = con.sql(queries.centroids_sql())
    got = queries.op12_centroids(spark, TABLES)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


# merge replay


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merge_replay.merges(RANKS).rank, special_tokens={})


def test_every_token_is_made_by_its_own_merges():
    """What replay in rank order rests on."""
    m = merge_replay.merges(RANKS)
    assert m.replay(list(m.rank)) == [r.to_bytes(4, "little") for r in m.rank.values()]


def test_replay_equals_library(library):
    m = merge_replay.merges(RANKS)
    r = random.Random(6)
    words = ["".join(r.choice("abcdetingos") for _ in range(r.randint(1, 40))).encode() for _ in range(3000)] + [b"a" * 5000, b"ab" * 3000, b"the" * 999, bytes(range(128, 256)) * 3, b"x"]
    want = [library._core_bpe.encode_single_piece(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.replay(words)] == want
    few = merge_replay.FEW
    try:
        for merge_replay.FEW in (0, 1 << 40):  # all by arrays, all place by place
            assert [np.frombuffer(x, "<u4").tolist() for x in m.replay(words)] == want
    finally:
        merge_replay.FEW = few


def test_words_are_the_patterns_matches(library):
    r = random.Random(7)
    alphabet = "abcde'stdmrelv  \n\t  é中文\U0001f600 ३5٣_!-՘࢏\x1c\x85ÅßǅＡ﻿​힣\U00011de0"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["it's 'tis ''s we'll", "  'd", "a  ", "\n\n b", "'" * 9]
    words, at = merge_replay.split(texts)
    m = merge_replay.merges(RANKS)
    ids = [list(memoryview(x).cast("I")) for x in m.replay(words)]
    assert ["".join(w.decode() for w in words[a:b]) for a, b in zip(at, at[1:], strict=False)] == texts
    assert [[i for w in ids[a:b] for i in w] for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_merge_replay_cases(spark, library):
    r = random.Random(8)
    common = " ".join(r.choice(["zorgle", "quaffing", "river", "Größe", "naïveté"]) for _ in range(4000))
    rows = [(1, common), (2, None), (3, ""), (4, " \n "), (5, "<|endoftext|> it's"), (6, "ab" * 60_000), (1, common), (None, "null id"), (7, "é中文\U0001f600" * 50), (8, "z" * 65 + " " + "y" * 64)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_tokens int, keep string").repartition(3)
    for head in (merge_replay.HEAD, 2, 0):  # how many words are replayed for the whole corpus changes nothing
        out = merge_replay.encode_decode(docs, RANKS, ids=True, head=head)
        assert out.columns == ["doc_id", "keep", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, x.ids, bytes(x.decoded)) for x in out.collect()), key=str)
        want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
        assert got == sorted(((i, len(e), sha(" ".join(map(str, e))), sha(b), e, b) for i, e, b in want), key=str)
    assert merge_replay.encode_decode(docs.limit(0), RANKS).count() == 0
    known = merge_replay.frequent_words(docs, RANKS)
    assert b" zorgle" in known["word"].to_pylist() and len(merge_replay.frequent_words(docs, RANKS, most=2)) <= 2


def test_merge_replay_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    for r in queries.op13_merge_replay(spark, TABLES).where(F.col("doc_id").isNotNull()).collect():
        e = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), sha(" ".join(map(str, e))), sha(docs[r.doc_id]))
