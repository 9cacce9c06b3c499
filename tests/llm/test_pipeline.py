"""The pipeline's stages, each held against what it should keep."""

import re
import zlib

import corpus_pipeline as P
import numpy as np
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    words = "river stone lamp green paper winter cloud table".split()
    text = lambda i, n=40: " ".join(words[(i * 7 + k * (1 + i % 5)) % 8] + str((i * 31 + k * k) % 50) for k in range(n))
    rows = [(i, text(i) + (" you worthless " + text(i + 1, 5) if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    rows += [(900, text(1).replace(" ", "  "), "en", "s", 0), (901, text(3, 40) + " tail", "en", "s", 0), (902, "write to ann@example.org today", "en", "s", 5), (903, None, None, None, None), (904, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS score", "1 AS kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = P.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert {903, 904} <= left and sum(i % 4 == 0 for i in left if i < 400) <= 2 and sum(i % 4 != 0 for i in left if i < 400) >= 298
    once = P.drop_copies(spark, clean, str(tmp_path))
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    assert sorted(norm(r.text) for r in once.collect()) == sorted({norm(r.text) for r in clean.collect()}) and once.columns == docs.columns
    far = P.drop_near_copies(spark, once, str(tmp_path))
    assert 901 not in {r.doc_id for r in far.collect()} and far.columns == docs.columns
    masked = P.mask_personal_data(spark, far, str(tmp_path))
    row = masked.where("doc_id = 902").first()
    assert row.text == "write to [EMAIL] today" and row.n_chars == len(row.text) and masked.columns == docs.columns
    pieces = P.pack_tokens(spark, masked, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in masked.collect()}
    assert P.run(spark, str(tmp_path)).count() == pieces.count()
    # the stages after the first, by brute force
    kept = {}
    for r in sorted((r for r in clean.collect()), key=lambda r: r.doc_id):
        kept.setdefault(norm(r.text), r)
    assert sorted(r.doc_id for r in kept.values()) == sorted(r.doc_id for r in once.collect())
    words = {r.doc_id: re.findall("[^\x20\x09-\x0d]+", (r.text or "").lower()) for r in kept.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    boss = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and boss[a] != boss[b] and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    boss[a] = boss[b] = min(boss[a], boss[b])
                    changed = True
    assert sorted(i for i in boss if boss[i] == i) == sorted(r.doc_id for r in far.collect())
    lib = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json"))
    whole = {r.doc_id: lib.encode(re.sub(r"ann@example\.org", "[EMAIL]", r.text or ""), add_special_tokens=False).ids + [0] for r in far.collect()}
    got = {}
    for r in pieces.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, ids in whole.items():
        at = 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
