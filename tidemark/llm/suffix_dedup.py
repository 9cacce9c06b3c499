"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte is removed if a string of `length` bytes that covers it starts anywhere else too. Any such string holds a
shorter one of `length` / 2 bytes whose hash is the least among those in it; wherever the long string occurs, the same
suffix is chosen. Only chosen suffixes are indexed: a sparse suffix array, one entry for about 100 bytes of text.

Index: suffixes of each batch of documents are sorted by what they begin with (eight bytes, then a hash of the whole
shorter string) into an array of range partitions, which is merge-scanned against the arrays of earlier batches.
Arrays of equal size are merged, so that there are as many arrays as the batches' number has binary ones. What is
found twice are repeated suffixes.

Matches: every occurrence of a repeated suffix is put beside the others together with its context, the bytes around it
that strings of `length` bytes may reach. Equal contexts repeat each other whole, so that one stands for all of them,
however many there are. Different contexts of a suffix are compared string by string where they are few. Where they
are many, their strings are halved into classes by where they begin, and dealt by the bytes that a class's strings have
in common, again and again, so that no group grows with a suffix's occurrences and none is sampled or capped. Runs of
repeated strings are merged and cut out of the text.

Defined cases: null text is an empty text; texts shorter than `length` bytes lose nothing; repeated rows are copies of
each other; columns named like those made here are replaced, all others kept; matches don't cross texts, and all are judged on the input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, bloom_has, bloom_of, column_name, flat_bytes, materialize, mix, plus, prefix_hash, slices, span_hash

#: So many contexts of a suffix at most are compared in one task; more are dealt to classes first.
HOT, STEP = 256, 1 << 20
_LOW, _ODD = np.uint64((1 << 24) - 1), np.uint64(0x9E3779B97F4A7C15)


def chosen(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen suffixes: where each begins, the hash of its first half-length bytes, and the first and last string that chose it."""
    k = length // 2
    w = length - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    limit = np.repeat(at[1:], np.diff(at)) - length  # last place where a string may start
    for c in range(0, max(0, len(data) - length + 1), STEP):
        part = data[c : c + STEP + length]
        n = len(part) - k + 1
        h = prefix_hash(part)
        v = span_hash(h, np.arange(n), np.arange(k, n + k))
        ranked = (v & ~_LOW) | np.arange(n, dtype=np.uint64)
        m = n - w + 1
        pad = -n % w
        blocks = np.r_[ranked, np.full(pad, ~np.uint64(0))].reshape(-1, w)
        fore = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(back[:m], fore[w - 1 : w - 1 + m])[: STEP]
        p = np.flatnonzero(limit[c : c + len(least)] >= np.arange(c, c + len(least)))
        a = (least[p] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1])]) if len(a) else np.zeros(0, np.int64)
        ends = np.r_[new[1:] - 1, len(a) - 1] if len(a) else new
        out.append((a[new] + c, v[a[new]], p[new] + c, p[ends] + c))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixArrays:
    """Sorted tables (head, khash, n) of chosen suffixes; each holds a power of two of batches, later ones fewer."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeated: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Merges a batch with the arrays of its size, and scans it against the larger ones."""
        size, rows = 1, batch.select("head", "khash", "n")
        while self.levels and self.levels[-1][0] == size:
            rows = rows.union(self.levels.pop()[1])
            size *= 2
        parts = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        merged = rows.repartitionByRange(parts, "head", "khash").groupBy("head", "khash").agg(F.sum("n").alias("n")).sortWithinPartitions("head", "khash")
        merged = materialize(merged, "suffixes")
        self.repeated.append(merged.where("n > 1"))
        for _, level in self.levels:
            self.repeated.append(merged.join(level.select("head", "khash"), ["head", "khash"], "left_semi"))
        self.levels.append((size, merged))

    def found(self) -> DataFrame:
        """Suffixes that occur more than once."""
        out = self.repeated[0]
        for x in self.repeated[1:]:
            out = out.union(x)
        return out.select("khash").distinct()


def _suffixes(docs: DataFrame, text: str, length: int, batches: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() % batches
        for b in rows:
            for s in slices(b, text):
                nth = (nth + 1) % batches
                data, at = flat_bytes(s.column(text))
                a, h, _, _ = chosen(data, at, length)
                uniq, first, n = np.unique(h, return_index=True, return_counts=True)
                head = np.zeros(len(uniq), np.uint64)
                for i in range(8):
                    head = (head << np.uint64(8)) | data[a[first] + i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uniq), nth, np.int32)), pa.array((head ^ np.uint64(1 << 63)).view(np.int64)), pa.array(uniq.view(np.int64)), pa.array(n.astype(np.int64))], ["batch", "head", "khash", "n"])

    return docs.select(text).mapInArrow(run, "batch int, head long, khash long, n long")


def _text_key(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _class_key(h: np.ndarray, begin: np.ndarray, khash: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and context of occurrences in the class of strings that begin first..last bytes before the suffix; lo..hi is the occurrence's own part of it.

    begin: where the hi bytes before the suffix begin in what h was made of; the k - lo bytes after it follow. The key is
    made of the bytes that all strings of the class hold, the context of those that any of the occurrence's strings holds.
    """
    at = begin + hi
    key = mix(span_hash(h, at - first, at + k - last) ^ mix(khash + first.astype(np.uint64) * _ODD + last.astype(np.uint64)))
    context = mix(span_hash(h, at - hi, at + k - lo) ^ mix(key + lo.astype(np.uint64) * _ODD + hi.astype(np.uint64)))
    return key, context


OCCURRENCE = "key long, context long, tkey binary, start long, lo int, hi int, around binary"


def _occurrences(docs: DataFrame, text: str, length: int, again: tuple[np.ndarray, int]) -> DataFrame:
    """Each occurrence of a repeated suffix: the text, which strings chose it (they begin lo..hi bytes before it), and the bytes around it without its own."""
    sent = docs.sparkSession.sparkContext.broadcast(again[0].tobytes())  # at most 8 MB, see bloom_of

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        k = length // 2
        for b in rows:
            for s in slices(b, text, SLICE_BYTES // 4):  # contexts overlap: they have about five times the bytes
                data, at = flat_bytes(s.column(text))
                a, h, p, q = chosen(data, at, length)
                some = bloom_has(own, again[1], h)
                a, h, p, q = a[some], h[some], p[some], q[some]
                doc = np.searchsorted(at, a, "right") - 1
                keys = np.array([b""] * s.num_rows, object)
                keys[:] = _text_key(data, at) if len(a) else keys
                whole = data.tobytes()
                around = pa.array([whole[i:j] + whole[j + k : e + length] for i, j, e in zip(p.tolist(), a.tolist(), q.tolist(), strict=True)], pa.binary())
                flat, begin = flat_bytes(around)
                lo, hi = a - q, a - p
                _, context = _class_key(prefix_hash(flat), begin[:-1], h, lo, hi, np.zeros_like(lo), np.full_like(lo, length - k), length - k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys[doc].tolist(), pa.binary()), pa.array(p - at[doc]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), around], ["key", "context", "tkey", "start", "lo", "hi", "around"])

    return docs.select(text).mapInArrow(run, OCCURRENCE)


def _halved(rows: DataFrame, length: int, level: int) -> DataFrame:
    """Occurrences dealt to the classes of the next level, each of which has half the strings: those whose strings are equal share a class's key."""
    k = length - length // 2
    bounds = (np.arange((1 << level) + 1) * (k + 1)) >> level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, begin = flat_bytes(b.column("around"))
            h = prefix_hash(data)
            key, start = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), b.column("start").to_numpy(zero_copy_only=False)
            lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            low, high = np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, hi, "right") - 1
            row = np.r_[np.arange(len(key)), np.flatnonzero(low != high)]
            part = np.r_[high, low[low != high]]
            first, last = bounds[part], bounds[part + 1] - 1
            l2, h2 = np.maximum(lo[row], first), np.minimum(hi[row], last)
            at = begin[:-1][row] + hi[row] - h2
            key2, context = _class_key(h, at, key[row], l2, h2, first, last, k)
            whole = data.tobytes()
            around = [whole[i:j] for i, j in zip(at.tolist(), (at + h2 + k - l2).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key2.view(np.int64)), pa.array(context.view(np.int64)), b.column("tkey").take(pa.array(row)), pa.array(start[row] + hi[row] - h2), pa.array(l2.astype(np.int32)), pa.array(h2.astype(np.int32)), pa.array(around, pa.binary())], ["key", "context", "tkey", "start", "lo", "hi", "around"])

    return rows.select("key", "context", "tkey", "start", "lo", "hi", "around").mapInArrow(run, OCCURRENCE)


RUN = "tkey binary, start long, upto long"


def _judged(rows: DataFrame, length: int, chunk: int = 4_000) -> DataFrame:
    """Runs of repeated strings of occurrences; those with one key (at most HOT) are compared with each other."""
    k = length - length // 2

    def judge(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").to_numpy().view(np.uint64)
        start, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("start", "lo", "hi"))
        col = t.column("around").combine_chunks()
        data, at = flat_bytes(col if isinstance(col, pa.Array) else col.chunk(0))
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = at[row] + nth
        string = mix(span_hash(prefix_hash(data), begin, begin + k) ^ mix(key[row] + (hi[row] - nth).astype(np.uint64)))
        _, back = np.unique(string, return_inverse=True)
        twice = np.bincount(back)[back] > 1
        # consecutive repeated strings of a row are one run
        edge = np.r_[True, (row[1:] != row[:-1]) | (twice[1:] != twice[:-1])]
        first = np.flatnonzero(edge & twice)
        cuts = np.flatnonzero(edge)
        last = np.r_[cuts[1:], len(row)][np.searchsorted(cuts, first)] - 1
        keys = t.column("tkey").combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row[first])), pa.array(start[row[first]] + nth[first]), pa.array(start[row[first]] + nth[last] + length)], ["tkey", "start", "upto"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < chunk:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield judge(t.slice(0, cut).combine_chunks())
                rest = t.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, RUN)


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """Runs (tkey, start, upto) of repeated strings.

    Occurrences whose context is the same repeat each other whole, and one stands for them. Where at most HOT contexts
    share a key they are compared; else their strings are halved into classes with keys of more bytes, at most until a
    class has one string, whose contexts are all the same. The sides that are hashed hold numbers only, so that the
    bytes of contexts are dealt out without being sorted, at every size of the input.
    """
    out: list[DataFrame] = []
    level = 0
    while True:
        rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "occurrences")
        contexts = materialize(rows.groupBy("context").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), F.first("key").alias("key")), "contexts")
        sizes = materialize(contexts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "sizes")
        kept = materialize(contexts.join(sizes.hint("shuffle_hash"), "key").select("uid", (F.col("contexts") > HOT).alias("hot")), "kept")
        same = rows.select("context", "tkey", "start", (F.col("start") + F.col("hi") - F.col("lo") + length).alias("upto")).join(contexts.where("n > 1").select("context").hint("shuffle_hash"), "context", "left_semi")
        out.append(same.select("tkey", "start", "upto").distinct())
        out.append(_judged(rows.join(kept.where("not hot").select("uid").hint("shuffle_hash"), "uid"), length))
        hot = kept.where("hot")
        if not hot.limit(1).count():
            break
        level += 1
        rows = _halved(rows.join(hot.select("uid").hint("shuffle_hash"), "uid"), length, level)
    out = [materialize(x, "runs") for x in out]
    runs = out[0]
    for x in out[1:]:
        runs = runs.union(x)
    return runs


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, batches: int = 3, keep_text: bool = False) -> DataFrame:
    """docs' other columns with n_bytes, n_removed, n_spans and kept_sha256; with keep_text also what is left, as kept_bytes."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept_bytes"] if keep_text else [])
    spark = docs.sparkSession
    entries = materialize(_suffixes(docs, text, length, batches), "entries")
    family = SuffixArrays()
    for i in range(batches):
        family.add(entries.where(F.col("batch") == i))
    repeated = materialize(family.found(), "repeated")
    cuts = _runs(_occurrences(docs, text, length, bloom_of(repeated, "khash")), length)
    # copies of a text list the same runs
    own = {c: column_name(docs, c) for c in ("tkey", "maybe", "size", "sha", "cuts")}
    listed = cuts.distinct().groupBy("tkey").agg(F.collect_list(F.struct("start", "upto")).alias("cuts"))
    listed = materialize(listed.withColumn("h", F.conv(F.hex(F.substring("tkey", 1, 8)), 16, -10).cast("long")), "cuts")
    cells, bits = bloom_of(listed, "h")
    sent = spark.sparkContext.broadcast(cells.tobytes())

    keep = [c for c in docs.columns if c not in made and c != text]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts go on only where runs may be listed for them."""
        mask = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            for s in slices(b, text):
                data, at = flat_bytes(s.column(text))
                whole = data.tobytes()
                texts = [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
                hit = bloom_has(mask, bits, np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(keys, pa.binary()), pa.array(np.diff(at)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t if keep_text or h else None for t, h in zip(texts, hit.tolist(), strict=True)], pa.binary())], [*keep, own["tkey"], own["size"], own["sha"], own["maybe"]])

    schema = plus(docs.select(*keep), {own["tkey"]: "binary", own["size"]: "long", own["sha"]: "string", own["maybe"]: "binary"})
    rows = docs.select(*keep, text).mapInArrow(split, schema)
    joined = rows.join(listed.select(F.col("tkey").alias(own["tkey"]), F.col("cuts").alias(own["cuts"])), own["tkey"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, own["maybe"]):
                removed, spans, sha, left = [], [], s.column(own["sha"]).to_pylist(), []
                for i, (t, c) in enumerate(zip(s.column(own["maybe"]), s.column(own["cuts"]).to_pylist(), strict=True)):
                    t = t.as_py()
                    gone = number = 0
                    if c:
                        out, at = [], 0
                        for x, y in sorted((r["start"], r["upto"]) for r in c):
                            if x > at or not number:
                                out.append(t[at:x])
                                number += 1
                                gone += y - x
                            else:
                                gone += max(0, y - at)
                            at = max(at, y)
                        t = b"".join(out) + t[at:]
                        sha[i] = hashlib.sha256(t).hexdigest()
                    removed.append(gone)
                    spans.append(number)
                    left.append(t)
                cols = [s.column(own["size"]), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(left, pa.binary())] if keep_text else [])
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *cols], [*keep, *made])

    kinds = dict(zip(made, ["long", "long", "long", "string", "binary"], strict=False))
    return joined.mapInArrow(cut, plus(docs.select(*keep), kinds))
