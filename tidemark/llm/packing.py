"""Packing of token sequences into windows by non-negative least squares.

Documents are cut into whole windows and a tail shorter than a window. Shallow combinations of tail lengths that fill
a window exactly are enumerated (two or three tails); non-negative least squares finds how often to use each, against
the histogram of tail lengths; counts are rounded down to what is there, and what is left is packed greedily, longest
first, into the fullest window with room. Tails are dealt at random into shards of bounded size, each of which is
packed on its own, so that no task holds more than SHARD tails however large the corpus.

Defined cases: a null text is empty and holds only the end token; repeated rows are packed as rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import vocabulary
from tidemark.llm.common import slices

SHARD = 50_000


def combinations(present: np.ndarray, window: int, triples: int = 4096) -> np.ndarray:
    """Combinations of two and three lengths that add up to window, as columns; of more than `triples` triples so many, at even steps through their sorted list."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    a = present[(present <= window - present) & have[window - present]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    x, y = np.meshgrid(present, present, indexing="ij")
    z = window - x - y
    ok = (x <= y) & (y <= z)
    ok[ok] = have[z[ok]]
    three = np.stack([x[ok], y[ok], z[ok]], 1)
    if len(three) > triples:
        three = three[np.linspace(0, len(three) - 1, triples).astype(np.int64)]
    return np.concatenate([pairs, three]).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative counts x that bring the lengths used near the histogram in the least-squares sense (projected, accelerated gradient)."""
    n = len(combos)
    if not n:
        return np.zeros(0)
    flat, weight = combos.ravel(), (combos.ravel() > 0).astype(float)
    size = len(histogram)
    use = lambda x: np.bincount(flat, np.repeat(x, 3) * weight, size)
    v = np.ones(n)
    for _ in range(12):
        v = (use(v)[flat] * weight).reshape(n, 3).sum(1)
        v /= np.linalg.norm(v)
    step = 1 / max(1e-9, float((use(v) ** 2).sum()))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * ((use(y) - histogram)[flat] * weight).reshape(n, 3).sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset for each length below window."""
    n = len(lengths)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=window + 1)
    begin = np.cumsum(left) - left
    combos = combinations(np.flatnonzero(left[:window]), window)
    x = solve(combos, left.astype(float))
    made = 0
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        c = combos[i][combos[i] > 0]
        kinds, need = np.unique(c, return_counts=True)
        k = int(min(np.rint(x[i]), (left[kinds] // need).min()))
        if k <= 0:
            continue
        at = 0
        for length in c:
            left[length] -= k
            rows = order[begin[length] + left[length] : begin[length] + left[length] + k]
            bins[rows] = made + np.arange(k)
            offset[rows] = at
            at += length
        made += k
    room: list[list[int]] = [[] for _ in range(window + 1)]
    for length in range(window, 0, -1):
        for r in order[begin[length] : begin[length] + left[length]].tolist():
            free = next((f for f in range(length, window) if room[f]), window)
            if free == window:
                b, made = made, made + 1
            else:
                b = room[free].pop()
            bins[r], offset[r] = b, window - free
            room[free - length].append(b)
    return bins, offset


def pack_documents(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()
    cut_schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for s in slices(b, "t"):
                ids, at, _, _ = voc.encode(s.column("t").to_pylist())
                who, start, length, crc, total = [], [], [], [], []
                for i in range(s.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                    for p in range(0, len(own), window):
                        piece = own[p : p + window]
                        who.append(i)
                        start.append(p)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
                yield pa.RecordBatch.from_arrays([s.column("k").take(pa.array(who, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["k", "start", "length", "ids_crc32", "doc_tokens"])

    from tidemark.llm.common import materialize

    pieces = materialize(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(cut, cut_schema), "pieces")
    full, tails = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    shards = max(1, -(-tails.count() // shard))

    def place(t: pa.Table) -> pa.Table:
        bins, offset = pack(t.column("length").to_numpy(), window)
        own = t.column("shard")[0].as_py()
        return t.select(["k", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array((own << 40) + bins * 2 + 1)).append_column("offset", pa.array(offset))

    dealt = tails.withColumn("shard", F.pmod(F.xxhash64("k", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInArrow(place, cut_schema + ", sequence_id long, offset long")
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    return alone.unionByName(placed).withColumnRenamed("k", key)
