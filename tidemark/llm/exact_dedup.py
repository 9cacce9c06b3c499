"""Exact duplicates by two passes over a Bloom filter.

The first pass sets, for each text's hash, cells that have been hit once or more than once; every task fills cells of
its own and segments of them are merged in Spark. The second pass asks the cells hit more than once: rows whose hash
can't have been seen twice go straight through, and only the others shuffle, by the digest of their text. False
positives cost a shuffle, never a result. The filter has a largest size; beyond it more rows shuffle.

Defined cases: null text is an empty text, and all empty texts are equal; of equal texts the smallest doc_id stays, a
null doc_id last, and of rows repeated with the same doc_id exactly one; an empty table gives an empty result. Other
columns of the input are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bloom_bits, bloom_cells, bloom_has, materialize

SEGMENT = 1 << 15  # bytes of a segment
MOST_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _merge(once: np.ndarray, twice: np.ndarray, parts: Iterator[tuple[bytes, bytes]]) -> None:
    for a, b in parts:
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        twice |= b | (once & a)
        once |= a


def repeated_filter(hashes: DataFrame, n: int, most: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """Cells hit more than once by a column of hashes, as a filter of at most `most` bits."""
    bits = bloom_bits(n, 8, most)
    size = min(SEGMENT, bits // 8)
    schema = "segment int, salt int, once binary, twice binary"

    def emit(once: np.ndarray, twice: np.ndarray, at: int, salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "salt", "once", "twice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            cells = np.stack(bloom_cells(h, bits), 1)
            hit, count = np.unique(np.concatenate([cells[:, 0], cells[cells[:, 1] != cells[:, 0], 1]]), return_counts=True)
            for at, only in ((hit, False), (hit[count > 1], True)):
                new = np.zeros(bits // 8, np.uint8)
                np.bitwise_or.at(new, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
                if only:
                    twice |= new
                else:
                    twice |= new & once
                    once |= new
        salt = TaskContext.get().partitionId() % 32
        for i in range(0, bits // 8, size):
            if once[i : i + size].any():
                yield emit(once[i : i + size], twice[i : i + size], i // size, salt)

    def merge(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        _merge(once, twice, zip(t.column("once").to_pylist(), t.column("twice").to_pylist(), strict=True))
        return pa.Table.from_batches([emit(once, twice, t.column("segment")[0].as_py(), 0)])

    parts = hashes.mapInArrow(fill, schema)
    parts = parts.groupBy("segment", "salt").applyInArrow(merge, schema).groupBy("segment").applyInArrow(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.select("segment", "twice").toLocalIterator():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out, bits


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, keep_text: bool = False) -> DataFrame:
    """docs' columns (without the text, unless keep_text) with keep_id, group_size, kept and text_sha256."""
    made = ("keep_id", "group_size", "kept", "text_sha256")
    keep = [c for c in docs.columns if c not in made and (keep_text or c != text)]
    norm = normalised(F.col(text))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(key).alias("id"), F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("h"))
    rows = materialize(rows, "digests").withColumn("uid", F.monotonically_increasing_id())
    n = rows.count()
    cells, bits = repeated_filter(rows.select("h"), n, most_bits)
    sent = rows.sparkSession.sparkContext.broadcast(cells.tobytes())  # at most most_bits / 8 bytes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            yield b.append_column("again", pa.array(bloom_has(own, bits, b.column("h").to_numpy(zero_copy_only=False))))

    asked = rows.mapInArrow(ask, T.StructType([*rows.schema.fields, T.StructField("again", T.BooleanType())]))
    again = asked.where("again")
    order = F.struct(F.isnull("id").alias("none"), "id", "uid")
    # written, so that both sides of the join are dealt by Spark for the join alone, which then splits the rows of a large group
    best = materialize(again.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("size")), "groups")
    found = again.join(best, "sha").select("row", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.uid") == F.col("uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = asked.where(~F.col("again")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(found).select("row.*", *made)
