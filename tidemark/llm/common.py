"""Helpers shared by the text operators: shared-folder tables, Arrow slices, rolling hashes and Bloom filters.

Everything that runs inside a task works on Arrow batches cut into slices of bounded size, so that a task's
memory doesn't depend on how many rows it gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import materialize  # noqa: F401  (the operators take it from here)

SLICE_BYTES = 2 << 20


def bucket_of(col: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n: the folds by which labelled rows are split. Null stays null."""
    return F.crc32(col.cast("string")) % n


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about limit bytes; one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after the other, and where each begins (one more at the end). Null: empty."""
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "").cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, at - at[0]


def flat_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each begins."""
    texts = [t or "" for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        _powers[:] = [powers(1 << max(16, int(n).bit_length()))]
    a, b = _powers[0]
    return a[:n], b[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h, so that (h[j] - h[i]) * base**-i is the polynomial hash of data[i:j]."""
    p, _ = _powers_to(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans start:end of what prefix_hash() was given, mixed."""
    _, inv = _powers_to(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * _M2)


# Bloom filters


def bloom_bits(n: int, bits_per_row: int = 10, most: int = 1 << 26) -> int:
    """A power of two; past most bits the filter lets more rows through, and stays as large."""
    return min(most, 1 << max(10, (max(1, n) * bits_per_row - 1).bit_length()))


def bloom_cells(h: np.ndarray, bits: int, k: int = 2) -> list[np.ndarray]:
    x = h.view(np.uint64) if h.dtype == np.int64 else h
    a, b = mix(x), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64) for i in range(k)]


def bloom_has(filter_bytes: np.ndarray, bits: int, h: np.ndarray, k: int = 2) -> np.ndarray:
    out = np.ones(len(h), bool)
    for c in bloom_cells(h, bits, k):
        out &= (filter_bytes[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return out


def bloom_of(df: DataFrame, column: str, n: int | None = None, most: int = 1 << 26) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column of longs, at most `most` bits: tasks set bits, words are or-ed by word before they reach the driver."""
    bits = bloom_bits(df.count() if n is None else n, most=most)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for c in bloom_cells(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(own, c >> 3, np.left_shift(1, c & 7).astype(np.uint8))
        w = own.view(np.int64)
        at = np.flatnonzero(w)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)].astype(np.int32)), pa.array(w[at[i : i + (1 << 16)]])], ["word", "bits"])

    got = df.select(F.col(column).cast("long")).dropna().mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8), bits


def plus(df: DataFrame, columns: dict[str, str]) -> T.StructType:
    """df's schema and more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.StructType.fromDDL(f"x {v}")[0].dataType) for k, v in columns.items())])


def column_name(df: DataFrame, wanted: str) -> str:
    """A name that df doesn't have yet."""
    while wanted in df.columns:
        wanted += "_"
    return wanted
