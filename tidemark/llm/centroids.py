"""Centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors become integers, and are turned once into their exact integer Walsh-Hadamard coefficients, ordered by sequency,
coarse to fine. The transform keeps distances but for a factor, the number of components, so that sums of squared
differences over the first coefficients are lower bounds. A search adds up coefficients from coarse to fine for all
centroids, finishes the one that leads after the first eight, drops those whose bound is strictly worse than that, and
finishes the others; ties go to the smaller number. All arithmetic is on integers.

Each round is one pass over the written coefficients, in which tasks add up their own vectors by cluster; the driver gets
the sums of k centroids only.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; no vectors
give an empty result; fewer vectors than k give that many clusters. Repeated ids are vectors of their own (seeds tie by
their components); a null id is kept, but is no seed. Other columns are kept, but for those named like a result column.
The table holds no texts. Components of 2**52 and more after scaling fail the job, as do distances beyond a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_name, materialize, plus

#: After how many coefficients centroids are compared with the one that leads.
STEPS = (0, 8, 16, 24, 32, 48, 64)
_ROWS = 4096


def sequency(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of size n by their number of sign changes."""
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    sign = np.bitwise_count(i & j) & 1
    return np.argsort((sign[:, 1:] != sign[:, :-1]).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows in natural order; its own inverse but for a factor, the rows' length."""
    n, step, out = x.shape[1], 1, x
    while step < n:
        a = out.reshape(len(x), n // (2 * step), 2, step)
        out = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return out


def nearest(y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients the nearest row of c, the smaller number if several are, and the squared distance of the coefficients."""
    n, k, size = len(y), len(c), y.shape[1]
    if max(np.abs(y).max(initial=0), np.abs(c).max(initial=0)) >= 1 << 27:  # squares of differences might not fit in 64 bits
        y, c = y.astype(object), c.astype(object)
    row, cen = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, y.dtype)
    steps = [s for s in STEPS if s < size] + [size]
    for lo, hi in pairwise(steps):
        if lo == steps[1]:
            lead = total.reshape(n, k).argmin(1)
            bound = ((y - c[lead]) ** 2).sum(1)
        if lo:
            left = total <= bound[row]
            row, cen, total = row[left], cen[left], total[left]
        total = total + ((y[row, lo:hi] - c[cen, lo:hi]) ** 2).sum(1)
    # rows are in order, and so are the centroids of a row: the first smallest total of each row
    begin = np.searchsorted(row, np.arange(n))
    low = np.minimum.reduceat(total, begin) if n else total
    hit = np.flatnonzero(total == low[row])
    first = hit[np.searchsorted(row[hit], np.arange(n))]
    return cen[first], total[first]


def _whole(col: pa.Array, dim: int) -> np.ndarray:
    """Which vectors have dim components, all there and finite."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(ok)
    values = pc.list_flatten(col.take(pa.array(at))).cast(pa.float64())
    there = values.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False))
    ok[at] = there.reshape(-1, dim).all(1)
    return ok


def coefficients(vectors: DataFrame, vector: str, dim: int, scale: int, name: str) -> DataFrame:
    """vectors' other columns with the coefficients, coarse to fine, of floor(scale * component)."""
    keep = [c for c in vectors.columns if c != vector]
    order = sequency(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array(np.flatnonzero(_whole(b.column(vector), dim)))
            x = pc.list_flatten(b.column(vector).take(rows)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.floor(x * float(scale))
            if np.abs(x).max(initial=0) >= 2.0**52:
                raise OverflowError("a component is too large for exact distances")
            y = np.ascontiguousarray(transform(x.astype(np.int64))[:, order])
            at = pa.array(np.arange(0, y.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in keep), pa.ListArray.from_arrays(at, pa.array(y.ravel()))], [*keep, name])

    return vectors.select(*keep, vector).mapInArrow(run, plus(vectors.select(*keep), {name: "array<long>"}))


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, _ROWS):
            s = b.slice(i, _ROWS)
            yield s, pc.list_flatten(s.column(name)).to_numpy(zero_copy_only=False).reshape(-1, dim)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vectors' other columns with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    dim is a power of two. The first centroids are the k vectors with the smallest sha256 of seed and key; each round
    replaces a centroid that has vectors by the floor of their mean, and vectors are assigned once more at the end.
    """
    made = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    rows = vectors.drop(*[c for c in made if c not in (key, vector)])
    name = column_name(vectors, "coefficients")
    rows = materialize(coefficients(rows, vector, dim, scale, name), "coefficients")
    order = sequency(dim)

    def back(y: list[int]) -> list[int]:
        natural = np.empty(dim, object)
        natural[order] = y
        return [int(x) // dim for x in transform(natural[None, :])[0]]

    seeds = rows.select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("h"), F.col(name).alias("y")).dropna().orderBy("h", "y").limit(k).collect()
    centres = [back([int(x) for x in r["y"]]) for r in seeds]
    if not centres:  # no vectors, or none with an id
        rows = rows.limit(0)

    def coded(centres: list[list[int]]) -> np.ndarray:
        return transform(np.array(centres, np.int64).reshape(-1, dim))[:, order]

    for _ in range(rounds if centres else 0):
        c = coded(centres)

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
            for _, y in _blocks(batches, name, dim):
                label, _ = nearest(y, c)
                for i in np.unique(label).tolist():
                    total[i] += (mine := y[label == i]).sum(0, dtype=np.int64 if np.abs(mine).max() < 1 << 50 else object)
                    count[i] += len(mine)
            own = np.flatnonzero(count)
            flat = [int(v) for i in own.tolist() for v in (count[i], *total[i])]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1), len(own)).astype(np.int32)), pa.array(flat, pa.decimal128(38, 0))], ["c", "at", "total"])

        got: dict[int, dict[int, int]] = {}
        for r in rows.select(name).mapInArrow(sums, "c int, at int, total decimal(38,0)").groupBy("c", "at").agg(F.sum("total").alias("total")).collect():
            got.setdefault(r["c"], {})[r["at"]] = int(r["total"])
        for i, t in got.items():
            centres[i] = [x // t[0] for x in back([t[j + 1] for j in range(dim)])]

    final = coded(centres)
    keep = [x for x in rows.columns if x != name]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, y in _blocks(batches, name, dim):
            at, d = nearest(y, final)
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(at.astype(np.int32)), pa.array([int(v) // dim for v in d], pa.int64())], [*keep, "cluster", "distance"])

    out = materialize(rows.mapInArrow(label, plus(rows.select(*keep), {"cluster": "int", "distance": "long"})), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    one = F.lit(None).cast("long")
    names = F.lit(None).cast("string")
    for i, x in inertia.items():
        one, names = F.when(F.col("cluster") == i, F.lit(x)).otherwise(one), F.when(F.col("cluster") == i, F.lit(sha[i])).otherwise(names)
    return out.withColumns({"cluster_inertia": one.cast("long"), "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": names})
