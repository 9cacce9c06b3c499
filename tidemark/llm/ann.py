"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are projected on a few random directions, shifted, and ordered along a Hilbert curve; each curve has its own
directions and shift. Every curve is cut into WINDOWS ranges of equal size. A query is compared with all vectors of
its own window and of the two beside it; the best of all curves are merged. A window's size is a fixed share of the
table, so that recall is the same at every size; windows are worked on in blocks of bounded size. Equal vectors are
searched once: each stands for its rows, of which only the `top` + 1 smallest vec_ids can be among a query's neighbours.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most; rows repeated with one vec_id count once (the smallest vector); ties go to the smaller
vec_id; with fewer candidates than `top` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

CURVES, WINDOWS, DIMENSIONS, BITS = 14, 24, 6, 8
BLOCK = 4096
#: A vector's rows are cut to the smallest vec_ids in so many parts first, so that no task gets all rows of one vector.
PARTS = 16


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions along a Hilbert curve of integer points with `bits` bits a coordinate."""
    x = x.astype(np.uint64).copy()
    n, one = x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0]) ^ swap
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[:, -1] >> np.uint64(b)) & one != 0, turn ^ np.uint64((1 << b) - 1), turn)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def curve_keys(v: np.ndarray, scale: float, curves: int) -> np.ndarray:
    """Keys of each vector on each curve."""
    out = np.zeros((len(v), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng(1000 + c)
        d = min(DIMENSIONS, v.shape[1])
        axes, _ = np.linalg.qr(rng.normal(size=(v.shape[1], d)))
        z = v @ axes / (6 * scale) + 0.5 + rng.uniform(-0.1, 0.1, d)
        out[:, c] = hilbert(np.clip(z * (1 << BITS), 0, (1 << BITS) - 1), BITS)
    return out


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before it exchanges them."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def _joined(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """A join by sorting. Spark guesses sizes from compressed files, of which a row may become many: a side that looks small may not fit the driver."""
    return left.join(right.hint("merge"), on, how)


def best_of(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the n candidates with the largest inner product for each query, ties to the smaller id."""
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    longest = np.sqrt((c * c).sum(1).max()) if len(c) else 0.0
    for i in range(0, len(qi) if len(ci) else 0, 512):
        x = q[i : i + 512]
        s = x @ c.T
        if s.shape[1] > n:
            # products of matrices are rounded otherwise than the scores: whatever may reach the n-th is scored again
            slack = 4 * x.shape[1] * np.finfo(np.float64).eps * longest * np.sqrt((x * x).sum(1))
            rows, cols = np.nonzero(~(s < (-np.partition(-s, n - 1, 1)[:, n - 1] - slack)[:, None]))
        else:
            rows, cols = (z.ravel() for z in np.indices(s.shape))
        score = np.concatenate([(x[rows[j : j + 65536]] * c[cols[j : j + 65536]]).sum(1) for j in range(0, len(rows), 65536)])
        order = np.lexsort((ci[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
        out.append((qi[i : i + 512][rows[ok]], ci[cols[ok]], score[ok]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def neighbours(table: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", top: int = 20, curves: int = CURVES, windows: int = WINDOWS) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` rows with the largest inner product for each row where is_query holds (an expression over `key`)."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = table.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(sound.where(fine).groupBy(key).agg(F.min("v").alias("v")).withColumn("q", F.expr(is_query)), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return empty
    # a row ahead of which are `top` other vectors has `top` rows ahead; one more, since a query isn't its own neighbour
    most = top + 1
    d, scale = sizes[0]["d"], max(1e-30, (sizes[0]["s"] / sizes[0]["n"] / sizes[0]["d"]) ** 0.5)

    whole = rows.where(F.size("v") == d).withColumn("q", F.coalesce("q", F.lit(False)))
    groups = materialize(whole.groupBy("v").agg(F.min(key).alias(key), F.bool_or("q").alias("q"), F.count("*").alias("n")), "distinct")
    several = groups.where("n > 1").select("v", F.col(key).alias("same"))
    members = materialize(_joined(whole, several, "v", "left").select(key, "q", "same"), "copies")
    copies = members.where("same is not null").select("same", key, F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part"))
    copies = _first(_first(copies, ["same", "part"], [key], most), ["same"], [key], most)
    # at most `most` each; written, so that a join can split the rows that meet a vector found by many
    copies = materialize(copies.groupBy("same").agg(F.collect_list(key).alias("ids")), "alike")
    rows = groups

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = curve_keys(_matrix(b.column("v"), d), scale, curves)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("q"), pa.ListArray.from_arrays(np.arange(0, k.size + 1, curves, dtype=np.int32), pa.array(k.ravel()))], [key, "q", "keys"])

    keyed = rows.select(key, "q", "v").mapInArrow(order, f"{key} long, q boolean, keys array<long>")
    placed = keyed.select(key, "q", F.posexplode("keys").alias("curve", "k"))
    placed = materialize(placed, "curves")
    share = [i / windows for i in range(1, windows)]
    cuts = {r["curve"]: list(dict.fromkeys(r["cuts"])) for r in placed.groupBy("curve").agg(F.percentile_approx("k", share, 20_000).alias("cuts")).collect()}  # curves * windows numbers
    # equal keys share a window: it may hold more than its share, and then has more blocks
    cut_of = F.create_map(*[x for c, v in cuts.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in v]))])
    window = F.size(F.filter(cut_of[F.col("curve")], lambda y: y < F.col("k"))).alias("w")
    placed = materialize(placed.select(key, "q", "curve", window), "windows")
    filled = {(r["curve"], r["w"]): (r["n"], r["m"]) for r in placed.groupBy("curve", "w").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("m")).collect()}
    rows_of = spark.sparkContext.broadcast({c: (-(-n // BLOCK), -(-max(1, m) // BLOCK)) for c, (n, m) in filled.items()})  # curves * windows entries

    near = [-1, 0, 1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A candidate goes to one block of its window, once for each block of queries; a query to all blocks of three windows."""
        blocks = rows_of.value
        for b in batches:
            out: list[tuple] = []
            for i, q, c, w in zip(*(b.column(x).to_pylist() for x in (key, "q", "curve", "w")), strict=True):
                mine = blocks[c, w]
                own = i * 0x9E3779B1 >> 8
                for o in near:
                    if other := blocks.get((c, w + o)):
                        # queries of window w + o meet candidates of window w
                        out += [(c, w + o, w, own % mine[0], j, i, False) for j in range(other[1])]
                        if q:
                            out += [(c, w, w + o, j, own % mine[1], i, True) for j in range(other[0])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())], ["curve", "wq", "wc", "bc", "bq", key, "ask"])

    dealt = _joined(placed.mapInArrow(deal, f"curve int, wq int, wc int, bc int, bq int, {key} long, ask boolean"), rows.select(key, "v"), key)

    def best(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ask = t.column("ask").to_numpy()
        ids, x = t.column(key).to_numpy(), _matrix(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"), d)
        a, b, s = best_of(ids[ask], x[ask], ids[~ask], x[~ask], most)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    found = dealt.groupBy("curve", "wq", "wc", "bc", "bq").applyInArrow(best, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = _first(merged, ["query_id"], [F.desc("score"), "vec_id"], most)
    ids = F.explode(F.coalesce("ids", F.array("vec_id")))
    spread = _joined(merged, copies, merged["vec_id"] == copies["same"], "left").select("query_id", (-F.col("score")).alias("s"), ids.alias("i"))
    lists = spread.groupBy(F.col("query_id").alias("same")).agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "i"))), 1, most).alias("list"))  # from most * most entries
    lists = materialize(lists, "lists")
    asked = members.where("q").select(F.col(key).alias("query_id"), F.coalesce("same", key).alias("same"))
    own = F.slice(F.filter("list", lambda x: x["i"] != F.col("query_id")), 1, top)
    out = _joined(asked, lists, "same").select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
