"""Near duplicates by circulant MinHash.

Two permutations of the shingles' hashes, one of which is shifted round step by step, give all coordinates of a
signature: coordinate k is the least pi(sigma(x) + k) over a text's shingles x. Bands of coordinates put alike texts
into common buckets. Texts with the same set of shingles are one class and take part once.

Not all pairs of a bucket are formed. Each member is compared with the bucket's smallest and largest class (two pairs
a member, however large the bucket); links are confirmed by the exact similarity of the whole sets and joined to
components. Members of a bucket that still holds several components are the rest, which is settled exactly: two sets
alike enough share one of their rarest shingles (prefix filtering), so the rest are joined on those; pairs of one
component, and pairs whose parities show that too many shingles differ, are left out, and the others confirmed. The chance that a linked pair shares no bucket is below `miss`.

Defined cases: null text, empty text or one without words has an empty set and is linked with nothing; with fewer
words than a shingle has, all of them are one shingle; repeated rows are in the same component; rows without a doc_id
come last when the smallest is chosen (their component may be null); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bloom_has, bloom_of, flat_bytes, materialize, mix, prefix_hash, slices, span_hash
from tidemark.llm.components import components

ROWS, PARITY = 6, 16


def shape(threshold: Fraction, miss: float = 1e-6, rows: int = ROWS) -> tuple[int, int]:
    """Bands and rows for which a pair just at the threshold shares no bucket with a chance below miss."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-float(threshold) ** rows))), rows


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    n = len(at) - 1
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1]))
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1
    w = span_hash(prefix_hash(low), start, end)
    words = np.diff(np.searchsorted(start, at))
    begin = np.cumsum(words) - words
    size = np.where(words == 0, 0, np.maximum(1, words - width + 1))
    doc = np.repeat(np.arange(n), size)
    first = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    h = np.full(len(doc), 0x51ED270B, np.uint64)
    last = (begin + words)[doc]
    pad = np.r_[w, np.zeros(width, np.uint64)]
    for i in range(width):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + np.where(first + i < last, pad[first + i], np.uint64(i + 1)))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _pi(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash: sigma is taken once, pi is shifted for each coordinate. Texts with an empty set get 2**32 - 1."""
    out = np.full((len(at) - 1, length), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at) > 0)
    if not len(some):
        return out
    sigma = (mix(h ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)
    step = np.uint32(0x9E3779B1)  # one step round the circle of 2**32 places
    block = max(1, (1 << 16))
    starts = at[some]
    # blocks of whole texts keep what is worked on in the processor's cache
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        lo, hi = starts[i], at[some[j - 1] + 1]
        x, cut = sigma[lo:hi].copy(), starts[i:j] - lo
        for k in range(length):
            out[some[i:j], k] = np.minimum.reduceat(_pi(x), cut)
            x += step
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, whether each of 64 * PARITY groups of hashes holds an odd number of them. Bits that differ between two sets are no more than elements that only one of them has."""
    out = np.zeros((len(at) - 1, PARITY * 64), np.uint8)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_xor.at(out, (doc, (h % np.uint64(PARITY * 64)).astype(np.int64)), 1)
    return np.packbits(out, 1).view(np.int64)


def profile(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, sid (digest of the set), n_shingles and the keys of all bands."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "t"):
                h, at = shingle_sets(*flat_bytes(s.column("t")), width)
                keys = band_keys(signatures(h, at, bands * rows), bands, rows)
                sid = [hashlib.blake2b(h[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(s.num_rows)]
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(sid, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))], ["id", "sid", "n_shingles", "bands"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, sid binary, n_shingles long, bands array<long>")


def sets_of(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, v, odd): the sorted sets and their parities of the wanted sids, read again from the texts of the rows (id, sid) in `wanted`."""
    spark = docs.sparkSession
    own = wanted.withColumn("h", F.xxhash64("id"))
    cells, bits = bloom_of(own, "h")
    sent = spark.sparkContext.broadcast(cells.tobytes())  # at most 8 MB, see bloom_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(bloom_has(own, bits, b.column("h").to_numpy(zero_copy_only=False))))
            for s in slices(b, "t"):
                h, at = shingle_sets(*flat_bytes(s.column("t")), width)
                sid = [hashlib.blake2b(h[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(s.num_rows)]
                odd = parities(h, at)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), s.column("id"), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(np.arange(0, odd.size + 1, PARITY, dtype=np.int32), pa.array(odd.ravel()))], ["sid", "id", "v", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.xxhash64(key).alias("h")).mapInArrow(run, f"sid binary, id {kind}, v array<long>, odd array<long>")
    return found.join(wanted, (found.sid == wanted.sid) & found.id.eqNullSafe(wanted.id), "left_semi").select("sid", "v", "odd").dropDuplicates(["sid"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) whose sets are alike enough."""
    left = sets.select(F.col("sid").alias("a"), F.col("v").alias("va"))
    right = sets.select(F.col("sid").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(right, "b").join(left, "a")
    inner = F.size(F.array_intersect("va", "vb"))
    return both.select("a", "b", inner.alias("i"), (F.size("va") + F.size("vb")).alias("s")).where(threshold.denominator * F.col("i") >= threshold.numerator * (F.col("s") - F.col("i"))).select("a", "b")


def _alike_sizes(x: Column, y: Column, t: Fraction) -> Column:
    return (x * t.denominator >= y * t.numerator) & (y * t.denominator >= x * t.numerator)


def _few_differ(n: Column, t: Fraction, a: str, b: str) -> Column:
    """False only if more elements differ than two sets with n elements together may have at similarity t."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, PARITY)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return differ * (t.numerator + t.denominator) <= n * (t.denominator - t.numerator)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | Fraction = 0.8, width: int = 5, miss: float = 1e-6) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept."""
    t = Fraction(threshold).limit_denominator(1000)
    bands, rows = shape(t, miss)
    prof = materialize(profile(docs, key, text, width, bands, rows), "profile")
    full = prof.where("n_shingles > 0")
    first = F.struct(F.isnull("id").alias("none"), "id")
    rep = materialize(full.groupBy("sid").agg(F.min(first).alias("m"), F.max("n_shingles").alias("n")).select("sid", F.col("m.id").alias("id"), "n"), "classes")
    keyed = full.join(rep.select("sid", "id"), (full.sid == rep.sid) & full.id.eqNullSafe(rep.id), "left_semi").select("sid", F.explode("bands").alias("bucket"))
    span = keyed.groupBy("bucket").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    members = materialize(keyed.join(span, "bucket").distinct(), "members")
    stars = members.select(F.col("lo").alias("a"), F.col("sid").alias("b")).union(members.select(F.col("sid").alias("a"), F.col("hi").alias("b"))).where("a <> b")
    stars = materialize(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    size = rep.select(F.col("sid").alias("a"), F.col("n").alias("na")), rep.select(F.col("sid").alias("b"), F.col("n").alias("nb"))
    stars = stars.join(size[0], "a").join(size[1], "b").where(_alike_sizes(F.col("na"), F.col("nb"), t)).select("a", "b")
    wanted = members.select("sid").distinct().join(rep.select("sid", "id"), "sid")
    sets = materialize(sets_of(docs, key, text, width, materialize(wanted, "wanted")), "sets")
    links = materialize(confirmed(stars, sets, t), "links")
    comp = components(links)

    # buckets that still hold several components
    named = members.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("bucket", "sid", F.coalesce("component", "sid").alias("c"))
    mixed = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    rest = named.join(mixed, "bucket", "left_semi").select("sid", "c").distinct()
    rest = materialize(rest.join(sets.select("sid", "v"), "sid"), "rest")
    tokens = rest.select("sid", "c", F.size("v").alias("n"), F.explode("v").alias("x"))
    rare = tokens.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one text only come first in the order of rarity and can't be shared: the prefix is what is left of it
    lead = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator) + 1
    known = tokens.join(rare, "x").groupBy("sid", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("v"))
    heads = known.select("sid", "c", "n", F.explode(F.slice("v", F.lit(1), F.greatest(F.lit(0), (lead - (F.col("n") - F.size("v"))).cast("int")))).alias("h")).select("sid", "c", "n", "h.x")
    heads = materialize(heads, "heads")
    spread = heads.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("x")
    heads = heads.join(spread, "x", "left_semi").join(sets.select("sid", "odd"), "sid")
    one, two = (heads.select("x", *(F.col(c).alias(c + i) for c in ("sid", "c", "n", "odd"))) for i in "12")
    more = one.join(two, "x").where((F.col("sid1") < F.col("sid2")) & (F.col("c1") != F.col("c2")) & _alike_sizes(F.col("n1"), F.col("n2"), t) & _few_differ(F.col("n1") + F.col("n2"), t, "odd1", "odd2")).select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).distinct()
    extra = materialize(confirmed(more, sets, t), "links")
    if extra.limit(1).count():
        comp = components(links.union(extra))

    least = F.min(F.struct(F.isnull("id").alias("none"), "id"))
    owner = rep.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "id", F.coalesce("component", "sid").alias("c"))
    owner = owner.join(owner.groupBy("c").agg(least.alias("m")), "c").select("sid", F.col("m.id").alias("component_id"))
    whole = prof.select("id", "n_shingles", "sid").join(owner, "sid", "left")
    out = whole.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
