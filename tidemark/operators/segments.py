"""Figures of many overlapping segments in one pass, with exact quantiles that hold no segment's values together.

Rows are turned once into a row for each dimension. Counts, means, spreads and extremes are moments that tasks add up by
themselves. Quantiles are found in two steps: a histogram of each segment says in which of its bins an order statistic
lies, and of these bins alone the distinct values are counted and put in order. However large a segment, no task holds
more of it than the distinct values of one bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def by_dimension(rows: DataFrame, dims: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """A row for each dimension and one for none (dim 'overall', seg null), with seg as text."""
    cuts = [F.struct(F.lit("overall").alias("dim"), F.lit(None).cast("string").alias("seg")), *[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("seg")) for d, c in dims.items()]]
    return rows.select(*keep, F.inline(F.array(*cuts)))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], bins: int = BINS) -> DataFrame:
    """by, and q, an array of the quantiles at `at` of each group's known values, interpolated between order statistics.

    Null is a value of a key; groups without a known value are left out; nan counts as unknown.
    """
    x = F.col(value).cast("double")
    known = rows.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    # a group is named by one value, so that null keys meet
    known = known.withColumn("_g", F.to_json(F.struct(*by)))
    span = known.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first(F.struct(*by)).alias("_by"))
    width = F.col("_hi") - F.col("_lo")
    bin_of = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / width * bins))).otherwise(0)
    binned = known.select("_g", "_x").join(span, "_g").select("_g", "_x", "_n", bin_of.alias("_bin"))
    hist = binned.groupBy("_g", "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    w = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1))) for q in at])))
    upto = hist.withColumn("_upto", F.sum("_c").over(w))
    wanted = upto.withColumn("_before", F.col("_upto") - F.col("_c")).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))).where(F.size("_ranks") > 0)
    inside = binned.select("_g", "_bin", "_x").join(wanted.select("_g", "_bin", "_before", "_ranks"), ["_g", "_bin"]).groupBy("_g", "_bin", "_x").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    v = Window.partitionBy("_g", "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(v))
    hit = placed.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))))).select("_g", "_r", "_x")
    found = hit.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))  # two entries for each of `at` at most
    out = []
    for q in at:
        place = q * (F.col("_n") - 1)
        low, high = F.element_at("_m", F.floor(place)), F.element_at("_m", F.ceil(place))
        out.append(low + (high - low) * (place - F.floor(place)))
    return span.join(found, "_g").select("_by.*", F.array(*out).alias("q"))


def segment_figures(rows: DataFrame, by: Sequence[str], value: str, excess: str, bins: int = BINS) -> DataFrame:
    """Rows and known values of each group, coverage, mean, median, share above zero, spread and quartile range (of two values or more), extremes and mean excess."""
    x = F.col(value)
    two = F.count(x) >= 2
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(x).alias("observed"), (F.count(x) / F.count("*")).alias("coverage"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("hit"), F.when(two, F.stddev_pop(x)).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(excess).alias("mean_excess"))
    q = quantiles(rows, by, value, (0.25, 0.5, 0.75), bins)
    same = None
    for c in by:
        eq = F.col("s." + c).eqNullSafe(F.col("q." + c))
        same = eq if same is None else same & eq
    both = sums.alias("s").join(q.alias("q"), same, "left")
    return both.select("s.*", F.col("q.q")[1].alias("median"), F.when(F.col("s.observed") >= 2, F.col("q.q")[2] - F.col("q.q")[0]).alias("iqr"))
