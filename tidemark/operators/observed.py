"""Observations of reports told apart by identity: levels, growth, trailing sums and margins of several series in one pass.

Series are rows, not columns: a report becomes one row for each of its values, and the series is one more key of every
join and window, so that the number of exchanges doesn't grow with the number of series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pit, trailing

BY = ("as_of", "code")
#: What tells an identity's observations apart, beside its entity, date and period.
IDENTITY = ("report_type", *trailing.PARTS)
DIGITS = 6


def series_rows(reports: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row for each report and value, as `series` and `value`; the other columns stay."""
    others = [c for c in reports.columns if c not in values]
    return reports.select(*others, F.inline(F.array(*[F.struct(F.lit(x).alias("series"), F.col(x).alias("value")) for x in values])))


def quarter_rows(reports: DataFrame, values: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Single quarters of all series; several metrics read them, so that a caller may want to write them."""
    return trailing.quarter_series(series_rows(reports, values), "value", [*by, "series"])


def observations(quarters: DataFrame, reports: DataFrame, numerator: str, denominator: str, by: Sequence[str] = BY) -> DataFrame:
    """One row for each identity's period, series and metric, with a value or the reason why there is none.

    quarters come from quarter_rows(). Metrics are level, yoy, qoq and ttm of single quarters, and margin and
    margin_change of reports, which stand under the numerator's series. Values are rounded to six digits. Rows of one
    identity and period that differ are an ambiguous_observation.
    """
    keyed = [*by, "series"]
    ids = [*keyed, "pn", *IDENTITY]

    def named(rows: DataFrame, metric: str, value: str, reason: str) -> DataFrame:
        return rows.select(*ids, F.lit(metric).alias("metric"), F.round(value, DIGITS).alias("value"), F.col(reason).alias("reason"))

    margins = trailing.margin_by_identity(reports, numerator, denominator, by=by).withColumn("series", F.lit(numerator))
    parts = [named(quarters, "level", "quarter_value", "reason"), *[named(trailing.growth_by_identity(quarters, lag, keyed), name, "growth", "reason") for name, lag in (("yoy", 4), ("qoq", 1))]]
    parts += [named(trailing.trailing_by_identity(quarters, by=keyed), "ttm", "ttm", "ttm_reason"), named(margins, "margin", "margin", "margin_reason"), named(margins, "margin_change", "margin_change", "change_reason")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy(*ids, "metric").agg(F.min("value").alias("least"), F.max("value").alias("value"), F.min("reason").alias("reason"))
    differ = F.col("least") != F.col("value")
    reason = F.when(differ, "ambiguous_observation").when(F.col("value").isNull(), F.col("reason"))
    return one.select(*ids, "metric", F.when(~differ, F.col("value")).alias("value"), reason.alias("reason"))


def trends(obs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each identity's series and metric at its latest known value: change, acceleration, length of the run and direction.

    Changes are those between consecutive periods; after a gap there is none. n counts the known values.
    """
    keys = [*by, "series", "metric", *IDENTITY]
    known = obs.where("value is not null").drop("reason")
    counts = known.groupBy(*keys).agg(F.count("*").alias("n"))
    last = pit.latest(pit.trend(known, "value", keys), keys, "pn").drop("nth")
    same = [last[k].eqNullSafe(counts[k]) for k in keys]
    way = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").when(F.col("change") == 0, "flat").otherwise("unknown")
    return last.join(counts, same).select(*[last[k] for k in keys], "pn", "n", "value", "change", "acceleration", F.col("run_length").cast("long").alias("length"), way.alias("direction"))


def latest_group(obs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each feature of an entity at its latest period, if one identity alone tells of it; else ambiguous_period_chain."""
    keys = [*by, "series", "metric"]
    per = obs.groupBy(*keys, "pn").agg(F.count("*").alias("told"), F.max("value").alias("value"), F.min("reason").alias("reason"))
    last = per.groupBy(*keys).agg(F.max_by(F.struct("pn", "told", "value", "reason"), "pn").alias("x")).select(*keys, "x.*")
    one = F.col("told") == 1
    return last.select(*keys, "pn", F.when(one, F.col("value")).alias("value"), F.when(one, F.col("reason")).otherwise("ambiguous_period_chain").alias("reason"))
