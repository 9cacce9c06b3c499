"""Growth, margins and trailing sums of reports told apart by identity: periods of one identity only, or a reason.

Single quarters of an identity form runs of consecutive periods (gaps and islands). A trailing sum stands at the fourth
and later quarters of a run, with the quarters it draws on; elsewhere the oldest quarter that is lacking is named by the
first part of the identity in which all rows of that period differ, or as missing. Each step is one exchange by entity
and date; periods meet by equality of their numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pit

BY = ("as_of", "code")
PARTS = tuple(pit.MISMATCHES)


def quarter_series(known: DataFrame, value: str, by: Sequence[str] = BY, key: Sequence[str] = ("report_type", "available", "update_flag")) -> DataFrame:
    """Single quarters of each report, whose duration is that of a single quarter where they are known, else UNKNOWN."""
    rows = pit.quarters_by_identity(known, value, by, key)
    return rows.withColumn("duration", F.when(F.col("reason").isNull(), "SINGLE_QUARTER").otherwise("UNKNOWN"))


def growth_by_identity(series: DataFrame, lag: int, by: Sequence[str] = BY, key: Sequence[str] = ("report_type",)) -> DataFrame:
    """Guarded growth of single quarters against the quarter of the same identity `lag` quarters before, or the first reason."""
    rows = pit.match_comparable(series.withColumn("own_reason", F.col("reason")), "quarter_value", lag, by, [*key, "own_reason"])
    return rows.drop("own_reason")


def margin(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    """A margin, and why there is none: a value that is missing, a denominator of zero or below it."""
    why = F.when(numerator.isNull() | denominator.isNull(), "missing_value").when(denominator == 0, "invalid_denominator").when(denominator < 0, "negative_denominator")
    return F.when(why.isNull(), numerator / denominator), why


def margin_by_identity(known: DataFrame, numerator: str, denominator: str, lag: int = 4, by: Sequence[str] = BY, key: Sequence[str] = ("report_type",)) -> DataFrame:
    """Each report's margin, and its change against the report of the same identity `lag` quarters before, each with its reason.

    A margin's own reason comes before that of its identity. A change needs a match; then the present margin's reason
    comes before the other's.
    """
    keep = [*by, "pn", *PARTS, *key, numerator, denominator]
    best = pit._explained(known.select(*keep), F.col("pn") - lag, keep, by, [numerator, denominator])
    own, why = margin(F.col(numerator), F.col(denominator))
    then, then_why = margin(F.col("other")[numerator], F.col("other")[denominator])
    unknown = pit.unknown_part()
    change_reason = F.coalesce(unknown, pit._mismatch(F.col("matched"), "missing_comparable_period"), why, then_why)
    reason = F.coalesce(why, unknown)
    out = best.withColumns({"margin_reason": reason, "margin": F.when(reason.isNull(), own), "change_reason": change_reason, "margin_change": F.when(change_reason.isNull(), own - then)})
    return out.drop("other", "matched")


def chosen_quarters(series: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row for each known quarter of an identity: of its latest versions the value, unknown if they differ."""
    ids = [*by, *PARTS, "pn"]
    flag = F.coalesce(F.col("update_flag").try_cast("double"), F.lit(-1.0))
    each = series.where("reason is null").groupBy(*ids, F.struct("available", flag.alias("flag")).alias("rank")).agg(F.count_distinct("quarter_value").alias("n"), F.max("quarter_value").alias("x"))
    best = each.groupBy(*ids).agg(F.max_by(F.struct("n", "x", "rank"), "rank").alias("b"))
    return best.select(*ids, F.when(F.col("b.n") == 1, F.col("b.x")).alias("x"), F.col("b.rank.available").alias("_day"))


def trailing_by_identity(series: DataFrame, periods: int = 4, by: Sequence[str] = BY) -> DataFrame:
    """series with the sum of the `periods` consecutive quarters of one identity that end at a row, or the first reason.

    run says how many consecutive quarters of the identity end at the row; source_quarters and availability_dates tell what
    a sum draws on. Reasons: the row's own quarter isn't known (its duration), then of the oldest quarter that is lacking
    the first part of the identity in which that period's rows all differ, or missing_quarter. Versions of one rank that
    differ are a missing quarter.
    """
    ids = [*by, *PARTS]
    one = chosen_quarters(series, by)
    w = Window.partitionBy(*ids).orderBy("pn")
    lacking = F.coalesce(*[F.when(F.count("x").over(w.rangeBetween(-k, -k)) == 0, F.lit(k)) for k in range(periods - 1, -1, -1)])
    there = F.collect_list(F.when(F.col("x").isNotNull(), F.struct("pn", "_day"))).over(w.rangeBetween(1 - periods, 0))
    rows = one.withColumns({"lacking": lacking, "_sum": F.sum("x").over(w.rangeBetween(1 - periods, 0)), "_there": there})
    # islands: consecutive periods have one difference of period and position
    known = rows.where("x is not null").withColumn("_island", F.col("pn") - F.row_number().over(w))
    run = known.withColumn("run", F.row_number().over(Window.partitionBy(*ids, "_island").orderBy("pn"))).select(*ids, "pn", "run", "lacking", "_sum", "_there")
    rows = run.unionByName(rows.where("x is null").select(*ids, "pn", F.lit(0).alias("run"), "lacking", "_sum", "_there"))
    # of quarters that are lacking: how far the period's rows agree with the identity
    pool = series.select(*[F.col(c).alias("_" + c) for c in by], F.col("pn").alias("_pn"), *[F.col(c).alias("_" + c) for c in PARTS]).distinct()
    probe = rows.where("lacking is not null").withColumn("_target", F.col("pn") - F.col("lacking"))
    same = F.col("_target") == F.col("_pn")
    for c in by:
        same = same & (F.col(c) == F.col("_" + c))
    alike = F.lit(0)
    for i in range(len(PARTS), 0, -1):
        fits = F.lit(True)
        for c in PARTS[:i]:
            fits = fits & F.col(c).eqNullSafe(F.col("_" + c))
        alike = F.when(fits, F.greatest(F.lit(i), alike)).otherwise(alike)
    level = probe.join(pool, same, "left").groupBy(*ids, "pn").agg(F.max(F.when(F.col("_pn").isNotNull(), alike)).alias("matched"))
    why = level.select(*ids, "pn", F.coalesce(pit._mismatch(F.col("matched"), "missing_quarter"), F.lit("missing_quarter")).alias("_why"))
    rows = rows.join(why, [*ids, "pn"], "left")
    full = F.col("_sum").isNotNull() & F.col("lacking").isNull()
    days = F.array_distinct(F.transform(F.col("_there._day"), lambda d: F.date_format(d, "yyyyMMdd")))
    found = rows.select(
        *ids, "pn", "run", F.when(full, F.col("_sum")).alias("ttm"), "_why",
        F.when(full, F.array_join(F.col("_there.pn").cast("array<string>"), "|")).alias("source_quarters"), F.when(full, F.array_join(days, "|")).alias("availability_dates"),
    )
    out = series.join(found, [*ids, "pn"], "left")
    return out.withColumn("ttm_reason", F.coalesce(pit.unknown_part(), F.col("_why"))).withColumn("run", F.coalesce("run", F.lit(0))).drop("_why")
