"""Selection of what was knowable on each date, and arithmetic on comparable periods.

All operators work on every entity and every as-of date at once. A version of a fact is current from the day it became
available until the day of the next version, so that facts are sorted once, whatever the number of as-of dates, and
meet the dates by the years in which they are current. The as-of table holds a date for each session at most; whether
it is broadcast is left to Spark's check of its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import growth


def versions(facts: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str | Column] = ()) -> DataFrame:
    """Each version with `until`, the day from which a later one replaces it; versions replaced on their own day go.

    Null is a value of a key. Of versions of one day the last by `ties` stays, nulls being first.
    """
    w = Window.partitionBy(*keys).orderBy(available, *ties)
    return facts.where(F.col(available).isNotNull()).withColumn("until", F.lead(available).over(w)).where(F.col("until").isNull() | (F.col("until") > F.col(available)))


def current_on(rows: DataFrame, dates: DataFrame, available: str) -> DataFrame:
    """Rows for each as-of date from their day on and before `until` (null: for ever)."""
    last = dates.agg(F.max(F.year("as_of"))).scalar()
    years = F.sequence(F.year(available), F.greatest(F.year(available), F.coalesce(F.year("until"), last)))
    v = rows.withColumn("in_year", F.explode(years))
    dated = dates.withColumn("in_year", F.year("as_of"))
    return dated.join(v, (dated["in_year"] == v["in_year"]) & (F.col(available) <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until")))).drop("until", "in_year")


def as_of(facts: DataFrame, dates: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str | Column] = ()) -> DataFrame:
    """For each as-of date, the latest version available on it of each key.

    Versions meet the dates of the years that they are current in, so that the join is one by equality.
    """
    return current_on(versions(facts, keys, available, ties), dates, available)


#: What tells simultaneous reports apart; a column that a table hasn't is left out.
IDENTITY = ("report_family", "statement_type", "duration", "scope", "unit", "accounting", "report_type", "type", "comp_type", "end_type", "bz_item", "curr_type")
#: The order in which a period that doesn't match is explained.
MISMATCHES = {"duration": "period_semantics_mismatch", "report_family": "report_family_mismatch", "statement_type": "statement_type_mismatch", "scope": "scope_mismatch", "unit": "unit_mismatch", "accounting": "accounting_semantics_mismatch"}


def as_of_identity(facts: DataFrame, dates: DataFrame, entity: str = "code", period: str = "end_date", available: str = "available", notice: str = "notice", flag: str = "update_flag", arrival: str = "ord") -> DataFrame:
    """For each as-of date, the latest version of each report.

    A report is an entity's period with all columns of IDENTITY that the table has. Later versions are those available
    later, then announced later, then with the larger number as update flag (none: -1), then those that arrived later.
    """
    keys = [entity, period, *(c for c in IDENTITY if c in facts.columns)]
    rank = F.coalesce(F.col(flag).try_cast("double"), F.lit(-1.0))
    return as_of(facts.where(F.col(period).isNotNull()), dates, keys, available, [F.col(notice).asc_nulls_first(), rank, F.col(arrival)])


def _explained(rows: DataFrame, target: Column, keep: Sequence[str], by: Sequence[str], candidates: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """rows with the row at `target` (a period number) that has the same identity, as `other`, and `matched`: null where the period is missing, else how many identity columns some row of it has alike, in the order of MISMATCHES. The other rows are those of `among`, if it is given."""
    names = list(MISMATCHES)
    pool = (rows if among is None else among).select(*(F.col(c).alias("_" + c) for c in by), F.col("pn").alias("_pn"), F.struct(*names, *candidates).alias("_c"))
    same = F.col("_target") == F.col("_pn")
    for c in by:
        same = same & (F.col(c) == F.col("_" + c))
    both = rows.withColumn("_target", target).join(pool, same, "left")
    alike = F.lit(0)
    for i in range(len(names), 0, -1):
        all_alike = F.lit(True)
        for n in names[:i]:
            all_alike = all_alike & F.col(n).eqNullSafe(F.col("_c")[n])
        alike = F.when(all_alike, F.greatest(F.lit(i), alike)).otherwise(alike)
    alike = F.when(F.col("_c").isNotNull(), alike)
    best = both.groupBy(*keep).agg(F.max(alike).alias("matched"), F.max(F.when(alike == len(names), F.struct(*[F.col("_c")[c].alias(c) for c in candidates]))).alias("other"))
    return best


def _mismatch(matched: Column, missing: str) -> Column:
    out = F.when(matched.isNull(), missing)
    for i, why in enumerate(MISMATCHES.values()):
        out = out.when(matched == i, why)
    return out


#: What is said of a part of the identity that isn't known, the first one counts.
UNKNOWN_PARTS = {"duration": "unsupported_duration_semantics", "report_family": "unsupported_report_family", "statement_type": "unsupported_statement_type", "scope": "unknown_scope", "unit": "unknown_unit", "accounting": "unknown_accounting_semantics"}


def unknown_part() -> Column:
    return F.coalesce(*[F.when(F.col(c).isNull() | (F.col(c) == "UNKNOWN"), why) for c, why in UNKNOWN_PARTS.items()])


def match_comparable(known: DataFrame, value: str, lag: int, by: Sequence[str] = ("as_of", "code"), key: Sequence[str] = ("report_type",)) -> DataFrame:
    """Each row's comparable period `lag` quarters before, by entity and identity, with guarded growth and the first reason against it.

    Reasons, in this order: a part of the identity that isn't known, quarterly comparison of sums that run from the year's
    start, no such period, the first identity column by which all of its rows differ, a missing value, and those of growth.
    """
    keep = [*by, "pn", *MISMATCHES, *key, value]
    rows = known.select(*keep)
    best = _explained(rows, F.col("pn") - lag, keep, by, [value])
    refused = F.when((F.col("duration") == "CUMULATIVE_YTD") & F.lit(lag == 1), "qoq_requires_validated_single_quarter")
    base = F.col("other")[value]
    g, why = growth(F.col(value), base)
    before = F.coalesce(unknown_part(), refused, _mismatch(F.col("matched"), "missing_comparable_period"))
    return best.withColumn("reason", F.coalesce(before, why)).withColumn("growth", F.when(F.col("reason").isNull(), g)).withColumn("base", F.when(before.isNull(), base)).drop("other", "matched")


def quarters_by_identity(known: DataFrame, value: str, by: Sequence[str] = ("as_of", "code"), key: Sequence[str] = ("report_type",)) -> DataFrame:
    """Single quarters within one identity and year: a sum less the one a quarter before; single quarters pass; else a reason, and the periods drawn on."""
    keep = [*by, "pn", *MISMATCHES, *key, value]
    best = _explained(known.select(*keep), F.col("pn") - 1, keep, by, [value])
    first, single = F.pmod(F.col("pn"), F.lit(4)) == 0, F.col("duration") == "SINGLE_QUARTER"
    kind = F.when((F.col("duration") != "CUMULATIVE_YTD") & ~single, "unsupported_duration_semantics")
    before = F.when(~first & ~single, _mismatch(F.col("matched"), "missing_preceding_cumulative_period"))
    missing = F.when(F.col(value).isNull() | (~first & ~single & F.col("other")[value].isNull()), "missing_value")
    reason = F.coalesce(unknown_part(), kind, before, missing)
    out = F.when(single | first, F.col(value)).otherwise(F.col(value) - F.col("other")[value])
    own, prev = F.col("pn").cast("string"), (F.col("pn") - 1).cast("string")
    chain = F.when(single | first, own).otherwise(F.concat_ws("|", own, prev))
    return best.withColumn("reason", reason).withColumn("quarter_value", F.when(F.col("reason").isNull(), out)).withColumn("source_periods", F.when(F.col("reason").isNull(), chain)).drop("other", "matched")


def quarters(known: DataFrame, values: Sequence[str], by: Sequence[str] = ("as_of", "code")) -> DataFrame:
    """Single quarters from sums that run from the year's start: each less its predecessor in the same year, else a reason."""
    prev = known.select(*by, "yr", (F.col("q") + 1).alias("q"), *[F.col(v).alias("prev_" + v) for v in values], F.lit(True).alias("has_prev"))
    out = known.join(prev, [*by, "yr", "q"], "left")
    for v in values:
        out = out.withColumn("sq_" + v, F.when(F.col("q") == 1, F.col(v)).otherwise(F.col(v) - F.col("prev_" + v)))
    reason = F.when((F.col("q") > 1) & F.col("has_prev").isNull(), "missing_preceding_cumulative_period")
    return out.withColumn("reason", reason).drop("has_prev", *["prev_" + v for v in values])


def comparable(known: DataFrame, value: str, lag: int = 4, by: Sequence[str] = ("as_of", "code")) -> DataFrame:
    """Growth against the period `lag` quarters before, as known on the same date."""
    prev = known.select(*by, (F.col("pn") + lag).alias("pn"), F.col(value).alias("base"))
    out = known.join(prev, [*by, "pn"], "left")
    g, why = growth(F.col(value), F.col("base"))
    return out.withColumn("growth", g).withColumn("reason", F.coalesce(F.when(F.col("base").isNull(), "missing_comparison_period"), why))


def trailing_sum(single: DataFrame, value: str, periods: int = 4, by: Sequence[str] = ("as_of", "code")) -> DataFrame:
    """The sum of consecutive periods that end at a row; any gap leaves it unknown."""
    w = Window.partitionBy(*by).orderBy("pn").rangeBetween(1 - periods, 0)
    full = F.count(value).over(w) == periods
    return single.withColumn("ttm", F.when(full, F.sum(value).over(w))).withColumn("ttm_reason", F.when(~full, "missing_quarter"))


def revised(facts: DataFrame, keys: Sequence[str], available: str, values: Sequence[str]) -> DataFrame:
    """Keys with several versions, days and a changed value, with the names of what changed."""
    counts = [F.count_distinct(v).alias("d_" + v) for v in values]
    g = facts.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.count_distinct(available).alias("n_days"), *counts)
    changed = F.filter(F.array(*[F.when(F.col("d_" + v) > 1, v) for v in values]), lambda x: x.isNotNull())
    return g.withColumn("changed", F.array_join(changed, "|")).where("n_versions > 1 and n_days > 1 and changed <> ''").drop(*["d_" + v for v in values])


def latest(known: DataFrame, by: Sequence[str], order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last())
    return known.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def next_periods(first: DataFrame, dates: DataFrame, keys: Sequence[str] = ("code",), period: str = "pn", day: str = "first_day") -> DataFrame:
    """For each as-of date the next two periods whose day comes after it, with nth (1 or 2).

    A period is one of the two from the second latest day of the periods before it until its own day, so that each meets
    only the dates of that time, in a join by year. Periods without a day are never ahead; an entity's periods are unique.
    """
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    rows = first.where(F.col(day).isNotNull()).withColumn("_latest", F.max(day).over(before))
    # the second latest so far is the latest of what a later maximum replaced or what fell short of one
    second = F.max(F.when(F.col("_latest").isNotNull(), F.least(day, "_latest"))).over(before)
    rows = rows.withColumn("_since", F.coalesce(second, dates.agg(F.min("as_of")).scalar())).withColumn("until", F.col(day)).where("_since < until")
    nth = F.when(F.col("_latest") > F.col("as_of"), 2).otherwise(1)
    return current_on(rows, dates, "_since").withColumn("nth", nth).drop("_latest", "_since")


def trend(obs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Change, former change and acceleration between consecutive periods, and how long the latest direction has lasted."""
    w = Window.partitionBy(*by).orderBy("pn")
    next_to = (F.col("pn") - F.lag("pn").over(w)) == 1
    out = obs.withColumn("change", F.when(next_to, F.col(value) - F.lag(value).over(w)))
    out = out.withColumn("prev_change", F.when(next_to, F.lag("change").over(w))).withColumn("acceleration", F.col("change") - F.col("prev_change"))
    same: Column = next_to & (F.signum("change") == F.signum("prev_change")) & (F.col("change") != 0)
    out = out.withColumn("brk", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("brk").over(w))
    wr = Window.partitionBy(*by, "run").orderBy("pn")
    return out.withColumn("run_length", F.when(F.col("change").isNull() | (F.col("change") == 0), 0).otherwise(F.row_number().over(wr))).drop("brk", "run")
