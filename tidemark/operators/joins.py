"""Joins by date and by membership: the row current on a date, running counts, outer unions of frames, overlaps of sets.

Joins by date are unions: both sides are sorted together once, and what the right side said last is carried forward to
the rows of the left. No row meets a range of other rows, however many dates there are. Entities are cut into blocks of
time, so that one with a large part of all rows is sorted by many tasks; what a block leaves behind is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _year(day: Column) -> Column:
    return F.year(day).cast("long")


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, ties: Sequence[str | Column] = (), name: str = "match", block: Callable[[Column], Column] = _year) -> DataFrame:
    """left's rows with, as a struct, the last row of right that has the same keys and is dated on or before them.

    Of rows of one date the last by `ties` counts, nulls being first. Rows of right without a date never match; rows of
    left without a date or with a null key match nothing, and are kept. block says to which stretch of time a date belongs
    (for dates their year); a later date never belongs to an earlier block.
    """
    key = [F.col(c) for c in by]
    r = right.where(F.col(right_on).isNotNull()).select(*key, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*ties, F.lit(0)).alias("_tie"), F.struct(*right.columns).alias("_right"))
    lefts = left.select(*key, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = r.unionByName(lefts, allowMissingColumns=True).withColumn("_block", block(F.col("_at")))
    w = Window.partitionBy(*by, "_block").orderBy(F.col("_at").asc_nulls_first(), "_side", "_tie")
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.lit(True))
    near = both.withColumn("_near", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # what earlier blocks leave behind: one row for each block of an entity
    ends = both.where("_side = 0").groupBy(*by, "_block").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_end"))
    blocks = both.groupBy(*by, "_block").agg(F.lit(1).alias("_one")).join(ends, [*by, "_block"], "left")
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null").select(*by, "_block", "_carried")
    out = near.join(carried, [*by, "_block"], "left")
    found = F.when(known & F.col("_at").isNotNull(), F.coalesce("_near", "_carried"))
    return out.select("_left.*", found.alias(name))


def last_row(rows: DataFrame, by: Sequence[str], arrival: str) -> DataFrame:
    """For each key the row that arrived last, as `match`; aggregated before the exchange."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(arrival, *[c for c in rows.columns if c != arrival])).alias("match"))


#: Columns that may date a reference row, the first that a table has counts.
REFERENCE_DATES = ("as_of_date", "trade_date", "effective_date")


def reference_row(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, arrival: str, dates: Sequence[str] = REFERENCE_DATES) -> DataFrame:
    """left's rows with the reference row that held on their date, as `match`.

    Of a table with one of `dates` the last dated row on or before the date counts, the later arrival of two of one day, and
    its undated rows never do; of a table that has none of them the row that arrived last.
    """
    dated = next((c for c in dates if c in right.columns), None)
    if dated:
        return as_of_join(left, right, by, left_on, dated, [arrival])
    return left.join(last_row(right, by, arrival), [*by], "left").select(*left.columns, "match")


def on_dates(rows: DataFrame, dates: DataFrame, name: str) -> DataFrame:
    """Each row once for each date: the dates, one for each session at most, are one array."""
    return rows.withColumn(name, F.explode(dates.agg(F.array_sort(F.collect_set(name))).scalar()))


def visible_counts(events: DataFrame, dates: DataFrame, by: Sequence[str], available: str, name: str = "as_of") -> DataFrame:
    """For each date and entity with a row available on it: how many such rows there are, and the last of their days.

    Rows are counted by entity and day first; then days and dates are sorted together and counts run on.
    """
    days = events.where(F.col(available).isNotNull()).groupBy(*by, F.col(available).alias("_at")).agg(F.count("*").alias("_n"))
    asked = on_dates(days.select(*by).distinct(), dates, name).withColumn("_at", F.col(name))
    w = Window.partitionBy(*by).orderBy("_at", F.col(name).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = days.unionByName(asked, allowMissingColumns=True)
    seen = both.withColumn("n", F.sum("_n").over(w)).withColumn("last_day", F.max(F.when(F.col("_n").isNotNull(), F.col("_at"))).over(w))
    return seen.where(F.col(name).isNotNull() & F.col("n").isNotNull()).select(name, *by, "n", "last_day")


def outer_frame(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_basic") -> DataFrame:
    """All rows of both frames by the keys that both have; other columns that both have get a suffix on the right.

    Without a common key the frames are united by name. Null keys match nothing, and both sides' rows are kept.
    """
    shared = [k for k in keys if k in left.columns and k in right.columns]
    if not shared:
        return left.unionByName(right, allowMissingColumns=True)
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in shared}
    return left.join(right.withColumnsRenamed(clash), shared, "full_outer")


def members(rows: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in a set; a null key is in no set."""
    return rows.join(allowed.select(*keys), [*keys], "left_semi")


def others(rows: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in a set; a null key is in no set."""
    return rows.join(removed.select(*keys), [*keys], "left_anti")


def overlap(left: DataFrame, right: DataFrame, by: Sequence[str], member: str, least: int = 500, cover: float = 0.98) -> DataFrame:
    """For each date how many members two datasets have, share and have alone, with the warnings and PASS or FAIL.

    Coverage is the shared ones as a part of the larger set. Both sides are marked and counted once; repeated rows count once.
    """
    flag = lambda df, name: df.where(F.col(member).isNotNull()).select(*by, member, F.lit(True).alias(name))
    both = flag(left, "_l").unionByName(flag(right, "_r"), allowMissingColumns=True)
    each = both.groupBy(*by, member).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    n = each.groupBy(*by).agg(F.count("l").alias("left_n"), F.count("r").alias("right_n"), F.count_if(F.col("l") & F.col("r")).alias("both_n"))
    share = F.col("both_n") / F.greatest("left_n", "right_n")
    small = F.when(F.least("left_n", "right_n") < least, "abnormally_low_symbol_count")
    thin = F.when(share < cover, "low_join_coverage")
    out = n.withColumns({"left_only": F.col("left_n") - F.col("both_n"), "right_only": F.col("right_n") - F.col("both_n"), "coverage": share, "warnings": F.concat_ws("|", small, thin)})
    return out.withColumn("status", F.when(F.col("warnings") == "", "PASS").otherwise("FAIL"))
