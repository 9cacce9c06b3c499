"""Windows over a panel of entities and sessions, evaluation of forward returns, and their summaries.

Windows run on the session index, never on dates; a session without a row stays missing. They are partitioned by
entity, so that one exchange serves all windows of a panel; cross-sections are partitioned by session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import Figure, window_figures, window_shares
from tidemark.operators.ranges import deepest_fall, fall_blocks
from tidemark.sources import materialize


def sessions(before: int, after: int, key: str = "code", idx: str = "idx"):
    return Window.partitionBy(key).orderBy(idx).rangeBetween(before, after)


def at_offset(px: DataFrame, value: str, offset: int, name: str, key: str = "code", idx: str = "idx") -> DataFrame:
    """The value exactly `offset` sessions away; null if that session has none."""
    w = Window.partitionBy(key).orderBy(idx).rangeBetween(offset, offset)
    return px.withColumn(name, F.first(value).over(w))


def window_return(px: DataFrame, lookback: int, value: str = "close") -> DataFrame:
    px = at_offset(px, value, -lookback, "then")
    return px.withColumn("ret", F.when(F.col("then") > 0, F.col(value) / F.col("then") - 1)).drop("then")


def prior_high(px: DataFrame, window: int, least: int, value: str = "close") -> DataFrame:
    w = sessions(-window, -1)
    return px.withColumn("high", F.when(F.count(value).over(w) >= least, F.max(value).over(w))).withColumn("below_high", F.col(value) / F.col("high") - 1)


def prior_median_ratio(px: DataFrame, value: str, window: int, least: int) -> DataFrame:
    good = px.withColumn("_good", F.when(F.col(value) > 0, F.col(value)))
    rows = window_figures(good, {"base": Figure("median", "_good", (-window, -1), least)}, count_rows=False).drop("_good")
    return rows.withColumn("ratio", F.col(value) / F.col("base"))


def self_percentile(px: DataFrame, value: str, rows: int, least: int) -> DataFrame:
    """The share of an entity's earlier rows that are not larger."""
    return window_shares(px, {"pct": value}, (-rows, -1), least)


def cross_percentile(px: DataFrame, by: str, value: str, least: int) -> DataFrame:
    w = Window.partitionBy(by)
    return px.where(F.col(value).isNotNull()).withColumn("pct", F.when(F.count("*").over(w) >= least, F.cume_dist().over(w.orderBy(value))))


def trailing_mean(px: DataFrame, value: str, rows: int) -> DataFrame:
    return px.withColumn("mean", F.avg(value).over(Window.partitionBy("code").orderBy("idx").rowsBetween(1 - rows, 0)))


def regime(bench: DataFrame, short: int, long: int) -> DataFrame:
    """bull, bear or range by the change over `short` sessions and the fall from the high of `long` sessions; every session must have a close."""
    one = Window.orderBy("idx")
    full = F.count(F.when(F.col("close") > 0, 1)).over(one.rowsBetween(1 - long, 0)) == long
    out = bench.withColumn("change", F.col("close") / F.lag("close", short).over(one) - 1).withColumn("fall", F.col("close") / F.max("close").over(one.rowsBetween(1 - long, 0)) - 1)
    label = F.when(~full, None).when((F.col("change") >= 0.1) & (F.col("fall") > -0.2), "bull").when((F.col("change") <= -0.1) | (F.col("fall") <= -0.2), "bear").otherwise("range")
    return out.withColumn("regime", label)


def forward(entries: DataFrame, px: DataFrame, bench: DataFrame, horizons: DataFrame, last_idx: int | Column, cost: float = 0.003) -> DataFrame:
    """Each entry's return to the exact session h later, with benchmark, excess and net of cost, and a status."""
    grid = entries.crossJoin(F.broadcast(horizons)).withColumn("exit_idx", F.col("idx") + F.col("h"))
    enter = px.select("code", "idx", F.col("close").alias("p0"))
    leave = px.select("code", F.col("idx").alias("exit_idx"), F.col("close").alias("p1"))
    b0, b1 = bench.select("idx", F.col("close").alias("b0")), bench.select(F.col("idx").alias("exit_idx"), F.col("close").alias("b1"))
    out = grid.join(enter, ["code", "idx"], "left").join(leave, ["code", "exit_idx"], "left").join(F.broadcast(b0), "idx", "left").join(F.broadcast(b1), "exit_idx", "left")
    status = F.when(F.col("exit_idx") > last_idx, "incomplete_market_window").when(F.col("p0").isNull(), "missing_entry_price").when(F.col("p1").isNull(), "missing_horizon_price").otherwise("observed")
    out = out.withColumn("status", status).withColumn("gross", F.when(F.col("status") == "observed", F.col("p1") / F.col("p0") - 1))
    return out.withColumn("net", F.when(F.col("gross").isNotNull(), F.greatest(F.lit(-1.0), F.col("gross") - cost))).withColumn("excess", F.col("gross") - (F.col("b1") / F.col("b0") - 1))


def forward_observation(entries: DataFrame, quotes: DataFrame, halts: DataFrame, bench: DataFrame, horizons: DataFrame, last_idx: int | Column, cost: float = 0.003) -> DataFrame:
    """Each entry's adjusted return to the exact session h later, what stands against it, and the deepest fall on the way.

    quotes: code, idx, raw, factor; halts: code, idx. An entry without a return has the first status that applies, in the
    order in which a reader would meet them: the market's window, the history, the entry's row, price and factor, then
    the exit's row (a halt explains a missing one), price and factor.
    """
    q = quotes.select("code", "idx", "raw", (F.col("raw") * F.col("factor")).alias("adj"), F.lit(True).alias("there"))
    grid = entries.join(F.broadcast(horizons)).withColumn("exit_idx", F.col("idx") + F.col("h"))
    enter = q.select("code", "idx", *[F.col(c).alias(c + "0") for c in ("raw", "adj", "there")])
    leave = q.select("code", F.col("idx").alias("exit_idx"), *[F.col(c).alias(c + "1") for c in ("raw", "adj", "there")])
    out = grid.join(quotes.select("code").distinct().withColumn("known", F.lit(True)), "code", "left").join(enter, ["code", "idx"], "left").join(leave, ["code", "exit_idx"], "left")
    out = out.join(halts.select("code", F.col("idx").alias("exit_idx"), F.lit(True).alias("halted")).distinct(), ["code", "exit_idx"], "left")
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    status = (
        F.when(F.col("exit_idx") > last_idx, "incomplete_market_window").when(F.col("known").isNull(), "missing_price_history").when(F.col("there0").isNull(), "missing_entry_price")
        .when(bad("raw0"), "invalid_entry_price").when(F.col("adj0").isNull(), "missing_adjustment_factor_entry").when(F.col("adj0") <= 0, "invalid_entry_price")
        .when(F.col("there1").isNull(), F.when(F.col("halted"), "suspended_at_exit").otherwise("missing_horizon_price"))
        .when(bad("raw1"), "invalid_exit_price").when(F.col("adj1").isNull(), "missing_adjustment_factor_exit").when(F.col("adj1") <= 0, "invalid_exit_price").otherwise("observed")
    )
    out = out.withColumn("status", status).withColumn("gross", F.when(F.col("status") == "observed", F.col("adj1") / F.col("adj0") - 1))
    b0, b1 = bench.select("idx", F.col("close").alias("b0")), bench.select(F.col("idx").alias("exit_idx"), F.col("close").alias("b1"))
    out = out.join(F.broadcast(b0), "idx", "left").join(F.broadcast(b1), "exit_idx", "left").withColumn("benchmark", F.col("b1") / F.col("b0") - 1)
    net = F.when(F.col("gross").isNotNull(), F.greatest(F.lit(-1.0), F.col("gross") - cost))
    out = out.withColumn("net", net).withColumn("excess", F.col("gross") - F.col("benchmark")).withColumn("net_excess", F.col("net") - F.col("benchmark"))
    # of each entry's way only its two ends are looked up, in blocks of the whole path
    shortest = F.length(F.bin(horizons.agg(F.min("h")).scalar().cast("long"))) - 1
    held = q.join(entries.select("code").distinct(), "code", "left_semi")
    blocks = materialize(fall_blocks(held, "adj", F.lit(last_idx) if isinstance(last_idx, int) else last_idx, lowest=shortest), "falls")  # both ends are looked up in it
    out = deepest_fall(out, blocks, "idx", "exit_idx")
    return out.withColumn("drawdown", F.when(F.col("status") == "observed", F.col("drawdown"))).drop("raw0", "raw1", "adj0", "adj1", "there0", "there1", "known", "halted", "b0", "b1")


def summary(x: Column, name: str = "") -> list[Column]:
    return [F.count(x).alias(name + "n"), F.round(F.avg(x), 6).alias(name + "mean"), F.round(F.percentile(x, F.lit(0.5)), 6).alias(name + "median"), F.round(F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)), 6).alias(name + "iqr"), F.round(F.avg((x > 0).cast("double")), 6).alias(name + "hit")]


def path_drawdown(px: DataFrame, by: Sequence[str] = ("code",)) -> DataFrame:
    peak = F.max("close").over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return px.withColumn("dd", F.col("close") / peak - 1).groupBy(*by).agg(F.round(F.min("dd"), 6).alias("drawdown"))


def compounded_drawdown(cohorts: DataFrame, by: str, order: str, ret: str) -> DataFrame:
    """The largest fall of wealth compounded over ordered cohorts (one value for each date, so that the list stays short)."""
    path = F.array_sort(F.collect_list(F.struct(order, ret)))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        w = a["w"] * (1 + x[ret])
        p = F.greatest(a["p"], w)
        return F.struct(w.alias("w"), p.alias("p"), F.least(a["d"], w / p - 1).alias("d"))

    return cohorts.groupBy(by).agg(path.alias("path")).select(by, F.round(F.aggregate("path", start, step)["d"], 6).alias("drawdown"))


def set_turnover(picks: DataFrame, by: str, member: str) -> DataFrame:
    """Overlap of each date's set with the date before (sets of a top-n, hence short)."""
    sets = picks.groupBy(by).agg(F.collect_set(member).alias("s"))
    w = Window.orderBy(by)
    out = sets.withColumn("p", F.lag("s").over(w)).where(F.col("p").isNotNull())
    both = F.size(F.array_intersect("s", "p"))
    return out.select(by, F.round(both / F.greatest(F.lit(1), F.size(F.array_union("s", "p"))), 6).alias("jaccard"), F.size(F.array_except("s", "p")).cast("long").alias("added"), F.size(F.array_except("p", "s")).cast("long").alias("removed"))
