"""Low attention on a date: an entity against its own past and against the market, what surges, and which gates it passes.

All entities and dates at once: figures of every session that is an entity's last on some date first, then for each date
that session, carried to it in one sorted union. Every value is unknown with a reason rather than guessed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import as_of_join
from tidemark.operators.order import Figure, window_figures
from tidemark.sources import materialize


@dataclass(frozen=True)
class Limits:
    """Windows in rows, least counts and cuts."""

    own_window: int = 252
    own_least: int = 21
    listing_days: int = 120
    population: int = 20
    base_window: int = 60
    base_least: int = 20
    cap: float = 10.0
    stale_days: int = 10
    amount_window: int = 20
    least_amount: float = 1.0
    surge: float = 2.0


FIELDS = {"turnover": "turnover", "amount": "amount", "volume": "vol"}


def session_figures(px: DataFrame, limits: Limits = Limits(), dates: DataFrame | None = None) -> DataFrame:
    """px with its entity's shares, medians and means over earlier rows, and its place among all entities of the session.

    With dates (as_of, session: the market's last day on that date), only the rows that are an entity's last on one of the
    dates are told of and kept, and places only for these sessions, of which every row is kept.
    """
    w = Window.partitionBy("code").orderBy("day")
    px = px.withColumns({"mean_amount": F.avg("amount").over(w.rowsBetween(1 - limits.amount_window, 0)), "_next": F.lead("day").over(w)})
    if dates is not None:
        px = px.crossJoin(F.broadcast(dates.agg(F.collect_set("as_of").alias("_dates"))))  # one row
    asked = F.lit(True) if dates is None else F.exists("_dates", lambda d: (d >= F.col("day")) & (F.col("_next").isNull() | (d < F.col("_next"))))
    own = {f"self_{k}": Figure("share", c, (-limits.own_window, -1), limits.own_least) for k, c in FIELDS.items()}
    base = {f"base_{c}": Figure("median", c, (-limits.base_window, -1), limits.base_least) for c in ("vol", "turnover")}
    rows = window_figures(px.withColumn("_asked", asked).drop("_dates"), own | base, at="day", only="_asked").drop("_next", "_asked")
    for k, c in FIELDS.items():
        day = Window.partitionBy("day", F.col(c).isNull())
        whole = F.lit(True) if dates is None else F.array_contains(dates.agg(F.collect_set("session")).scalar(), F.col("day"))
        rows = rows.withColumn(f"cross_{k}", F.when(whole & F.col(c).isNotNull() & (F.count("*").over(day) >= limits.population), F.cume_dist().over(day.orderBy(c))))
    return rows


def _ratio(value: Column, base: Column) -> Column:
    return F.when(base != 0, value / base)


def low_attention(px: DataFrame, asked: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """asked (as_of, code, list_day) with everything that is told of an entity's attention on a date.

    px: code, day, vol, turnover and amount of each session. status: `traded` in the market's last session on or before the
    date, `suspended_session` or, after more than stale_days, `stale` if the entity's last one is earlier, else `no_data`.
    liquidity_reasons: all gates that fail, by `|`. The score needs all four core shares; the opportunity also a session on
    the day, liquidity, and no surge (an unknown surge is none).
    """
    c = F.col
    # rows before an entity was listed are not its own, but they stay in the market of their day
    listed = asked.where("list_day is not null").groupBy("code").agg(F.min("list_day").alias("_listed"))
    market = px.select("day").distinct().withColumn("market", F.lit(1))
    dates = as_of_join(asked.select("as_of").distinct().withColumn("market", F.lit(1)), market, ["market"], "as_of", "day").select("as_of", c("match.day").alias("session"))
    dates = materialize(dates, "dates")  # a row for each date
    # written, since the join reads it several times
    all_days = materialize(session_figures_of_listed(px, listed, limits, dates), "figures")
    rows = as_of_join(asked, all_days, ["code"], "as_of", "day").join(F.broadcast(dates), "as_of", "left")
    m = lambda x: c("match." + x)
    lag = F.datediff("session", m("day"))
    status = F.when(m("day").isNull(), "no_data").when(m("day") == c("session"), "traded").when(lag > limits.stale_days, "stale").otherwise("suspended_session")
    age = F.datediff("as_of", "list_day")
    rows = rows.withColumns({"status": status, "lag_days": lag, "age": age})
    traded, new = c("status") == "traded", F.coalesce(c("age") < limits.listing_days, F.lit(False))
    gates = F.concat_ws(
        "|", F.when(m("mean_amount").isNull(), "unknown_liquidity").when(m("mean_amount") < limits.least_amount, "low_liquidity"), F.when(traded & m("amount").isNull(), "unknown_current_liquidity").when(traded & (m("amount") <= 0), "no_trading_activity"),
        F.when(new, "new_listing"), F.when(~traded, "no_session_at_decision"),
    )
    missing = F.when(c("status") == "stale", "stale_data").when(c("status") == "suspended_session", "suspended_session").when(~traded, "missing_history")
    own_reason = F.coalesce(missing, F.when(new, "new_listing"))
    rows = rows.withColumns({"liquidity_reasons": gates, "self_reason": own_reason, "average_amount": m("mean_amount")})
    rows = rows.withColumns({f"self_{k}": F.when(own_reason.isNull(), m(f"self_{k}")) for k in FIELDS} | {f"cross_{k}": F.when(traded, m(f"cross_{k}")) for k in FIELDS})
    raw, change = F.when(traded, _ratio(m("vol"), m("base_vol"))), F.when(traded, _ratio(m("turnover"), m("base_turnover")))
    rows = rows.withColumns({"raw_ratio": raw, "baseline_change": change})
    rows = rows.withColumns({"abnormal_volume": F.when(c("raw_ratio").isNotNull(), F.least("raw_ratio", F.lit(limits.cap))), "capped": F.coalesce(c("raw_ratio") > limits.cap, F.lit(False))})
    surge = F.greatest("raw_ratio", "baseline_change") >= limits.surge  # greatest() passes over what is unknown
    rows = rows.withColumns({"attention_surge": surge, "surge_reason": F.coalesce(missing, F.when(surge.isNull(), "missing_attention_baseline"))})
    core = ["cross_turnover", "cross_amount", "self_turnover", "self_amount"]
    score = 100 * (sum((1 - c(x) for x in core[1:]), 1 - c(core[0]))) / len(core)
    rows = rows.withColumn("score", score)
    open_to = (c("liquidity_reasons") == "") & traded & ~F.coalesce("attention_surge", F.lit(False))
    return rows.withColumn("opportunity", F.when(c("score").isNotNull(), open_to)).drop("match", "session", "age")


def session_figures_of_listed(px: DataFrame, listed: DataFrame, limits: Limits, dates: DataFrame | None = None) -> DataFrame:
    """session_figures, in which an entity's own windows begin with its listing."""
    rows = px.join(listed, "code", "left").withColumn("_own", F.col("_listed").isNull() | (F.col("day") >= F.col("_listed")))
    early = rows.where("not _own")
    # all rows of a day count for its cross-section, so early ones take part under another name
    both = rows.where("_own").withColumn("_was", F.lit(False)).unionByName(early.withColumn("code", -1 - F.col("code")).withColumn("_was", F.lit(True)))
    return session_figures(both.drop("_listed", "_own"), limits, dates).where("not _was").drop("_was")
