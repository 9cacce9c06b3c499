"""Queries on revised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mean_known, sign_transition
from tidemark.operators import pit
from tidemark.plans.views import Views
from tidemark.registry import query

KEYS = ["code", "yr", "q"]
KNOWN = """k AS (SELECT * FROM (SELECT a.as_of, i.*, row_number() OVER (PARTITION BY a.as_of, code, yr, q ORDER BY ann_date DESC, update_flag DESC) AS rn
  FROM as_of a JOIN income i ON i.ann_date <= a.as_of) WHERE rn = 1)"""
SINGLE = KNOWN + """, s AS (SELECT k.as_of, k.code, k.yr, k.q, k.pn, CASE WHEN k.q = 1 THEN k.revenue ELSE k.revenue - p.revenue END AS sq_revenue,
  CASE WHEN k.q = 1 THEN k.profit ELSE k.profit - p.profit END AS sq_profit, CASE WHEN k.q > 1 AND p.q IS NULL THEN 'missing_preceding_cumulative_period' END AS reason
  FROM k LEFT JOIN k p ON p.as_of = k.as_of AND p.code = k.code AND p.yr = k.yr AND p.q = k.q - 1)"""


def known(v: Views) -> DataFrame:
    return pit.as_of(v.income, v.as_of.select("as_of"), KEYS, "ann_date", ["update_flag"])


def single(v: Views) -> DataFrame:
    """Single quarters, written once by queries that keep what they read several times."""
    return v.once("single", lambda: pit.quarters(v.once("known", lambda: known(v)), ["revenue", "profit"]))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("P01_as_of", f", {KNOWN} SELECT as_of, code, yr, q, ann_date, update_flag, round(revenue, 6) AS revenue FROM k")
def p01(v: Views) -> DataFrame:
    return rounded(known(v).select("as_of", "code", "yr", "q", "ann_date", "update_flag", "revenue"), "revenue")


@query("P05_latest_previous", f", {KNOWN} SELECT as_of, code, pn, nth FROM (SELECT as_of, code, pn, row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) AS nth FROM k) WHERE nth <= 2")
def p05(v: Views) -> DataFrame:
    return pit.latest(known(v), ["as_of", "code"], "pn", 2).select("as_of", "code", "pn", F.col("nth").cast("long").alias("nth"))


@query("P09_quarters", f", {SINGLE} SELECT as_of, code, yr, q, round(sq_revenue, 6) AS sq_revenue, round(sq_profit, 6) AS sq_profit, reason FROM s")
def p09(v: Views) -> DataFrame:
    return rounded(single(v).select("as_of", "code", "yr", "q", "sq_revenue", "sq_profit", "reason"), "sq_revenue", "sq_profit")


GROWTH = """g AS (SELECT s.as_of, s.code, s.pn, s.{v} AS v, b.{v} AS base, CASE WHEN b.{v} IS NULL THEN 'missing_comparison_period' WHEN s.{v} IS NULL THEN 'missing_value'
  WHEN b.{v} > 0 AND s.{v} < 0 THEN 'sign_transition' WHEN b.{v} = 0 THEN 'invalid_denominator' WHEN b.{v} < 0 THEN 'negative_denominator' END AS why
  FROM s LEFT JOIN s b ON b.as_of = s.as_of AND b.code = s.code AND b.pn = s.pn - {lag})"""


def _growth(name: str, value: str, lag: int) -> None:
    sql = f", {SINGLE}, {GROWTH.format(v=value, lag=lag)} SELECT as_of, code, pn, round(CASE WHEN why IS NULL THEN (v - base) / base END, 6) AS growth, why AS reason FROM g"

    @query(name, sql)
    def run(v: Views) -> DataFrame:
        out = pit.comparable(single(v).drop("reason"), value, lag)
        return out.select("as_of", "code", "pn", F.round("growth", 6).alias("growth"), "reason")


_growth("P08_yoy_revenue", "sq_revenue", 4)
_growth("P11_yoy_profit", "sq_profit", 4)
_growth("P08_qoq_revenue", "sq_revenue", 1)


@query("P12_margin_change", f", {SINGLE}, m AS (SELECT as_of, code, pn, CASE WHEN sq_revenue > 0 THEN sq_profit / sq_revenue END AS m FROM s) SELECT m.as_of, m.code, m.pn, round(m.m, 6) AS margin, round(m.m - b.m, 6) AS margin_change FROM m LEFT JOIN m b ON b.as_of = m.as_of AND b.code = m.code AND b.pn = m.pn - 4")
def p12(v: Views) -> DataFrame:
    m = single(v).select("as_of", "code", "pn", F.when(F.col("sq_revenue") > 0, F.col("sq_profit") / F.col("sq_revenue")).alias("m"))
    b = m.select("as_of", "code", (F.col("pn") + 4).alias("pn"), F.col("m").alias("b"))
    return m.join(b, ["as_of", "code", "pn"], "left").select("as_of", "code", "pn", F.round("m", 6).alias("margin"), F.round(F.col("m") - F.col("b"), 6).alias("margin_change"))


TTM = f"{SINGLE}, t AS (SELECT as_of, code, pn, count(sq_revenue) OVER w AS n, sum(sq_revenue) OVER w AS s FROM s WINDOW w AS (PARTITION BY as_of, code ORDER BY pn RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))"


@query("P13_ttm", f", {TTM} SELECT as_of, code, pn, round(CASE WHEN n = 4 THEN s END, 6) AS ttm, CASE WHEN n <> 4 THEN 'missing_quarter' END AS ttm_reason FROM t")
def p13(v: Views) -> DataFrame:
    return pit.trailing_sum(single(v), "sq_revenue").select("as_of", "code", "pn", F.round("ttm", 6).alias("ttm"), "ttm_reason")


@query("P15_revisions", " SELECT code, yr, q, count(*) AS n_versions, count(DISTINCT ann_date) AS n_days, concat_ws('|', CASE WHEN count(DISTINCT revenue) > 1 THEN 'revenue' END, CASE WHEN count(DISTINCT profit) > 1 THEN 'profit' END) AS changed FROM income GROUP BY code, yr, q HAVING count(*) > 1 AND count(DISTINCT ann_date) > 1 AND (count(DISTINCT revenue) > 1 OR count(DISTINCT profit) > 1)")
def p15(v: Views) -> DataFrame:
    return pit.revised(v.income, KEYS, "ann_date", ["revenue", "profit"])


@query("P16_revision_boundaries", " SELECT a.code, a.yr, a.q, true AS before_first_empty, true AS first_visible, true AS day_before_is_first, b.revenue <> a.revenue AS on_revision_differs FROM income a JOIN income b ON a.code = b.code AND a.yr = b.yr AND a.q = b.q AND a.update_flag = 0 AND b.update_flag = 1")
def p16(v: Views) -> DataFrame:
    facts = v.income
    pair = facts.groupBy(*KEYS).agg(F.min("ann_date").alias("d1"), F.max("ann_date").alias("d2"), F.min_by("revenue", "ann_date").alias("r1")).where("d1 <> d2")
    probe = pair.select(*KEYS, "r1", F.explode(F.array(*[F.struct(F.lit(n).alias("at"), d.alias("as_of")) for n, d in (("b", F.date_sub("d1", 1)), ("f", F.col("d1")), ("l", F.date_sub("d2", 1)), ("r", F.col("d2")))])).alias("p")).select(*KEYS, "r1", "p.*")
    cur = pit.versions(facts, KEYS, "ann_date", ["update_flag"]).select(*KEYS, "ann_date", "until", "revenue")
    seen = probe.join(cur, KEYS).where("ann_date <= as_of and (until is null or as_of < until)").select(*KEYS, "at", F.col("revenue").alias("seen"))
    wide = probe.join(seen, [*KEYS, "at"], "left").groupBy(*KEYS, "r1").pivot("at", ["b", "f", "l", "r"]).agg(F.first("seen"))
    return wide.select(*KEYS, F.isnull("b").alias("before_first_empty"), F.isnotnull("f").alias("first_visible"), (F.col("l") == F.col("r1")).alias("day_before_is_first"), (F.col("r") != F.col("r1")).alias("on_revision_differs"))


@query("P17_bridge", f", {SINGLE} SELECT s.as_of, s.code, s.yr, abs(sum(s.sq_revenue) - max(k.revenue)) <= greatest(1e-6, 1e-8 * abs(max(k.revenue))) AS bridges FROM s JOIN k USING (as_of, code, yr, q) GROUP BY s.as_of, s.code, s.yr HAVING count(s.sq_revenue) = 4")
def p17(v: Views) -> DataFrame:
    g = single(v).groupBy("as_of", "code", "yr").agg(F.count("sq_revenue").alias("n"), F.sum("sq_revenue").alias("s"), F.max("revenue").alias("fy")).where("n = 4")
    return g.select("as_of", "code", "yr", (F.abs(F.col("s") - F.col("fy")) <= F.greatest(F.lit(1e-6), 1e-8 * F.abs("fy"))).alias("bridges"))


@query("P18_period_counts", f", {KNOWN} SELECT as_of, code, count(DISTINCT pn) AS n_periods, max(end_date) AS last_end FROM k GROUP BY as_of, code")
def p18(v: Views) -> DataFrame:
    return known(v).groupBy("as_of", "code").agg(F.count_distinct("pn").alias("n_periods"), F.max("end_date").alias("last_end"))


@query("F18_sign_transition", f", {SINGLE} SELECT s.as_of, s.code, s.pn, CASE WHEN a IS NULL OR b IS NULL THEN 'UNKNOWN' WHEN a < 0 AND b > 0 THEN 'NEGATIVE_TO_POSITIVE' WHEN a > 0 AND b < 0 THEN 'POSITIVE_TO_NEGATIVE' WHEN a = 0 AND b > 0 THEN 'ZERO_TO_POSITIVE' WHEN a = 0 AND b < 0 THEN 'ZERO_TO_NEGATIVE' WHEN a <> 0 AND b = 0 THEN 'TO_ZERO' ELSE 'NONE' END AS label FROM (SELECT as_of, code, pn, CASE WHEN code % 7 = 0 AND pn % 3 = 0 THEN 0 ELSE sq_profit END AS b FROM s) s LEFT JOIN (SELECT as_of, code, pn, CASE WHEN code % 7 = 0 AND pn % 3 = 0 THEN 0 ELSE sq_profit END AS a FROM s) p ON p.as_of = s.as_of AND p.code = s.code AND p.pn = s.pn - 1")
def f18(v: Views) -> DataFrame:
    """Every third quarter of some entities is zero, so that all labels occur."""
    s = single(v).select("as_of", "code", "pn", F.when((F.col("code") % 7 == 0) & (F.col("pn") % 3 == 0), 0).otherwise(F.col("sq_profit")).alias("sq_profit"))
    p = s.select("as_of", "code", (F.col("pn") + 1).alias("pn"), F.col("sq_profit").alias("p"))
    return s.join(p, ["as_of", "code", "pn"], "left").select("as_of", "code", "pn", sign_transition(F.col("p"), F.col("sq_profit")).alias("label"))


TREND = f"""{SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, o AS (SELECT as_of, code, pn, CASE WHEN why IS NULL THEN (v - base) / base END AS g FROM g),
  d AS (SELECT *, CASE WHEN pn - lag(pn) OVER w = 1 THEN g - lag(g) OVER w END AS c, pn - lag(pn) OVER w AS gap FROM o WINDOW w AS (PARTITION BY as_of, code ORDER BY pn)),
  e AS (SELECT *, CASE WHEN gap = 1 THEN lag(c) OVER w END AS pc FROM d WINDOW w AS (PARTITION BY as_of, code ORDER BY pn)),
  f AS (SELECT *, CASE WHEN gap = 1 AND sign(c) = sign(pc) AND c <> 0 THEN 0 ELSE 1 END AS b FROM e),
  h AS (SELECT *, sum(b) OVER (PARTITION BY as_of, code ORDER BY pn) AS run FROM f),
  tr AS (SELECT *, CASE WHEN c IS NULL OR c = 0 THEN 0 ELSE row_number() OVER (PARTITION BY as_of, code, run ORDER BY pn) END AS run_length FROM h)"""


@query("W15_trend", f", {TREND} SELECT as_of, code, pn, round(c, 6) AS change, round(pc, 6) AS prev_change, round(c - pc, 6) AS acceleration FROM tr")
def w15(v: Views) -> DataFrame:
    out = pit.trend(_obs(v), "growth", ["as_of", "code"])
    return out.select("as_of", "code", "pn", *[F.round(c, 6).alias(c) for c in ("change", "prev_change", "acceleration")])


@query("W16_run_length", f", {TREND} SELECT as_of, code, pn, run_length FROM tr")
def w16(v: Views) -> DataFrame:
    return pit.trend(_obs(v), "growth", ["as_of", "code"]).select("as_of", "code", "pn", F.col("run_length").cast("long").alias("run_length"))


def _obs(v: Views) -> DataFrame:
    return pit.comparable(single(v).drop("reason"), "sq_revenue", 4).select("as_of", "code", "pn", "growth")


@query("K02_rank_growth", f", {SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, l AS (SELECT as_of, code, CASE WHEN why IS NULL THEN (v - base) / base END AS x, row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) AS n FROM g) SELECT as_of, code, round(x, 6) AS growth, row_number() OVER (PARTITION BY as_of ORDER BY x DESC NULLS LAST, code) AS rank FROM l WHERE n = 1 QUALIFY rank <= 10")
def k02(v: Views) -> DataFrame:
    from tidemark.operators.rank import top

    v.keep("as_of")
    last = pit.latest(_obs(v), ["as_of", "code"], "pn")
    return top(last, ["as_of"], [F.col("growth").desc_nulls_last(), F.col("code")], 10).select("as_of", "code", F.round("growth", 6).alias("growth"), "rank")


@query("X14_component_score", f", {SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, p AS (SELECT as_of, code, pn, CASE WHEN sq_revenue > 0 THEN sq_profit / sq_revenue END AS m FROM s), z AS (SELECT g.as_of, g.code, g.pn, 50 + 50 * tanh(CASE WHEN why IS NULL THEN (v - base) / base END * 2.0) AS a, 50 + 50 * tanh(p.m * 5.0) AS b FROM g JOIN p USING (as_of, code, pn)) SELECT as_of, code, pn, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::int + (b IS NOT NULL)::int) END, 4) AS score FROM z")
def x14(v: Views) -> DataFrame:
    from tidemark.functions import bounded

    s = pit.comparable(single(v).drop("reason"), "sq_revenue", 4)
    margin = F.when(F.col("sq_revenue") > 0, F.col("sq_profit") / F.col("sq_revenue"))
    return s.select("as_of", "code", "pn", F.round(mean_known(bounded(F.col("growth"), 2.0), bounded(margin, 5.0)), 4).alias("score"))
