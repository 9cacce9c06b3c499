"""Queries on growth, margins and trailing sums by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pit, trailing
from tidemark.plans.comparables import COLS, DIFFERS, OUT, QUARTER, REPORTS, UNKNOWN, reports
from tidemark.plans.views import Views
from tidemark.registry import query

IDS = ", ".join(pit.MISMATCHES)


def _agree(a: str, b: str, upto: int = len(pit.MISMATCHES)) -> str:
    return " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in list(pit.MISMATCHES)[:upto])


def _meets(rows: str, lag: str, value: str, more: str = "") -> str:
    """Each row with the rows of another period: how many there are, how far they agree, and what fully agreeing ones say."""
    steps = "".join(f", bool_or({_agree('p', 'c', i + 1)}) AS m{i}" for i in range(len(pit.MISMATCHES)))
    return f"(SELECT c.*, count(p.pn) AS n{steps}, max(CASE WHEN {_agree('p', 'c')} THEN p.{value} END) AS base{more} FROM {rows} c LEFT JOIN {rows} p ON p.as_of = c.as_of AND p.code = c.code AND p.pn = c.pn - {lag} GROUP BY ALL)"


WHOLE = "duration = 'SINGLE_QUARTER' OR pn % 4 = 0"
SERIES = f"""{REPORTS}, rq AS (SELECT as_of, code, pn, report_type, available, update_flag, {IDS}, revenue FROM rep), rw AS (SELECT *, {QUARTER} AS reason FROM {_meets('rq', '1', 'revenue')}),
  se AS (SELECT as_of, code, pn, report_type, available, update_flag, CASE WHEN reason IS NULL THEN 'SINGLE_QUARTER' ELSE 'UNKNOWN' END AS duration, {IDS.removeprefix('duration, ')}, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN {WHOLE} THEN revenue ELSE revenue - base END AS x FROM rw)"""
GUARDS = "WHEN base > 0 AND x < 0 THEN 'sign_transition' WHEN base = 0 THEN 'invalid_denominator' WHEN base < 0 THEN 'negative_denominator'"


def series(v: Views) -> DataFrame:
    """Single quarters of all reports; they and the reports are read several times, and so written once."""
    v.keep("as_of")
    return v.once("quarter_series", lambda: trailing.quarter_series(v.once("reports", lambda: reports(v)), "revenue"))


def _growth_sql(lag: int) -> str:
    return f"gr AS (SELECT as_of, code, pn, report_type, {IDS}, x FROM se), gw AS (SELECT *, CASE {UNKNOWN} WHEN n = 0 THEN 'missing_comparable_period' {DIFFERS} WHEN base IS NULL OR x IS NULL THEN 'missing_value' {GUARDS} END AS reason FROM {_meets('gr', str(lag), 'x')})"


def _growth(name: str, lag: int) -> None:
    @query(name, f", {SERIES}, {_growth_sql(lag)} SELECT {COLS}, reason, round(CASE WHEN reason IS NULL THEN (x - base) / base END, 6) AS growth FROM gw")
    def run(v: Views) -> DataFrame:
        return trailing.growth_by_identity(series(v), lag).select(*OUT, "reason", F.round("growth", 6).alias("growth"))


_growth("P11_yoy_identity", 4)
_growth("P11_qoq_identity", 1)


def _margin_why(num: str, den: str) -> str:
    return f"CASE WHEN {num} IS NULL OR {den} IS NULL THEN 'missing_value' WHEN {den} = 0 THEN 'invalid_denominator' WHEN {den} < 0 THEN 'negative_denominator' END"


MARGINS = f"""mr AS (SELECT as_of, code, pn, report_type, {IDS}, profit, revenue, CASE WHEN revenue IS NOT NULL THEN struct_pack(profit := profit, revenue := revenue) ELSE struct_pack(profit := profit, revenue := CAST(NULL AS double)) END AS both FROM rep),
  mm AS (SELECT *, {_margin_why('profit', 'revenue')} AS why, {_margin_why('base.profit', 'base.revenue')} AS then_why FROM {_meets('mr', '4', 'both')}),
  mw AS (SELECT *, coalesce(why, CASE {UNKNOWN} END) AS margin_reason, coalesce(CASE {UNKNOWN} WHEN n = 0 THEN 'missing_comparable_period' {DIFFERS} END, why, then_why) AS change_reason FROM mm)"""


@query("P12_margin_identity", f""", {REPORTS}, {MARGINS}
  SELECT {COLS}, margin_reason, round(CASE WHEN margin_reason IS NULL THEN profit / revenue END, 6) AS margin, change_reason, round(CASE WHEN change_reason IS NULL THEN profit / revenue - base.profit / base.revenue END, 6) AS margin_change FROM mw""")
def p12_identity(v: Views) -> DataFrame:
    """Margins of reports, and their changes over a year within one identity."""
    v.keep("as_of")
    out = trailing.margin_by_identity(v.once("reports", lambda: reports(v)), "profit", "revenue")
    return out.select(*OUT, "margin_reason", F.round("margin", 6).alias("margin"), "change_reason", F.round("margin_change", 6).alias("margin_change"))


_POOL = ", ".join(f"bool_or({_agree('p', 'e', i + 1)}) AS m{i}" for i in range(len(pit.MISMATCHES)))


TTM = f"""kr AS (SELECT *, rank() OVER (PARTITION BY as_of, code, pn, {IDS} ORDER BY available DESC, coalesce(TRY_CAST(update_flag AS double), -1) DESC) AS rk FROM se WHERE reason IS NULL),
  kn AS (SELECT as_of, code, pn, {IDS}, CASE WHEN count(DISTINCT x) = 1 THEN max(x) END AS x, max(available) AS day FROM kr WHERE rk = 1 GROUP BY ALL),
  tq AS (SELECT e.as_of, e.code, e.pn, {', '.join('e.' + n for n in pit.MISMATCHES)}, o.k, t.x, t.day FROM kn e CROSS JOIN (SELECT unnest([3, 2, 1, 0]) AS k) o LEFT JOIN kn t ON t.as_of = e.as_of AND t.code = e.code AND t.pn = e.pn - o.k AND {_agree('t', 'e')}),
  ts AS (SELECT as_of, code, pn, {IDS}, count(x) AS held, sum(x) AS total, max(CASE WHEN x IS NULL THEN k END) AS lacking, CASE WHEN max(CASE WHEN k = 0 THEN x END) IS NULL THEN 0 WHEN max(CASE WHEN k = 1 THEN x END) IS NULL THEN 1 WHEN max(CASE WHEN k = 2 THEN x END) IS NULL THEN 2 WHEN max(CASE WHEN k = 3 THEN x END) IS NULL THEN 3 ELSE 4 END AS run,
      string_agg(pn - k, '|' ORDER BY k DESC) AS quarters FROM tq GROUP BY ALL),
  tl AS (SELECT e.as_of, e.code, e.pn, {', '.join('e.' + n for n in pit.MISMATCHES)}, count(p.pn) AS n, {_POOL} FROM ts e LEFT JOIN se p ON p.as_of = e.as_of AND p.code = e.code AND p.pn = e.pn - e.lacking WHERE e.lacking IS NOT NULL GROUP BY ALL),
  tw AS (SELECT s.as_of, s.code, s.pn, s.report_type, {', '.join('s.' + n for n in pit.MISMATCHES)}, t.total, t.held, t.run, t.quarters, l.pn AS lp, l.n, {', '.join(f'l.m{i}' for i in range(len(pit.MISMATCHES)))} FROM se s LEFT JOIN ts t ON t.as_of = s.as_of AND t.code = s.code AND t.pn = s.pn AND {_agree('t', 's')} LEFT JOIN tl l ON l.as_of = s.as_of AND l.code = s.code AND l.pn = s.pn AND {_agree('l', 's')})"""


@query("P13_ttm_identity", f""", {SERIES}, {TTM}
  SELECT {COLS}, coalesce(CASE {UNKNOWN} END, CASE WHEN lp IS NOT NULL THEN CASE WHEN n = 0 THEN 'missing_quarter' {DIFFERS} ELSE 'missing_quarter' END END) AS ttm_reason, round(CASE WHEN held = 4 THEN total END, 6) AS ttm, coalesce(run, 0) AS run, CASE WHEN held = 4 THEN quarters END AS source_quarters FROM tw""")
def p13_identity(v: Views) -> DataFrame:
    """Sums of four consecutive quarters of one identity, with what they draw on; run is told up to four."""
    out = trailing.trailing_by_identity(series(v))
    return out.select(*OUT, "ttm_reason", F.round("ttm", 6).alias("ttm"), F.least("run", F.lit(4)).alias("run"), "source_quarters")


METRICS = f"""ob AS (SELECT as_of, code, pn, {IDS}, 'level' AS metric, x AS value FROM se UNION ALL SELECT as_of, code, pn, {IDS}, 'yoy', CASE WHEN reason IS NULL THEN (x - base) / base END FROM gw
    UNION ALL SELECT as_of, code, pn, {IDS}, 'margin', CASE WHEN margin_reason IS NULL THEN profit / revenue END FROM mw UNION ALL SELECT as_of, code, pn, {IDS}, 'ttm', CASE WHEN held = 4 THEN total END FROM tw),
  oc AS (SELECT as_of, code, pn, {IDS}, metric, max(value) AS value FROM ob WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT round(value, 9)) = 1),
  oj AS (SELECT c.*, p.value AS prev FROM oc c LEFT JOIN oc p ON p.as_of = c.as_of AND p.code = c.code AND p.pn = c.pn - 1 AND p.metric = c.metric AND {_agree('p', 'c')})"""


@query("X06_states", f", {SERIES}, {_growth_sql(4)}, {MARGINS}, {TTM}, {METRICS} SELECT as_of, code, pn, {IDS}, metric, CASE WHEN prev IS NULL THEN 'INSUFFICIENT' WHEN round(value - prev, 9) > 0 THEN CASE WHEN prev < 0 AND value > 0 THEN 'STRONG_TURNAROUND' ELSE 'IMPROVING' END WHEN round(value - prev, 9) < 0 THEN 'DETERIORATING' ELSE 'STABLE' END AS state FROM oj")
def x06_states(v: Views) -> DataFrame:
    """What each metric of a report's identity says of a turnaround: level, growth, margin and trailing sum, each against the quarter before."""
    se = series(v)
    ids = ["as_of", "code", "pn", *pit.MISMATCHES]
    named = lambda df, name, value: df.select(*ids, F.lit(name).alias("metric"), F.col(value).alias("value"))
    parts = [named(se, "level", "quarter_value"), named(trailing.growth_by_identity(se, 4), "yoy", "growth"), named(trailing.margin_by_identity(v.once("reports", lambda: reports(v)), "profit", "revenue"), "margin", "margin"), named(trailing.trailing_by_identity(se), "ttm", "ttm")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keys = [*ids, "metric"]
    one = v.written(rows.where("value is not null").groupBy(*keys).agg(F.count_distinct(F.round("value", 9)).alias("n"), F.max("value").alias("value")).where("n = 1").drop("n"), "observations")
    prev = one.withColumn("pn", F.col("pn") + 1).withColumnRenamed("value", "prev")
    change = F.round(F.col("value") - F.col("prev"), 9)
    up = F.when((F.col("prev") < 0) & (F.col("value") > 0), "STRONG_TURNAROUND").otherwise("IMPROVING")
    state = F.when(F.col("prev").isNull(), "INSUFFICIENT").when(change > 0, up).when(change < 0, "DETERIORATING").otherwise("STABLE")
    return one.join(prev, keys, "left").select(*keys, state.alias("state"))
