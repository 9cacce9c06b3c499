"""Queries on observations, trends and feature groups by identity: two series, six metrics, one chain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import observed, pit
from tidemark.plans.comparables import DIFFERS, UNKNOWN, reports
from tidemark.plans.trailing import IDS, MARGINS, SERIES, TTM, _growth_sql
from tidemark.plans.views import Views
from tidemark.registry import query

VALUES = ("revenue", "profit")
# in SQL each report is told twice, under an even number for revenue and the odd one after it for profit
TWICE = "rep AS (SELECT * REPLACE (code * 2 AS code) FROM rep0 UNION ALL SELECT * REPLACE (code * 2 + 1 AS code, profit AS revenue) FROM rep0)"
LONG = SERIES.replace("rep AS (", "rep0 AS (", 1).replace(", rq AS", f", {TWICE}, rq AS", 1)
QOQ = re.sub(r"\bgw\b", "hw", re.sub(r"\bgr\b", "hr", _growth_sql(1)))
TTM_WHY = f"coalesce(CASE {UNKNOWN} END, CASE WHEN lp IS NOT NULL THEN CASE WHEN n = 0 THEN 'missing_quarter' {DIFFERS} ELSE 'missing_quarter' END END)"
OBS = f"""{LONG}, {_growth_sql(4)}, {QOQ}, {TTM}, {MARGINS}, oa AS (
    SELECT as_of, code, pn, report_type, {IDS}, 'level' AS metric, x AS value, reason FROM se
    UNION ALL SELECT as_of, code, pn, report_type, {IDS}, 'yoy', CASE WHEN reason IS NULL THEN (x - base) / base END, reason FROM gw
    UNION ALL SELECT as_of, code, pn, report_type, {IDS}, 'qoq', CASE WHEN reason IS NULL THEN (x - base) / base END, reason FROM hw
    UNION ALL SELECT as_of, code, pn, report_type, {IDS}, 'ttm', CASE WHEN held = 4 THEN total END, {TTM_WHY} FROM tw
    UNION ALL SELECT as_of, code + 1, pn, report_type, {IDS}, 'margin', CASE WHEN margin_reason IS NULL THEN profit / revenue END, margin_reason FROM mw WHERE code % 2 = 0
    UNION ALL SELECT as_of, code + 1, pn, report_type, {IDS}, 'margin_change', CASE WHEN change_reason IS NULL THEN profit / revenue - base.profit / base.revenue END, change_reason FROM mw WHERE code % 2 = 0),
  og AS (SELECT as_of, code // 2 AS code, CASE WHEN code % 2 = 0 THEN 'revenue' ELSE 'profit' END AS series, metric, pn, report_type, {IDS}, min(round(value, 6)) AS a, max(round(value, 6)) AS b, min(reason) AS why FROM oa GROUP BY ALL),
  ox AS (SELECT * EXCLUDE (a, b, why), CASE WHEN a = b THEN a END AS value, CASE WHEN a <> b THEN 'ambiguous_observation' WHEN b IS NULL THEN why END AS reason FROM og)"""


def observations(v: Views) -> DataFrame:
    v.keep("as_of")
    known = v.once("reports", lambda: reports(v))
    quarters = v.once("quarter_rows", lambda: observed.quarter_rows(known, VALUES))
    return v.once("observed", lambda: observed.observations(quarters, known, "profit", "revenue"))


COLS = f"as_of, code, series, metric, pn, report_type, {IDS}"


@query("X05_observations_identity", f", {OBS} SELECT {COLS}, value, reason FROM ox")
def x05_identity(v: Views) -> DataFrame:
    """Level, growth on the year and the quarter, trailing sum, margin and its change, by identity, each with its reason."""
    return observations(v).select("as_of", "code", "series", "metric", "pn", *observed.IDENTITY, "value", "reason")


CHAIN = f"PARTITION BY as_of, code, series, metric, report_type, {IDS}"
TREND = f"""t1 AS (SELECT *, pn - lag(pn) OVER w AS gap, CASE WHEN pn - lag(pn) OVER w = 1 THEN value - lag(value) OVER w END AS c FROM ox WHERE value IS NOT NULL WINDOW w AS ({CHAIN} ORDER BY pn)),
  t2 AS (SELECT *, CASE WHEN gap = 1 THEN lag(c) OVER ({CHAIN} ORDER BY pn) END AS pc FROM t1),
  t3 AS (SELECT *, sum(CASE WHEN gap = 1 AND sign(c) = sign(pc) AND c <> 0 THEN 0 ELSE 1 END) OVER ({CHAIN} ORDER BY pn) AS run FROM t2),
  t4 AS (SELECT *, CASE WHEN c IS NULL OR c = 0 THEN 0 ELSE row_number() OVER ({CHAIN}, run ORDER BY pn) END AS length, count(*) OVER ({CHAIN}) AS n FROM t3)"""


@query("X04_trend_identity", f", {OBS}, {TREND} SELECT {COLS}, n, value, round(c, 6) AS change, round(c - pc, 6) AS acceleration, length, CASE WHEN c > 0 THEN 'up' WHEN c < 0 THEN 'down' WHEN c = 0 THEN 'flat' ELSE 'unknown' END AS direction FROM t4 QUALIFY row_number() OVER ({CHAIN} ORDER BY pn DESC) = 1")
def x04_identity(v: Views) -> DataFrame:
    """Where each identity's metrics are heading at their latest known value."""
    out = observed.trends(observations(v))
    return out.withColumns({c: F.round(c, 6) for c in ("change", "acceleration")}).select("as_of", "code", "series", "metric", "pn", *observed.IDENTITY, "n", "value", "change", "acceleration", "length", "direction")


@query("X03_group_identity", f", {OBS} SELECT as_of, code, series, metric, pn, CASE WHEN count(*) = 1 THEN max(value) END AS value, CASE WHEN count(*) = 1 THEN max(reason) ELSE 'ambiguous_period_chain' END AS reason FROM (SELECT * FROM ox QUALIFY rank() OVER (PARTITION BY as_of, code, series, metric ORDER BY pn DESC) = 1) GROUP BY as_of, code, series, metric, pn")
def x03_identity(v: Views) -> DataFrame:
    """The features of every entity at their latest period, unknown where several identities tell of it."""
    return observed.latest_group(observations(v))


@query("G14_identity_coverage", f""", {OBS}, lg AS (SELECT as_of, code, series, metric, pn, CASE WHEN count(*) = 1 THEN max(reason) ELSE 'ambiguous_period_chain' END AS reason FROM (SELECT * FROM ox QUALIFY rank() OVER (PARTITION BY as_of, code, series, metric ORDER BY pn DESC) = 1) GROUP BY as_of, code, series, metric, pn)
  SELECT as_of, series, metric, coalesce(reason, 'known') AS outcome, count(*) AS n FROM lg GROUP BY ALL""")
def g14_identity(v: Views) -> DataFrame:
    """How many entities know each feature on each date, and what the others lack."""
    return observed.latest_group(observations(v)).groupBy("as_of", "series", "metric", F.coalesce("reason", F.lit("known")).alias("outcome")).agg(F.count("*").alias("n"))
