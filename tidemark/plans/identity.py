"""Queries on what a reported row is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import date_text, finite, fiscal_period, period_number
from tidemark.functions import identity as I
from tidemark.plans.views import Views
from tidemark.registry import query

#: Texts as sources write them, and what each means.
DURATIONS = {
    "Single-Quarter": "SINGLE_QUARTER", "quarterly": "SINGLE_QUARTER", "Quarter": "SINGLE_QUARTER", "single": "SINGLE_QUARTER", "single_quarter value": "SINGLE_QUARTER",
    "cumulative_ytd": "CUMULATIVE_YTD", "Cumulative": "CUMULATIVE_YTD", "YTD": "CUMULATIVE_YTD", "year-to-date": "CUMULATIVE_YTD", "annual": "CUMULATIVE_YTD", "FY": "CUMULATIVE_YTD", "year to date sum": "CUMULATIVE_YTD", "flow ytd": "CUMULATIVE_YTD",
    "point in time": "POINT_IN_TIME", "Point": "POINT_IN_TIME", "stock": "POINT_IN_TIME", "snapshot": "POINT_IN_TIME", "instant": "POINT_IN_TIME", "end snapshot": "POINT_IN_TIME", "unknown": "UNKNOWN", "n/a": "UNKNOWN", "other": "UNKNOWN",
}
FLAGS = {"1": True, "TRUE": True, "yes": True, "0": False, "no": False, "maybe": None}
SCOPES = {"合并": "consolidated", "合并报表": "consolidated", "Consolidated": "consolidated", "consolidation": "consolidated", "parent": "parent_only", "Parent Only": "parent_only", "parent-company": "parent_only", "母公司": "parent_only", "Raw:Branch": "raw:branch", "Branch  Office": "raw:branch office", "unsupported": "UNKNOWN", "source_default": "source_default", " nan ": None}
UNITS = {"RMB": "cny:1", "cny": "cny:1", "元": "cny:1", "千元": "cny:1000", "in thousand CNY": "cny:1000", "Million RMB": "cny:1000000", "百万元": "cny:1000000", "million-cny (rounded)": "cny:1000000", "CNY:10": "cny:10", "raw:lots": "raw:lots", "Lots of it": "raw:lots of it", "na": "UNKNOWN", "source default": "source_default"}
BASES = {"IFRS": "raw:ifrs", "raw:gaap": "raw:gaap", "NA": "UNKNOWN", "source-default": "source_default"}
FAMILIES = {"Report-Type:7": "report_type:7", "raw:x": "raw:x", "Own Family": "raw:own family", "unknown": "UNKNOWN"}
STATEMENTS = {" Notes ": "Notes", "unsupported": "UNKNOWN"}


def pick(words: Iterable[str], number: str, gap: int) -> str:
    """SQL that deals words by a number; `gap` more numbers get none."""
    words = list(words)
    return f"CASE ({number}) % {len(words) + gap} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def meaning(column: str, words: dict, otherwise: str = "NULL") -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {text(m)}" for k, m in words.items()) + f" ELSE {otherwise} END"


WORDS = f"""SELECT code, yr, q, update_flag, ann_date, end_date, CASE WHEN (code + q) % 10 < 9 THEN CAST((code + q) % 10 AS varchar(2)) || '.0' END AS report_type,
  {pick(DURATIONS, "code * 5 + yr * 3 + q", 20)} AS dur, {pick(FLAGS, "code * 3 + yr + q * 5", 14)} AS single_flag, {pick(FLAGS, "code * 7 + yr + q * 2", 22)} AS ytd_flag,
  {pick(SCOPES, "code * 3 + yr * 7 + q", 9)} AS sc, {pick(FLAGS, "code * 11 + yr * 2 + q", 25)} AS con, {pick(UNITS, "code * 2 + yr * 5 + q", 4)} AS un, {pick(BASES, "code + yr + q", 9)} AS acct,
  {pick(BASES, "code + yr * 2 + q", 23)} AS acct2, {pick(FAMILIES, "code * 2 + yr + q", 11)} AS fam, {pick(STATEMENTS, "code + yr * 3 + q", 9)} AS stm, CASE WHEN q % 2 = 0 THEN make_date(yr, q * 3 - 2, 1) WHEN code % 3 = 0 THEN make_date(yr, 1, 1) END AS start FROM income"""
FLAG = {k: "yes" if m else "no" if m is False else "odd" for k, m in FLAGS.items()}
#: What is said, each part by its own; two parts that differ make UNKNOWN.
KINDS = f"""rr AS ({WORDS.replace("varchar(2)", "text")}), kd AS (SELECT *, CASE WHEN replace(report_type, '.0', '') IN ('2', '3', '7', '8') THEN 'SINGLE_QUARTER' WHEN replace(report_type, '.0', '') IN ('1', '4', '5', '6') THEN 'CUMULATIVE_YTD' END AS typed,
    list_distinct(list_filter([{meaning("dur", DURATIONS)}, CASE {meaning("single_flag", FLAG)} WHEN 'yes' THEN 'SINGLE_QUARTER' WHEN 'no' THEN 'CUMULATIVE_YTD' WHEN 'odd' THEN 'UNKNOWN' END, CASE {meaning("ytd_flag", FLAG)} WHEN 'yes' THEN 'CUMULATIVE_YTD' WHEN 'no' THEN 'SINGLE_QUARTER' WHEN 'odd' THEN 'UNKNOWN' END], lambda x: x IS NOT NULL)) AS durs,
    list_distinct(list_filter([{meaning("sc", SCOPES)}, CASE {meaning("con", FLAG)} WHEN 'yes' THEN 'consolidated' WHEN 'no' THEN 'parent_only' WHEN 'odd' THEN 'UNKNOWN' END], lambda x: x IS NOT NULL)) AS scopes,
    list_distinct(list_filter([{meaning("acct", BASES)}, {meaning("acct2", BASES)}], lambda x: x IS NOT NULL)) AS bases FROM rr),
  kk AS (SELECT *, CASE WHEN len(durs) > 1 THEN 'UNKNOWN' WHEN len(durs) = 1 THEN CASE WHEN typed <> durs[1] THEN 'UNKNOWN' ELSE durs[1] END
      ELSE coalesce(typed, CASE WHEN start = make_date(yr, 1, 1) THEN 'CUMULATIVE_YTD' WHEN start IS NOT NULL THEN 'SINGLE_QUARTER' END, 'CUMULATIVE_YTD') END AS duration,
    CASE WHEN len(durs) = 0 OR (len(durs) = 1 AND durs[1] = 'POINT_IN_TIME' AND typed IS NULL) THEN 'POINT_IN_TIME' ELSE 'UNKNOWN' END AS balance_duration,
    CASE WHEN len(scopes) > 1 THEN 'UNKNOWN' WHEN len(scopes) = 1 THEN scopes[1] WHEN replace(report_type, '.0', '') IN ('1', '2', '3', '4') THEN 'consolidated' WHEN replace(report_type, '.0', '') IN ('5', '6', '7', '8') THEN 'parent_only' ELSE 'source_default' END AS scope,
    {meaning("un", UNITS, "'source_default'")} AS unit, CASE WHEN len(bases) > 1 THEN 'UNKNOWN' WHEN len(bases) = 1 THEN bases[1] ELSE 'source_default' END AS accounting,
    {meaning("fam", FAMILIES, "coalesce('report_type:' || replace(report_type, '.0', ''), 'source_default')")} AS family, {meaning("stm", STATEMENTS, "'INCOME_STATEMENT'")} AS statement FROM kd)"""


def said(v: Views) -> DataFrame:
    return v.run(WORDS)


def kinds(v: Views) -> DataFrame:
    c = F.col
    by = ([c("dur")], c("report_type"), c("start"), c("yr"), c("q"), [c("single_flag")], [c("ytd_flag")])
    parts = {"duration": I.duration("income", *by), "balance_duration": I.duration("balancesheet", *by), "scope": I.scope([c("sc")], c("report_type"), [c("con")]), "unit": I.unit(c("un"))}
    return said(v).withColumns(parts | {"accounting": I.accounting(c("acct"), c("acct2")), "family": I.family(c("report_type"), c("fam")), "statement": I.statement("income", c("stm"))})


@query("F03_date_text", " SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def f03(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", date_text(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query("F11_duration", f", {KINDS} SELECT code, yr, q, update_flag, duration, balance_duration FROM kk")
def f11(v: Views) -> DataFrame:
    return kinds(v).select("code", "yr", "q", "update_flag", "duration", "balance_duration")


@query("F12_scope_unit", f", {KINDS} SELECT code, yr, q, update_flag, scope, unit, family, accounting, statement FROM kk")
def f12(v: Views) -> DataFrame:
    return kinds(v).select("code", "yr", "q", "update_flag", "scope", "unit", "family", "accounting", "statement")


ORDER = ("duration", "family", "statement", "scope", "unit", "accounting")


@query("F14_canonical", f", {KINDS} SELECT code, yr, q, update_flag, ann_date AS available, CASE WHEN (code + q) % 13 = 0 THEN 'unknown_period' {' '.join(f"WHEN {c} = 'UNKNOWN' THEN 'unknown_{c}'" for c in ORDER)} END AS reason, CASE WHEN (code + q) % 13 <> 0 AND 'UNKNOWN' NOT IN ({', '.join(ORDER)}) THEN concat_ws('|', yr, q, {', '.join(ORDER)}) END AS period_key FROM kk")
def f14(v: Views) -> DataFrame:
    """Availability, period and identity of each row, and the first thing that isn't known of it; some rows end on a day that ends no quarter."""
    c = F.col
    rows = kinds(v)
    text = F.date_format(F.when((c("code") + c("q")) % 13 == 0, F.date_sub("end_date", 1)).otherwise(c("end_date")), "yyyyMMdd")
    end, _ = fiscal_period(text)
    why = I.first_problem(period=end.cast("string"), **{k: c(k) for k in ORDER})
    key = F.concat_ws("|", F.year(end), F.quarter(end), *ORDER)
    return rows.withColumn("reason", why).select("code", "yr", "q", "update_flag", c("ann_date").alias("available"), "reason", F.when(c("reason").isNull(), key).alias("period_key"))


@query("F04_finite", " SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS number FROM events")
def f04(v: Views) -> DataFrame:
    """Numbers from texts, some of which are infinite, not a number or no number at all."""
    odd = F.element_at(F.array(*map(F.lit, ("inf", "-Infinity", "NaN", "none", ""))), (F.col("event_id") / 5 % 5 + 1).cast("int"))
    text = F.when(F.col("event_id") % 5 == 0, odd).otherwise(F.col("value").cast("string"))
    return v.events.select("event_id", F.round(finite(text), 6).alias("number"))


@query("F19_period_number", " SELECT code, yr, q, pn AS number, lead(pn) OVER (PARTITION BY code ORDER BY pn) = pn + 1 AS goes_on FROM q_first")
def f19(v: Views) -> DataFrame:
    """The number of each reported quarter, and whether the next one is reported too."""
    number = period_number(F.col("yr"), F.col("q"))
    w = Window.partitionBy("code").orderBy("number")
    return v.q_first.select("code", "yr", "q", number.alias("number")).withColumn("goes_on", F.lead("number").over(w) == F.col("number") + 1)
