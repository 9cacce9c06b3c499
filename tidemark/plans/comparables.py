"""Queries on reports told apart by identity: selection, comparable periods and single quarters with every reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans.views import Views
from tidemark.registry import query

KEYS = ("code", "end_date", "report_family", "statement_type", "duration", "scope", "unit", "accounting", "report_type")
REPORTS = f"""rep AS (SELECT * EXCLUDE (rn) FROM (SELECT a.as_of, f.*, row_number() OVER (PARTITION BY a.as_of, {", ".join("f." + k for k in KEYS)}
  ORDER BY available DESC, notice DESC NULLS LAST, coalesce(TRY_CAST(update_flag AS double), -1) DESC, ord DESC) AS rn FROM as_of a JOIN filings f ON f.available <= a.as_of) WHERE rn = 1)"""


def reports(v: Views) -> DataFrame:
    return pit.as_of_identity(v.filings, v.as_of.select("as_of"))


OUT = ("as_of", "code", "pn", "report_type", "duration", "report_family", "scope", "unit", "accounting")
COLS = ", ".join(OUT)


@query("P01_as_of_identity", f", {REPORTS} SELECT {COLS}, available, update_flag, round(revenue, 6) AS revenue FROM rep")
def p01_identity(v: Views) -> DataFrame:
    return reports(v).select(*OUT, "available", "update_flag", F.round("revenue", 6).alias("revenue"))


def _chain(lag: str) -> str:
    """For each row, how far the rows of the other period agree with it, tried one column after the other."""
    names = list(pit.MISMATCHES)
    steps = "".join(f", bool_or({' AND '.join(f'p.{n} IS NOT DISTINCT FROM c.{n}' for n in names[: i + 1])}) AS m{i}" for i in range(len(names)))
    full = " AND ".join(f"p.{n} IS NOT DISTINCT FROM c.{n}" for n in names)
    return f"""mt AS (SELECT c.as_of, c.code, c.pn, c.report_type, c.duration, c.report_family, c.statement_type, c.scope, c.unit, c.accounting, c.revenue, count(p.pn) AS n{steps},
      max(CASE WHEN {full} THEN p.revenue END) AS base FROM rep c LEFT JOIN rep p ON p.as_of = c.as_of AND p.code = c.code AND p.pn = c.pn - {lag} GROUP BY ALL)"""


UNKNOWN = " ".join(f"WHEN {n} = 'UNKNOWN' THEN '{why}'" for n, why in pit.UNKNOWN_PARTS.items())
DIFFERS = " ".join(f"WHEN NOT m{i} THEN '{why}'" for i, why in enumerate(pit.MISMATCHES.values()))


def _match(name: str, lag: int) -> None:
    refused = "WHEN duration = 'CUMULATIVE_YTD' THEN 'qoq_requires_validated_single_quarter'" if lag == 1 else ""
    why = f"CASE {UNKNOWN} {refused} WHEN n = 0 THEN 'missing_comparable_period' {DIFFERS} WHEN base IS NULL OR revenue IS NULL THEN 'missing_value' WHEN base > 0 AND revenue < 0 THEN 'sign_transition' WHEN base = 0 THEN 'invalid_denominator' WHEN base < 0 THEN 'negative_denominator' END"

    @query(name, f", {REPORTS}, {_chain(str(lag))}, w AS (SELECT *, {why} AS reason FROM mt) SELECT {COLS}, reason, round(CASE WHEN reason IS NULL THEN (revenue - base) / base END, 6) AS growth FROM w")
    def run(v: Views) -> DataFrame:
        v.keep("as_of")
        return pit.match_comparable(v.once("reports", lambda: reports(v)), "revenue", lag).select(*OUT, "reason", F.round("growth", 6).alias("growth"))


_match("P08_match_yoy", 4)
_match("P08_match_qoq", 1)

QUARTER = f"""CASE {UNKNOWN} WHEN duration NOT IN ('CUMULATIVE_YTD', 'SINGLE_QUARTER') THEN 'unsupported_duration_semantics'
  WHEN pn % 4 <> 0 AND duration <> 'SINGLE_QUARTER' THEN CASE WHEN n = 0 THEN 'missing_preceding_cumulative_period' {DIFFERS} WHEN base IS NULL OR revenue IS NULL THEN 'missing_value' END WHEN revenue IS NULL THEN 'missing_value' END"""


@query("P09_quarters_identity", f", {REPORTS}, {_chain('1')}, w AS (SELECT *, {QUARTER} AS reason, duration = 'SINGLE_QUARTER' OR pn % 4 = 0 AS whole FROM mt) SELECT {COLS}, reason, round(CASE WHEN reason IS NOT NULL THEN NULL WHEN whole THEN revenue ELSE revenue - base END, 6) AS quarter_value, CASE WHEN reason IS NULL THEN CASE WHEN whole THEN pn::varchar ELSE concat_ws('|', pn, pn - 1) END END AS source_periods FROM w")
def p09_identity(v: Views) -> DataFrame:
    v.keep("as_of")
    return pit.quarters_by_identity(v.once("reports", lambda: reports(v)), "revenue").select(*OUT, "reason", F.round("quarter_value", 6).alias("quarter_value"), "source_periods")


@query("P06_latest_identity", f", {REPORTS}, l AS (SELECT *, rank() OVER (PARTITION BY as_of, code ORDER BY pn DESC) AS r FROM rep) SELECT as_of, code, pn, CASE WHEN count(DISTINCT (coalesce(report_type, ''), duration, report_family, statement_type, scope, unit, accounting)) > 1 THEN 'ambiguous_period_chain' END AS reason, round(CASE WHEN count(DISTINCT (coalesce(report_type, ''), duration, report_family, statement_type, scope, unit, accounting)) = 1 THEN max(revenue) END, 6) AS revenue FROM l WHERE r = 1 GROUP BY as_of, code, pn")
def p06_identity(v: Views) -> DataFrame:
    """The latest period, if only one identity tells of it."""
    rows = reports(v)
    kind = F.struct(F.coalesce("report_type", F.lit("")), *pit.MISMATCHES)
    per = rows.groupBy("as_of", "code", "pn").agg(F.count_distinct(kind).alias("n"), F.max("revenue").alias("r"))
    return pit.latest(per, ["as_of", "code"], "pn").select("as_of", "code", "pn", F.when(F.col("n") > 1, "ambiguous_period_chain").alias("reason"), F.round(F.when(F.col("n") == 1, F.col("r")), 6).alias("revenue"))


@query("P26_source_records", f", {REPORTS}, s AS (SELECT * FROM rep WHERE scope = 'consolidated' AND revenue IS NOT NULL) SELECT as_of, code, pn, string_agg(concat_ws(':', pn, coalesce(update_flag, '-'), strftime(available, '%Y%m%d'), CAST(round(revenue) AS bigint)), '|' ORDER BY pn, report_type NULLS FIRST, duration, unit, report_family, accounting) OVER (PARTITION BY as_of, code ORDER BY pn RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS chain FROM s")
def p26_records(v: Views) -> DataFrame:
    """Period, version, day and value of all that a trailing sum draws on, in order."""
    w = Window.partitionBy("as_of", "code").orderBy("pn").rangeBetween(-3, 0)
    record = F.concat_ws(":", "pn", F.coalesce("update_flag", F.lit("-")), F.date_format("available", "yyyyMMdd"), F.round("revenue").cast("long"))
    rows = reports(v).where("scope = 'consolidated' and revenue is not null")
    chain = F.array_sort(F.collect_list(F.struct("pn", "report_type", "duration", "unit", "report_family", "accounting", record.alias("record"))).over(w))
    return rows.select("as_of", "code", "pn", F.array_join(chain["record"], "|").alias("chain"))
