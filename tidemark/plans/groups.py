"""Queries on the whole group of fundamental features by identity, and the component that is the mean of six of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bounded, mean_known
from tidemark.operators import fundamental as G
from tidemark.operators import pit
from tidemark.plans.comparables import DIFFERS, KEYS, REPORTS, UNKNOWN
from tidemark.plans.trailing import GUARDS, IDS, SERIES, _agree, _growth_sql, _margin_why
from tidemark.plans.views import Views
from tidemark.registry import query

HOME = {x: d for d, names in G.DATASETS.items() for x in names}
FILED = f"""fd AS (SELECT * EXCLUDE (rn) FROM (SELECT a.as_of, f.*, row_number() OVER (PARTITION BY a.as_of, f.dataset, {", ".join("f." + k for k in KEYS)}
  ORDER BY available DESC, notice DESC NULLS LAST, coalesce(TRY_CAST(update_flag AS double), -1) DESC, ord DESC) AS rn FROM as_of a JOIN filed f ON f.available <= a.as_of) WHERE rn = 1)"""
# single quarters and their growth come from the text for revenue, over reports of cash flow that call it so
CASH = SERIES.replace(REPORTS, f"{FILED}, rep AS (SELECT * REPLACE (cfo AS revenue) FROM fd WHERE dataset = 'cashflow')")
STEPS = ", ".join(f"bool_or({_agree('p', 'c', i + 1)}) AS m{i}" for i in range(len(pit.MISMATCHES)))
LAST = f"""la AS (SELECT as_of, code, dataset, pn, count(DISTINCT ({IDS})) = 1 AS one, {", ".join(f"max({x}) AS {x}" for x in (*pit.MISMATCHES, *G.VALUES))} FROM (SELECT *, rank() OVER (PARTITION BY as_of, code, dataset ORDER BY pn DESC) AS r FROM fd) WHERE r = 1 GROUP BY ALL),
  lm AS (SELECT c.*, count(p.pn) AS n, {STEPS}, {", ".join(f"max(CASE WHEN {_agree('p', 'c')} THEN p.{x} END) AS t_{x}" for x in G.VALUES)} FROM la c LEFT JOIN fd p ON p.as_of = c.as_of AND p.code = c.code AND p.dataset = c.dataset AND p.pn = c.pn - 4 GROUP BY ALL),
  lw AS (SELECT *, CASE {UNKNOWN} END AS unknown, CASE {UNKNOWN} WHEN n = 0 THEN 'missing_comparable_period' {DIFFERS} END AS before FROM lm),
  en AS (SELECT DISTINCT as_of, code FROM la), sides AS (SELECT e.as_of, e.code, i AS income, c AS cashflow, b AS balancesheet FROM en e LEFT JOIN lw i ON i.as_of = e.as_of AND i.code = e.code AND i.dataset = 'income' LEFT JOIN lw c ON c.as_of = e.as_of AND c.code = e.code AND c.dataset = 'cashflow' LEFT JOIN lw b ON b.as_of = e.as_of AND b.code = e.code AND b.dataset = 'balancesheet'),
  cg AS (SELECT g.as_of, g.code, max(CASE WHEN g.reason IS NULL THEN (g.x - g.base) / g.base END) AS growth, max(coalesce(s.reason, g.reason)) AS why FROM gw g JOIN la l ON l.as_of = g.as_of AND l.code = g.code AND l.pn = g.pn AND l.dataset = 'cashflow' AND l.one JOIN se s ON s.as_of = g.as_of AND s.code = g.code AND s.pn = g.pn GROUP BY 1, 2)"""


def _now(x: str) -> str:
    return f"{HOME[x]}.{x}"


def _then(x: str) -> str:
    return f"{HOME[x]}.t_{x}"


def _many(d: str) -> str:
    return f"CASE WHEN NOT {d}.one THEN 'ambiguous_period_chain' END"


def _lacks(*xs: str) -> str:
    return ", ".join([_many(HOME[xs[0]]), *[f"CASE WHEN {_now(x)} IS NULL THEN 'missing_value' END" for x in xs]])


def _growth_why(x: str) -> str:
    return f"CASE WHEN {_now(x)} IS NULL OR {_then(x)} IS NULL THEN 'missing_value' {GUARDS.replace('base', _then(x)).replace(' x ', f' {_now(x)} ')} END"


def _aligned(d: str) -> str:
    same = " AND ".join(f"income.{c} IS NOT DISTINCT FROM {d}.{c}" for c in G.ALIKE)
    return f"coalesce(income.one AND {d}.one AND income.pn = {d}.pn AND {same} AND (income.duration = {d}.duration OR income.duration = 'POINT_IN_TIME' OR {d}.duration = 'POINT_IN_TIME'), false)"


def _features() -> dict[str, tuple[str, str]]:
    """Each feature's value and the first reason against it, as SQL over the three statements."""
    out = {n: (_now(x), f"coalesce({_lacks(x)})") for n, x in G.LEVELS.items()}
    out |= {n: (f"({_now(x)} - {_then(x)}) / {_then(x)}", f"coalesce({_lacks(x)}, {HOME[x]}.before, {_growth_why(x)})") for n, x in G.GROWTHS.items()}
    for n, x in G.MARGINS.items():
        why, old = _margin_why(_now(x), "income.revenue"), _margin_why(_then(x), "income.t_revenue")
        out[n] = f"{_now(x)} / income.revenue", f"coalesce({_lacks(x, 'revenue')}, {why}, income.unknown)"
        out[n + "_yoy_change"] = f"{_now(x)} / income.revenue - {_then(x)} / income.t_revenue", f"coalesce({_lacks(x, 'revenue')}, income.before, {why}, {old})"
    out["operating_cash_flow_change"] = "cg.growth", f"coalesce({_many('cashflow')}, CASE WHEN cashflow IS NULL THEN 'missing_value' END, cg.why)"
    for n, (x, y) in G.RATIOS.items():
        other = "balancesheet" if "balancesheet" in (HOME[x], HOME[y]) else "cashflow"
        lost = f"{_many(other)}, CASE WHEN {other} IS NULL THEN 'missing_current_period' END, " if other == "balancesheet" else ""
        out[n] = f"{_now(x)} / {_now(y)}", f"CASE WHEN NOT {_aligned(other)} THEN coalesce({lost}'period_alignment_mismatch') WHEN {_now(y)} = 0 THEN 'invalid_denominator' WHEN {_now(x)} IS NULL OR {_now(y)} IS NULL THEN 'missing_value' END"
    return out | {"fundamental_data_status": ("1.0", "CASE WHEN income IS NULL THEN 'no_income_history' END")}


GROUP = f"""{CASH}, {_growth_sql(1)}, {LAST}, fg AS ({' UNION ALL '.join(
    f"SELECT s.as_of, s.code, '{n}' AS feature, CASE WHEN ({why}) IS NULL THEN {value} END AS value, {why} AS reason FROM sides s LEFT JOIN cg ON cg.as_of = s.as_of AND cg.code = s.code" for n, (value, why) in _features().items())})"""


def group(v: Views) -> DataFrame:
    """The group of every entity on every date; reports are read three times, and so written once."""
    v.keep("as_of")
    reports = v.once("filed_reports", lambda: pit.as_of(v.filed, v.as_of.select("as_of"), [*KEYS, "dataset"], "available", [F.col("notice").asc_nulls_first(), F.coalesce(F.col("update_flag").try_cast("double"), F.lit(-1.0)), F.col("ord")]))
    return G.fundamental_group(reports)


@query("X03_features_identity", f", {GROUP} SELECT as_of, code, feature, round(value, 6) AS value, reason FROM fg")
def x03_features(v: Views) -> DataFrame:
    """All twenty fundamental features at the latest period, compared within one identity and across aligned statements."""
    return group(v).select("as_of", "code", "feature", F.round("value", 6).alias("value"), "reason")


INPUTS = {"revenue_yoy": 1.5, "net_profit_yoy": 1.5, "operating_profit_yoy": 1.5, **dict.fromkeys(G.MARGINS, 2.0)}


@query("X14_fundamental_identity", f""", {GROUP} SELECT as_of, code, count(value) AS known, string_agg(feature, '|' ORDER BY feature) FILTER (value IS NULL) AS missing, round(avg(50 + 50 * tanh(value * CASE {' '.join(f"WHEN feature = '{n}' THEN {k}" for n, k in INPUTS.items())} END)), 4) AS fundamental
  FROM fg WHERE feature IN ({', '.join(f"'{n}'" for n in INPUTS)}) GROUP BY as_of, code""")
def x14_identity(v: Views) -> DataFrame:
    """The fundamental component as the mean of what is known of its six inputs, each by identity, with those that lack."""
    of = {n: F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in INPUTS}
    rows = group(v).where(F.col("feature").isin(*INPUTS)).groupBy("as_of", "code").agg(*of.values())
    lack = F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in INPUTS]), lambda x: x.isNotNull())), "|")
    known = sum((F.col(n).isNotNull().cast("long") for n in INPUTS), F.lit(0).cast("long"))
    return rows.select("as_of", "code", known.alias("known"), F.when(lack != "", lack).alias("missing"), F.round(mean_known(*[bounded(F.col(n), k) for n, k in INPUTS.items()]), 4).alias("fundamental"))
