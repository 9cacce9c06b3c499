"""Queries on fundamentals: histories, several fields at once, observations of many series, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import safe_change
from tidemark.operators import joins, pit
from tidemark.plans.facts import KEYS, KNOWN, SINGLE, known, single
from tidemark.plans.views import Views
from tidemark.registry import query

FLOWS = ["revenue", "profit", "gross", "operating", "cfo"]
STOCKS = ["assets", "equity", "inventories", "receivables"]
KNOWN_ALL = KNOWN.replace("income i", "statements i")
SINGLE_ALL = f"""{KNOWN_ALL}, s AS (SELECT k.as_of, k.code, k.yr, k.q, k.pn, {", ".join("k." + c for c in STOCKS)},
  {", ".join(f"CASE WHEN k.q = 1 THEN k.{c} ELSE k.{c} - p.{c} END AS sq_{c}" for c in FLOWS)}
  FROM k LEFT JOIN k p ON p.as_of = k.as_of AND p.code = k.code AND p.yr = k.yr AND p.q = k.q - 1)"""


def known_all(v: Views) -> DataFrame:
    return v.once("known_all", lambda: pit.as_of(v.statements, v.as_of.select("as_of"), KEYS, "ann_date", ["update_flag"]))


def single_all(v: Views) -> DataFrame:
    return v.once("single_all", lambda: pit.quarters(known_all(v), FLOWS))


def back(columns: list[str], n: int) -> Column:
    """The columns of the period exactly n quarters before, as a struct; null if there is none."""
    return F.first(F.struct(*columns)).over(Window.partitionBy("as_of", "code").orderBy("pn").rangeBetween(-n, -n))


def over(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b)


def change_sql(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 AND {cur} >= 0 THEN ({cur} - {prev}) / {prev} END"


def over_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def rounding(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("P04_history", f", {KNOWN} SELECT as_of, code, pn, row_number() OVER (PARTITION BY as_of, code ORDER BY pn) AS position, round(revenue, 6) AS revenue FROM k")
def p04(v: Views) -> DataFrame:
    """The history of every entity as known on every date, in order of periods."""
    w = Window.partitionBy("as_of", "code").orderBy("pn")
    return known(v).select("as_of", "code", "pn", F.row_number().over(w).cast("long").alias("position"), F.round("revenue", 6).alias("revenue"))


CANDIDATES = """c AS (SELECT code, yr, q, ann_date, update_flag, revenue FROM income UNION ALL
  SELECT code, yr, q, ann_date, update_flag, CASE WHEN code % 2 = 0 THEN revenue ELSE revenue + 1 END FROM income WHERE (code + yr + q) % 6 = 0)"""


@query("P07_visible_candidate", f", {CANDIDATES}, d AS (SELECT *, dense_rank() OVER (PARTITION BY as_of, code, yr, q ORDER BY ann_date DESC, update_flag DESC) AS r FROM c JOIN (SELECT as_of FROM as_of) ON ann_date <= as_of) SELECT as_of, code, yr, q, CASE WHEN count(DISTINCT revenue) > 1 THEN 'ambiguous' END AS reason, round(CASE WHEN count(DISTINCT revenue) = 1 THEN max(revenue) END, 6) AS revenue FROM d WHERE r = 1 GROUP BY as_of, code, yr, q")
def p07(v: Views) -> DataFrame:
    """Candidates of equal rank that differ leave the value unknown; they are merged before they meet the dates."""
    rows = v.income.select(*KEYS, "ann_date", "update_flag", "revenue")
    again = rows.where("(code + yr + q) % 6 = 0").withColumn("revenue", F.when(F.col("code") % 2 == 0, F.col("revenue")).otherwise(F.col("revenue") + 1))
    merged = rows.unionByName(again).groupBy(*KEYS, "ann_date", "update_flag").agg(F.count_distinct("revenue").alias("n"), F.max("revenue").alias("r"))
    seen = pit.as_of(merged, v.as_of.select("as_of"), KEYS, "ann_date", ["update_flag"])
    return seen.select("as_of", *KEYS, F.when(F.col("n") > 1, "ambiguous").alias("reason"), F.round(F.when(F.col("n") == 1, F.col("r")), 6).alias("revenue"))


@query("P10_many_fields", f", {SINGLE_ALL} SELECT as_of, code, pn, {rounding(['sq_' + c for c in FLOWS])} FROM s")
def p10(v: Views) -> DataFrame:
    """Single quarters of all flow fields from one join."""
    return single_all(v).select("as_of", "code", "pn", *[F.round("sq_" + c, 6).alias("sq_" + c) for c in FLOWS])


@query("J05_bitemporal", " SELECT a.as_of, i.code, count(*) AS n_versions, max(i.ann_date) AS last_day FROM as_of a JOIN income i ON i.ann_date <= a.as_of GROUP BY 1, 2")
def j05(v: Views) -> DataFrame:
    """All versions visible on each date, as counts that run on over versions and dates sorted together."""
    return joins.visible_counts(v.income, v.as_of, ["code"], "ann_date").withColumnRenamed("n", "n_versions")


#: Each feature: its name and its SQL over s (the period), y (the same a year before) and p (the quarter before).
MARGINS = {"gross_margin": "sq_gross", "operating_margin": "sq_operating", "net_margin": "sq_profit"}
FUND_SQL = {
    "revenue": "s.sq_revenue",
    "profit": "s.sq_profit",
    "cfo": "s.sq_cfo",
    "revenue_yoy": change_sql("s.sq_revenue", "y.sq_revenue"),
    "profit_yoy": change_sql("s.sq_profit", "y.sq_profit"),
    "operating_yoy": change_sql("s.sq_operating", "y.sq_operating"),
    "cfo_qoq": change_sql("s.sq_cfo", "p.sq_cfo"),
    **{n: over_sql("s." + c, "s.sq_revenue") for n, c in MARGINS.items()},
    **{n + "_change": f"{over_sql('s.' + c, 's.sq_revenue')} - {over_sql('y.' + c, 'y.sq_revenue')}" for n, c in MARGINS.items()},
    "cfo_to_profit": over_sql("s.sq_cfo", "s.sq_profit"),
    "cfo_to_revenue": over_sql("s.sq_cfo", "s.sq_revenue"),
    "roe": over_sql("s.sq_profit", "s.equity"),
    "roa": over_sql("s.sq_profit", "s.assets"),
    "asset_turnover": over_sql("s.sq_revenue", "s.assets"),
    "inventories_yoy": change_sql("s.inventories", "y.inventories"),
    "receivables_yoy": change_sql("s.receivables", "y.receivables"),
}
SHIFTED = " FROM s LEFT JOIN s y ON y.as_of = s.as_of AND y.code = s.code AND y.pn = s.pn - 4 LEFT JOIN s p ON p.as_of = s.as_of AND p.code = s.code AND p.pn = s.pn - 1"
FUND = f"{SINGLE_ALL}, fx AS (SELECT s.as_of, s.code, s.pn, {', '.join(f'{e} AS {n}' for n, e in FUND_SQL.items())}{SHIFTED}), fu AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) = 1)"


def fundamentals(v: Views) -> DataFrame:
    """The fundamental features of every period; shifted periods come from frames of one exchange."""
    cols = ["sq_" + c for c in FLOWS] + STOCKS
    s = single_all(v).select("as_of", "code", "pn", *cols).withColumn("y", back(cols, 4)).withColumn("p", back(cols, 1))
    yoy = lambda c: safe_change(F.col(c), F.col("y." + c))
    margins = {n: over(c, "sq_revenue") for n, c in MARGINS.items()}
    features = {
        "revenue": F.col("sq_revenue"), "profit": F.col("sq_profit"), "cfo": F.col("sq_cfo"),
        "revenue_yoy": yoy("sq_revenue"), "profit_yoy": yoy("sq_profit"), "operating_yoy": yoy("sq_operating"), "cfo_qoq": safe_change(F.col("sq_cfo"), F.col("p.sq_cfo")),
        **margins, **{n + "_change": margins[n] - over("y." + c, "y.sq_revenue") for n, c in MARGINS.items()},
        "cfo_to_profit": over("sq_cfo", "sq_profit"), "cfo_to_revenue": over("sq_cfo", "sq_revenue"),
        "roe": over("sq_profit", "equity"), "roa": over("sq_profit", "assets"), "asset_turnover": over("sq_revenue", "assets"),
        "inventories_yoy": yoy("inventories"), "receivables_yoy": yoy("receivables"),
    }
    return s.select("as_of", "code", "pn", *[c.alias(n) for n, c in features.items()])


@query("X03_fundamental_group", f", {FUND} SELECT as_of, code, pn, {rounding(list(FUND_SQL))} FROM fu")
def x03(v: Views) -> DataFrame:
    return pit.latest(fundamentals(v), ["as_of", "code"], "pn").select("as_of", "code", "pn", *[F.round(n, 6).alias(n) for n in FUND_SQL])


SERIES = ("revenue", "profit", "cfo")
OBS = f"""{SINGLE_ALL}, ob AS ({" UNION ALL ".join(
    f"SELECT s.as_of, s.code, s.pn, '{k}_{c}' AS metric, {change_sql('s.sq_' + c, o + '.sq_' + c)} AS value{SHIFTED}" for k, o in (("yoy", "y"), ("qoq", "p")) for c in SERIES)} UNION ALL {" UNION ALL ".join(
    f"SELECT as_of, code, pn, '{n}', {over_sql(c, 'sq_revenue')} FROM s" for n, c in MARGINS.items())} UNION ALL {" UNION ALL ".join(
    f"SELECT as_of, code, pn, 'ttm_{c}', CASE WHEN count(sq_{c}) OVER w = 4 THEN (sum(CAST(sq_{c} AS decimal(28,6))) OVER w)::double END FROM s WINDOW w AS (PARTITION BY as_of, code ORDER BY pn RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)" for c in SERIES)})"""


def observations(v: Views) -> DataFrame:
    """Twelve series in long form: growth on the year and the quarter, margins, and trailing sums."""
    cols = ["sq_" + c for c in SERIES]
    year = Window.partitionBy("as_of", "code").orderBy("pn").rangeBetween(-3, 0)
    s = single_all(v).withColumn("y", back(cols, 4)).withColumn("p", back(cols, 1))
    s = s.withColumns({"t_" + c: F.when(F.count("sq_" + c).over(year) == 4, F.sum(F.col("sq_" + c).cast("decimal(28,6)")).over(year).cast("double")) for c in SERIES})
    values = {f"{k}_{c}": safe_change(F.col("sq_" + c), F.col(f"{o}.sq_{c}")) for k, o in (("yoy", "y"), ("qoq", "p")) for c in SERIES}
    values |= {n: over(c, "sq_revenue") for n, c in MARGINS.items()} | {"ttm_" + c: F.col("t_" + c) for c in SERIES}
    return s.select("as_of", "code", "pn", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in values.items()])))


@query("X05_observations", f", {OBS} SELECT as_of, code, pn, metric, round(value, 6) AS value FROM ob")
def x05(v: Views) -> DataFrame:
    return observations(v).select("as_of", "code", "pn", "metric", F.round("value", 6).alias("value"))


TREND_ALL = f"""{OBS}, t1 AS (SELECT *, CASE WHEN pn - lag(pn) OVER w = 1 THEN value - lag(value) OVER w END AS c, pn - lag(pn) OVER w AS gap FROM ob WINDOW w AS (PARTITION BY as_of, code, metric ORDER BY pn)),
  t2 AS (SELECT *, CASE WHEN gap = 1 THEN lag(c) OVER (PARTITION BY as_of, code, metric ORDER BY pn) END AS pc FROM t1),
  t3 AS (SELECT *, sum(CASE WHEN gap = 1 AND sign(c) = sign(pc) AND c <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY as_of, code, metric ORDER BY pn) AS run FROM t2),
  t4 AS (SELECT *, CASE WHEN c IS NULL OR c = 0 THEN 0 ELSE row_number() OVER (PARTITION BY as_of, code, metric, run ORDER BY pn) END AS length, count(value) OVER (PARTITION BY as_of, code, metric) AS n FROM t3),
  tt AS (SELECT * FROM t4 QUALIFY row_number() OVER (PARTITION BY as_of, code, metric ORDER BY pn DESC) = 1)"""


def trends(v: Views) -> DataFrame:
    """The trend of each series at its latest period: all series in one pass."""
    by = ["as_of", "code", "metric"]
    out = pit.trend(observations(v), "value", by).withColumn("n", F.count("value").over(Window.partitionBy(*by)))
    return pit.latest(out, by, "pn")


@query("X04_trend_group", f", {TREND_ALL} SELECT as_of, code, metric, pn, n, round(value, 6) AS value, round(c, 6) AS change, round(c - pc, 6) AS acceleration, length, CASE WHEN c > 0 THEN 'up' WHEN c < 0 THEN 'down' WHEN c = 0 THEN 'flat' ELSE 'unknown' END AS direction FROM tt")
def x04(v: Views) -> DataFrame:
    way = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").when(F.col("change") == 0, "flat").otherwise("unknown")
    return trends(v).select("as_of", "code", "metric", "pn", "n", *[F.round(c, 6).alias(c) for c in ("value", "change", "acceleration")], F.col("run_length").cast("long").alias("length"), way.alias("direction"))


#: Flag, penalty, whether it rejects outright, and its rule as SQL over the latest period l and the one before.
GATE = (
    ("profit_dominated_by_non_recurring_items", 30, True, "profit > 0 AND adjusted / profit < 0.5"),
    ("non_operating_income_dominates_profit", 25, True, "total <> 0 AND abs(non_operating / total) >= 0.8"),
    ("negative_operating_cash_flow", 25, False, "profit > 0 AND cfo < 0"),
    ("inventory_pressure", 10, False, "prev_inventories > 0 AND (inventories - prev_inventories) / prev_inventories > 0.5"),
    ("receivables_pressure", 10, False, "prev_receivables > 0 AND (receivables - prev_receivables) / prev_receivables > 0.5"),
    ("impairment_effect", 20, False, "total <> 0 AND abs(impairment / total) >= 0.8"),
)
EXTRA = {
    "adjusted": "profit * CASE WHEN code % 9 = 0 THEN 0.4 ELSE 0.9 END",
    "total": "1.3 * profit",
    "non_operating": "1.3 * profit * CASE WHEN code % 7 = 0 THEN 0.85 ELSE 0.1 END",
    "impairment": "1.3 * profit * CASE WHEN code % 6 = 0 AND q = 4 THEN 0.9 ELSE 0.05 END",
}
QUALITY = f"""qa AS (SELECT as_of, code, pn, profit, cfo, inventories, receivables, {', '.join(f'{e} AS {n}' for n, e in EXTRA.items())}, lag(inventories) OVER w AS prev_inventories, lag(receivables) OVER w AS prev_receivables
  FROM k WINDOW w AS (PARTITION BY as_of, code ORDER BY pn) QUALIFY row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) = 1),
  qg AS (SELECT as_of, code, pn, concat_ws('|', {', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, _, _, r in GATE)}) AS flags, greatest(0, 100 - {' - '.join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for _, p, _, r in GATE)})::bigint AS score,
  CASE WHEN {' OR '.join(f'coalesce({r}, false)' for _, _, hard, r in GATE if hard)} THEN 'rejected' ELSE 'pass' END AS gate FROM qa)"""


def quality(v: Views) -> DataFrame:
    """The latest period's diagnostics, the flags they raise, a score of 100 less their penalties, and the gate."""
    w = Window.partitionBy("as_of", "code").orderBy("pn")
    rows = known_all(v).withColumns({"prev_" + c: F.lag(c).over(w) for c in ("inventories", "receivables")})
    rows = pit.latest(rows, ["as_of", "code"], "pn").withColumns({n: F.expr(e) for n, e in EXTRA.items()})
    c = F.col
    bad = {
        "profit_dominated_by_non_recurring_items": (c("profit") > 0) & (over("adjusted", "profit") < 0.5),
        "non_operating_income_dominates_profit": F.abs(c("non_operating")) >= F.when(c("total") != 0, 0.8 * F.abs("total")),
        "negative_operating_cash_flow": (c("profit") > 0) & (c("cfo") < 0),
        "inventory_pressure": safe_change(c("inventories"), c("prev_inventories")) > 0.5,
        "receivables_pressure": safe_change(c("receivables"), c("prev_receivables")) > 0.5,
        "impairment_effect": F.abs(c("impairment")) >= F.when(c("total") != 0, 0.8 * F.abs("total")),
    }
    raised = F.filter(F.array(*[F.when(bad[n], F.struct(F.lit(n).alias("flag"), F.lit(p).alias("penalty"), F.lit(hard).alias("hard"))) for n, p, hard, _ in GATE]), lambda x: x.isNotNull())
    rows = rows.withColumn("raised", raised)
    score = F.greatest(F.lit(0), F.aggregate("raised", F.lit(100), lambda a, x: a - x["penalty"])).cast("long")
    return rows.select("as_of", "code", "pn", F.array_join(F.transform("raised", lambda x: x["flag"]), "|").alias("flags"), score.alias("score"), F.when(F.exists("raised", lambda x: x["hard"]), "rejected").otherwise("pass").alias("gate"))


@query("X07_quality_gate", f", {KNOWN_ALL}, {QUALITY} SELECT as_of, code, pn, flags, score, gate FROM qg")
def x07(v: Views) -> DataFrame:
    return quality(v)


@query("F26_vector_merge", f", {SINGLE}, va AS (SELECT as_of, code, pn, 'level' AS name, sq_revenue AS value, 'revenue' AS producer FROM s UNION ALL SELECT as_of, code, pn, 'level', sq_profit, 'profit' FROM s UNION ALL SELECT as_of, code, pn, 'margin', CASE WHEN sq_revenue > 0 THEN sq_profit / sq_revenue END, 'profit' FROM s) SELECT as_of, code, pn, CASE WHEN count(*) OVER (PARTITION BY as_of, code, pn, name) > 1 THEN producer || '.' || name ELSE name END AS feature, round(value, 6) AS value FROM va")
def f26(v: Views) -> DataFrame:
    """Features of several producers in one long table; a name that collides gets its producer in front."""
    s = single(v)
    rows = s.select("as_of", "code", "pn", F.lit("level").alias("name"), F.col("sq_revenue").alias("value"), F.lit("revenue").alias("producer"))
    for name, value in (("level", F.col("sq_profit")), ("margin", over("sq_profit", "sq_revenue"))):
        rows = rows.unionByName(s.select("as_of", "code", "pn", F.lit(name).alias("name"), value.alias("value"), F.lit("profit").alias("producer")))
    n = F.count("*").over(Window.partitionBy("as_of", "code", "pn", "name"))
    return rows.select("as_of", "code", "pn", F.when(n > 1, F.concat("producer", F.lit("."), "name")).otherwise(F.col("name")).alias("feature"), F.round("value", 6).alias("value"))
