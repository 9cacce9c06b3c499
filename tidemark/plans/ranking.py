"""Queries that rank, evaluate and compare rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators.rank import top
from tidemark.plans.panels import bench
from tidemark.plans.views import Views
from tidemark.registry import query

PICKS = ", pk AS (SELECT * FROM (SELECT a.as_of, p.code, p.idx, p.vol, row_number() OVER (PARTITION BY a.as_of ORDER BY p.vol DESC, p.code) AS rank FROM as_of a JOIN px p ON p.idx = a.idx) WHERE rank <= 20)"
OUT = PICKS + """, hz AS (SELECT unnest([20, 60, 120]) AS h), bx AS (SELECT b.*, c.idx FROM bench b JOIN cal c USING (session_date)),
  ob AS (SELECT k.as_of, k.code, k.rank, h, CASE WHEN k.idx + h > (SELECT max(idx) FROM cal) THEN 'incomplete_market_window' WHEN p.close IS NULL THEN 'missing_entry_price' WHEN x.close IS NULL THEN 'missing_horizon_price' ELSE 'observed' END AS status,
    x.close / p.close - 1 AS gross, x.close / p.close - 1 - (b1.close / b0.close - 1) AS excess FROM pk k CROSS JOIN hz LEFT JOIN px p ON p.code = k.code AND p.idx = k.idx LEFT JOIN px x ON x.code = k.code AND x.idx = k.idx + h LEFT JOIN bx b0 ON b0.idx = k.idx LEFT JOIN bx b1 ON b1.idx = k.idx + h)"""


def picks(v: Views, n: int = 20, order: str = "vol") -> DataFrame:
    rows = v.px.join(F.broadcast(v.as_of), "idx")
    return top(rows, ["as_of"], [F.col(order).desc(), F.col("code")], n).select("as_of", "code", "idx", "vol", "rank")


def outcomes(v: Views) -> DataFrame:
    v.keep("px", "as_of", "cal", "bench")
    last = v.cal.agg(F.max("idx")).scalar()
    horizons = v.spark.range(1).select(F.explode(F.array(F.lit(20), F.lit(60), F.lit(120))).alias("h"))
    return P.forward(picks(v), v.px, bench(v), horizons, last)


@query("K03_selection", f"{PICKS} SELECT as_of, code, rank FROM pk")
def k03(v: Views) -> DataFrame:
    return picks(v).select("as_of", "code", "rank")


@query("K04_tail", " SELECT code, idx FROM (SELECT code, idx, row_number() OVER (PARTITION BY code ORDER BY idx DESC) AS n FROM px) WHERE n <= 5")
def k04(v: Views) -> DataFrame:
    return top(v.px, ["code"], [F.col("idx").desc()], 5, "n").select("code", "idx")


@query("E02_forward", f"{OUT} SELECT as_of, code, h, status, round(gross, 6) AS gross, round(CASE WHEN gross IS NOT NULL THEN greatest(-1.0, gross - 0.003) END, 6) AS net, round(excess, 6) AS excess FROM ob")
def e02(v: Views) -> DataFrame:
    return outcomes(v).select("as_of", "code", F.col("h").cast("int").alias("h"), "status", *[F.round(c, 6).alias(c) for c in ("gross", "net", "excess")])


@query("G07_return_summary", f"{OUT} SELECT h, count(gross) AS n, round(avg(gross), 6) AS mean, round(median(gross), 6) AS median, round(quantile_cont(gross, 0.75) - quantile_cont(gross, 0.25), 6) AS iqr, round(avg(CASE WHEN gross > 0 THEN 1.0 WHEN gross IS NOT NULL THEN 0.0 END), 6) AS hit FROM ob GROUP BY h")
def g07(v: Views) -> DataFrame:
    return outcomes(v).groupBy(F.col("h").cast("int").alias("h")).agg(*P.summary(F.col("gross")))


@query("G08_cohort_mean", f"{OUT} SELECT h, round(avg(m), 6) AS mean FROM (SELECT h, as_of, avg(gross) AS m FROM ob GROUP BY 1, 2) GROUP BY h")
def g08(v: Views) -> DataFrame:
    return outcomes(v).groupBy(F.col("h").cast("int").alias("h"), "as_of").agg(F.avg("gross").alias("m")).groupBy("h").agg(F.round(F.avg("m"), 6).alias("mean"))


@query("G09_cohort_drawdown", f"{OUT}, c AS (SELECT h, as_of, avg(gross) AS m FROM ob GROUP BY 1, 2 HAVING avg(gross) IS NOT NULL), w AS (SELECT h, as_of, product(1 + m) OVER (PARTITION BY h ORDER BY as_of) AS w FROM c) SELECT h, round(min(w / greatest(1.0, p) - 1), 6) AS drawdown FROM (SELECT *, max(w) OVER (PARTITION BY h ORDER BY as_of) AS p FROM w) GROUP BY h")
def g09(v: Views) -> DataFrame:
    c = outcomes(v).groupBy(F.col("h").cast("int").alias("h"), "as_of").agg(F.avg("gross").alias("m")).where("m is not null")
    return P.compounded_drawdown(c, "h", "as_of", "m")


@query("G10_path_drawdown", " SELECT code, round(min(close / p - 1), 6) AS drawdown FROM (SELECT code, close, max(close) OVER (PARTITION BY code ORDER BY idx) AS p FROM px) GROUP BY code")
def g10(v: Views) -> DataFrame:
    return P.path_drawdown(v.px)


@query("G11_reason_counts", f"{OUT} SELECT h, status, count(*) AS n FROM ob GROUP BY h, status")
def g11(v: Views) -> DataFrame:
    return outcomes(v).groupBy(F.col("h").cast("int").alias("h"), "status").agg(F.count("*").alias("n"))


@query("G13_segments", f"{OUT} SELECT grouping_id(h, yr) AS gid, h, yr, count(gross) AS n, round(avg(gross), 6) AS mean, round(CASE WHEN count(gross) >= 2 THEN stddev_pop(gross) END, 6) AS std, round(max(gross), 6) AS most FROM (SELECT h, year(as_of) AS yr, gross FROM ob) GROUP BY GROUPING SETS ((), (h), (yr), (h, yr))")
def g13(v: Views) -> DataFrame:
    rows = outcomes(v).select(F.col("h").cast("int").alias("h"), F.year("as_of").alias("yr"), "gross")
    g = F.col("gross")
    return rows.cube("h", "yr").agg(F.grouping_id("h", "yr").alias("gid"), F.count(g).alias("n"), F.round(F.avg(g), 6).alias("mean"), F.round(F.when(F.count(g) >= 2, F.stddev_pop(g)), 6).alias("std"), F.round(F.max(g), 6).alias("most"))


@query("K05_worst_five", f"{OUT} SELECT h, as_of, code, n FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY gross, as_of, code) AS n FROM ob WHERE gross IS NOT NULL) WHERE n <= 5")
def k05(v: Views) -> DataFrame:
    return top(outcomes(v).where("gross is not null"), ["h"], [F.col("gross"), F.col("as_of"), F.col("code")], 5, "n").select(F.col("h").cast("int").alias("h"), "as_of", "code", "n")


SETS = "t AS (SELECT as_of, list(code) AS s FROM pk GROUP BY as_of), l AS (SELECT as_of, s, lag(s) OVER (ORDER BY as_of) AS p FROM t)"


@query("G17_turnover", f"{PICKS}, {SETS} SELECT as_of, round(len(list_intersect(s, p)) / greatest(1, len(list_distinct(list_concat(s, p)))), 6) AS jaccard, len(list_filter(s, lambda x: NOT list_contains(p, x))) AS added, len(list_filter(p, lambda x: NOT list_contains(s, x))) AS removed FROM l WHERE p IS NOT NULL")
def g17(v: Views) -> DataFrame:
    return P.set_turnover(picks(v), "as_of", "code")


ALT = ", pa AS (SELECT * FROM (SELECT a.as_of, p.code, row_number() OVER (PARTITION BY a.as_of ORDER BY p.turnover DESC, p.code) AS rank FROM as_of a JOIN px p ON p.idx = a.idx) WHERE rank <= 20)"


@query("J08_snapshot_compare", f"{PICKS}{ALT} SELECT as_of, code, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN a.rank = b.rank THEN 'unchanged' ELSE 'changed' END AS change, b.rank - a.rank AS delta FROM pk a FULL JOIN pa b USING (as_of, code)")
def j08(v: Views) -> DataFrame:
    a = picks(v).select("as_of", "code", F.col("rank").alias("ra"))
    b = _alt(v).select("as_of", "code", F.col("rank").alias("rb"))
    change = F.when(F.col("ra").isNull(), "added").when(F.col("rb").isNull(), "removed").when(F.col("ra") == F.col("rb"), "unchanged").otherwise("changed")
    return a.join(b, ["as_of", "code"], "full_outer").select("as_of", "code", change.alias("change"), (F.col("rb") - F.col("ra")).alias("delta"))


def _alt(v: Views) -> DataFrame:
    return top(v.px.join(F.broadcast(v.as_of), "idx"), ["as_of"], [F.col("turnover").desc(), F.col("code")], 20)


@query("G16_set_overlap", f"{PICKS}{ALT} SELECT as_of, round(count(a.rank + b.rank) / count(*), 6) AS jaccard FROM pk a FULL JOIN pa b USING (as_of, code) GROUP BY as_of")
def g16(v: Views) -> DataFrame:
    return j08(v).groupBy("as_of").agg(F.round(F.count("delta") / F.count("*"), 6).alias("jaccard"))


@query("G18_ablation_diff", f"{PICKS}{ALT} SELECT as_of, count(*) FILTER (b.rank IS NULL) AS removed, count(*) FILTER (a.rank IS NULL) AS added FROM pk a FULL JOIN pa b USING (as_of, code) GROUP BY as_of")
def g18(v: Views) -> DataFrame:
    return j08(v).groupBy("as_of").agg(F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "added").alias("added"))
