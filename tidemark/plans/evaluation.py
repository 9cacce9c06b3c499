"""Queries that hold selections against later prices and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import date_text, first_available, safe_change
from tidemark.operators import panel as P
from tidemark.operators import pit
from tidemark.plans.fundamentals import change_sql, over, over_sql
from tidemark.plans.panels import bench, p19
from tidemark.plans.ranking import OUT, PICKS, _alt, outcomes, picks
from tidemark.plans.views import Views
from tidemark.registry import query

METRICS = ["revenue_yoy", "profit_yoy", "margin"]
IND = f"""ind AS (SELECT c.code, c.pn, c.q, CAST(c.end_date + CAST(20 + (c.code * 7 + c.q * 3) % 40 AS int) AS date) AS available, {change_sql('c.revenue', 'p.revenue')} AS revenue_yoy,
  {change_sql('c.profit', 'p.profit')} AS profit_yoy, {over_sql('c.profit', 'c.revenue')} AS margin FROM q_first c LEFT JOIN q_first p ON p.code = c.code AND p.pn = c.pn - 4)"""


def indicators(v: Views) -> DataFrame:
    """Each period's indicators as first disclosed, with the day."""
    then = F.first(F.struct("revenue", "profit")).over(Window.partitionBy("code").orderBy("pn").rangeBetween(-4, -4))
    rows = v.q_first.withColumn("then", then).withColumn("available", F.expr("date_add(end_date, cast(20 + (code * 7 + q * 3) % 40 as int))"))
    return rows.select("code", "pn", "q", "available", safe_change(F.col("revenue"), F.col("then.revenue")).alias("revenue_yoy"), safe_change(F.col("profit"), F.col("then.profit")).alias("profit_yoy"), over("profit", "revenue").alias("margin"))


@query("E04_net_of_cost", f"{OUT} SELECT as_of, code, h, round(gross - excess, 6) AS benchmark, round(excess, 6) AS excess, round(greatest(-1, gross - 0.003), 6) AS net FROM ob WHERE status = 'observed'")
def e04(v: Views) -> DataFrame:
    rows = outcomes(v).where("status = 'observed'")
    return rows.select("as_of", "code", F.col("h").cast("int").alias("h"), F.round(F.col("b1") / F.col("b0") - 1, 6).alias("benchmark"), *[F.round(c, 6).alias(c) for c in ("excess", "net")])


MEMBER = "CASE WHEN k.code % 10 = 0 THEN 'member_from_snapshot' WHEN r.code IS NULL THEN 'unknown_missing_history' WHEN r.list_idx > k.idx THEN 'not_listed_by_as_of' WHEN r.delist_idx <= k.idx THEN 'delisted_by_as_of' ELSE 'member_from_history' END"


def members(v: Views) -> DataFrame:
    """What a snapshot says of membership goes before what dates say."""
    rows = picks(v).join(v.ref.where("code % 13 <> 0").select("code", "list_idx", "delist_idx", F.lit(True).alias("known")), "code", "left")
    status = (
        F.when(F.col("code") % 10 == 0, "member_from_snapshot").when(F.col("known").isNull(), "unknown_missing_history").when(F.col("list_idx") > F.col("idx"), "not_listed_by_as_of")
        .when(F.col("delist_idx") <= F.col("idx"), "delisted_by_as_of").otherwise("member_from_history")
    )
    return rows.withColumn("membership", status)


@query("E05_membership", f"{PICKS} SELECT k.as_of, k.code, {MEMBER} AS membership FROM pk k LEFT JOIN (SELECT * FROM ref WHERE code % 13 <> 0) r ON r.code = k.code")
def e05(v: Views) -> DataFrame:
    return members(v).select("as_of", "code", "membership")


@query("E06_exposures", f"{PICKS} SELECT k.as_of, k.code, CASE WHEN k.code % 3 = 0 THEN 'picked' WHEN k.code % 2 = 0 AND p.code IS NOT NULL THEN 'dated' ELSE CAST(r.industry AS text) END AS industry, CASE WHEN k.code % 3 = 0 THEN 'frozen_scan' WHEN k.code % 2 = 0 AND p.code IS NOT NULL THEN 'dated_exposure' ELSE 'stock_basic_fallback' END AS source, CASE WHEN k.rank % 4 <> 0 THEN k.vol ELSE p.amount END AS cap, CASE WHEN k.rank % 4 <> 0 THEN 'frozen_scan' WHEN p.amount IS NOT NULL THEN 'dated_exposure' ELSE 'missing' END AS cap_source FROM pk k LEFT JOIN px p ON p.code = k.code AND p.idx = k.idx - 1 LEFT JOIN ref r ON r.code = k.code")
def e06(v: Views) -> DataFrame:
    """Exposures frozen with the selection, else those dated before it, else the reference."""
    dated = v.px.select("code", (F.col("idx") + 1).alias("idx"), "amount", F.when(F.col("code") % 2 == 0, "dated").alias("dated"))
    rows = picks(v).join(dated, ["code", "idx"], "left").join(v.ref.select("code", F.col("industry").cast("string").alias("fallback")), "code", "left")
    frozen, cap = F.when(F.col("code") % 3 == 0, "picked"), F.when(F.col("rank") % 4 != 0, F.col("vol"))
    source = F.when(frozen.isNotNull(), "frozen_scan").when(F.col("dated").isNotNull(), "dated_exposure").when(F.col("fallback").isNotNull(), "stock_basic_fallback").otherwise("missing")
    cap_source = F.when(cap.isNotNull(), "frozen_scan").when(F.col("amount").isNotNull(), "dated_exposure").otherwise("missing")
    return rows.select("as_of", "code", F.coalesce(frozen, "dated", "fallback").alias("industry"), source.alias("source"), F.coalesce(cap, "amount").alias("cap"), cap_source.alias("cap_source"))


@query("E07_indicator_history", f", {IND} SELECT code, pn, available, round(revenue_yoy, 6) AS value, CASE WHEN revenue_yoy IS NULL THEN NULL WHEN code % 3 <> 0 THEN 'primary' ELSE 'fallback' END AS source FROM ind")
def e07(v: Views) -> DataFrame:
    """Percentage points as ratios, from the first column that has them."""
    rows = indicators(v).select("code", "pn", "available", F.when(F.col("code") % 3 != 0, F.col("revenue_yoy") * 100).alias("primary"), (F.col("revenue_yoy") * 100).alias("fallback"))
    source = F.when(F.col("primary").isNotNull(), "primary").when(F.col("fallback").isNotNull(), "fallback")
    return rows.select("code", "pn", "available", F.round(F.coalesce("primary", "fallback") / 100, 6).alias("value"), source.alias("source"))


@query("E15_prepared_history", " SELECT code, yr, q, update_flag, CASE (code + q) % 4 WHEN 0 THEN 'actual' WHEN 1 THEN 'final' WHEN 2 THEN 'announced' ELSE 'published' END AS source, ann_date AS available, CASE WHEN update_flag = 1 THEN 'revised' ELSE sha256(concat_ws('|', code, yr, q, strftime(ann_date, '%Y%m%d'))) END AS version FROM income WHERE (code + q) % 9 <> 0")
def e15(v: Views) -> DataFrame:
    """Availability from four columns and the period from two; a version's label or else its hash; what lacks a period goes."""
    kind, day = (F.col("code") + F.col("q")) % 4, F.date_format("ann_date", "yyyyMMdd")
    columns = [(n, F.when(kind <= i, F.when(kind == i, day))) for i, n in enumerate(("actual", "final", "announced", "published"))]
    available, source = first_available(*columns)
    spare = (F.col("code") + F.col("q")) % 9
    period = F.coalesce(F.when(spare > 4, date_text(F.date_format("end_date", "yyyyMMdd"))), F.when(spare > 0, F.date_format("end_date", "yyyyMMdd")))
    label = F.when(F.col("update_flag") == 1, "revised")
    rows = v.income.withColumns({"available": available, "source": source, "period": period}).where("available is not null and period is not null")
    return rows.select("code", "yr", "q", "update_flag", "source", "available", F.coalesce(label, F.sha2(F.concat_ws("|", "code", "yr", "q", date_text(F.date_format("available", "yyyyMMdd"))), 256)).alias("version"))


FOLLOW = f"""{IND}, ib AS (SELECT a.as_of, i.* FROM as_of a JOIN ind i ON i.available <= a.as_of QUALIFY row_number() OVER (PARTITION BY a.as_of, i.code ORDER BY i.pn DESC) = 1),
  nx AS (SELECT b.as_of, b.code, row_number() OVER (PARTITION BY b.as_of, b.code ORDER BY i.pn) AS nth, {', '.join(f'i.{m} - b.{m} AS d_{m}' for m in METRICS)} FROM ib b JOIN ind i ON i.code = b.code AND i.pn > b.pn AND i.available > b.as_of),
  vt AS (SELECT *, {' + '.join(f'(d_{m} IS NOT NULL)::bigint' for m in METRICS)} AS n, {' + '.join(f'coalesce(d_{m} > 0, false)::bigint' for m in METRICS)} AS up FROM nx WHERE nth <= 2),
  fl AS (SELECT *, CASE WHEN n >= 2 THEN up > n - up END AS improved FROM vt)"""


def followed(v: Views) -> DataFrame:
    """The next two reports after each date against the last one known on it, by metric and by vote.

    A report is the last one known until the first later one comes, so that its two successors are the next two reports
    on all those dates; one sorted run of each entity serves them. Reports without a day are never known.
    """
    ind = indicators(v).where("available is not null")
    w = Window.partitionBy("code").orderBy("pn")
    until = F.min("available").over(w.rowsBetween(1, Window.unboundedFollowing))
    after = F.array_compact(F.array(*[F.lead(F.struct(*METRICS), n).over(w) for n in (1, 2)]))
    rows = ind.withColumn("until", until).withColumn("after", after)
    base = pit.current_on(rows, v.as_of.select("as_of"), "available")
    out = base.select("as_of", "code", *[F.col(m).alias("b_" + m) for m in METRICS], F.posexplode("after").alias("i", "r"))
    deltas = {m: F.col("r." + m) - F.col("b_" + m) for m in METRICS}
    out = out.select("as_of", "code", (F.col("i") + 1).cast("long").alias("nth"), *[d.alias("d_" + m) for m, d in deltas.items()])
    known = sum((F.col("d_" + m).isNotNull().cast("long") for m in METRICS), F.lit(0))
    up = sum((F.coalesce(F.col("d_" + m) > 0, F.lit(False)).cast("long") for m in METRICS), F.lit(0))
    out = out.withColumn("n", known).withColumn("up", up)
    return out.withColumn("improved", F.when(F.col("n") >= 2, F.col("up") > F.col("n") - F.col("up")))


@query("E09_follow_through", f", {FOLLOW} SELECT as_of, code, nth, n, up, improved, CASE WHEN n < 2 THEN 'insufficient_metric_coverage' ELSE 'observed' END AS status FROM fl")
def e09(v: Views) -> DataFrame:
    return followed(v).select("as_of", "code", "nth", "n", "up", "improved", F.when(F.col("n") < 2, "insufficient_metric_coverage").otherwise("observed").alias("status"))


@query("E10_persistence", f", {FOLLOW} SELECT as_of, code, CASE WHEN a IS NULL THEN 'unknown' WHEN a AND b THEN 'persistent' WHEN a AND NOT b THEN 'false_turnaround' WHEN a THEN 'awaiting_second' WHEN b THEN 'delayed' ELSE 'not_improved' END AS outcome FROM (SELECT as_of, code, bool_or(CASE WHEN nth = 1 THEN improved END) AS a, bool_or(CASE WHEN nth = 2 THEN improved END) AS b FROM fl GROUP BY 1, 2)")
def e10(v: Views) -> DataFrame:
    g = followed(v).groupBy("as_of", "code").agg(*[F.bool_or(F.when(F.col("nth") == i, F.col("improved"))).alias(n) for i, n in ((1, "a"), (2, "b"))])
    outcome = F.when(F.col("a").isNull(), "unknown").when(F.col("a") & F.col("b"), "persistent").when(F.col("a") & ~F.col("b"), "false_turnaround").when(F.col("a"), "awaiting_second").when(F.col("b"), "delayed").otherwise("not_improved")
    return g.select("as_of", "code", outcome.alias("outcome"))


@query("G12_follow_summary", f", {FOLLOW}, lg AS ({' UNION ALL '.join(f'''SELECT nth, '{m}' AS metric, d_{m} AS d FROM fl''' for m in METRICS)}) SELECT nth, metric, count(*) AS total, count(d) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 6) AS improved FROM lg GROUP BY 1, 2")
def g12(v: Views) -> DataFrame:
    rows = followed(v).select("nth", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("d_" + m).alias("d")) for m in METRICS])))
    d = F.col("d")
    return rows.groupBy("nth", "metric").agg(F.count("*").alias("total"), F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median"), F.round(F.avg((d > 0).cast("double")), 6).alias("improved"))


@query("E11_evaluated_scans", f"{OUT} SELECT o.h, o.m AS membership, count(*) AS n, count(gross) FILTER (status = 'observed') AS observed, round(avg(gross) FILTER (status = 'observed'), 6) AS mean, round(avg(excess) FILTER (status = 'observed'), 6) AS excess FROM (SELECT ob.*, {MEMBER} AS m FROM ob JOIN pk k ON k.as_of = ob.as_of AND k.code = ob.code LEFT JOIN (SELECT * FROM ref WHERE code % 13 <> 0) r ON r.code = k.code) o GROUP BY 1, 2")
def e11(v: Views) -> DataFrame:
    """Every candidate at every horizon, summed up by membership."""
    rows = outcomes(v).join(members(v).select("as_of", "code", "membership"), ["as_of", "code"])
    seen = F.col("status") == "observed"
    return rows.groupBy(F.col("h").cast("int").alias("h"), "membership").agg(F.count("*").alias("n"), F.count_if(seen).alias("observed"), F.round(F.avg("gross"), 6).alias("mean"), F.round(F.avg(F.when(seen, F.col("excess"))), 6).alias("excess"))


@query("E14_campaign", f"{PICKS} SELECT s.month, s.as_of, CASE WHEN p.n IS NOT NULL THEN 'reused' WHEN c.idx < 100 THEN 'unavailable_history' ELSE 'pending' END AS status, coalesce(p.n, 0) AS n FROM (SELECT date_trunc('month', session_date)::date AS month, min(session_date) AS as_of FROM cal WHERE day(session_date) >= 15 GROUP BY 1) s JOIN cal c ON c.session_date = s.as_of LEFT JOIN (SELECT date_trunc('month', as_of)::date AS month, count(*) AS n FROM pk GROUP BY 1) p ON p.month = s.month")
def e14(v: Views) -> DataFrame:
    """The schedule against the snapshots there are: reuse, or say why there is none."""
    held = picks(v).groupBy(F.to_date(F.date_trunc("month", "as_of")).alias("month")).agg(F.count("*").alias("n"))
    rows = p19(v).join(v.cal.select(F.col("session_date").alias("as_of"), "idx"), "as_of").join(held, "month", "left")
    status = F.when(F.col("n").isNotNull(), "reused").when(F.col("idx") < 100, "unavailable_history").otherwise("pending")
    return rows.select("month", "as_of", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def _picked(variant: str, order: str) -> str:
    return f"SELECT '{variant}' AS variant, a.as_of, p.code, p.idx FROM as_of a JOIN px p ON p.idx = a.idx QUALIFY row_number() OVER (PARTITION BY a.as_of ORDER BY p.{order} DESC, p.code) <= 20"


SEGMENTS = f""", p2 AS (SELECT * FROM ({_picked('a', 'vol')}) UNION ALL SELECT * FROM ({_picked('b', 'turnover')})), o2 AS (SELECT k.variant, year(k.as_of) AS yr, h, x.close / p.close - 1 AS gross FROM p2 k CROSS JOIN (SELECT unnest([20, 60, 120]) AS h) JOIN px p ON p.code = k.code AND p.idx = k.idx JOIN px x ON x.code = k.code AND x.idx = k.idx + h),
  sg AS (SELECT 'year' AS dim, CAST(yr AS text) AS seg, round(avg(gross) FILTER (variant = 'b') - avg(gross) FILTER (variant = 'a'), 9) AS d FROM o2 GROUP BY yr HAVING least(count(*) FILTER (variant = 'a'), count(*) FILTER (variant = 'b')) >= 20
    UNION ALL SELECT 'horizon', CAST(h AS text), round(avg(gross) FILTER (variant = 'b') - avg(gross) FILTER (variant = 'a'), 9) FROM o2 GROUP BY h HAVING least(count(*) FILTER (variant = 'a'), count(*) FILTER (variant = 'b')) >= 20)"""


def segment_deltas(v: Views) -> DataFrame:
    """What one variant gains over the other by year and by horizon, where both have enough outcomes."""
    last = v.cal.agg(F.max("idx")).scalar()
    horizons = v.spark.range(1).select(F.explode(F.array(F.lit(20), F.lit(60), F.lit(120))).alias("h"))
    both = picks(v).select(F.lit("a").alias("variant"), "as_of", "code", "idx").unionByName(_alt(v).select(F.lit("b").alias("variant"), "as_of", "code", "idx"))
    rows = P.forward(both, v.px, bench(v), horizons, last).where("status = 'observed'")
    cut = F.array(F.struct(F.lit("year").alias("dim"), F.year("as_of").cast("string").alias("seg")), F.struct(F.lit("horizon").alias("dim"), F.col("h").cast("string").alias("seg")))
    of = lambda n: F.when(F.col("variant") == n, F.col("gross"))
    g = rows.select("variant", "gross", F.inline(cut)).groupBy("dim", "seg").agg(*[f(of(n)).alias(k + n) for n in "ab" for f, k in ((F.avg, "m"), (F.count, "n"))])
    return g.where("least(na, nb) >= 20").select("dim", "seg", F.round(F.col("mb") - F.col("ma"), 9).alias("d"))


@query("E13_stability", f"{SEGMENTS}, su AS (SELECT count(*) FILTER (dim = 'year') AS years, count(*) FILTER (dim = 'horizon') AS horizons, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FILTER (dim = 'year') AS up_years, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FILTER (dim = 'horizon') AS up_horizons, median(d) AS median, min(d) AS worst, max(d) AS best FROM sg) SELECT years, horizons, round(up_years, 6) AS up_years, round(up_horizons, 6) AS up_horizons, round(median, 6) AS median, round(worst, 6) AS worst, round(best, 6) AS best, CASE WHEN years + horizons = 0 THEN 'insufficient_evidence' WHEN years >= 3 AND horizons >= 2 AND up_years >= 0.6 AND up_horizons >= 0.6 AND median > 0 AND worst >= -0.05 THEN 'stable_positive' WHEN years >= 3 AND horizons >= 2 AND median <= 0 THEN 'ineffective' ELSE 'unstable' END AS class FROM su")
def e13(v: Views) -> DataFrame:
    d, of = F.col("d"), lambda n: F.col("dim") == n
    share = lambda n: F.avg(F.when(of(n), (d > 0).cast("double")))
    s = segment_deltas(v).agg(F.count_if(of("year")).alias("years"), F.count_if(of("horizon")).alias("horizons"), share("year").alias("up_years"), share("horizon").alias("up_horizons"), F.percentile(d, F.lit(0.5)).alias("median"), F.min(d).alias("worst"), F.max(d).alias("best"))
    broad = F.expr("years >= 3 and horizons >= 2")
    label = F.when(F.expr("years + horizons = 0"), "insufficient_evidence").when(broad & F.expr("up_years >= 0.6 and up_horizons >= 0.6 and median > 0 and worst >= -0.05"), "stable_positive").when(broad & (F.col("median") <= 0), "ineffective").otherwise("unstable")
    return s.select("years", "horizons", *[F.round(c, 6).alias(c) for c in ("up_years", "up_horizons", "median", "worst", "best")], label.alias("class"))
