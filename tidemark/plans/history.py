"""Queries on periods, availability, evidence and provenance of revised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import evidence_class, first_available, fiscal_period, norm_date, version_id
from tidemark.operators import pit
from tidemark.plans.facts import GROWTH, KNOWN, SINGLE, known, single
from tidemark.plans.panels import REGIME, p21
from tidemark.plans.views import Views
from tidemark.registry import query


@query("F02_bad_dates", " SELECT l_returnflag, count(*) FILTER (l_linenumber % 3 = 0) AS bad FROM lineitem GROUP BY 1")
def f02(v: Views) -> DataFrame:
    """Texts that are neither blank nor a date."""
    text = F.when(F.col("l_linenumber") % 3 == 0, "20200230").when(F.col("l_linenumber") % 3 == 1, " ").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    return v.lineitem.groupBy("l_returnflag").agg(F.count_if((F.trim(text) != "") & norm_date(text).isNull()).alias("bad"))


@query("F08_history_column", " SELECT code, idx, CASE WHEN max(CASE WHEN code % 3 = 0 AND idx % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code) = 1 THEN 'close' ELSE 'vol' END AS chosen, round(CASE WHEN max(CASE WHEN code % 3 = 0 AND idx % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code) = 1 THEN CASE WHEN code % 3 = 0 AND idx % 50 = 0 THEN close END ELSE vol END, 6) AS value FROM px")
def f08(v: Views) -> DataFrame:
    """One column for the whole history of an entity: the first that has any value in it."""
    w = Window.partitionBy("code")
    rows = v.px.select("code", "idx", F.when((F.col("code") % 3 == 0) & (F.col("idx") % 50 == 0), F.col("close")).alias("a"), "vol")
    rows = rows.withColumn("has", F.max(F.col("a").isNotNull()).over(w))
    return rows.select("code", "idx", F.when(F.col("has"), "close").otherwise("vol").alias("chosen"), F.round(F.when(F.col("has"), F.col("a")).otherwise(F.col("vol")), 6).alias("value"))


@query("F09_availability", " SELECT code, yr, q, update_flag, ann_date AS available, CASE WHEN code % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM income")
def f09(v: Views) -> DataFrame:
    day = F.date_format("ann_date", "yyyyMMdd")
    available, source = first_available(("first", F.when(F.col("code") % 2 == 0, day).otherwise("not known")), ("second", day))
    return v.income.select("code", "yr", "q", "update_flag", available.alias("available"), source.alias("source"))


@query("F10_period", " SELECT code, yr, q, update_flag, end_date AS period_end, pn FROM income")
def f10(v: Views) -> DataFrame:
    kind = F.col("code") % 3
    half = F.when(F.col("q") == 2, "H1").when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), "q"))
    text = F.when(kind == 0, F.concat("yr", F.lit("Q"), "q")).when(kind == 1, F.date_format("end_date", "yyyyMMdd")).otherwise(F.concat("yr", half))
    end, number = fiscal_period(text)
    return v.income.select("code", "yr", "q", "update_flag", end.alias("period_end"), number.alias("pn"))


@query("F13_version_identity", " SELECT code, count(DISTINCT (yr, q, ann_date, revenue, profit)) AS versions FROM income GROUP BY code")
def f13(v: Views) -> DataFrame:
    own = v.income.withColumn("version", version_id("income", "code", "yr", "q", "ann_date", "revenue", "profit"))
    return own.groupBy("code").agg(F.count_distinct("version").alias("versions"))


EVIDENCE = f"{SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, ev AS (SELECT as_of, code, pn, CASE WHEN why IS NULL THEN 'valid' WHEN why LIKE 'missing%' THEN 'missing' ELSE 'invalid' END AS class FROM g)"


def _growth(v: Views, value: str = "sq_revenue", lag: int = 4) -> DataFrame:
    return pit.comparable(single(v).drop("reason"), value, lag)


@query("F20_evidence_class", f", {EVIDENCE} SELECT as_of, code, class, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def f20(v: Views) -> DataFrame:
    return _growth(v).groupBy("as_of", "code", evidence_class(F.col("growth"), F.col("reason")).alias("class")).agg(F.count("*").alias("n"))


@query("F23_visible_rows", " SELECT as_of, count(*) FILTER (ann_date <= as_of) AS visible, count(*) FILTER (ann_date > as_of) AS hidden FROM as_of CROSS JOIN income GROUP BY as_of")
def f23(v: Views) -> DataFrame:
    """Rows are counted by day before they meet the as-of dates."""
    days = v.income.groupBy("ann_date").agg(F.count("*").alias("n"))
    grid = v.as_of.select("as_of").join(F.broadcast(days))
    seen = F.col("ann_date") <= F.col("as_of")
    return grid.groupBy("as_of").agg(F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("visible"), F.sum(F.when(seen, 0).otherwise(F.col("n"))).alias("hidden"))


FEATURES = f"{SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, fw AS (SELECT g.as_of, g.code, g.pn, CASE WHEN why IS NULL THEN (v - base) / base END AS yoy, CASE WHEN s.sq_revenue > 0 THEN s.sq_profit / s.sq_revenue END AS margin, s.sq_profit AS profit FROM g JOIN s USING (as_of, code, pn))"


def features(v: Views) -> DataFrame:
    """A row for each entity, period and named feature."""
    rows = _growth(v)
    margin = F.when(F.col("sq_revenue") > 0, F.col("sq_profit") / F.col("sq_revenue"))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in (("yoy", F.col("growth")), ("margin", margin), ("profit", F.col("sq_profit")))])
    return rows.select("as_of", "code", "pn", F.inline(pairs))


@query("F25_flatten", f", {FEATURES} SELECT as_of, code, pn, round(yoy, 6) AS yoy, round(margin, 6) AS margin, round(profit, 6) AS profit FROM fw")
def f25(v: Views) -> DataFrame:
    return features(v).groupBy("as_of", "code", "pn").pivot("feature", ["yoy", "margin", "profit"]).agg(F.round(F.first("value"), 6))


COVER = f"{FEATURES}, lw AS (SELECT *, row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) AS nth FROM fw), cv AS (SELECT as_of, code, (yoy IS NOT NULL)::bigint + (margin IS NOT NULL)::bigint + (profit IS NOT NULL)::bigint AS n_valid, yoy IS NULL AS critical FROM lw WHERE nth = 1), cf AS (SELECT *, CASE WHEN critical OR n_valid / 3 < 0.25 THEN 'INSUFFICIENT' WHEN n_valid / 3 >= 0.9 THEN 'HIGH' WHEN n_valid / 3 >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM cv)"


def coverage(v: Views) -> DataFrame:
    """Of the latest period: how many features are known, and how far that can be relied on."""
    known_n = features(v).groupBy("as_of", "code", "pn").agg(F.count("value").alias("n_valid"), F.max((F.col("feature") == "yoy") & F.col("value").isNull()).alias("critical"))
    share = F.col("n_valid") / 3
    confidence = F.when(F.col("critical") | (share < 0.25), "INSUFFICIENT").when(share >= 0.9, "HIGH").when(share >= 0.75, "MEDIUM").otherwise("LOW")
    return pit.latest(known_n, ["as_of", "code"], "pn").withColumn("confidence", confidence)


@query("G14_evidence_coverage", f", {COVER} SELECT as_of, code, n_valid, round(n_valid / 3, 6) AS coverage, confidence FROM cf")
def g14(v: Views) -> DataFrame:
    return coverage(v).select("as_of", "code", "n_valid", F.round(F.col("n_valid") / 3, 6).alias("coverage"), "confidence")


@query("X16_eligibility", f", {COVER} SELECT as_of, code, CASE WHEN critical THEN 'critical_unknown' WHEN n_valid / 3 < 0.5 THEN 'low_coverage' WHEN confidence = 'INSUFFICIENT' THEN 'low_confidence' END AS reason FROM cf")
def x16(v: Views) -> DataFrame:
    reason = F.when(F.col("critical"), "critical_unknown").when(F.col("n_valid") / 3 < 0.5, "low_coverage").when(F.col("confidence") == "INSUFFICIENT", "low_confidence")
    return coverage(v).select("as_of", "code", reason.alias("reason"))


@query("G15_snapshot_metrics", f", {COVER} SELECT as_of, confidence, count(*) AS n, count(*) FILTER (critical) AS unknown FROM cf GROUP BY 1, 2")
def g15(v: Views) -> DataFrame:
    return coverage(v).groupBy("as_of", "confidence").agg(F.count("*").alias("n"), F.count_if("critical").alias("unknown"))


@query("P02_as_of_query", f", {KNOWN} SELECT as_of, code, count(*) AS n, sum(CAST(revenue AS decimal(28,6)))::double AS revenue FROM k WHERE end_date <= as_of GROUP BY 1, 2")
def p02(v: Views) -> DataFrame:
    rows = known(v).where("end_date <= as_of")
    return rows.groupBy("as_of", "code").agg(F.count("*").alias("n"), F.sum(F.col("revenue").cast("decimal(28,6)")).cast("double").alias("revenue"))


@query("P03_disclosure_fallback", " SELECT i.code, i.yr, i.q, i.update_flag, CASE WHEN (i.code + i.q) % 4 = 0 THEN d.actual ELSE i.ann_date END AS available FROM income i JOIN (SELECT code, end_date, min(ann_date + CAST(code % 3 AS int))::date AS actual FROM income GROUP BY 1, 2) d USING (code, end_date)")
def p03(v: Views) -> DataFrame:
    """The earliest disclosure of a period fills an availability that is missing."""
    facts = v.income.withColumn("ann", F.when((F.col("code") + F.col("q")) % 4 != 0, F.col("ann_date")))
    actual = v.income.groupBy("code", "end_date").agg(F.min(F.expr("date_add(ann_date, cast(code % 3 as int))")).alias("actual"))
    return facts.join(actual, ["code", "end_date"], "left").select("code", "yr", "q", "update_flag", F.coalesce("ann", "actual").alias("available"))


@query("P06_latest_validated", " SELECT code, pn, CASE WHEN n > 1 THEN 'ambiguous_period_chain' END AS reason, round(CASE WHEN n = 1 THEN r END, 6) AS revenue FROM (SELECT code, pn, count(DISTINCT update_flag) AS n, max(revenue) AS r, row_number() OVER (PARTITION BY code ORDER BY pn DESC) AS nth FROM income GROUP BY code, pn) WHERE nth = 1")
def p06(v: Views) -> DataFrame:
    """The latest period, if only one identity tells of it."""
    g = v.income.groupBy("code", "pn").agg(F.count_distinct("update_flag").alias("n"), F.max("revenue").alias("r"))
    return pit.latest(g, ["code"], "pn").select("code", "pn", F.when(F.col("n") > 1, "ambiguous_period_chain").alias("reason"), F.round(F.when(F.col("n") == 1, F.col("r")), 6).alias("revenue"))


@query("P14_level", f", {KNOWN} SELECT as_of, code, max(pn) AS pn, round(arg_max(revenue, pn), 6) AS level FROM k GROUP BY 1, 2")
def p14(v: Views) -> DataFrame:
    return known(v).groupBy("as_of", "code").agg(F.max("pn").alias("pn"), F.round(F.max_by("revenue", "pn"), 6).alias("level"))


@query("P26_source_chain", f", {SINGLE} SELECT as_of, code, pn, string_agg(pn::varchar, '|' ORDER BY pn) OVER (PARTITION BY as_of, code ORDER BY pn RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS chain FROM s WHERE sq_revenue IS NOT NULL")
def p26(v: Views) -> DataFrame:
    """The periods that a trailing sum draws on, in order."""
    w = Window.partitionBy("as_of", "code").orderBy("pn").rangeBetween(-3, 0)
    chain = F.array_sort(F.collect_list("pn").over(w))
    return single(v).where("sq_revenue is not null").select("as_of", "code", "pn", F.array_join(chain.cast("array<string>"), "|").alias("chain"))


@query("G21_provenance", " SELECT code, yr, string_agg(DISTINCT strftime(ann_date, '%Y%m%d'), '|' ORDER BY strftime(ann_date, '%Y%m%d')) AS dates, count(*) AS n FROM income GROUP BY 1, 2")
def g21(v: Views) -> DataFrame:
    days = F.array_sort(F.collect_set(F.date_format("ann_date", "yyyyMMdd")))
    return v.income.groupBy("code", "yr").agg(F.array_join(days, "|").alias("dates"), F.count("*").alias("n"))


@query("G06_period_union", " SELECT code, count(*) AS n FROM (SELECT code, yr, q FROM income UNION SELECT code, yr, q FROM q_cum WHERE q <> 3) GROUP BY code")
def g06(v: Views) -> DataFrame:
    both = v.income.select("code", "yr", "q").unionByName(v.q_cum.where("q <> 3").select("code", "yr", "q")).distinct()
    return both.groupBy("code").agg(F.count("*").alias("n"))


MONTHS = f"{REGIME}, ms AS (SELECT s.month, s.as_of, coalesce(r.regime, 'none') AS regime FROM (SELECT date_trunc('month', session_date)::date AS month, min(session_date) AS as_of FROM cal WHERE day(session_date) >= 15 GROUP BY 1) s JOIN reg r ON r.session_date = s.as_of)"


def months(v: Views) -> DataFrame:
    return p21(v).select("month", "as_of", F.coalesce("regime", F.lit("none")).alias("regime"))


@query("P22_stratified_sample", f"{MONTHS} SELECT year(month)::int AS yr, regime, month FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY year(month), regime) AS t FROM ms WINDOW w AS (PARTITION BY year(month), regime ORDER BY month)) WHERE n = (t - 1) // 2 + 1")
def p22(v: Views) -> DataFrame:
    """Of each year and regime the lower median month."""
    w = Window.partitionBy("yr", "regime")
    rows = months(v).withColumn("yr", F.year("month"))
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("month"))).withColumn("t", F.count("*").over(w))
    return rows.where("n = (t - 1) div 2 + 1").select("yr", "regime", "month")


@query("P27_stage_selection", f"{MONTHS} SELECT month, regime, n = 1 AS first_of_year, n = 1 OR n = t OR n = (t + 1) // 2 AS spread FROM (SELECT *, row_number() OVER (PARTITION BY year(month) ORDER BY month) AS n, count(*) OVER (PARTITION BY year(month)) AS t FROM ms)")
def p27(v: Views) -> DataFrame:
    w = Window.partitionBy(F.year("month"))
    rows = months(v).withColumn("n", F.row_number().over(w.orderBy("month"))).withColumn("t", F.count("*").over(w))
    return rows.select("month", "regime", (F.col("n") == 1).alias("first_of_year"), F.expr("n = 1 or n = t or n = (t + 1) div 2").alias("spread"))


@query("E08_next_reports", " SELECT as_of, code, pn, nth FROM (SELECT a.as_of, f.code, f.pn, row_number() OVER (PARTITION BY a.as_of, f.code ORDER BY f.pn) AS nth FROM as_of a JOIN (SELECT code, pn, min(ann_date) AS first_day FROM income GROUP BY 1, 2) f ON f.first_day > a.as_of) WHERE nth <= 2")
def e08(v: Views) -> DataFrame:
    """The next two periods whose first version came after the date."""
    first = v.income.groupBy("code", "pn").agg(F.min("ann_date").alias("first_day"))
    return pit.next_periods(first, v.as_of.select("as_of")).select("as_of", "code", "pn", F.col("nth").cast("long").alias("nth"))


@query("X06_turnaround_state", f", {SINGLE}, tp AS (SELECT s.as_of, s.code, s.pn, s.sq_profit AS c, p.sq_profit AS p FROM s LEFT JOIN s p ON p.as_of = s.as_of AND p.code = s.code AND p.pn = s.pn - 1) SELECT as_of, code, pn, CASE WHEN c IS NULL OR p IS NULL THEN 'INSUFFICIENT' WHEN p < 0 AND c > 0 THEN 'STRONG_TURNAROUND' WHEN c > p THEN 'IMPROVING' WHEN c < p THEN 'DETERIORATING' ELSE 'STABLE' END AS state FROM tp")
def x06(v: Views) -> DataFrame:
    s = single(v).select("as_of", "code", "pn", F.col("sq_profit").alias("c"))
    p = s.select("as_of", "code", (F.col("pn") + 1).alias("pn"), F.col("c").alias("p"))
    state = F.when(F.col("c").isNull() | F.col("p").isNull(), "INSUFFICIENT").when((F.col("p") < 0) & (F.col("c") > 0), "STRONG_TURNAROUND").when(F.col("c") > F.col("p"), "IMPROVING").when(F.col("c") < F.col("p"), "DETERIORATING").otherwise("STABLE")
    return s.join(p, ["as_of", "code", "pn"], "left").select("as_of", "code", "pn", state.alias("state"))


@query("A09_leak_audit", f", {KNOWN} SELECT as_of, count(*) AS n, count(*) FILTER (ann_date > as_of OR end_date > as_of) AS leaks FROM k GROUP BY as_of")
def a09(v: Views) -> DataFrame:
    """Evidence whose date comes after the date it was used on; there must be none."""
    return known(v).groupBy("as_of").agg(F.count("*").alias("n"), F.count_if(F.expr("ann_date > as_of or end_date > as_of")).alias("leaks"))


@query("J06_shifted_periods", f", {KNOWN} SELECT k.as_of, k.code, k.pn, p.pn IS NOT NULL AS has_previous, y.pn IS NOT NULL AS has_year_before FROM k LEFT JOIN k p ON p.as_of = k.as_of AND p.code = k.code AND p.pn = k.pn - 1 LEFT JOIN k y ON y.as_of = k.as_of AND y.code = k.code AND y.pn = k.pn - 4")
def j06(v: Views) -> DataFrame:
    """Both shifted periods come from one exchange, as frames on the period number."""
    w = Window.partitionBy("as_of", "code").orderBy("pn")
    return known(v).select("as_of", "code", "pn", (F.count("*").over(w.rangeBetween(-1, -1)) > 0).alias("has_previous"), (F.count("*").over(w.rangeBetween(-4, -4)) > 0).alias("has_year_before"))
