"""Audits of the stored tables: manifests, reconciliation, provenance and what fields may be used for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import top
from tidemark.plans.history import FEATURES, features
from tidemark.plans.views import Views
from tidemark.registry import query
from tidemark.sources import schema_hash

COLUMNS = ("l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey", "l_tax")


def manifest(df: DataFrame, day: str) -> DataFrame:
    """Rows, first and last day and schema of each monthly partition."""
    d = F.to_date(day)
    return df.groupBy(F.to_date(F.date_trunc("month", day)).alias("part")).agg(F.count("*").alias("n"), F.min(d).alias("first_day"), F.max(d).alias("last_day")).withColumn("schema_hash", F.lit(schema_hash(df.columns)))


@query("A07_manifest", f" SELECT date_trunc('month', l_shipdate)::date AS part, count(*) AS n, min(l_shipdate)::date AS first_day, max(l_shipdate)::date AS last_day, '{schema_hash(COLUMNS)}' AS schema_hash FROM lineitem GROUP BY 1")
def a07(v: Views) -> DataFrame:
    return manifest(v.lineitem, "l_shipdate")


@query("A05_reconciliation", " SELECT part, n, claimed, CASE WHEN n IS NULL THEN 'missing' WHEN claimed IS NULL THEN 'unclaimed' WHEN n <> claimed THEN 'row_mismatch' ELSE 'ok' END AS status FROM (SELECT date_trunc('month', o_orderdate)::date AS part, count(*) AS n FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1) FULL JOIN (SELECT date_trunc('month', o_orderdate)::date AS part, count(*) + CASE WHEN month(min(o_orderdate)) = 3 THEN 1 ELSE 0 END AS claimed FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1) USING (part)")
def a05(v: Views) -> DataFrame:
    """A ledger of claimed rows against what is stored."""
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("part")
    stored = v.orders.where("month(o_orderdate) <> 5").groupBy(month).agg(F.count("*").alias("n"))
    ledger = v.orders.where("month(o_orderdate) <> 7").groupBy(month).agg(F.count("*").alias("claimed")).withColumn("claimed", F.col("claimed") + F.when(F.month("part") == 3, 1).otherwise(0))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("claimed").isNull(), "unclaimed").when(F.col("n") != F.col("claimed"), "row_mismatch").otherwise("ok")
    return stored.join(ledger, "part", "full_outer").select("part", "n", "claimed", status.alias("status"))


@query("A04_corpus_verdict", " , yc AS (SELECT p.code, year(c.session_date)::int AS yr, count(*) AS n FROM px p JOIN cal c USING (idx) GROUP BY 1, 2), yt AS (SELECT year(session_date)::int AS yr, count(*) AS sessions FROM cal GROUP BY 1), yd AS (SELECT year(l_shipdate)::int AS yr, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem GROUP BY 1) SELECT y.yr, y.sessions, count(c.code) AS entities, count(*) FILTER (c.n < 0.5 * y.sessions) AS sparse, max(d.repeated) AS repeated, CASE WHEN count(c.code) = 0 THEN 'FAIL' WHEN count(*) FILTER (c.n < 0.5 * y.sessions) > 0.2 * count(c.code) THEN 'WARN' ELSE 'PASS' END AS verdict FROM yt y LEFT JOIN yc c USING (yr) LEFT JOIN yd d USING (yr) GROUP BY 1, 2")
def a04(v: Views) -> DataFrame:
    """Per year: sessions, entities, those with less than half of the sessions, repeated keys, and the verdict."""
    held = v.px.groupBy("code", F.year("session_date").alias("yr")).agg(F.count("*").alias("n"))
    sessions = v.cal.groupBy(F.year("session_date").alias("yr")).agg(F.count("*").alias("sessions"))
    keys = v.lineitem.groupBy(F.year("l_shipdate").alias("yr"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).groupBy("yr").agg(F.sum(F.col("k") - 1).alias("repeated"))
    rows = held.join(F.broadcast(sessions), "yr", "right").groupBy("yr", "sessions").agg(F.count("code").alias("entities"), F.count_if(F.col("n") < 0.5 * F.col("sessions")).alias("sparse"))
    verdict = F.when(F.col("entities") == 0, "FAIL").when(F.col("sparse") > 0.2 * F.col("entities"), "WARN").otherwise("PASS")
    return rows.join(keys, "yr", "left").select("yr", "sessions", "entities", "sparse", "repeated", verdict.alias("verdict"))


HORIZONS = (20, 60, 120, 250)
WINDOWS = f"""aw AS (SELECT CAST(h AS int) AS horizon, count(*) FILTER (idx + h <= last) AS available, CAST(least(h, max(last)) AS bigint) AS right_censored, min(CASE WHEN idx + h <= last THEN session_date END) AS first_day, max(CASE WHEN idx + h <= last THEN session_date END) AS last_day
  FROM (SELECT *, max(idx) OVER () AS last FROM cal), (SELECT unnest({list(HORIZONS)}) AS h) GROUP BY h)"""


@query("A04_forward_windows", f", {WINDOWS} SELECT *, CASE WHEN available > 0 THEN 'PASS' ELSE 'UNKNOWN' END AS status FROM aw")
def a04_windows(v: Views) -> DataFrame:
    """For each horizon how many sessions have their whole window before the calendar's end, the first and last of them, and how many lack it."""
    rows = v.cal.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn("end", v.cal.agg(F.max("idx")).scalar())
    whole = F.col("idx") + F.col("horizon") <= F.col("end")
    out = rows.groupBy("horizon").agg(F.count_if(whole).alias("available"), F.least("horizon", F.max("end")).cast("long").alias("right_censored"), F.min(F.when(whole, F.col("session_date"))).alias("first_day"), F.max(F.when(whole, F.col("session_date"))).alias("last_day"))
    return out.withColumn("status", F.when(F.col("available") > 0, "PASS").otherwise("UNKNOWN"))


#: The benchmark lacks some sessions; the longest-known entity with 21 sessions in common gives the sample.
SAMPLE = """ab AS (SELECT c.idx, b.session_date, b.close FROM bench b JOIN cal c USING (session_date) WHERE c.idx % 40 <> 0), af AS (SELECT code, min(session_date) AS since FROM px GROUP BY 1),
  ac AS (SELECT p.code, p.idx, p.session_date, p.close AS s, b.close AS b, row_number() OVER (PARTITION BY p.code ORDER BY p.idx DESC) AS nth FROM px p JOIN ab b ON b.idx = p.idx),
  as1 AS (SELECT a.code, f.since, z.session_date AS sample_date, z.s / a.s - 1 AS stock_return, z.b / a.b - 1 AS benchmark_return FROM ac a JOIN ac z ON z.code = a.code AND z.nth = 1 JOIN af f ON f.code = a.code WHERE a.nth = 21 AND a.s <> 0 AND a.b <> 0),
  as2 AS (SELECT * FROM as1 ORDER BY since, code LIMIT 1), al AS (SELECT c.session_date FROM cal c LEFT JOIN ab b ON b.idx = c.idx WHERE b.idx IS NULL),
  an AS (SELECT (SELECT count(*) FROM cal) AS expected, (SELECT count(*) FROM ab) AS actual, (SELECT min(session_date) FROM ab) AS first_day, (SELECT max(session_date) FROM ab) AS last_day, coalesce((SELECT string_agg(strftime(session_date, '%Y%m%d'), '|' ORDER BY session_date) FROM al), '') AS missing)"""
SAMPLED = f"""{SAMPLE}, ax AS (SELECT n.*, s.code AS sample_code, s.sample_date, s.stock_return, s.benchmark_return, concat_ws('|', CASE WHEN n.missing <> '' THEN 'missing_benchmark_sessions' END, CASE WHEN s.code IS NULL THEN 'benchmark_excess_sample_unavailable' END) AS warnings FROM an n LEFT JOIN as2 s ON true)"""


@query("A04_benchmark", f", {SAMPLED} SELECT expected, actual, first_day, last_day, missing, sample_code, sample_date, round(stock_return, 6) AS stock_return, round(benchmark_return, 6) AS benchmark_return, round(stock_return - benchmark_return, 6) AS excess, warnings, CASE WHEN actual = 0 THEN 'UNKNOWN' WHEN warnings = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM ax")
def a04_benchmark(v: Views) -> DataFrame:
    """Sessions that the benchmark has and lacks, and the excess of a sample over the last 21 sessions in common; the calendar bounds the list."""
    v.keep("px", "cal", "bench")
    marks = v.bench.join(v.cal, "session_date").where("idx % 40 <> 0")
    sums = marks.agg(F.count("*").alias("actual"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))
    lacking = v.cal.join(marks.select("idx"), "idx", "left_anti").agg(F.array_join(F.array_sort(F.collect_list(F.date_format("session_date", "yyyyMMdd"))), "|").alias("missing"))
    common = v.px.select("code", "idx", "session_date", F.col("close").alias("s")).join(marks.select("idx", F.col("close").alias("b")), "idx")
    last = top(common, ["code"], [F.col("idx").desc()], 21, "nth")
    at = lambda c, n: F.max(F.when(F.col("nth") == n, F.col(c)))
    each = last.groupBy("code").agg(at("session_date", 1).alias("sample_date"), at("s", 1).alias("s1"), at("s", 21).alias("s0"), at("b", 1).alias("b1"), at("b", 21).alias("b0")).where("s0 <> 0 and b0 <> 0")
    oldest = each.join(v.px.groupBy("code").agg(F.min("session_date").alias("since")), "code").agg(F.min(F.struct("since", "code", "sample_date", (F.col("s1") / F.col("s0") - 1).alias("stock"), (F.col("b1") / F.col("b0") - 1).alias("mark"))).alias("x"))
    # one row each
    out = v.cal.agg(F.count("*").alias("expected")).join(sums).join(lacking).join(oldest)
    warnings = F.concat_ws("|", F.when(F.col("missing") != "", "missing_benchmark_sessions"), F.when(F.col("x").isNull(), "benchmark_excess_sample_unavailable"))
    status = F.when(F.col("actual") == 0, "UNKNOWN").when(warnings == "", "PASS").otherwise("FAIL")
    return out.select("expected", "actual", "first_day", "last_day", "missing", F.col("x.code").alias("sample_code"), "x.sample_date", F.round("x.stock", 6).alias("stock_return"), F.round("x.mark", 6).alias("benchmark_return"), F.round(F.col("x.stock") - F.col("x.mark"), 6).alias("excess"), warnings.alias("warnings"), status.alias("status"))


@query("A13_payload_store", " SELECT sha256(props) AS ref_id, props, count(*) AS n, 0::bigint AS dangling FROM events WHERE props IS NOT NULL GROUP BY props")
def a13(v: Views) -> DataFrame:
    """Payloads held once under their hash, how often each is referred to, and references that lead nowhere."""
    refs = v.events.where("props is not null").select("event_id", F.sha2("props", 256).alias("ref_id"))
    store = v.events.where("props is not null").groupBy("props").agg(F.count("*").alias("held")).select(F.sha2("props", 256).alias("ref_id"), "props", F.lit(True).alias("found"))
    used = refs.groupBy("ref_id").agg(F.count("*").alias("n"))
    return used.join(store, "ref_id", "full_outer").select("ref_id", "props", "n", F.when(F.col("found").isNull(), F.col("n")).otherwise(0).alias("dangling"))


@query("A18_field_registry", f", {FEATURES}, fr AS (SELECT * FROM (VALUES ('yoy', 'PIT_SAFE'), ('profit', 'UNSUPPORTED_PIT')) t(feature, status)) SELECT u.as_of, u.feature, coalesce(r.status, 'UNREGISTERED') AS status, u.n FROM (SELECT as_of, 'yoy' AS feature, count(yoy) AS n FROM fw GROUP BY 1 UNION ALL SELECT as_of, 'margin', count(margin) FROM fw GROUP BY 1 UNION ALL SELECT as_of, 'profit', count(profit) FROM fw GROUP BY 1) u LEFT JOIN fr r USING (feature)")
def a18(v: Views) -> DataFrame:
    """Every use of a field with what the registry allows it for."""
    registry = v.spark.createDataFrame([("yoy", "PIT_SAFE"), ("profit", "UNSUPPORTED_PIT")], "feature string, status string")
    used = features(v).groupBy("as_of", "feature").agg(F.count("value").alias("n"))
    return used.join(F.broadcast(registry), "feature", "left").select("as_of", "feature", F.coalesce("status", F.lit("UNREGISTERED")).alias("status"), "n")
