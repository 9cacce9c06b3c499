"""Queries that check frames, evidence, rankings and the use of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.functions.quality import INVALID_TOKENS, evidence_category, fatal, frame_quality
from tidemark.operators import pit
from tidemark.plans.facts import GROWTH, KNOWN, SINGLE, known, single
from tidemark.plans.replay import FIELDS, RANKED, ranked
from tidemark.plans.stored import place
from tidemark.plans.views import Views
from tidemark.registry import query

STATUS = """CASE (code + pn) % 9 WHEN 0 THEN 'Unsupported_PIT' WHEN 1 THEN 'stale' WHEN 2 THEN 'missing' WHEN 3 THEN 'insufficient_history' WHEN 4 THEN 'odd' WHEN 5 THEN ' Valid ' WHEN 6 THEN 'known' WHEN 7 THEN 'known' END"""
REASON = """CASE (code * 3 + pn) % 11 WHEN 0 THEN 'unsupported_dataset' WHEN 1 THEN 'calendar_stale' WHEN 2 THEN 'zero_baseline' WHEN 3 THEN 'missing_row' ELSE why END"""


@query("F20_evidence_status", f""", {SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, st AS (SELECT as_of, code, pn, {STATUS} AS status, {REASON} AS reason, CASE WHEN why IS NULL THEN (v - base) / base END AS value FROM g),
  sl AS (SELECT *, coalesce(lower(trim(status)), 'missing') AS s, coalesce(reason, '') AS r FROM st),
  sc AS (SELECT *, CASE WHEN s LIKE '%unsupported%' OR r LIKE '%unsupported%' THEN 'unsupported' WHEN regexp_matches(r, '{"|".join(INVALID_TOKENS)}') OR s = 'stale' THEN 'invalid' WHEN value IS NULL THEN CASE WHEN s IN ('insufficient_history', 'stale') THEN 'invalid' ELSE 'missing' END
    WHEN s IN ('known', 'valid') THEN 'valid' WHEN s = 'missing' THEN 'missing' ELSE 'invalid' END AS category FROM sl)
  SELECT as_of, code, pn, category FROM sc""")
def f20_status(v: Views) -> DataFrame:
    """Statuses and reasons of all kinds on growth figures; some statuses are unheard of, some missing."""
    rows = pit.comparable(single(v).drop("reason"), "sq_revenue", 4).withColumnRenamed("reason", "why")
    return rows.select("as_of", "code", "pn", evidence_category(F.expr(STATUS), F.expr(REASON), F.col("growth")).alias("category"))


#: A feed with a text for its date, some of them impossible, some rows without key or partition, and in some batches another column.
FEED = "SELECT CASE WHEN l_orderkey % 97 <> 5 THEN l_orderkey END AS l_orderkey, l_linenumber, CASE WHEN l_partkey % 53 <> 7 THEN l_returnflag END AS l_returnflag, CASE WHEN l_suppkey % 89 = 3 THEN '20210230' ELSE date_format(l_shipdate, 'yyyyMMdd') END AS day, l_quantity, month(l_shipdate) AS unit, l_orderkey AS batch FROM lineitem"
FEED_SQL = FEED.replace("date_format(l_shipdate, 'yyyyMMdd')", "strftime(l_shipdate, '%Y%m%d')")
EXPECTED = ("l_orderkey", "l_linenumber", "l_returnflag", "day", "l_quantity")
QUALITY = f"""fe AS ({FEED_SQL}), fi AS (SELECT unit, l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag IS NULL) AS np, count(*) FILTER (day = '20210230') AS bd FROM fe GROUP BY ALL),
  fq AS (SELECT unit, sum(n)::bigint AS "rows", coalesce(sum(n) FILTER (n > 1), 0)::bigint AS duplicate_identity_rows, coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0)::bigint AS null_identity_rows, sum(np)::bigint AS null_partition_rows, sum(bd)::bigint AS bad_dates FROM fi GROUP BY unit),
  fz AS (SELECT *, 'superset' AS schema_relation, concat_ws('|', 'missing_required=l_tax', CASE WHEN null_identity_rows > 0 THEN 'null_identity_rows=' || null_identity_rows END, CASE WHEN duplicate_identity_rows > 0 THEN 'duplicate_identity_rows=' || duplicate_identity_rows END, CASE WHEN null_partition_rows > 0 THEN 'null_partition_rows=' || null_partition_rows END, CASE WHEN bad_dates > 0 THEN 'bad_dates=' || bad_dates END, 'schema_drift=superset') AS warnings FROM fq)"""


def feed(v: Views) -> DataFrame:
    return v.run(FEED)


@query("A01_frame_quality", f", {QUALITY} SELECT * FROM fz")
def a01_quality(v: Views) -> DataFrame:
    """All checks of each month's batch in one pass."""
    return frame_quality(feed(v), ["unit"], ["l_orderkey", "l_tax"], ["l_orderkey", "l_linenumber"], "l_returnflag", ["day"], EXPECTED)


GATED = f"""fe AS ({FEED_SQL}), gu AS (SELECT * FROM fe WHERE l_quantity < 40), gi AS (SELECT batch, l_orderkey, l_linenumber, day, count(*) AS n, count(*) FILTER (day = '20210230') AS bd FROM gu GROUP BY ALL),
  gb AS (SELECT batch, CASE WHEN count(*) FILTER (l_orderkey IS NULL) > 0 OR coalesce(sum(bd), 0) > 0 THEN 'fatal_quality' WHEN min(CASE WHEN bd = 0 THEN day END) < '19950105' OR max(CASE WHEN bd = 0 THEN day END) > '20010801' THEN 'out_of_range' END AS reason FROM gi GROUP BY batch)"""


ROWS_A_TASK = 250_000


@query("A19_routed_batches", f", {GATED} SELECT coalesce(b.reason, 'accepted') AS route, count(DISTINCT b.batch) AS batches, count(*) AS n, sum(CASE WHEN b.reason IS NULL THEN g.l_quantity END)::bigint AS stored_quantity FROM gb b JOIN gu g USING (batch) GROUP BY 1")
def a19_routed(v: Views) -> DataFrame:
    """Batches whose checks warn or whose dates leave the range are set aside whole and not written; the others are stored."""
    rows = sources.materialize(feed(v).where("l_quantity < 40"), "batches")
    # shuffled bytes of such rows say little of what they take in memory, so tasks are dealt by number of rows, and whole batches meet once
    rows = rows.repartition(1 + rows.count() // ROWS_A_TASK, "batch")
    keys = ["l_orderkey", "l_linenumber"]
    checks = frame_quality(rows.dropDuplicates(["batch", *keys, "day"]), ["batch"], [], [*keys, "day"], "l_quantity", ["day"], rows.columns)
    good = F.col("day") != "20210230"
    span = rows.groupBy("batch").agg(F.min(F.when(good, F.col("day"))).alias("lo"), F.max(F.when(good, F.col("day"))).alias("hi"))
    why = F.when(fatal(F.col("warnings")), "fatal_quality").when((F.col("lo") < "19950105") | (F.col("hi") > "20010801"), "out_of_range")
    routed = rows.join(checks.join(span.hint("merge"), "batch").select("batch", why.alias("reason")).hint("merge"), "batch")
    path = place(v, "accepted")
    sources.write(routed.where("reason is null").drop("reason"), path)
    try:
        stored = v.spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = rows.limit(0)
    refused = routed.where("reason is not null").groupBy(F.col("reason").alias("route")).agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"), F.lit(None).cast("long").alias("stored_quantity"))
    kept = stored.groupBy(F.lit("accepted").alias("route")).agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("stored_quantity"))
    return refused.unionByName(kept)


@query("A09_full_audit", f""", {RANKED}, au AS (SELECT as_of, count(*) FILTER (ann_date > as_of) AS late_available, count(*) FILTER (end_date > as_of) AS late_period FROM k GROUP BY as_of),
  ra AS (SELECT as_of, count(*) AS n, max(rank) - count(*) AS rank_gap, count(*) FILTER (score > before AND gate = gate_before) AS disorder, count(*) FILTER (gate <> 'rejected' AND gate_before = 'rejected') AS rejected_ahead, count(*) FILTER (expectation IS NOT NULL AND repricing_20d IS NULL) AS excess_without_benchmark
    FROM (SELECT *, lag(round(score, 4)) OVER (PARTITION BY as_of ORDER BY rank) AS before, lag(gate) OVER (PARTITION BY as_of ORDER BY rank) AS gate_before FROM (SELECT * REPLACE (round(score, 4) AS score) FROM rk)) GROUP BY as_of)
  SELECT as_of, n, late_available, late_period, rank_gap, disorder, rejected_ahead, excess_without_benchmark FROM ra JOIN au USING (as_of)""")
def a09_full(v: Views) -> DataFrame:
    """Evidence later than its date, an excess without its benchmark, and ranks that leave gaps or break their order; there must be none."""
    w = Window.partitionBy("as_of").orderBy("rank")
    c = F.col
    v.keep("px", "as_of", "cal", "bench", "statements", "income")
    rows = v.once("ranked", lambda: ranked(v)).withColumn("score", F.round("score", 4))
    rows = rows.withColumns({"before": F.lag("score").over(w), "gate_before": F.lag("gate").over(w)})
    ranks = rows.groupBy("as_of").agg(
        F.count("*").alias("n"), (F.max("rank") - F.count("*")).alias("rank_gap"), F.count_if((c("score") > c("before")) & (c("gate") == c("gate_before"))).alias("disorder"),
        F.count_if((c("gate") != "rejected") & (c("gate_before") == "rejected")).alias("rejected_ahead"), F.count_if(c("expectation").isNotNull() & c("repricing_20d").isNull()).alias("excess_without_benchmark"),
    )
    late = known(v).groupBy("as_of").agg(F.count_if(F.expr("ann_date > as_of")).alias("late_available"), F.count_if(F.expr("end_date > as_of")).alias("late_period"))
    return ranks.join(late, "as_of").select("as_of", "n", "late_available", "late_period", "rank_gap", "disorder", "rejected_ahead", "excess_without_benchmark")


#: A dated registry of what a field may be used for, kept with the data: from the year's first announcement on.
SAFETY = "CASE WHEN field IN ('gate', 'quality') THEN 'PIT_SAFE' WHEN field LIKE '%percentile' OR field = 'abnormal_volume' THEN 'PIT_SAFE_WITH_LAG' WHEN field = 'transition' THEN 'UNSUPPORTED_PIT' WHEN field LIKE '%penalty' THEN NULL ELSE 'PIT_SAFE' END"


@query("A18_registry_use", f", {RANKED}, uf AS ({' UNION ALL '.join(f'''SELECT as_of, '{f}' AS field, count({f}) AS n FROM rk GROUP BY as_of''' for f in FIELDS)}) SELECT field, coalesce({SAFETY}, 'UNREGISTERED') AS status, sum(n)::bigint AS uses, count(*) FILTER (n > 0) AS dates FROM uf GROUP BY 1, 2")
def a18_use(v: Views) -> DataFrame:
    """How often each of the required fields is used, and what the registry allows it for."""
    counts = ranked(v).groupBy("as_of").agg(*[F.count(f).alias(f) for f in FIELDS])
    long = counts.select("as_of", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in FIELDS])))
    return long.groupBy("field", F.coalesce(F.expr(SAFETY), F.lit("UNREGISTERED")).alias("status")).agg(F.sum("n").alias("uses"), F.count_if(F.col("n") > 0).alias("dates"))


SMOKE = {
    "filtered": "SELECT code, pn, CAST(NULL AS bigint) AS n FROM income WHERE code = :code AND end_date = :period",
    "sorted": "SELECT code, pn, CAST(row_number() OVER (ORDER BY end_date DESC, update_flag) AS bigint) AS n FROM income WHERE code = :code",
    "aggregate": "SELECT code, CAST(NULL AS int) AS pn, count(*) AS n FROM income GROUP BY code",
    "window": "SELECT code, pn, count(*) OVER (PARTITION BY code) AS n FROM income",
}


@query("S14_smoke_queries", f" {' UNION ALL '.join(f'''SELECT '{k}' AS kind, * FROM ({q.replace(':code', '3').replace(':period', "DATE '1997-06-30'")})''' for k, q in SMOKE.items())}")
def s14_smoke(v: Views) -> DataFrame:
    """The four queries that every dataset must answer: filter, sort, aggregate and window, with bound parameters."""
    import datetime

    name = sources.register(v.income, "income")
    out = None
    for kind, sql in SMOKE.items():
        args = {k: x for k, x in {"code": 3, "period": datetime.date(1997, 6, 30)}.items() if ":" + k in sql}
        rows = v.spark.sql(sql.replace("income", name), args=args).select(F.lit(kind).alias("kind"), "code", F.col("pn").cast("int").alias("pn"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("K07_reference_sample", " SELECT code, string_agg(why, '|' ORDER BY why) AS roles FROM (SELECT code, 'first_of_board' AS why FROM ref QUALIFY row_number() OVER (PARTITION BY board ORDER BY code) = 1 UNION ALL SELECT code, 'first_of_industry' FROM ref QUALIFY row_number() OVER (PARTITION BY industry ORDER BY code) = 1 UNION ALL SELECT code, 'oldest' FROM ref QUALIFY row_number() OVER (ORDER BY list_idx, code) <= 2 UNION ALL SELECT code, 'newest' FROM ref QUALIFY row_number() OVER (ORDER BY list_idx DESC, code DESC) <= 2) GROUP BY code ORDER BY code LIMIT 16")
def k07_sample(v: Views) -> DataFrame:
    """At most sixteen entities for checks: the oldest, the newest, and the first of each board and industry. The limit is the operator's own."""
    from tidemark.operators.rank import top

    ref, c = v.ref, F.col
    parts = [top(ref, [by], [c("code")], 1).select("code", F.lit(f"first_of_{by}").alias("why")) for by in ("board", "industry")]
    for why, order in (("oldest", ["list_idx", "code"]), ("newest", [c("list_idx").desc(), c("code").desc()])):
        parts.append(ref.orderBy(*order).limit(2).select("code", F.lit(why).alias("why")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("why")), "|").alias("roles")).orderBy("code").limit(16)
