"""Queries that count, audit and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.views import Views
from tidemark.registry import query


@query("G01_group_count", " SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def g01(v: Views) -> DataFrame:
    return v.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("G02_duplicates", " SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def g02(v: Views) -> DataFrame:
    return v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("G03_ranges", " SELECT l_partkey, min(l_shipdate)::date AS lo, max(l_shipdate)::date AS hi, count(*) AS n FROM lineitem GROUP BY 1")
def g03(v: Views) -> DataFrame:
    return v.lineitem.groupBy("l_partkey").agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"), F.count("*").alias("n"))


@query("G05_distinct_per_date", " SELECT l_shipdate::date AS d, count(*) AS n, count(DISTINCT l_suppkey) AS codes FROM lineitem GROUP BY 1")
def g05(v: Views) -> DataFrame:
    return v.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("codes"))


@query("A01_quality", " SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates, count(*) FILTER (l_shipdate IS NULL) AS bad_dates, count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys FROM lineitem")
def a01(v: Views) -> DataFrame:
    g = v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"), F.count_if(F.isnull("l_shipdate")).alias("b"))
    return g.agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("duplicates"), F.sum("b").alias("bad_dates"), F.sum(F.when(F.isnull("l_orderkey") | F.isnull("l_linenumber"), F.col("c")).otherwise(0)).alias("null_keys"))


@query("A02_missing_sessions", " SELECT r.code, count(c.idx) - count(p.idx) AS missing, CASE WHEN count(p.idx) = 0 THEN 'EMPTY' WHEN count(c.idx) = count(p.idx) THEN 'PASS' ELSE 'PARTIAL' END AS status FROM ref r CROSS JOIN cal c LEFT JOIN px p ON p.code = r.code AND p.idx = c.idx GROUP BY r.code")
def a02(v: Views) -> DataFrame:
    total = v.cal.agg(F.count("*").alias("t"))
    have = v.px.groupBy("code").agg(F.count("*").alias("h"))
    out = v.ref.select("code").join(have, "code", "left").crossJoin(F.broadcast(total)).withColumn("h", F.coalesce("h", F.lit(0)))
    return out.select("code", (F.col("t") - F.col("h")).alias("missing"), F.when(F.col("h") == 0, "EMPTY").when(F.col("h") == F.col("t"), "PASS").otherwise("PARTIAL").alias("status"))


INGEST = "ig AS (SELECT event_id % 10 AS batch_id, event_id, user_id FROM events UNION ALL SELECT 10, event_id, user_id FROM events WHERE event_id % 10 = 7)"


def ingest(v: Views) -> DataFrame:
    e = v.events.select((F.col("event_id") % 10).alias("batch_id"), "event_id", "user_id", "ts", "value")
    return e.union(e.where("batch_id = 7").withColumn("batch_id", F.lit(10).cast("long")))


@query("A12_batch_audit", f", {INGEST}, s AS (SELECT batch_id, count(*) AS n, count(DISTINCT event_id) AS ids, min(event_id) AS lo, max(event_id) AS hi, sum(user_id) AS u FROM ig GROUP BY 1) SELECT batch_id, n, n - ids AS duplicates, count(*) OVER (PARTITION BY n, lo, hi, u) > 1 AS replayed FROM s")
def a12(v: Views) -> DataFrame:
    """Batches with one signature are replays; a signature is an order-free sum of row hashes."""
    s = ingest(v).groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum(F.xxhash64("event_id", "user_id", "ts", "value").cast("decimal(38,0)")).alias("sig"))
    return s.select("batch_id", "n", (F.col("n") - F.col("ids")).alias("duplicates"), (F.count("*").over(Window.partitionBy("n", "sig")) > 1).alias("replayed"))


@query("S07_merge", f", {INGEST} SELECT event_id, max(batch_id) AS batch_id FROM ig GROUP BY event_id")
def s07(v: Views) -> DataFrame:
    """The last batch's row of each key stays."""
    w = Window.partitionBy("event_id").orderBy(F.col("batch_id").desc())
    return ingest(v).withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id", "batch_id")


@query("A06_latest_record", f", {INGEST} SELECT user_id, arg_max(event_id, event_id) AS last_event, count(*) AS n FROM ig GROUP BY user_id")
def a06(v: Views) -> DataFrame:
    return ingest(v).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query("A16_table_state", " SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, min(o_orderdate)::date AS lo, max(o_orderdate)::date AS hi FROM orders")
def a16(v: Views) -> DataFrame:
    return v.orders.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("keys"), F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))


@query("A17_required_inputs", " SELECT a.as_of, r.code FROM as_of a CROSS JOIN ref r WHERE NOT EXISTS (SELECT 1 FROM px p WHERE p.code = r.code AND p.idx = a.idx)")
def a17(v: Views) -> DataFrame:
    grid = v.ref.select("code").crossJoin(F.broadcast(v.as_of))
    return grid.join(v.px.select("code", "idx"), ["code", "idx"], "left_anti").select("as_of", "code")


@query("J09_multiset_compare", " SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 <> 0) GROUP BY 1, 2")
def j09(v: Views) -> DataFrame:
    e = v.events.select("user_id", "event_type")
    return e.exceptAll(v.events.where("event_id % 3 <> 0").select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


#: A row as text in which both engines agree, its sha256, and of that the first 12 digits as a number.
ROW_TEXT = "concat_ws('|', o_orderkey, coalesce(CAST(o_custkey AS varchar(20)), '~'), coalesce(o_orderstatus, '~'), coalesce(CAST(CAST(round(o_totalprice * 100) AS bigint) AS varchar(20)), '~'), coalesce(CAST(CAST(o_orderdate AS date) AS varchar(10)), '~'), coalesce(o_orderpriority, '~'))"


@query("A08_fingerprint", f" SELECT count(*) AS n, CAST(sum(h) AS varchar) AS total, CAST(bit_xor(CAST(h AS bigint)) AS bigint) AS mixed, sha256(concat_ws('|', count(*), CAST(sum(h) AS varchar), bit_xor(CAST(h AS bigint)))) AS fingerprint FROM (SELECT CAST('0x' || substr(sha256({ROW_TEXT}), 1, 12) AS bigint) AS h FROM orders)")
def a08(v: Views) -> DataFrame:
    """An identity of a table that doesn't depend on the order of rows: their number, and the sum and xor of their hashes."""
    return fingerprint(v.orders, F.expr(ROW_TEXT))


def fingerprint(df: DataFrame, row_text: Column) -> DataFrame:
    h = F.conv(F.substring(F.sha2(row_text, 256), 1, 12), 16, 10).cast("long")
    out = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("mixed"))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "n", "total", "mixed"), 256))
