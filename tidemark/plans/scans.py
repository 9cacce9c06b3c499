"""Queries that scan, project and join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import coverage_bucket, date_text, first_of, loose_bool, norm_date, redact, safe_change, safe_ratio
from tidemark.plans.views import Views
from tidemark.registry import query


@query("S01_scan", " SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'")
def s01(v: Views) -> DataFrame:
    return v.lineitem.where("l_shipdate >= timestamp '1997-01-01' and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("S14_bound_sql", " SELECT o_custkey, count(*) AS n, round(sum(CAST(o_totalprice AS decimal(18,2)))::double, 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def s14(v: Views) -> DataFrame:
    v.orders.createOrReplaceTempView("orders")
    return v.spark.sql("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders WHERE o_totalprice > :least GROUP BY o_custkey", args={"least": 1000})


@query("F01_norm_date", " SELECT l_orderkey, l_linenumber, l_shipdate::date AS d, strftime(l_shipdate, '%Y%m%d') AS t FROM lineitem")
def f01(v: Views) -> DataFrame:
    text = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.when(F.col("l_linenumber") % 2 == 0, ".0").otherwise(""))
    return v.lineitem.select("l_orderkey", "l_linenumber", norm_date(text).alias("d"), date_text(text).alias("t"))


@query("F05_safe_change", " SELECT c_custkey, round(CASE WHEN p > 0 AND c_acctbal >= 0 THEN (c_acctbal - p) / p END, 6) AS change, round(CASE WHEN p <> 0 THEN c_acctbal / p END, 6) AS ratio FROM (SELECT *, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer)")
def f05(v: Views) -> DataFrame:
    p = F.lag("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = v.customer.withColumn("p", p)
    return rows.select("c_custkey", F.round(safe_change(F.col("c_acctbal"), F.col("p")), 6).alias("change"), F.round(safe_ratio(F.col("c_acctbal"), F.col("p")), 6).alias("ratio"))


@query("F06_flags", " SELECT o_orderkey, o_orderstatus = 'F' AS flag, CASE WHEN o_totalprice < 0.25e5 THEN '[0.00,0.25)' WHEN o_totalprice < 0.5e5 THEN '[0.25,0.50)' WHEN o_totalprice < 0.75e5 THEN '[0.50,0.75)' WHEN o_totalprice < 0.9e5 THEN '[0.75,0.90)' ELSE '[0.90,1.00]' END AS bucket FROM orders")
def f06(v: Views) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("no")
    return v.orders.select("o_orderkey", loose_bool(text).alias("flag"), coverage_bucket(F.col("o_totalprice") / 1e5).alias("bucket"))


@query("F07_first_value", " SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS value, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS source FROM part")
def f07(v: Views) -> DataFrame:
    rows = v.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("a"), F.col("p_type").alias("b"))
    value, source = first_of("a", "b")
    return rows.select("p_partkey", value.alias("value"), source.alias("source"))


@query("F22_redact", r" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, source, '<redacted>'), '\b(?:proxy-)?authorization\s*[:=]\s*(?:bearer\s+)?\S+', '<redacted-authorization>', 'gi'), '(\bhost\s*=\s*[" + "''" + r'"]?)[^,' + "''" + r'")\s]+' + r"', '\1<redacted-host>', 'gi'), 'https?://[^\s''" + '"' + r"<>\]\[)]+', '<redacted-url>', 'gi') AS text FROM (SELECT doc_id, source, text || ' Authorization: Bearer ' || doc_id || ' host=h' || doc_id || '.lan, key ' || source AS t FROM documents)")
def f22(v: Views) -> DataFrame:
    """Texts with a header, a host and the row's source as its secret at their end."""
    own = [F.col("doc_id").cast("string"), F.col("source")]
    text = F.concat("text", F.lit(" Authorization: Bearer "), own[0], F.lit(" host=h"), own[0], F.lit(".lan, key "), own[1])
    return v.documents.select("doc_id", redact(text, own[1]).alias("text"))
