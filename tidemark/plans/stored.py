"""Queries that write datasets in each layout and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.plans.audits import INGEST, ingest
from tidemark.plans.ranking import ALT, PICKS, _alt, picks
from tidemark.plans.views import Views
from tidemark.registry import query
from tidemark.streaming import upsert


def place(v: Views, label: str) -> str:
    return f"{sources.shared_dir(v.spark)}/tidemark/{label}-{uuid.uuid4().hex}"


@query("S02_full_read", " SELECT year(o_orderdate) AS yr, count(*) AS n, count(o_custkey) FILTER (year(o_orderdate) >= 1998) AS with_customer, sum(CAST(o_totalprice AS decimal(18,2)))::double AS total FROM orders GROUP BY 1")
def s02(v: Views) -> DataFrame:
    """Files whose columns differ are read as one dataset by column name."""
    path, rows = place(v, "orders"), v.orders.withColumn("yr", F.year("o_orderdate").cast("long"))
    rows.where("yr < 1998").drop("o_custkey").write.partitionBy("yr").parquet(path)
    rows.where("yr >= 1998").write.mode("append").partitionBy("yr").parquet(path)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    return sources.read(v.spark, path).groupBy(F.col("yr").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.count("o_custkey").alias("with_customer"), total)


@query("S05_partitioned_write", " SELECT strftime(o_orderdate, '%Y%m%d') AS day, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <= 6 AND (month(o_orderdate) <> 3 OR o_orderstatus = 'F' OR o_orderdate::date NOT IN (SELECT o_orderdate::date FROM orders WHERE o_orderstatus = 'F')) GROUP BY 1")
def s05(v: Views) -> DataFrame:
    """A layout by date; writing a month again replaces the days that it has and no others."""
    path = place(v, "by-date")
    rows = v.orders.where("year(o_orderdate) = 1997 and month(o_orderdate) <= 6").withColumn("text", F.date_format("o_orderdate", "yyyyMMdd"))
    sources.write(rows, path, "date", "text")
    again = rows.where("month(o_orderdate) = 3 and o_orderstatus = 'F'")
    sources.write(again, path, "date", "text")
    return sources.read(v.spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("S06_period_write", " SELECT 'third-' || code % 3 AS unit, yr AS year, CASE q WHEN 2 THEN 'H1' WHEN 4 THEN 'FY' ELSE 'Q' || q END AS period, count(*) AS n FROM income GROUP BY code % 3, yr, q")
def s06(v: Views) -> DataFrame:
    """By year and period, then all of it by units, and nothing for a unit without rows."""
    path, unit = place(v, "by-period"), place(v, "by-unit")
    sources.write_period(v.income.withColumn("end", F.date_format("end_date", "yyyyMMdd")), path, "end")
    rows = v.spark.read.parquet(path)
    for n in range(3):
        sources.write_unit(rows.where(F.col("code") % 3 == n), unit, f"third-{n}")
    sources.write_unit(rows.where("code < 0"), unit, "none")
    return v.spark.read.parquet(unit).groupBy("unit", "year", "period").agg(F.count("*").alias("n"))


@query("S09_snapshots", f"{PICKS} SELECT as_of, code, rank FROM pk WHERE as_of = (SELECT max(as_of) FROM as_of)")
def s09(v: Views) -> DataFrame:
    """All scans as snapshots, of which one date is read back."""
    path = place(v, "scans")
    sources.write_snapshot(picks(v).select("as_of", "code", "rank"), path)
    last = v.as_of.agg(F.date_format(F.max("as_of"), "yyyyMMdd")).scalar()
    return sources.read_snapshot(v.spark, path, last).select("as_of", "code", "rank")


RANKED = f"{PICKS}{ALT}, vr AS (SELECT 'volume' AS variant, as_of, code, rank FROM pk UNION ALL SELECT 'turnover', as_of, code, rank FROM pa)"


def variants(v: Views) -> DataFrame:
    both = picks(v).select(F.lit("volume").alias("variant"), "as_of", "code", "rank")
    return both.unionByName(_alt(v).select(F.lit("turnover").alias("variant"), "as_of", "code", "rank"))


@query("S10_rankings", f"{RANKED} SELECT variant, year(as_of) AS yr, count(*) AS n, sum(rank)::bigint AS ranks FROM vr GROUP BY ALL")
def s10(v: Views) -> DataFrame:
    path = place(v, "rankings")
    sources.write_rankings(variants(v), path)
    return v.spark.read.parquet(path).groupBy("variant", F.year("as_of").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


@query("S12_top_from_artifact", f"{RANKED} SELECT variant, as_of, code, rank FROM vr WHERE rank <= 3")
def s12(v: Views) -> DataFrame:
    """The first of each ranking, from what was stored: columns and the cut reach the scan."""
    path = place(v, "rankings")
    sources.write_rankings(variants(v), path)
    return sources.read(v.spark, path, ["variant", "as_of", "code", "rank"], "rank <= 3")


@query("S11_observations", f"{RANKED} SELECT variant, config, strftime(as_of, '%Y%m%d') AS day, code, rank FROM (SELECT *, 'config-' || variant AS config FROM vr)")
def s11(v: Views) -> DataFrame:
    """Artifacts of two variants, each with its config beside its observations, labelled and united."""
    out = None
    for name in ("volume", "turnover"):
        path = place(v, name) + ".json"
        rows = variants(v).where(F.col("variant") == name).select(F.date_format("as_of", "yyyyMMdd").alias("day"), "code", "rank")
        # a file for each date, so that no artifact holds all observations
        whole = rows.groupBy("day").agg(F.collect_list(F.struct("day", "code", "rank")).alias("observations")).select(F.lit("config-" + name).alias("config"), "observations")
        whole.write.json(path)
        got = sources.observations(v.spark, path, name, lines=True)
        out = got if out is None else out.unionByName(got)
    return out.select("variant", "config", F.col("day").cast("string").alias("day"), "code", "rank")


@query("S13_register_view", " SELECT code, count(*) AS n, sum(update_flag)::bigint AS revised FROM income GROUP BY code")
def s13(v: Views) -> DataFrame:
    name = sources.register(v.income, "registered_income")
    return v.spark.sql(f"SELECT code, count(*) AS n, sum(update_flag) AS revised FROM {name} GROUP BY code")


@query("S08_provenance_stamp", " SELECT o_orderpriority AS priority, 'orders_' || o_orderpriority AS source, 'daily' AS source_api, max(o_orderdate)::date AS retrieved, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def s08_stamp(v: Views) -> DataFrame:
    """What each feed retrieved, from where and when."""
    rows = sources.stamp(v.orders, F.concat(F.lit("orders_"), "o_orderpriority"), F.lit("daily"), F.col("o_orderdate"))
    return rows.groupBy(F.col("o_orderpriority").alias("priority"), "source", "source_api").agg(F.to_date(F.max("retrieved_at")).alias("retrieved"), F.count("*").alias("n"))


OLD, NEW = ["o_orderkey", "o_orderdate", "o_totalprice"], ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"]


@query("A03_schema_drift", f" SELECT CAST(yr AS varchar) AS yr, 1::bigint AS schemas, CASE WHEN yr < 1998 THEN '{sources.schema_hash(OLD)}' ELSE '{sources.schema_hash(NEW)}' END AS schema_hash, CASE WHEN yr < 1998 THEN 'o_orderpriority' ELSE '' END AS lacking FROM (SELECT DISTINCT year(o_orderdate) AS yr FROM orders)")
def a03(v: Views) -> DataFrame:
    """Which yearly partitions have other columns than the dataset, by their files' footers."""
    path, rows = place(v, "drifting"), v.orders.withColumn("yr", F.year("o_orderdate"))
    rows.where("yr < 1998").select(*OLD, "yr").write.partitionBy("yr").parquet(path)
    rows.where("yr >= 1998").select(*NEW, "yr").write.mode("append").partitionBy("yr").parquet(path)
    files = sources.schemas(v.spark, path).withColumn("yr", F.regexp_extract("file", r"/yr=(\d+)/", 1))
    return sources.drift(files, "yr")


@query("T01_upsert", f", {INGEST} SELECT event_id, max(batch_id) AS batch_id FROM ig WHERE event_id % 11 <> 0 GROUP BY event_id")
def t01(v: Views) -> DataFrame:
    """Batches arrive as files; rows without a key are left out, and the last batch's row of each key stays, whatever the order of arrival."""
    feed, table, ledger, at = (place(v, n) for n in ("feed", "table", "ledger", "progress"))
    rows = ingest(v).select(F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("event_id"), "batch_id", F.pmod("event_id", F.lit(8)).alias("bucket"))
    rows.repartition("batch_id").write.partitionBy("batch_id").parquet(feed)
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(feed)
    upsert(stream, table, ledger, at, ["event_id"], "bucket", ["batch_id"], F.col("event_id").isNotNull()).awaitTermination()
    return v.spark.read.parquet(table).select("event_id", F.col("batch_id").cast(rows.schema["batch_id"].dataType).alias("batch_id"))
