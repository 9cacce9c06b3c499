"""Reads, partitioned writes, merges and the incremental upsert, on small tables."""

import json

import pytest

from pyspark.sql import functions as F

from tidemark import sources
from tidemark.streaming import outcome, upsert

SCHEMA = "code int, day string, value double"


def test_read_unites_columns_and_write_replaces_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write(spark.createDataFrame([(1, "20240102", 1.0), (2, "20250103", 2.0)], SCHEMA), path, "year", "day")
    sources.write(spark.createDataFrame([(3, "20250104", 3.0, "x")], SCHEMA + ", note string"), path, "year", "day")
    rows = sources.read(spark, path, ["code", "note", "year"], "value > 0")
    assert sorted(map(tuple, rows.collect())) == [(1, None, 2024), (3, "x", 2025)]
    sources.write(spark.createDataFrame([], SCHEMA), path, "year", "day")
    assert sources.read(spark, path).count() == 2


def test_invalid_partition_date_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="invalid partition date"):
        sources.write(spark.createDataFrame([(1, "20240230", 1.0)], SCHEMA), str(tmp_path / "t"), "date", "day")


def test_merge_keeps_the_last_row_of_each_key(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (None, "b", 2.0)], SCHEMA)
    new = spark.createDataFrame([(1, "a", 5.0), (1, "c", 6.0), (None, "b", None)], SCHEMA)
    got = sources.merged(old, new, ["code"], ["day"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "c", 6.0), (None, "b", None)], key=str)


def test_stamp_and_observations(spark, tmp_path):
    assert {"source", "source_api", "retrieved_at"} < set(sources.stamp(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), "s", "a").columns)
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"run": "r", "observations": [{"code": 1}, {"code": 2}]}))
    assert sorted((r.run, r.code, r.variant) for r in sources.observations(spark, str(path), "full").collect()) == [("r", 1, "full"), ("r", 2, "full")]


def test_upsert_merges_batches_and_keeps_a_ledger(spark, tmp_path):
    feed, at = str(tmp_path / "feed"), {n: str(tmp_path / n) for n in ("table", "ledger", "checkpoint")}
    for rows in ([(1, "a", 1.0), (2, "a", 2.0)], [(2, "a", 9.0), (3, "a", 3.0), (4, "b", 4.0), (None, "b", 5.0)], [(None, "c", 1.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        upsert(spark.readStream.schema(SCHEMA).parquet(feed), at["table"], at["ledger"], at["checkpoint"], ["code"], "day", ["value"], F.col("code").isNotNull()).awaitTermination(60)
    got = spark.read.parquet(at["table"]).select("code", "day", "value").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1.0), (2, "a", 9.0), (3, "a", 3.0), (4, "b", 4.0)]
    assert sorted((r.batch, r.n, r.kept, r.outcome) for r in spark.read.parquet(at["ledger"]).collect()) == [(0, 2, 2, "success"), (1, 4, 3, "partial"), (2, 1, 0, "failed")]


def test_outcomes(spark):
    rows = spark.createDataFrame([(0, 0, True), (0, 0, False), (2, 0, False), (2, 1, False), (2, 2, True)], "n int, k int, c boolean")
    assert [r.o for r in rows.select(outcome(F.col("n"), F.col("k"), F.col("c")).alias("o")).collect()] == ["not_due", "pending", "failed", "partial", "success"]


def test_named_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024H1", 1.0), (2, "20241231", 2.0)], SCHEMA)
    at = {n: str(tmp_path / n) for n in ("period", "unit", "scan", "rank")}
    sources.write_period(rows, at["period"], "day")
    assert sorted((r.code, r.year, r.period) for r in sources.read(spark, at["period"]).collect()) == [(1, 2024, "H1"), (2, 2024, "FY")]
    with pytest.raises(Exception, match="invalid period"):
        sources.write_period(spark.createDataFrame([(1, "20240501", 1.0)], SCHEMA), at["period"], "day")
    sources.write_unit(rows, at["unit"], "north")
    sources.write_unit(rows.limit(0), at["unit"], "north")
    assert sources.read(spark, at["unit"]).where("unit = 'north'").count() == 2
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            sources.write_unit(rows, at["unit"], bad)
    sources.write(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    scan = rows.selectExpr("code", "to_date('2024-01-0' || code) AS as_of")
    sources.write_snapshot(scan, at["scan"])
    assert [r.code for r in sources.read_snapshot(spark, at["scan"], "20240102").collect()] == [2]
    sources.write_rankings(scan.selectExpr("*", "'full' AS variant"), at["rank"])
    assert (tmp_path / "rank" / "variant=full" / "as_of_date=20240101").exists()
    assert spark.table(sources.register(scan, "scan_view")).count() == 2
    with pytest.raises(ValueError):
        sources.register(scan, "a; drop")


def test_schema_drift(spark, tmp_path):
    for i, extra in enumerate(("", ", note string")):
        spark.createDataFrame([(i, "a", 1.0) + (("x",) if extra else ())], SCHEMA + extra).coalesce(1).write.parquet(str(tmp_path / "t" / f"part={i}"))
    files = sources.schemas(spark, str(tmp_path / "t")).withColumn("part", F.regexp_extract("file", "part=([0-9])", 1))
    got = {r.part: (r.schemas, r.schema_hash, r.lacking) for r in sources.drift(files, "part").collect()}
    assert got == {"0": (1, sources.schema_hash(["code", "day", "value"]), "note"), "1": (1, sources.schema_hash(["note", "value", "day", "code"]), "")}
