"""Datasets as folders of Parquet: reads with a union of columns, partitioned writes, merges by key, observation files."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fiscal_period, norm_date


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where that is unset and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = spark.conf.get("tidemark.own.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.own.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """All files of a dataset, united by column name; the filter and the columns reach the scan."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def stamp(df: DataFrame, source: str | Column, api: str | Column, at: Column | None = None) -> DataFrame:
    """Where rows came from, and when."""
    return df.withColumns({"retrieved_at": F.current_timestamp() if at is None else at, "source": F.lit(source), "source_api": F.lit(api)})


def partitioned(df: DataFrame, by: str, date: str | None = None) -> tuple[DataFrame, list[str]]:
    """Adds the partition columns of a layout: none, year or date. A date that doesn't parse fails the job that writes."""
    if by == "none":
        return df, []
    day = norm_date(F.col(date))
    sure = F.when(day.isNotNull(), day).otherwise(F.raise_error(F.lit(f"invalid partition date in {date}")).cast("date"))
    return (df.withColumn("year", F.year(sure)), ["year"]) if by == "year" else (df.withColumn("day", F.date_format(sure, "yyyyMMdd")), ["day"])


def write(df: DataFrame, path: str, by: str = "none", date: str | None = None) -> None:
    """Replaces the partitions that df touches; a table without rows changes nothing."""
    rows, cols = partitioned(df, by, date)
    _replace(rows, path, cols)


def _replace(rows: DataFrame, path: str, cols: Sequence[str]) -> None:
    if not cols and rows.isEmpty():
        return
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*cols) if cols else out).parquet(path)


def write_period(df: DataFrame, path: str, period: str) -> None:
    """Partitions by year and period, from the column in which a row's period is named or dated; one that isn't a period fails the job."""
    end, _ = fiscal_period(F.col(period))
    sure = F.when(end.isNotNull(), end).otherwise(F.raise_error(F.lit(f"invalid period in {period}")).cast("date"))
    name = F.when(F.quarter(sure) == 2, "H1").when(F.quarter(sure) == 4, "FY").otherwise(F.concat(F.lit("Q"), F.quarter(sure)))
    _replace(df.withColumn("year", F.year(sure)).withColumn("period", name), path, ["year", "period"])


def write_partition(df: DataFrame, path: str, **parts: str) -> None:
    """One partition, named by the caller."""
    _replace(df.withColumns({k: F.lit(x) for k, x in parts.items()}), path, list(parts))


def write_unit(df: DataFrame, path: str, unit: str) -> None:
    """A named unit of a dataset; names hold letters, digits, dots, hyphens and underscores only."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", unit) or set(unit) == {"."}:
        raise ValueError(f"invalid unit {unit!r}")
    write_partition(df, path, unit=unit)


def write_snapshot(scan: DataFrame, path: str, as_of: str = "as_of") -> None:
    """Scans by their as-of date; a date that is written again replaces its snapshot."""
    _replace(scan.withColumn("as_of_date", F.date_format(as_of, "yyyyMMdd")), path, ["as_of_date"])


def read_snapshot(spark: SparkSession, path: str, as_of_date: str | Column) -> DataFrame:
    """The scan of one date, which prunes all other folders."""
    return spark.read.parquet(path).where(F.col("as_of_date") == F.lit(as_of_date).cast("string")).drop("as_of_date")


def write_rankings(rows: DataFrame, path: str, variant: str = "variant", as_of: str = "as_of") -> None:
    """Ranked rows of variants, by variant and as-of date."""
    _replace(rows.withColumns({"variant": F.col(variant), "as_of_date": F.date_format(as_of, "yyyyMMdd")}), path, ["variant", "as_of_date"])


def register(df: DataFrame, name: str) -> str:
    """A view for SQL; names are plain identifiers."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"invalid view name {name!r}")
    df.createOrReplaceTempView(name)
    return name


def schemas(spark: SparkSession, path: str) -> DataFrame:
    """file, columns and schema_hash of each Parquet file of a dataset; tasks read footers only."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for f in b["path"]:
                fs, at = pyarrow.fs.FileSystem.from_uri(f)
                with fs.open_input_file(at) as file:
                    found.append(sorted(pyarrow.parquet.ParquetFile(file).schema_arrow.names))
            yield pd.DataFrame({"file": b["path"], "columns": found, "schema_hash": [schema_hash(c) for c in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(footers, "file string, columns array<string>, schema_hash string")


def schema_hash(columns: Sequence[str]) -> str:
    """An identity of a set of column names."""
    return hashlib.sha256(json.dumps(sorted(columns), separators=(",", ":")).encode()).hexdigest()


def drift(files: DataFrame, by: str) -> DataFrame:
    """For each group of files: how many schemas it has, and which columns some of its files lack of those that the dataset has."""
    every = files.select(F.explode("columns").alias("c")).distinct().agg(F.sort_array(F.collect_set("c"))).scalar()
    lacking = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array_except(every, "columns")))))
    return files.groupBy(by).agg(F.count_distinct("schema_hash").alias("schemas"), F.max("schema_hash").alias("schema_hash"), F.array_join(lacking, "|").alias("lacking"))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each key, null being a value: new rows replace old ones, and among new rows the last by `order` stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in order])
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_new", "_nth")


def observations(spark: SparkSession, path: str, label: str, lines: bool = False) -> DataFrame:
    """Rows of a Parquet, CSV or JSON artifact; a JSON artifact holds them in `observations` beside its own fields, and with `lines` has an object in each line."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        whole = spark.read.option("multiLine", not lines).json(path)
        others = [c for c in whole.columns if c != "observations"]
        rows = whole.select(*others, F.explode("observations").alias("_row")).select(*others, "_row.*")
    else:
        rows = spark.read.option("header", True).csv(path, inferSchema=True) if kind == "csv" else spark.read.parquet(path)
    return rows.withColumn("variant", F.lit(label))


def artifact(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Observations of JSON artifacts, each one document with one array that may be large, with the config and snapshots beside it.

    Columns of all observations are united; the schema is read from them by all tasks. `_artifact_evaluation_config` is the
    configuration with its names in order, `_artifact_snapshot_ids` the snapshots in order. A document that is an array has
    neither. Without any observation only those columns are there.
    """
    from tidemark.sources.json_array import elements

    rows, headers = elements(spark, path)
    rows = materialize(rows, "observations")
    whole = rows.agg(F.schema_of_variant_agg(F.parse_json("json"))).first()[0]
    v = F.try_parse_json("json")
    text = lambda at: F.to_json(F.try_variant_get(v, at, "variant"))
    ids = F.to_json(F.array_sort(F.try_variant_get(v, "$.provenance.scan_snapshot_ids", "array<string>")))
    beside = headers.select("file", text("$.configuration").alias("_artifact_evaluation_config"), F.try_variant_get(v, "$.provenance.evaluation_config_fingerprint", "string").alias("_artifact_evaluation_fingerprint"), ids.alias("_artifact_snapshot_ids"))
    known = whole and whole.startswith("OBJECT")
    rows = rows.select("file", F.from_json("json", re.sub(r"\bOBJECT<", "STRUCT<", whole)).alias("_row") if known else F.struct(F.lit(None).alias("_none")).alias("_row"))
    return rows.join(beside, "file", "left").select("_row.*", *beside.columns[1:], F.lit(label).alias("variant"))
