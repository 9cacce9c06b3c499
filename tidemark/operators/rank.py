"""Ranks and selections with a declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 in each group; with n only the first n, which Spark cuts before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return (out if n is None else out.where(F.col(name) <= n)).withColumn(name, F.col(name).cast("long"))


def terciles(df: DataFrame, by: Sequence[str], value: str, ties: str) -> DataFrame:
    """small, mid or large by (position - 1/2) / count; only positive values count."""
    w = Window.partitionBy(*by)
    p = (F.row_number().over(w.orderBy(value, ties)) - 0.5) / F.count("*").over(w)
    return df.where(F.col(value) > 0).withColumn("p", p).withColumn("bucket", F.when(F.col("p") <= 1 / 3, "small").when(F.col("p") <= 2 / 3, "mid").otherwise("large")).drop("p")
