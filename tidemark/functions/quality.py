"""Checks of frames before they are stored, and of evidence before it is used."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import norm_date

# Statuses of evidence, and what in a reason makes it invalid.
VALID = ("known", "valid")
MISSING = ("unknown", "missing")
UNSUPPORTED = ("unsupported", "unsupported_pit", "pit_unsupported")
INVALID_TOKENS = ("pit_warning", "pit_unsafe", "future_unsafe", "stale", "insufficient", "discontinuous", "invalid", "denominator", "zero_baseline")
UNSAFE = ("stale", "future_unsafe", "future-unsafe", "pit_warning", "pit_unsafe")
INSUFFICIENT = ("insufficient_history", "insufficient_data", "discontinuous", "stale")


def evidence_category(status: Column, reason: Column, value: Column, warned: Column | None = None) -> Column:
    """valid, missing, unsupported or invalid: by warned (something nested in the evidence tells of unsafe use), status, reason and value.

    A status that is in none of the lists makes the evidence invalid, whatever its value.
    """
    s, r = F.coalesce(F.lower(F.trim(status)), F.lit("missing")), F.coalesce(F.lower(F.trim(reason)), F.lit(""))
    absent = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return (
        F.when(F.coalesce(warned, F.lit(False)) if warned is not None else F.lit(False), "invalid").when(s.isin(*UNSUPPORTED) | s.contains("unsupported") | r.contains("unsupported"), "unsupported")
        .when(r.rlike("|".join(INVALID_TOKENS)) | s.isin(*UNSAFE), "invalid")
        .when(absent, F.when(s.isin(*INSUFFICIENT), "invalid").otherwise("missing"))
        .when(s.isin(*VALID), "valid").when(s.isin(*MISSING), "missing").otherwise("invalid")
    )


def compare_fields(left: Iterable[str], right: Iterable[str]) -> str:
    """What the first set of columns is to the second."""
    a, b = set(left), set(right)
    return "same" if a == b else "superset" if a > b else "subset" if a < b else "different"


def frame_quality(df: DataFrame, by: Sequence[str], required: Sequence[str], keys: Sequence[str], partition: str, dates: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """One row of checks for each group of `by`: rows, duplicate and null identities, null partitions and bad dates, with the warnings.

    Rows are counted by identity first, so that no group has to be held together for its duplicates.
    """
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    bad = F.lit(0)
    for d in dates:
        text = F.trim(F.col(d).cast("string"))
        bad = bad + ((text != "") & norm_date(F.col(d)).isNull() & text.isNotNull()).cast("long")
    per = df.groupBy(*by, *(k for k in keys if k not in by)).agg(F.count("*").alias("n"), F.count_if(F.col(partition).isNull()).alias("np"), F.sum(bad).alias("bd"))
    out = per.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_identity_rows"), F.sum(F.when(null_key, F.col("n")).otherwise(0)).alias("null_identity_rows"), F.sum("np").alias("null_partition_rows"), F.sum("bd").alias("bad_dates"))
    missing, relation = ",".join(r for r in required if r not in df.columns), compare_fields(df.columns, expected)
    counted = [F.when(F.col(c) > 0, F.concat(F.lit(c + "="), c)) for c in ("null_identity_rows", "duplicate_identity_rows", "null_partition_rows", "bad_dates")]
    warnings = F.concat_ws("|", *([F.lit("missing_required=" + missing)] if missing else []), *counted, *([F.lit("schema_drift=" + relation)] if relation != "same" else []))
    return out.withColumns({"schema_relation": F.lit(relation), "warnings": warnings})


def fatal(warnings: Column, allowed: Sequence[str] = ("schema_drift=superset",)) -> Column:
    """Whether any warning rejects the batch: all do but those allowed."""
    said = F.filter(F.split(warnings, r"\|"), lambda x: (x != "") & ~x.isin(*allowed))
    return F.size(said) > 0
