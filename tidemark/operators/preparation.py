"""Evaluation observations before they are compared: values made comparable, and why a set of them is refused.

Whole campaigns are checked at once, by grouped counts and fingerprints: sets of snapshots are compared by the number
and the sum of the hashes of their distinct members, which tasks add up by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite, norm_date

# What the benchmark has to move for a regime.
THRESHOLD = 0.05


def prepared(rows: DataFrame, cutoffs: Sequence[float], labels: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Observations with day, rank, horizon, forward_return and excess_return as values, year, regime, bucket and industry.

    A regime or bucket that is given stays; else they follow from the benchmark's return and the market value, or are
    unknown. Cuts belong to the bucket above them. Values that don't parse are null, and refused later.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    mark, cap = finite(has("benchmark_return")), finite(has("market_cap"))
    regime = F.when(mark > threshold, "bull").when(mark < -threshold, "bear").when(mark.isNotNull(), "range")
    bucket = F.when(cap.isNull(), None)
    for cut, label in zip(cutoffs, labels, strict=False):
        bucket = bucket.when(cap < cut, label)
    day = norm_date(F.col("as_of_date"))
    return rows.withColumns({
        "day": day, "rank": finite(F.col("rank")), "horizon": finite(F.col("horizon")), "forward_return": finite(F.col("forward_return")), "excess_return": finite(has("excess_return")), "year": F.year(day),
        "regime": F.coalesce(has("regime"), regime, F.lit("unknown")), "bucket": F.coalesce(has("market_cap_bucket"), bucket.otherwise(labels[-1]), F.lit("unknown")), "industry": F.coalesce(has("industry"), F.lit("unknown")),
    })


def _fingerprint(c: str) -> list[Column]:
    return [F.count(c).alias("n"), F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias("h")]


def refusals(rows: DataFrame, variants: Sequence[str], by: Sequence[str] = ("campaign",)) -> DataFrame:
    """by, refused and warnings of each campaign of prepared observations.

    Refused, by the first that applies: missing_variants, invalid_values (a day, rank or horizon), duplicate_observations
    (of a variant, entity, day and horizon), different_snapshots (between variants that name any), different_configurations
    (of the evaluation), mixed_score_configurations (within a variant). Other variants than those named are left out.
    """
    c = F.col
    named = rows.where(c("variant").isin(*variants))
    every = rows.select(*by).distinct()
    sums = named.groupBy(*by).agg(
        F.count_distinct("variant").alias("variants"), F.count_if(c("day").isNull() | c("rank").isNull() | c("horizon").isNull()).alias("bad"), F.count_distinct("evaluation_config").alias("configs"), F.count("score_config").alias("scores"),
        *[F.count_if(c(x) == "unknown").alias("no_" + x) for x in ("regime", "bucket", "industry")], F.count_if(c("forward_return").isNull()).alias("no_return"),
    )
    repeats = named.groupBy(*by, "variant", "code", "day", "horizon").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("repeats"))
    held = named.select(*by, "variant", "snapshot_id").where("snapshot_id is not null").distinct().groupBy(*by, "variant").agg(*_fingerprint("snapshot_id"))
    snapshots = held.groupBy(*by).agg(F.count_distinct("n", "h").alias("snapshots"))
    mixed = named.groupBy(*by, "variant").agg(F.count_distinct("score_config").alias("n")).groupBy(*by).agg(F.max("n").alias("mixed"))
    out = every
    for part in (sums, repeats, snapshots, mixed):
        out = out.join(part, [*by], "left")
    n = lambda x: F.coalesce(c(x), F.lit(0))
    refused = (
        F.when(n("variants") < len(set(variants)), "missing_variants").when(n("bad") > 0, "invalid_values").when(n("repeats") > 1, "duplicate_observations").when(n("snapshots") > 1, "different_snapshots")
        .when(n("configs") > 1, "different_configurations").when(n("mixed") > 1, "mixed_score_configurations")
    )
    said = F.concat_ws(
        "|", F.when(n("snapshots") == 0, "pit_snapshot_provenance_missing"), F.when(n("configs") == 0, "evaluation_config_provenance_missing"), F.when(n("scores") == 0, "score_config_provenance_missing"),
        F.when(n("no_regime") > 0, "regime_unavailable_for_some_observations"), F.when(n("no_bucket") > 0, "market_cap_bucket_unavailable_for_some_observations"), F.when(n("no_industry") > 0, "industry_unavailable_for_some_observations"), F.when(n("no_return") > 0, "forward_window_missing_for_some_candidates"),
    )
    return out.select(*by, refused.alias("refused"), F.when(refused.isNull(), said).otherwise("").alias("warnings"))
