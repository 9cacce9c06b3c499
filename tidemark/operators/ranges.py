"""Falls of a path between any two of its places, from two stored summaries.

At each level a path is cut into blocks of a power of two of places, and every place stores what lies between it and its
block's middle: the highest and lowest value and the deepest fall. Two places meet across the middle of just one block, at
the level of the highest bit in which their numbers differ: the deepest fall between them is the deeper of both sides, or
the fall from the first side's highest to the second side's lowest. So a path of n places stores n rows a level, and an
entry meets two rows for each horizon, instead of all places on its way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_of(a: Column, b: Column) -> Column:
    """The highest bit in which two different whole numbers differ."""
    return F.length(F.bin(a.bitwiseXOR(b).cast("long"))) - 1


def fall_blocks(path: DataFrame, value: str, top: Column, by: Sequence[str] = ("code",), at: str = "idx", lowest: Column | int = 0) -> DataFrame:
    """by, at, level, high, low and fall: what lies between each place and its block's middle, itself included.

    Places are whole numbers from 0 on, each at most once for an entity; those without a value aren't on the path. top is a
    number that no place exceeds, lowest the first level that will be asked for.
    """
    x = F.col("_x")
    rows = path.where(F.col(value).isNotNull()).select(*by, F.col(at).cast("long").alias("_at"), F.col(value).alias("_x"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(lowest), F.greatest(F.lit(lowest), F.length(F.bin(top.cast("long"))) - 1))))
    # _after: 0 before the middle, 1 after it
    rows = rows.withColumn("_block", F.expr("shiftright(_at, level + 1)")).withColumn("_after", F.expr("shiftright(_at, level) & 1"))
    # both sides run outwards from the middle
    w = Window.partitionBy(*by, "level", "_block", "_after").orderBy(F.when(F.col("_after") == 0, -F.col("_at")).otherwise(F.col("_at")))
    rows = rows.withColumns({"high": F.max(x).over(w), "low": F.min(x).over(w)})
    step = F.when(F.col("_after") == 0, F.when(x > 0, F.col("low") / x - 1)).otherwise(F.when(F.col("high") > 0, x / F.col("high") - 1))
    return rows.withColumn("fall", F.min(step).over(w)).select(*by, F.col("_at").alias(at), "level", "high", "low", "fall")


def deepest_fall(entries: DataFrame, blocks: DataFrame, start: str, end: str, name: str = "drawdown", by: Sequence[str] = ("code",), at: str = "idx") -> DataFrame:
    """entries with the deepest fall from their start to their end, both included; unknown unless both are on the path."""
    def side(prefix: str, place: str) -> DataFrame:
        return blocks.select(*by, F.col(at).alias(place), F.col("level").alias("_level"), *[F.col(c).alias(prefix + c) for c in ("high", "low", "fall")])

    asked = entries.withColumn("_level", F.when(F.col(start) < F.col(end), level_of(F.col(start), F.col(end)))).withColumn("_a", F.col(start).cast("long")).withColumn("_b", F.col(end).cast("long"))
    out = asked.join(side("_a_", "_a"), [*by, "_a", "_level"], "left").join(side("_b_", "_b"), [*by, "_b", "_level"], "left")
    across = F.when(F.col("_a_high") > 0, F.col("_b_low") / F.col("_a_high") - 1)
    both = F.col("_a_high").isNotNull() & F.col("_b_high").isNotNull()
    return out.select(*entries.columns, F.when(both, F.least("_a_fall", "_b_fall", across)).alias(name))
