"""Incremental upsert of arriving batches, with a ledger of what became of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import materialize, merged


def outcome(n: Column, kept: Column, closed: Column) -> Column:
    """not_due: nothing came and no session was open; pending: nothing came; failed: nothing of it could be used; partial: some of it could; success."""
    return F.when(n == 0, F.when(closed, "not_due").otherwise("pending")).when(kept == 0, "failed").when(kept < n, "partial").otherwise("success")


def upsert(stream: DataFrame, target: str, ledger: str, checkpoint: str, keys: Sequence[str], partition: str, order: Sequence[str] = (), valid: Column | None = None, open_session: bool = True) -> StreamingQuery:
    """Merges each micro-batch into a table by key and writes its outcome to the ledger.

    Only the partitions that a batch touches are read and replaced; a key has to stay in its partition. Rows for which
    `valid` doesn't hold are left out. A batch that runs again after a lost driver finds its own rows and replaces them by
    the same ones; its folder of the ledger is overwritten likewise. Later versions are kept where their number is a key.
    """
    fine = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        came = materialize(batch.withColumn("_fine", fine), "batch")
        new = came.where("_fine").drop("_fine")
        if not new.isEmpty():
            try:
                old = spark.read.parquet(target)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                old = new.limit(0)
            touched = old.join(F.broadcast(new.select(partition).distinct()), partition, "left_semi")
            rows = materialize(merged(touched, new, keys, order), "merged")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)
        counts = came.agg(F.count("*").alias("n"), F.count_if("_fine").alias("kept")).withColumn("batch", F.lit(batch_id).cast("long"))
        counts.withColumn("outcome", outcome(F.col("n"), F.col("kept"), F.lit(not open_session))).write.mode("overwrite").parquet(f"{ledger}/run={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
