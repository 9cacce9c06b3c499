"""A corpus pipeline: toxic documents go, exact and near duplicates go, personal data is masked, tokens are packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, whose columns may be null and may have more
columns than documents has, whatever their names; they are kept up to the last stage. A table without rows passes
through every stage. Texts of any length are worked on whole; of rows that tie, one with the smallest doc_id stays, and
rows repeated with one doc_id are copies like any others. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, minhash, packing, pii, toxicity
from tidemark.llm.common import bucket_of, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored below 0.5. Null and empty texts are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, bucket_of(F.col("doc_id"), 5) != 0)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.score(rows, model).where("predicted = 0 or coalesce(row.text, '') = ''").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, keeps the row with the smallest doc_id."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return exact_dedup.deduplicate(rows).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), keeps the row with the smallest doc_id."""
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    keyed = docs.select(own.alias("own_key"), "text")
    gone = minhash.near_duplicates(keyed, key="own_key", threshold=0.8).where("n_shingles > 0 and not kept").select(F.col("own_key").alias("gone_key"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("own_key"))
    return rows.join(gone, F.col("own_key") == F.col("gone_key"), "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each identifier; n_chars follows the new text."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    out = pii.detect(rows, redact=True).withColumn("row", F.col("row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("spans") != "", F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))))
    return out.select("row.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 1024)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("personal_data", mask_personal_data), ("packing", pack_tokens)]

#: Scores and packings aren't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
