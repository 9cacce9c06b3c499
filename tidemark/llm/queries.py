"""One query for each operator, over its whole table, with the contract's columns."""

from __future__ import annotations

from fractions import Fraction

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, centroids, exact_dedup, html_wrap, langid, merge_replay, minhash, packing, pii, suffix_dedup, toxicity, word_runs
from tidemark.llm.common import bucket_of

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = bucket_of(F.col("doc_id"), 4)
    samples = langid.sample_texts(docs.where(fold != 2))
    return langid.detect(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), samples)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrap.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=Fraction(85, 100))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = bucket_of(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), model)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), 1024)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(TOKENIZER))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", top=20)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text, in which a tenth of the documents repeat a stretch of words up to their end, as op11's contract plants them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # of an array of one, so that words are taken once for each row
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.element_at(F.transform(F.array(words), planted), 1)).otherwise(text)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return word_runs.repeated_words(docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text")), least=6, times=4)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, scale=1024, dim=64, seed="3:")


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(RANKS))


def queries() -> dict:
    found = (op1_language, op2_main_text, op3_near_duplicates, op4_toxicity, op5_packing, op6_tokens, op7_exact_duplicates, op8_repeated_strings, op9_personal_data, op10_neighbours, op11_word_runs, op12_centroids, op13_merge_replay)
    return {f.__name__: f for f in found}


def centroids_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round written out: vectors to their nearest centroid, and centroids to the floor of their vectors' mean."""
    assigned = "a{r} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.vec_id, v.x, k.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS bigint) AS d FROM v, k{r} k) GROUP BY ALL)"
    moved = """s{n} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2),
            k{n} AS MATERIALIZED (SELECT k.c, coalesce(t.x, k.x) AS x FROM k{r} k LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS bigint) ORDER BY i) AS x FROM s{n} GROUP BY c) t ON t.c = k.c)"""
    steps = ",\n            ".join(assigned.format(r=r) + ("" if r == rounds else ",\n            " + moved.format(r=r, n=r + 1)) for r in range(rounds + 1))
    return f"""
            WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS double)) AS bigint)) AS x FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
            k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS int) AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k}),
            {steps}
            SELECT a.vec_id, a.m.c AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS bigint) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS bigint) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
            FROM a{rounds} a JOIN k{rounds} k ON k.c = a.m.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_centroids": centroids_sql(),
        "op7_exact_duplicates": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER w = 1 AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)""",
        "op3_near_duplicates": r"""
            WITH RECURSIVE w AS (
              SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
            s AS (
              SELECT DISTINCT doc_id, hash(array_to_string(a[i:i + 4], ' ')) AS g
              FROM (SELECT doc_id, a, unnest(range(1, greatest(2, len(a) - 3))) AS i FROM w WHERE len(a) > 0)),
            n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
            i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
            e AS (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * i.c >= 85 * (p.c + q.c - i.c)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
            SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
            FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
    }
