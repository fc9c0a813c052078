"""The thin queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, line_dedup, mixing, ngram_join, pii, sharding, toxicity, urlfilter, vafile
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_copies").alias("copies"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here; pipelines pass their own secret."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"registered-query")
    return out.select("doc_id", F.size("pii_spans").alias("n_found"), F.transform("pii_spans", lambda s: s["kind"]).alias("kinds"), "text")


def op6_topk_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")  # pages have no fetch date, so the query sets one
    fetched = F.date_add(F.lit(urlfilter.FETCH_START).cast("date"), (F.col("page_id") * 7 % 366).cast("int"))
    return urlfilter.judge(pages.withColumn("fetched_on", fetched), urlfilter.entries(spark))


def op8_shard_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_topk_vafile": op6_topk_vafile,
    "op7_url_filters": op7_url_filters,
    "op8_shard_differencing": op8_shard_differencing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op6_topk_vafile": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_url_filters": urlfilter.ORACLE,
}
