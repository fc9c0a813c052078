"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. Decisions:

1. toxicity: rows that score THRESHOLD or more go. Trained on the labels of sf_dir for the documents it is given.
2. line dedup: later lines alike an earlier one go; n_chars follows the text. A document of which no line with words is left
   (a whole copy) goes; documents that had none stay.
3. n-gram Jaccard join: of each group of linked documents the one with the least doc_id stays. Documents without words and
   rows without doc_id are in no group and stay.
4. mixing: each row as often as the systematic sampling emits it.
5. byte-level BPE: doc_id, lang, source, n_tokens, token_ids and decoded_sha256 of every row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from tidewright.llm.common import discard, materialise, passing, shield, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    safe, restore = shield(docs, "tox_score", "tox_predicted")
    return restore(toxicity.score(safe, model).where("tox_predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, restore = shield(docs, "n_lines", "n_kept", "line_dedup_kept", "line_dedup_id")
    out = line_dedup.dedup(safe).where("n_kept > 0 OR n_lines = 0")
    chars = F.when(F.col("n_kept") < F.col("n_lines"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return restore(out.withColumn("n_chars", chars))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    later = ngram_join.join(docs).where("component_id < doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL can express neither the trained scorer nor the byte-pair merges; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (label, stage) in enumerate(STAGES[:-1]):
        with passing() as here:  # a stage's own tables go when its result is written, and so does what it read
            after = here.keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{k}"))
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
