from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long one, repeated rows, copies and near copies."""
    near = BASE.replace("upsilon", "phi")
    return [
        (1, BASE, "en", "a", 10), (2, BASE, "en", "b", 10), (3, near, None, "a", None), (4, None, "en", "a", 0), (5, "", "en", None, 0), (6, " \n\t ", "fr", "b", 4),
        (7, "one", "en", "a", 3), (7, "one", "en", "a", 3), (8, "you idiot\nyou idiot\nplain line of eight words stands here now", "en", "a", 9), (9, "x" * 50_000, "de", "c", 50_000),
        (10, " ".join(f"w{i}" for i in range(5_000)), "en", "c", 1), (None, BASE, "en", "a", 1), (11, "plain line of eight words stands here today", "en", "a", 1), (12, "é漢字 🙂 " * 20, "es", "é", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["n", "size", "key", "node", "component", "line", "words", "keys", "bucket", "shard", "slot", "fingerprint", "sketch", "n_tokens", "token_ids", "mix_size", "tox_score", "pii_spans", "n_lines", "n_kept", "digest", "a", "b", "rank", "score"]
    return odd.select("*", *[F.lit("mine").alias(c) for c in names])
