"""The pipeline's stages on small tables, and what the queries return against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from tidewright.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    odd.where("doc_id IS NOT NULL").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i == 8)) for i in range(1, 13)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_return_the_columns_of_documents(spark, odd, none, clashing, folder):
    for frame in (odd, none, clashing):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.columns == frame.columns, name
            if frame is clashing:
                assert {r.n_kept for r in out.select("n_kept").collect()} == {"mine"}
    assert pipeline.STAGES[-1][1](spark, none, folder).count() == 0


def test_stages_take_effect(spark, odd, folder):
    deduped = {r.doc_id: r for r in pipeline.dedup_lines(spark, odd, folder).collect()}
    assert 2 not in deduped and 3 not in deduped and 11 not in deduped  # copies and a near copy
    assert {1, 4, 5, 6, 7, 8, 9, 10, 12, None} <= set(deduped) and deduped[8].n_chars == len(deduped[8].text)
    grouped = Counter(r.doc_id for r in pipeline.one_of_each_group(spark, odd, folder).collect())
    assert grouped == Counter([1, 4, 5, 6, 7, 7, 8, 9, 10, None, 11, 12])


def test_run_encodes_what_the_stages_keep(spark, folder):
    out = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert want and Counter((r.doc_id, r.decoded_sha256) for r in out) == want


def plain_run(rows, labels, vocabulary):
    """The five stages in plain Python: rows of doc_id, text, lang, source, n_chars."""
    import numpy as np
    import tiktoken
    import test_llm_operators as plain

    from tidewright.llm import bpe, toxicity

    marks = {}
    for i, y in labels:
        marks[i] = max(marks.get(i, 0), y)
    known = sorted((i, t, marks[i]) for i, t, *_ in rows if i in marks and zlib.crc32(str(i).encode()) % 4 != 2)
    lexicon = plain.plain_lexicon([(t, y) for _, t, y in known])
    weights = toxicity.fit(np.array([plain.plain_features(t, lexicon) for _, t, _ in known]), np.array([y for *_, y in known], float))
    rows = [r for r in rows if 1 / (1 + math.exp(-float(np.array(plain.plain_features(r[1], lexicon) + [1.0]) @ weights))) < toxicity.THRESHOLD]

    keep, left = plain.brute_lines([(i, t) for i, t, *_ in rows]), []
    for i, t, lang, source, n in rows:
        parts = (t or "").split("\n")
        worded = [bool(plain.WORD.search(x)) for x in parts]
        stay = [x for k, x in enumerate(parts) if not worded[k] or (i, k) in keep]
        gone = sum(worded) - sum(w and (i, k) in keep for k, w in enumerate(worded))
        if not any(worded) or gone < sum(worded):
            left.append((i, "\n".join(stay) if gone else t, lang, source, n))
    group = plain.brute_components([(i, t) for i, t, *_ in left])
    left = [r for r in left if group[r[0]][1] == r[0]]
    copies = plain.plain_mix([(i, t, s) for i, t, _, s, _ in left])
    path, pattern = vocabulary
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    return Counter({(r[0], tuple(lib.encode_ordinary(r[1] or ""))): n for r, n in zip(left, copies, strict=True) if n})


def test_run_equals_a_plain_version(spark, tmp_path):
    import test_llm_operators as plain

    rng = random.Random(21)
    texts = dict(plain.edited_copies(17, 120, 40))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t)) for i, t in texts.items()]
    rows += [(i, f"you {rng.choice(['dolt', 'numpty'])} and {rng.choice(['dolt', 'numpty'])} number{i} house garden river table window", "en", "a", 1) for i in range(200, 320)]
    rows += [(400, None, "en", "b", 0), (401, "", "en", "b", 0), (402, "first line of this text has many words in it\n\nfirst line of this text has many words at it\nshort line", "fr", "c", 9), (403, "short line\nanother one", "fr", "c", 9)]
    labels = [(i, int(200 <= i < 320)) for i, *_ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, tuple(r.token_ids)) for r in pipeline.run(spark, str(tmp_path)).collect())
    import public_tokenizers

    want = plain_run(rows, labels, (public_tokenizers.path(pipeline.RANKS), public_tokenizers.PATTERN))
    assert got == want and len(want) > 20 and not any(200 <= i < 320 for i, _ in want)


def test_queries_give_the_contracts_columns(spark, sf_dir):
    want = {"op1": ["doc_id", "n_shingles", "component_id"], "op2": ["doc_id", "held_out", "score", "predicted"], "op3": ["doc_id", "size", "source_size", "target", "taken"], "op6": ["query_id", "rank", "vec_id", "score"], "op8": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op10": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]}
    names = {n.split("_")[0]: n for n in queries.QUERIES}
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 11))
    for op, columns in want.items():
        assert queries.QUERIES[names[op]](spark, sf_dir).columns[: len(columns)] == columns
