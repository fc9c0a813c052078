"""N-gram Jaccard join: a size-aware heavy-light set-similarity join, exact.

Sets: distinct shingles of WIDTH words. Sets of sizes a and b link when their overlap is at least t/(1+t) (a + b), so the
partner of a set of n has at least ceil(t n) of it. In any one order of all shingles, two linked sets therefore share
k shingles among the first n - ceil(t n) + k of each.

* Light sets (n up to a boundary) enumerate the fixed-size subsets: all pairs out of their first n - ceil(t n) + 2
  shingles, each pair one hashed key.
* Heavy sets stand in inverted lists under each of their first n - ceil(t n) + 1 shingles, and so do the light sets whose
  size lets them link to a heavy one.
* The boundary is the largest size at which enumerating costs no more than reading lists: pairs <= list entries * (1 +
  expected length of a list), the length from the sketch below. It has no other limit.

Order: shingles by commonness, then by hash. Commonness is a class of a count sketch of all shingles of all texts (SKETCH
counters whatever the input, so it is broadcast with a fixed size). The order only decides how long lists get; any order
gives the same links.

Lists of copies are not expanded to pairs. Equal sets are one node. Round one checks every member of a list against the
list's least node and joins what links into components. Round two checks the pairs of a list that are still in different
components and may link by size (bands of sizes are part of the join's key) and place: what is left are lists that unlike texts share. Every link between different
components is found, so the components are exact; links inside a component need no check.

Before texts are read, a pair must pass a lossless filter: each set has a map of parities (how many of its shingles fall on
a bit, odd or even), and two sets differ in at least as many shingles as their maps differ in bits. A map of PARITY_BITS
stands in the lists; pairs that pass are tried with maps as wide as the sets are large.

Nodes, links and components stay in tables in the shared folder; the driver sees the sketch only.

Defined cases: null or blank text: empty set, a component of its own; rows without doc_id take no part (component null);
rows of equal doc_id are one node: what links to one of their texts links to all; repeated rows come back repeated. Nulls in
other columns and columns with names used here don't matter: two columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, passing, tidy
from .components import components
from .shingles import mixed, shingle_lists
from .sketch import SKETCH_BITS, class_of, commonness, sketch
from .textfilter import texts_near

WIDTH = 5
PERCENT = 80
PARITY_BITS = 512
MAPS = [f"g{k}" for k in range(PARITY_BITS // 64)]
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """ceil(percent n / 100): what any partner shares at least."""
    return -(-percent * n // 100)


def boundary(length: float, percent: int = PERCENT) -> int:
    """The largest size whose pairs, (p + 1) p / 2, cost no more than its p list entries and their scans, p (1 + length)."""
    n, most = 1, 1 + 2 * length
    while n + 1 - least_overlap(n + 1, percent) + 1 <= most:
        n += 1
    return n


def signatures(hashes: np.ndarray, classes: np.ndarray, light_to: int, percent: int) -> np.ndarray:
    """uint64 keys of one set; the lists' keys come first, in order of place."""
    n = len(hashes)
    if n < 2:
        return hashes[:0]  # one shingle links to the same one only, and equal sets are one node
    p = n - least_overlap(n, percent) + 1
    ordered = hashes[np.argsort(class_of(hashes, classes), kind="stable")]
    if n > light_to:
        return ordered[:p]
    first = ordered[: p + 1]
    i, j = np.triu_indices(len(first), 1)
    pairs = mixed(first[i] * _PAIR + first[j])
    return np.concatenate([ordered[:p], pairs]) if n >= least_overlap(light_to + 1, percent) else pairs


def nodes(docs: DataFrame, classes: np.ndarray, light_to: int, width: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's digest), lists (how many of the keys are list keys), keys and parity maps of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n, s1, s2, lists, keys, maps, wide = [], [], [], [], [], [], []
            for _, hashes in shingle_lists(batch.column(1), width):
                hashes = np.unique(hashes)
                size = len(hashes)
                n.append(size)
                s1.append(hashes.sum(dtype=np.uint64) if size else np.uint64(0))
                s2.append(np.bitwise_xor.reduce(mixed(hashes * _PAIR)) if size else np.uint64(0))
                keys.append(signatures(hashes, own, light_to, percent))
                odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                wide.append(parity_map(hashes))
                lists.append(0 if size < 2 or size < least_overlap(light_to + 1, percent) else size - least_overlap(size, percent) + 1)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            maps = np.array(maps, np.int64).reshape(len(maps), len(MAPS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(lists, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *map(pa.array, maps.T.copy()), pa.array(wide, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "lists", "keys", *MAPS, "wide"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n int, s1 long, s2 long, lists int, keys array<long>, " + ", ".join(f"{g} long" for g in MAPS) + ", wide binary")


def parity_map(hashes: np.ndarray) -> bytes:
    """Parities on a power of two of bits, at least as many as there are hashes."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 64)
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two maps differ, the wider folded to the other's width (which keeps parities)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def close_maps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows of pairs (a, b and more) whose wide maps allow a link."""
    of = lambda s: sets.where("n > 0").select(F.col("doc_id").alias(s), F.col("n").alias(f"map_{s}_n"), F.col("wide").alias(f"map_{s}"))
    names, columns = ["map_a_n", "map_b_n", "map_a", "map_b"], pairs.columns
    wide = pairs.join(of("a"), "a").join(of("b"), "b").select(*columns, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)
            keep = [(100 + percent) * bits_apart(x, y) <= (100 - percent) * (n + m) for n, m, x, y in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    return wide.mapInArrow(tidy(run), pairs.schema).distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b whose sets link, counted on the whole texts."""
    texts = materialise(texts_near(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), "ngram-texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            b_sets = shingle_lists(batch.column(3), width)
            for row, (_, b) in enumerate(b_sets):
                b = np.unique(b)
                text = batch.column(2)[row].as_py()
                if last[0] != text:
                    last = text, np.unique(next(shingle_lists(batch.column(2).slice(row, 1), width))[1])
                both = len(np.intersect1d(last[1], b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(last[1]) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with passing() as here:  # of all that is written only what the result reads is left
        classes, length = commonness(sketch(docs, lambda texts: (h for _, h in shingle_lists(texts, width))))
        sets = materialise(nodes(docs, classes, boundary(length, percent), width, percent), "ngram-sets")
        digest = ["n", "s1", "s2"]
        classed = sets.where("n > 0 AND doc_id IS NOT NULL")
        least = classed.groupBy(*digest).agg(F.min(F.struct("doc_id", "lists", "keys")).alias("x"))
        entries = least.select(F.col("x.doc_id").alias("node"), "n", "x.lists", F.posexplode("x.keys").alias("place", "key"))
        entries = entries.select("key", "node", "n", F.when(F.col("place") < F.col("lists"), F.col("place")).otherwise(F.lit(0)).alias("place"))
        ends = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
        lists = materialise(entries.join(ends, "key").select("key", "node", "n", "place", "least"), "ngram-lists")  # a join, which may be split at a long list

        t = F.lit(percent)
        a_n, b_n = F.col("a_n"), F.col("b_n")
        by_size = (100 * F.least(a_n, b_n) >= t * F.greatest(a_n, b_n))
        by_place = (100 + percent) * (1 + F.least(a_n - F.col("a_place"), b_n - F.col("b_place")) - 1) >= t * (a_n + b_n)  # if this is the first they share

        differ = sum((F.bit_count(F.col(f"a_{g}").bitwiseXOR(F.col(f"b_{g}"))) for g in MAPS), F.lit(0))
        by_map = (100 + percent) * differ <= (100 - percent) * (a_n + b_n)
        of = lambda s: sets.select(F.col("doc_id").alias(s), F.col("n").alias(f"{s}_n"), *[F.col(g).alias(f"{s}_{g}") for g in MAPS])

        heads = lists.where("node = least").select("key", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("place").alias("a_place"))
        tails = lists.where("node <> least").select("key", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("place").alias("b_place"))
        stars = heads.join(tails, "key").where(by_size & by_place).select("a", "b").distinct()
        stars = stars.join(of("a"), "a").join(of("b"), "b").where(by_map).select("a", "b").distinct()
        stars = close_maps(stars, sets, percent)
        with passing() as own:
            links = verified(materialise(stars, "ngram-stars"), docs, width, percent)
            first = own.keep(materialise(components(links.union(shared_ids(classed, digest)), "a", "b"), "ngram-components"))

        named = lists.join(first.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        split = materialise(split, "ngram-split")  # a table, so that the join below may be split where one key has very many rows
        still = named.where("node <> least").join(split, "key").join(sets.select(F.col("doc_id").alias("node"), *MAPS), "node")
        still = materialise(still.select("key", "node", "n", "place", "component", *MAPS), "ngram-open")
        band = F.floor(F.log("n") / F.log(100 / t))  # sizes that may link lie in one band or in neighbours
        still = still.withColumn("band", band.cast("int"))
        side = lambda s, b: still.select("key", b.alias("band"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "place", "component", *MAPS)])
        bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
        cross = side("a", bands).join(side("b", F.col("band")), ["key", "band"]).where((F.col("a_component") < F.col("b_component")) & by_size & by_place & by_map)
        cross = cross.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_component", "b_component").distinct()
        rest = materialise(close_maps(cross, sets, percent), "ngram-rest")
        more = verified(rest.select("a", "b"), docs, width, percent).join(rest, ["a", "b"])
        second = components(more, "a_component", "b_component")

        known = classed.groupBy(*digest).agg(F.min("doc_id").alias("node")).join(first.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = known.join(second.select(F.col("id").alias("component"), F.col("component").alias("final")), "component", "left").select(*digest, F.coalesce("final", "component").alias("component"))
        known = here.keep(materialise(known, "ngram-known"))  # a table, so that the join may be split at a group of many copies
        sets = here.keep(materialise(sets.select("doc_id", *digest), "ngram-digests"))
    out = sets.join(known, digest, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.cast("long").alias("component_id"))


def shared_ids(classed: DataFrame, digest: list[str]) -> DataFrame:
    """a, b: nodes (each the least doc_id of a digest) of digests that stand under one doc_id."""
    several = classed.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in digest for f in (F.min, F.max)])
    several = several.where(" OR ".join(f"min_{c} <> max_{c}" for c in digest)).select("doc_id")
    mixed_ids = materialise(classed.join(several, "doc_id").select("doc_id", *digest).distinct(), "ngram-mixed-ids")
    named = classed.join(mixed_ids.select(*digest).distinct(), digest).groupBy(*digest).agg(F.min("doc_id").alias("node"))
    least = mixed_ids.join(named, digest).select("doc_id", "node")
    return least.join(least.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()


#: The same as SQL: all pairs that share a shingle, and the least id that links reach.
ORACLE = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * u UNION ALL SELECT b, a FROM p WHERE 100 * c >= 80 * u),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)"""
