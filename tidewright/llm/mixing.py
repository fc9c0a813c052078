"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: the sources, ordered by code point with null last, get the weights 3, 1, 2 in turn and share `share` times all
sizes. A target stops at `cap` times its source's size and the excess goes to the others by weight (water filling): with
the sources ordered by cap/weight, the level is the largest (budget - caps before) / (weights from here on).

Sampling: every document of a source expects rate = target / source size copies. The expected copies are prefix-summed
within the source, one random offset of the source is added, and a document is emitted once for each integer it crosses. The
order runs from short documents to long ones over one half of the source (by a hash of the row) and back over the other:
with sizes in order what rounding takes from one document the next one returns, and the two slopes cancel the offset's part.

Scale: a source may hold a third of all rows, so no window spans a source. Rows are numbered inside cells of (source, slope,
salt), SALTS salts at every size, drawn from the row's id and text, so the order is the same at every size. A cell's offset
is the sum of two prefix sums: over the salts of its slope (SALTS rows at most) and over the slopes of its source.

Defined cases: a null text has size 0 and may still be emitted (it takes no words); a null source is a source of its own,
last in order; rows without id are documents like others; an empty table gives no rows; repeated rows are documents of their
own, in any order, as they are the same; rows of one id and other texts are told apart by the text's digest; other columns pass through (mix keeps
them all; copies leaves out those that have its outputs' names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialise, shield, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20_240_607
SALTS = 1 << 16
OUTPUTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
SLOPES = 10_000  # above twice the largest class, 32 log2 of a long
INNER = ("mix_id", "mix_src", "mix_class", "mix_slope", "mix_salt", "mix_digest", "mix_row", "rows_before", "mix_rate", "mix_u", "mix_copy")


def targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """mix_src, mix_source_size, mix_target for every source. cells: mix_src, cell_size. One row a source from here on."""
    src = cells.groupBy("mix_src").agg(F.sum("cell_size").alias("mix_source_size"))
    by_name = Window.orderBy("mix_src")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("cap", F.col("mix_source_size") * F.lit(float(cap)))
    src = src.withColumn("budget", F.sum("mix_source_size").over(everything) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "mix_src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    level = left / (F.col("all_w") - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    src = src.withColumn("level_here", level).withColumn("level", F.max("level_here").over(everything))
    return src.select("mix_src", "mix_source_size", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("mix_target"))


def number_of(text: Column, digits: int) -> Column:
    """A drawn number: the first hexadecimal digits of the text's md5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """32 classes an octave of size + 1, in whole numbers only."""
    octave = F.length(F.bin(size + 1)) - 1
    return (octave * 32 + F.floor((size + 1) * 32 / F.pow(F.lit(2.0), octave)) - 32).cast("int")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs (or its columns `keep`) with mix_size, mix_source_size, mix_target, mix_copies and mix_taken."""
    kept = [docs[c] for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    src = F.when(docs[source_col].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source_col]))
    digest = F.coalesce(F.md5(docs[text_col].cast("binary")), F.lit("none"))
    base = docs.select(*kept, docs[id_col].alias("mix_id"), src.alias("mix_src"), word_count(docs[text_col]).alias("mix_size"), digest.alias("mix_digest"))
    drawn = number_of(F.concat(F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.lit("|"), F.col("mix_digest")), 12)
    base = base.withColumn("mix_class", size_class(F.col("mix_size"))).withColumn("mix_salt", (drawn % SALTS).cast("int"))
    base = base.withColumn("mix_slope", F.when(F.floor(drawn / (1 << 24)) % 2 == 0, F.col("mix_class")).otherwise(SLOPES - F.col("mix_class")))
    base = materialise(base, "mix-sizes")  # words are counted once
    cell = ["mix_src", "mix_slope", "mix_salt"]
    cells = base.groupBy(*cell).agg(F.count(F.lit(1)).alias("cell_rows"), F.sum("mix_size").alias("cell_size"))
    slopes = cells.groupBy("mix_src", "mix_slope").agg(F.sum("cell_rows").alias("slope_rows"), F.sum("cell_size").alias("cell_size"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slope_before = F.coalesce(F.sum("slope_rows").over(earlier(Window.partitionBy("mix_src").orderBy("mix_slope"))), F.lit(0))
    salt_before = F.coalesce(F.sum("cell_rows").over(earlier(Window.partitionBy("mix_src", "mix_slope").orderBy("mix_salt"))), F.lit(0))
    offset = (number_of(F.concat(F.col("mix_src"), F.lit(f"|{seed}")), 10) / F.lit(float(1 << 40))).alias("mix_u")
    plan = targets(slopes, weights, share, cap)
    slopes = slopes.select("mix_src", "mix_slope", slope_before.alias("slope_before"))
    cells = cells.withColumn("salt_before", salt_before).join(slopes, ["mix_src", "mix_slope"]).withColumn("rows_before", F.col("slope_before") + F.col("salt_before")).join(plan, "mix_src")
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    cells = cells.select(*cell, "rows_before", "mix_source_size", "mix_target", rate.alias("mix_rate"), offset)
    in_cell = Window.partitionBy(*cell).orderBy("mix_id", "mix_digest")
    out = base.withColumn("mix_row", F.row_number().over(in_cell)).join(cells, cell).withColumn("mix_row", F.col("mix_row") + F.col("rows_before"))
    crossed = lambda n: F.floor(n * F.col("mix_rate") + F.col("mix_u"))
    out = out.withColumn("mix_copies", (crossed(F.col("mix_row")) - crossed(F.col("mix_row") - 1)).cast("int"))
    out = out.withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))
    return out.drop(*INNER)


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each row of docs as often as the sampling emits it, with docs' own columns."""
    safe, restore = shield(docs, *OUTPUTS, *INNER)
    out = copies(safe, **params)
    return restore(out.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))))


#: The same as SQL.
ORACLE = rf"""
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}')) AS BIGINT) AS size,
                      coalesce(md5(text), 'none') AS digest FROM documents),
    n AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest), 1, 12) AS BIGINT) AS drawn FROM d),
    c AS (SELECT *, CAST((length(bin(size + 1)) - 1) * 32 + floor((size + 1) * 32 / pow(2, length(bin(size + 1)) - 1)) - 32 AS BIGINT) AS class FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN drawn // 16777216 % 2 = 0 THEN class ELSE {SLOPES} - class END, drawn % {SALTS}, doc_id NULLS FIRST, digest) AS k FROM c),
    s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, CAST(list_extract({list(WEIGHTS)}, CAST((row_number() OVER (ORDER BY src) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS DOUBLE) AS w FROM d GROUP BY src),
    f AS (SELECT *, source_size * {CAP} AS cap, sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) AS budget, sum(w) OVER () AS all_w FROM s),
    g AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS here FROM f WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT src, source_size, least(cap, w * max(here) OVER ()) AS target, CAST('0x' || substr(md5(src || '|{SEED}'), 1, 10) AS BIGINT) / CAST({1 << 40} AS DOUBLE) AS u FROM g),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, CAST({CAP} AS DOUBLE)) ELSE 0 END AS rate FROM t),
    x AS (SELECT o.*, source_size, target, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS INTEGER) AS copies FROM o JOIN r USING (src))
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM x"""
