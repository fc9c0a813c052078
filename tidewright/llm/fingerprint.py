"""Document fingerprints: threshold-scaled sketches. DataFrame functions only.

A text's shingles are its distinct runs of SHINGLE words (the whole sequence when it has fewer; none when it has no word).
Each is hashed to BITS bits (the upper ones of xxhash64); the sketch keeps every hash below FRACTION * 2^BITS, whatever the
text's length. Sketches of one fraction merge by union, and |A n B| / min(|A|, |B|) estimates containment, also between texts
of very unequal length.

The fingerprint is the kept values in ascending order, 8 hex digits each. A text with words of which no hash is kept shows its
least hash instead, so that short texts differ too; this value lies above the fraction, and `merge` drops it as soon as
either side has a kept one. Only texts without words have the empty fingerprint. Likeness is a function of two fingerprints: 1 for equal
ones, else the containment, and 0 if one of them is empty.

Defined cases: a null text counts as empty; documents with equal doc_id follow each other as one (the successor's smallest
edit head is used); a row without doc_id has no successor, its edited text just loses the tail and near_next is 0; a single document is its own successor;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_for, words_of

SHINGLE = 3
BITS = 31
FRACTION = 0.25
IDS_PER_RANGE = 250_000


def add_sketch(df: DataFrame, text: Column, name: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """df with column `name`: array<int>, ascending, of the kept hashes, or the least one where none is kept."""
    below, drop = F.lit(int(fraction * (1 << BITS))), 64 - BITS
    df = df.withColumn("fp_words", words_of(text))
    n = F.size("fp_words")
    runs = F.when(n >= shingle, F.sequence(F.lit(1), n - (shingle - 1)))
    hashed = F.transform(runs, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at("fp_words", i + k) for k in range(shingle)]), drop))
    few = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64("fp_words"), drop))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("fp_hashes", F.coalesce(hashed, few))
    df = df.withColumn(name, F.sort_array(F.array_distinct(F.filter("fp_hashes", lambda h: h < below))).cast("array<int>"))
    least = F.when(F.size("fp_hashes") > 0, F.array(F.array_min("fp_hashes"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(least.cast("array<int>"))).drop("fp_words", "fp_hashes")


def as_text(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 8, "0")))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together, from theirs."""
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda h: h < F.lit(int(fraction * (1 << BITS))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sketch and fingerprint of every row."""
    out = add_sketch(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")), F.col("text"), "sketch")
    return out.withColumn("fingerprint", as_text(F.col("sketch")))


def successors(ids: DataFrame) -> DataFrame:
    """next_id of every distinct id; the first follows the last. No window spans all ids: Spark cuts them into ranges of about
    as many ids each, whatever their values, and each range's last id gets the first id of the next range."""
    ranges = parts_for(ids.count(), IDS_PER_RANGE, 1_000_000)
    cut = ids.repartitionByRange(ranges, "doc_id").withColumn("id_range", F.spark_partition_id())
    cut = materialise(cut, "fingerprint-ids")  # written, so that the ranges stay what they are
    firsts = cut.groupBy("id_range").agg(F.min("doc_id").alias("first_id"))
    by_range = Window.orderBy("id_range")  # a row for each range
    after = F.coalesce(F.lead("first_id").over(by_range), F.min("first_id").over(Window.partitionBy()))
    firsts = firsts.select("id_range", after.alias("first_after"))
    inside = F.lead("doc_id").over(Window.partitionBy("id_range").orderBy("doc_id"))
    return cut.withColumn("inside", inside).join(firsts, "id_range").select("doc_id", F.coalesce("inside", "first_after").alias("next_id"), "tail")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint, its edited text's, and the likenesses. Edited: the last floor(n / 4) code points give
    way to the first as many of the next document. Texts are dealt by doc_id once; what travels further is the heads."""
    # An alias on one side of a self-join only would make two exchanges of one, so rename only what needs it.
    base = docs.select(docs[id_col] if id_col == "doc_id" else docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    named = base.where("doc_id IS NOT NULL")  # one exchange of this serves both joins
    tails = named.select("doc_id", quarter.alias("tail")).groupBy("doc_id").agg(F.max("tail").alias("tail"))
    wanted = successors(tails).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), "tail")
    heads = named.join(wanted, "doc_id").select("prev_id", "text", F.expr("left(text, tail)").alias("head"))
    heads = add_sketch(heads, F.col("text"), "next_sketch").groupBy("prev_id").agg(F.min(F.struct("head", "next_sketch")).alias("next"))
    heads = heads.select(F.col("prev_id").alias("doc_id"), "next.head", "next.next_sketch")
    nameless = base.where("doc_id IS NULL").withColumns({"head": F.lit(""), "next_sketch": F.lit(None).cast("array<int>")})
    out = named.join(heads, "doc_id", "left").unionByName(nameless).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", quarter)
    out = out.withColumn("edited_text", F.concat(F.expr("left(text, n_chars - cut)"), F.expr("left(coalesce(head, ''), cut)")))
    out = add_sketch(add_sketch(out, F.col("text"), "sketch"), F.col("edited_text"), "edited_sketch")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), likeness(F.col("sketch"), F.col("next_sketch"))).otherwise(F.lit(0.0)).alias("near_next"),
    )
