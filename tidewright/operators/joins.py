"""Joins that Spark lacks, composed from those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """left with `columns` of the latest row of right that is not later, per `by`: one union, one window, no range join.
    Columns are null where there is none; at equal times right counts as earlier. Right rows of equal key and time: the
    one whose columns are largest."""
    r = right.groupBy(by, right_time).agg(F.max(F.struct(*columns)).alias("asof_row")).select(F.col(by).alias("asof_by"), F.col(right_time).alias("asof_time"), "asof_row", F.lit(0).alias("asof_side"), F.lit(None).cast(left.schema.simpleString()).alias("asof_left"))
    whole = F.struct(*[left[c] for c in left.columns])
    l = left.select(left[by].alias("asof_by"), left[left_time].alias("asof_time"), F.lit(None).cast(r.schema["asof_row"].dataType).alias("asof_row"), F.lit(1).alias("asof_side"), whole.alias("asof_left"))
    w = Window.partitionBy("asof_by").orderBy("asof_time", "asof_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("asof_row", F.last("asof_row", ignorenulls=True).over(w)).where("asof_side = 1")
    return both.select("asof_left.*", *[F.col("asof_row")[c].alias(c) for c in columns])


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_low: str, right_high: str, width: float) -> DataFrame:
    """Rows of left and right with right_low <= left_value < right_high, by an equi-join on bins of `width`: an interval
    stands in each bin that it touches, so only what can match meets. Choose the width near a typical interval's."""
    bins = F.sequence(F.floor(F.col(right_low) / width), F.floor(F.col(right_high) / width))
    r = right.where(F.col(right_low) < F.col(right_high)).withColumn("band_bin", F.explode(bins))
    l = left.withColumn("band_bin", F.floor(F.col(left_value) / width))
    return l.join(r, "band_bin").where((F.col(left_value) >= F.col(right_low)) & (F.col(left_value) < F.col(right_high))).drop("band_bin")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join with each key of left dealt over `salts` parts, for keys that adaptive execution can't split (it needs
    rows of a later aggregation to stay together). right is repeated, so it should be the smaller. The part depends on the row
    alone, so a task that runs again deals its rows the same way; equal rows share a part."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat rows of right")
    l = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    r = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "salt"], how).drop("salt")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_key NOT IN (SELECT right_key FROM right), with SQL's nulls, as a plain anti join behind two counts: Spark's own
    null-aware anti join has to broadcast right, whatever its size. Nothing stays if right holds a null; a null on the left
    stays only if right is empty."""
    keys = right.select(right[right_key].alias("not_in_key"))
    counts = keys.agg(F.count(F.lit(1)).alias("not_in_rows"), F.count_if(F.col("not_in_key").isNull()).alias("not_in_nulls"))  # one row
    able = left.crossJoin(F.broadcast(counts)).where((F.col("not_in_rows") == 0) | ((F.col("not_in_nulls") == 0) & F.col(left_key).isNotNull()))
    return able.join(keys, F.col(left_key) == F.col("not_in_key"), "left_anti").select(*left.columns)


def or_to_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """One IN filter for a chain of equalities, which the scan takes as one predicate."""
    return df.where(F.col(column).isin(*values))
