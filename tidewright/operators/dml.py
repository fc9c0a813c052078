"""Row-level changes as rewrites of immutable tables: each gives the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows for which the condition is unknown stay as they are."""
    return df.withColumns({c: F.when(condition, v).otherwise(df[c]).cast(df.schema[c].dataType) for c, v in changes.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: bool = True, insert: bool = True, delete_flag: str | None = None) -> DataFrame:
    """Rows of target replaced by those of source with equal keys, and the rest of source added. One row a key in source.
    A source row whose delete_flag is true removes its match and adds nothing."""
    columns = target.columns
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in columns], F.lit(True).alias("in_t"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("in_s"), *([F.col(delete_flag).alias("gone")] if delete_flag else []))
    both = t.join(s, [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys], "full")
    if delete_flag:
        both = both.where(~F.coalesce(F.col("gone"), F.lit(False)))
    if not insert:
        both = both.where("in_t")
    new = F.col("in_s").isNotNull() & (F.lit(True) if update else F.col("in_t").isNull())
    return both.select(*[F.when(new, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in columns])


def incremental_append(target: DataFrame, source: DataFrame, key: str, high_water: str) -> DataFrame:
    """target and those rows of source that are later than all of it and not in it."""
    mark = target.agg(F.max(high_water).alias("mark"))  # one row
    fresh = source.crossJoin(F.broadcast(mark)).where(F.col("mark").isNull() | (F.col(high_water) > F.col("mark"))).drop("mark")
    return target.unionByName(fresh.join(target.select(key), key, "left_anti").select(*target.columns))
