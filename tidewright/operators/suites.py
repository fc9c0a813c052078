"""Runs data-quality suites and generated tests: one pass over the table for all checks that one row can fail, and one
aggregation more for each uniqueness check."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality

#: expectation type -> how a row fails. k: the expectation's arguments.
ROW_CHECKS = {
    "expect_column_values_to_not_be_null": lambda c, k: c.isNull(),
    "expect_column_values_to_be_null": lambda c, k: c.isNotNull(),
    "expect_column_values_to_be_between": lambda c, k: _outside(c, k.get("min_value"), k.get("max_value")),
    "expect_column_values_to_be_in_set": lambda c, k: ~c.isin(*k.get("value_set", [])),
    "expect_column_values_to_not_be_in_set": lambda c, k: c.isin(*k.get("value_set", [])),
    "expect_column_values_to_match_regex": lambda c, k: ~c.cast("string").rlike(k.get("regex", "")),
    "expect_column_value_lengths_to_be_between": lambda c, k: _outside(F.length(c.cast("string")), k.get("min_value"), k.get("max_value")),
}


def _outside(c: Column, low, high) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (c < low)
    if high is not None:
        out = out | (c > high)
    return out


def run_suite(df: DataFrame, expectations: list[dict]) -> DataFrame:
    """expectation, column, n_rows, n_failing, success of every expectation; a type or column that isn't known has success
    null. `mostly` is the share that has to pass."""
    known, rest, columns = [], [], set(df.columns)
    for k, e in enumerate(expectations):
        kind, args = e.get("expectation_type") or e.get("type"), e.get("kwargs") or {}
        known.append((k, kind, args)) if kind in ROW_CHECKS and args.get("column") in columns else rest.append((k, kind, args))
    n = F.count(F.lit(1))
    made = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("expectation"), F.lit(args["column"]).alias("column"), n.alias("n_rows"), F.count_if(ROW_CHECKS[kind](F.col(args["column"]), args)).alias("n_failing"), F.lit(float(args.get("mostly", 1.0))).alias("mostly")) for k, kind, args in known]
    out = None
    if made:
        out = df.agg(F.array(*made).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    for k, kind, args in rest:
        column = args.get("column")
        if kind == "expect_column_values_to_be_unique" and column in columns:
            one = quality.unique(df.where(F.col(column).isNotNull()), [column]).select(F.lit(k).alias("k"), F.lit(kind).alias("expectation"), F.lit(column).alias("column"), "n_rows", "n_failing", F.lit(float(args.get("mostly", 1.0))).alias("mostly"))
        elif kind == "expect_table_row_count_to_be_between":
            bad = _outside(F.count(F.lit(1)), args.get("min_value"), args.get("max_value"))
            one = df.agg(F.lit(k).alias("k"), F.lit(kind).alias("expectation"), F.lit(None).cast("string").alias("column"), n.alias("n_rows"), F.when(bad, n).otherwise(F.lit(0)).alias("n_failing"), F.lit(1.0).alias("mostly"))
        else:
            one = df.sparkSession.range(1).select(F.lit(k).alias("k"), F.lit(kind).alias("expectation"), F.lit(column).cast("string").alias("column"), F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("n_failing"), F.lit(1.0).alias("mostly"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return df.sparkSession.createDataFrame([], "expectation string, column string, n_rows long, n_failing long, success boolean")
    passed = F.when(F.col("n_rows") == 0, F.lit(True)).otherwise((F.col("n_rows") - F.col("n_failing")) / F.col("n_rows") >= F.col("mostly"))
    return out.select("expectation", "column", "n_rows", "n_failing", F.when(F.col("n_rows").isNotNull(), passed).alias("success"))


def to_suite(tests: DataFrame, name: str) -> str:
    """Generated tests of one table (column, test) as the text of a suite."""
    kinds = {"not_null": "expect_column_values_to_not_be_null", "unique": "expect_column_values_to_be_unique", "between": "expect_column_values_to_be_between", "accepted_values": "expect_column_values_to_be_in_set"}
    rows = sorted((r["column"], r["test"]) for r in tests.select("column", "test").collect())  # columns of one table
    made = [{"expectation_type": kinds[t], "kwargs": {"column": c} | ({"min_value": 0} if t == "between" else {"value_set": []} if t == "accepted_values" else {})} for c, t in rows if t in kinds]
    return json.dumps({"expectation_suite_name": name, "expectations": made}, indent=2)


def to_yaml(tests: DataFrame, name: str) -> str:
    """The same as a model's schema.yml."""
    import yaml

    by: dict[str, list] = {}
    for r in sorted(tests.select("column", "test").collect()):
        if r["test"] in ("unique", "not_null", "accepted_values", "relationships"):
            by.setdefault(r["column"], []).append({"accepted_values": {"values": []}} if r["test"] == "accepted_values" else r["test"])
    text = yaml.safe_dump({"version": 2, "models": [{"name": name, "columns": [{"name": c, "tests": t} for c, t in by.items()]}]}, sort_keys=False)
    yaml.safe_load(text)
    return text
