"""The live lens: what tables there are, their columns and rows, and what a read query costs. Only queries pass."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import TABLES, read, register

STATS = "query string, allowed boolean, reason string, estimated_bytes double, rows_produced long, elapsed_ms double"
_history: list[tuple] = []

#: What a plan's nodes extend when they change something or run a command.
_CHANGING = ("Command", "ParsedStatement")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    register(spark, sf_dir, TABLES)


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, column_name, position, type and nullable of every column; footers only."""
    rows = [(t, f.name, k, f.dataType.simpleString(), f.nullable) for t in TABLES for k, f in enumerate(read(spark, sf_dir, t).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, type string, nullable boolean")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def is_read_only(spark: SparkSession, text: str) -> tuple[bool, str]:
    """By the class of the parsed plan, wherever it stands, not by its first word."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001  whatever doesn't parse is refused
        return False, f"not parsed: {str(e).splitlines()[0][:120]}"
    loader = spark._jvm.Thread.currentThread().getContextClassLoader()
    changing = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in _CHANGING]
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if any(c.isInstance(node) for c in changing):
            return False, f"{name} is not a query"
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name == "UnresolvedWith":
            todo += [node.cteRelations().apply(i)._2() for i in range(node.cteRelations().size())]
    return True, ""


def profile(spark: SparkSession, text: str) -> DataFrame:
    """One row: Catalyst's estimate of the bytes read, and the rows and time of a run to nowhere. Kept in the history."""
    allowed, reason = is_read_only(spark, text)
    if not allowed:
        row = (text, False, reason, None, None, None)
    else:
        df = spark.sql(text)
        estimate = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        seen = Observation()
        began = time.time()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        row = (text, True, "", estimate, seen.get["n"], (time.time() - began) * 1000)
    _history.append(row)
    return spark.createDataFrame([row], STATS)


def history(spark: SparkSession, limit: int = 50) -> DataFrame:
    """The newest first."""
    return spark.createDataFrame(_history[::-1][:limit], STATS)
