"""Whole reports: one row a pipeline of all engines, what-if grids, and columns grounded in a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engines as E, rules
from .ir import Tables


def traits(t: Tables) -> DataFrame:
    """What the score looks at besides issues."""
    tests = t.tall.where("rel = 'test' OR type = 'EXPECTATION'").select("pipeline").distinct().withColumn("has_tests", F.lit(True))
    sla = t.ops("DAG", "TASK").where(F.col("a")["has_sla"] == "true").select("pipeline").distinct().withColumn("has_sla", F.lit(True))
    retries = t.ops("DAG", "TASK").groupBy("pipeline").agg(F.max(F.coalesce(F.col("a")["default_retries"], F.col("a")["retries"]).cast("int")).alias("retries"))
    alias = t.tables.where("alias <> ''").select("pipeline").distinct().withColumn("has_aliases", F.lit(True))
    x = t.pipelines.select("pipeline", F.coalesce(F.col("facts")["described"] == "true", F.lit(False)).alias("described"))
    for part in (tests, sla, retries, alias):
        x = x.join(part, "pipeline", "left")
    return x.fillna(False, ["has_tests", "has_sla", "has_aliases"])


def shapes(t: Tables) -> DataFrame:
    """What the cost looks at besides issues: tables read, a star, and different columns selected."""
    reads = t.tables.where("access <> 'write'").groupBy("pipeline").agg(F.count(F.lit(1)).cast("int").alias("n_reads"))
    s = t.ops("SELECT")
    star = s.groupBy("pipeline").agg(F.max(F.col("a")["has_star"] == "true").alias("has_star"))
    shown = s.select("pipeline", F.explode(F.from_json(F.col("a")["projections"], "array<string>")).alias("c")).unionByName(t.lineage.select("pipeline", F.col("output_column").alias("c")))
    n = shown.groupBy("pipeline").agg(F.countDistinct(F.lower("c")).cast("int").alias("n_projected"))
    return t.pipelines.select("pipeline").join(reads, "pipeline", "left").join(star, "pipeline", "left").join(n, "pipeline", "left").fillna(0).fillna(False)


def report(t: Tables, issues: DataFrame, params: DataFrame) -> DataFrame:
    """pipeline, format, issues by severity, score, cost, risk and a summary line, for each of the parameters."""
    by = issues.groupBy("pipeline").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in rules.SEVERITY_RANK])
    score = E.score(traits(t), issues).select("pipeline", "total")
    cost = E.cost(shapes(t), issues.select("pipeline", "rule"), params).select("pipeline", "n_rows", "runs", "warehouse", "usd_month", "usd_month_optimised", "savings_pct", "risk")
    x = t.pipelines.where("format IS NOT NULL").select("pipeline", "format").join(by, "pipeline", "left").fillna(0).join(score, "pipeline").join(cost, "pipeline")
    text = F.format_string("%s pipeline, score %d: %d critical, %d warnings, %d notes; about %.2f USD a month, %.2f after the fixes", "format", "total", "critical", "warning", "info", "usd_month", "usd_month_optimised")
    return x.withColumn("summary", text)


def what_if(t: Tables, issues: DataFrame, params: DataFrame) -> DataFrame:
    """Cost and the most expensive issue of every pipeline under every parameter row; the texts aren't looked at again."""
    cost = E.cost(shapes(t), issues.select("pipeline", "rule"), params)
    worst = E.impact(issues.select("pipeline", "rule", "severity", "category").distinct().join(cost.select("pipeline", F.col("usd_month").alias("base_usd"), F.col("warehouse").alias("of"), F.col("n_rows").alias("of_rows")), "pipeline"), params)
    worst = worst.where("place = 1").select("pipeline", "warehouse", F.col("rule").alias("worst_rule"))
    return cost.select("pipeline", "n_rows", "runs", "warehouse", "usd_month", "risk").join(worst.dropDuplicates(["pipeline", "warehouse"]), ["pipeline", "warehouse"], "left")


def ground(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """tables (pipeline, name) with the columns of the catalog's table that the name means: the full name, else its last two
    parts, else its last part. catalog: table_name, column_name, position."""
    parts = F.split(F.lower("name"), r"\.")
    tries = F.array_distinct(F.array(F.lower("name"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."), F.element_at(parts, -1)))
    columns = catalog.groupBy(F.lower("table_name").alias("candidate")).agg(F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("c"))
    x = tables.select("pipeline", "name", F.posexplode(tries).alias("pos", "candidate")).join(columns, "candidate")
    best = x.groupBy("pipeline", "name").agg(F.min_by(F.struct("candidate", "c"), "pos").alias("b"))
    out = tables.select("pipeline", "name").join(best, ["pipeline", "name"], "left")
    return out.select("pipeline", "name", F.col("b.candidate").alias("table_name"), F.transform("b.c", lambda v: v["column_name"]).alias("columns"))
