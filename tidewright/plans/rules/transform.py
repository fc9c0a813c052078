"""The 15 rules on dbt models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ..ir import Tables
from . import a, at, once, rule



def like_key(name: Column) -> Column:
    """id, or a name that ends with id, key or pk or begins with pk, parts told by underscores."""
    several = F.size(N.parts(name)) > 1
    return (F.lower(name) == "id") | (several & (N.last_part(name).isin("id", "key", "pk") | (N.parts(name)[0] == "pk")))


def like_date(name: Column) -> Column:
    several = F.size(N.parts(name)) > 1
    return N.contains_any(F.lower(name), ("date", "time", "partition")) | F.lower(name).isin("dt", "day", "month") | (several & N.last_part(name).isin("at", "ts"))


def fact(name: str) -> Column:
    return F.coalesce(F.col("facts")[name], F.lit(""))


def models(t: Tables) -> DataFrame:
    """One row a model, at line 1."""
    return t.pipelines.where("format = 'dbt'").select("pipeline", "source", "facts", F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("ord"))


def tests(t: Tables) -> DataFrame:
    return t.rel("test").select("pipeline", F.col("type").alias("test"), a("column").alias("column"))


def without(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("pipeline").distinct(), "pipeline", "left_anti")


@rule("NO_TESTS_ON_PRIMARY_KEY", "CRITICAL", "observability", "dbt", "The key is not tested", "Test the key with unique and not_null.")
def _(t: Tables) -> DataFrame:
    first = once(t.rel("lineage").where(a("output_column").isNotNull())).select("pipeline", a("output_column").alias("first"))
    m = models(t).join(first, "pipeline", "left")
    key = F.when(fact("unique_key") != "", F.split(fact("unique_key"), ",")[0]).when(like_key(F.col("first")), F.col("first"))
    m = m.withColumn("column", key).where("column IS NOT NULL")
    tested = tests(t).where(F.col("test").rlike("unique|not_null")).select("pipeline", "column").distinct()
    return at(m.join(tested, ["pipeline", "column"], "left_anti"), "The key %s has no unique or not_null test", "column")


@rule("UNTESTED_SOURCE", "CRITICAL", "observability", "dbt", "Sources without tests", "Test the sources' keys.")
def _(t: Tables) -> DataFrame:
    return at(without(models(t).where(fact("sources") != ""), tests(t)), "No test guards the sources %s", fact("sources"))


@rule("EPHEMERAL_IN_PRODUCTION", "CRITICAL", "reliability", "dbt", "An ephemeral model", "Materialise it as a view or table.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where(fact("materialization") == "ephemeral"), "%s leaves no relation to look at", fact("name"))


@rule("MISSING_DESCRIPTION", "WARNING", "maintainability", "dbt", "No description", "Describe the model in schema.yml.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where(fact("described") != "true"), "%s has no description", fact("name"))


@rule("MISSING_INCREMENTAL_STRATEGY", "WARNING", "performance", "dbt", "No incremental strategy", "Set incremental_strategy.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where((fact("materialization") == "incremental") & (fact("strategy") == "")), "%s is incremental by the adapter's default", fact("name"))


@rule("FULL_REFRESH_ON_LARGE_TABLE", "WARNING", "cost", "dbt", "The whole table is rebuilt", "Make the model incremental, or filter by date.")
def _(t: Tables) -> DataFrame:
    dated = t.ops("FILTER").where(F.exists(F.from_json(a("columns"), "array<string>"), lambda x: like_date(x))).select("pipeline")
    return at(without(models(t).where(fact("materialization") == "table"), dated.unionByName(t.ops("PARTITION_FILTER").select("pipeline"))), "%s reads all history on each run", fact("name"))


@rule("MISSING_UNIQUE_TEST", "WARNING", "observability", "dbt", "Nothing is tested to be unique", "Add a unique test.")
def _(t: Tables) -> DataFrame:
    return at(without(models(t), tests(t).where(F.col("test").contains("unique"))), "%s has no unique test", fact("name"))


@rule("REF_INSTEAD_OF_SOURCE", "WARNING", "maintainability", "dbt", "A table is named directly", "Use ref() or source().")
def _(t: Tables) -> DataFrame:
    return at(models(t).where(fact("raw_refs") != ""), "%s are read by name, so their lineage is lost", fact("raw_refs"))


@rule("NO_UNIQUE_KEY_ON_INCREMENTAL", "WARNING", "reliability", "dbt", "No unique key", "Set unique_key.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where((fact("materialization") == "incremental") & (fact("unique_key") == "")), "A second run of %s appends the same rows again", fact("name"))


@rule("MISSING_NOT_NULL_TEST", "WARNING", "observability", "dbt", "Nothing is tested for NULL", "Add a not_null test.")
def _(t: Tables) -> DataFrame:
    return at(without(models(t), tests(t).where(F.col("test").contains("not_null"))), "%s has no not_null test", fact("name"))


@rule("MISSING_INCREMENTAL_GUARD", "WARNING", "performance", "dbt", "No incremental filter", "Filter new rows under is_incremental().")
def _(t: Tables) -> DataFrame:
    return at(models(t).where((fact("materialization") == "incremental") & (fact("incremental_guard") != "true")), "%s reads everything on each run", fact("name"))


@rule("TOO_MANY_JOINS", "WARNING", "performance", "dbt", "Six joins or more", "Split the model.")
def _(t: Tables) -> DataFrame:
    x = t.ops("JOIN").groupBy("pipeline").agg(F.array_sort(F.collect_list(F.struct("ord", "line", "col"))).alias("x")).where(F.size("x") >= 6)
    return x.select("pipeline", F.col("x")[5]["line"].alias("line"), F.col("x")[5]["col"].alias("col"), F.format_string("The model has %d joins", F.size("x")).alias("message"))


@rule("NO_TAGS", "INFO", "maintainability", "dbt", "No tags", "Add tags.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where(fact("tags") == ""), "%s has no tags", fact("name"))


@rule("MODEL_NAMING_CONVENTION", "INFO", "maintainability", "dbt", "The name shows no layer", "Begin the name with stg_, int_, fct_, dim_ or mart.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where((fact("name") != "") & ~fact("name").rlike("(?i)^(stg_|int_|fct_|dim_|mart)")), "%s shows no layer", fact("name"))


@rule("MISSING_SOURCE_FRESHNESS", "INFO", "observability", "dbt", "Sources without freshness", "Set freshness on the sources.")
def _(t: Tables) -> DataFrame:
    return at(models(t).where((fact("sources") != "") & (fact("freshness") != "true")), "Nobody is told when %s stops to be loaded", fact("sources"))
