"""Rules over the intermediate representation: each is a query from tables to issues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ir import Tables

ISSUES = ("pipeline", "issue_id", "rule", "severity", "category", "title", "message", "line", "col", "fix", "rule_ord", "emit_ord")
SEVERITY_RANK = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}


@dataclass
class Rule:
    id: str
    severity: str
    category: str
    formats: tuple[str, ...]
    title: str
    fix: str
    find: Callable[[Tables], DataFrame]


RULES: list[Rule] = []


def rule(id_: str, severity: str, category: str, formats: str, title: str, fix: str):
    """find gives pipeline, line, col (0: unknown), message and maybe fix."""

    def add(find: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        every = ("sql", "dbt", "flink", "spark", "airflow", "prefect", "kafka", "great_expectations")
        RULES.append(Rule(id_, severity, category, every if formats == "all" else tuple(formats.split()), title, fix, find))
        return find

    return add


def at(df: DataFrame, message: str | Column, *args: Column | str, fix: Column | None = None) -> DataFrame:
    """Issues at the rows' own lines. message: a format with a %s for each arg."""
    text = message if isinstance(message, Column) else F.format_string(message, *[F.col(a) if isinstance(a, str) else a for a in args]) if args else F.lit(message)
    out = df.select("pipeline", "line", "col", text.alias("message"), *([fix.alias("fix")] if fix is not None else []))
    return out


def a(name: str) -> Column:
    """A detail of the row; null where it has none."""
    return F.col("a")[name]


def yes(name: str) -> Column:
    return F.coalesce(a(name) == "true", F.lit(False))


def once(df: DataFrame, *by: str) -> DataFrame:
    """The first row, by order, of each pipeline (and what else is named)."""
    return df.groupBy("pipeline", *by).agg(F.min_by(F.struct("ord", "line", "col", "a"), "ord").alias("x")).select("pipeline", *by, "x.*")


def cap(df: DataFrame, n: int) -> DataFrame:
    """At most the first n rows of each pipeline: the feature caps what one text reports."""
    from pyspark.sql import Window

    return df.withColumn("cap_row", F.row_number().over(Window.partitionBy("pipeline").orderBy("ord"))).where(F.col("cap_row") <= n).drop("cap_row")


def load() -> None:
    """The rules register when their modules are imported; the order is their order in ties."""
    from . import sql, orchestration, transform, streaming, security  # noqa: F401, I001


def run(tables: Tables, ids: list[str] | None = None) -> DataFrame:
    """All issues, in the columns ISSUES. A text's formats choose its rules; ids are digests, so they repeat."""
    load()
    present = {r["format"] for r in tables.pipelines.select("format").distinct().collect()}  # eight formats at most
    out = None
    for k, r in enumerate(RULES):
        if ids is not None and r.id not in ids or not present & set(r.formats):
            continue
        found = r.find(tables)
        found = found if "fix" in found.columns else found.withColumn("fix", F.lit(r.fix))
        shown = F.when(F.col("line") > 0, F.col("line"))
        one = found.select("pipeline", F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.title).alias("title"), "message", shown.alias("line"), F.when(F.col("line") > 0, F.col("col")).alias("col"), "fix", F.lit(k).alias("rule_ord"), F.array(*map(F.lit, r.formats)).alias("formats"))
        out = one if out is None else out.unionByName(one)
    if out is None:  # no rule is for these texts
        nothing = tables.pipelines.sparkSession.createDataFrame([], "pipeline string, issue_id string, rule string, severity string, category string, title string, message string, line int, col int, fix string, rule_ord int, emit_ord int")
        return nothing.select(*ISSUES)
    fmt = tables.pipelines.select("pipeline", "format")
    out = out.join(fmt, "pipeline").where(F.array_contains("formats", F.col("format")))
    key = F.concat_ws("|", "rule", F.coalesce(F.col("line").cast("string"), F.lit("None")), F.coalesce(F.col("col").cast("string"), F.lit("None")), "message")
    out = out.withColumn("issue_id", F.substring(F.sha1(key), 1, 16)).withColumn("emit_ord", F.coalesce("line", F.lit(1_000_000_000)))
    return out.select(*ISSUES)


def ordered(issues: DataFrame) -> DataFrame:
    """Most severe first, then by line with unknown ones last, then as registered."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    return issues.orderBy("pipeline", rank, "emit_ord", "rule_ord", "issue_id")
