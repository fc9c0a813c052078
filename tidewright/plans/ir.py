"""The intermediate representation as tables: pipelines are parsed in Python workers, one row in, many rows out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, ship
from .detect import dialect_of, format_of

SCHEMA = "pipeline string, rel string, ord int, type string, line int, col int, a map<string,string>"
FORMATS = ("sql", "dbt", "flink", "spark", "airflow", "prefect", "kafka", "great_expectations")


def parse_one(fmt: str | None, source: str) -> tuple[list, dict, list[str]]:
    """Rows, facts and warnings; a text that can't be parsed gives a warning, never an exception."""
    from . import parse_py, parse_sql

    parsers = {"sql": parse_sql.sql_rows, "dbt": parse_sql.dbt_rows, "flink": parse_sql.flink_rows, "spark": parse_py.spark_rows, "airflow": parse_py.airflow_rows, "prefect": parse_py.prefect_rows, "kafka": parse_py.kafka_rows, "great_expectations": parse_py.suite_rows}
    if fmt not in parsers:
        return [], {}, ["no pipeline format was recognised"]
    try:
        return parsers[fmt](source)
    except Exception as e:  # noqa: BLE001  one text must not fail the others
        return [], {}, [f"{type(e).__name__}: {e}"]


@dataclass
class Tables:
    """pipelines(pipeline, source, format, dialect, facts) and views of one tall table by relation."""

    pipelines: DataFrame
    tall: DataFrame

    def rel(self, name: str) -> DataFrame:
        return self.tall.where(F.col("rel") == name).drop("rel")

    def ops(self, *types: str) -> DataFrame:
        out = self.rel("op")
        return out.where(F.col("type").isin(*types)) if types else out

    def nodes(self, *kinds: str) -> DataFrame:
        out = self.rel("node")
        return out.where(F.col("type").isin(*kinds)) if kinds else out

    @property
    def tables(self) -> DataFrame:
        return self.rel("table").select("pipeline", "ord", F.col("type").alias("access"), F.col("a")["name"].alias("name"), F.col("a")["alias"].alias("alias"), F.filter(F.split(F.col("a")["columns"], ","), lambda x: x != "").alias("columns"))

    @property
    def deps(self) -> DataFrame:
        return self.rel("dep").select("pipeline", "ord", F.col("a")["source"].alias("source"), F.col("a")["target"].alias("target"), "type")

    @property
    def lineage(self) -> DataFrame:
        names = ("output_table", "output_column", "source_table", "source_column", "expression")
        return self.rel("lineage").select("pipeline", "ord", "line", F.col("type").alias("transformation"), *[F.col("a")[n].alias(n) for n in names])

    @property
    def lines(self) -> DataFrame:
        """Every line of every text, numbered from 1."""
        return self.pipelines.select("pipeline", F.posexplode(F.split("source", "\r\n|\n|\r|\f|\x0b")).alias("pos", "content")).select("pipeline", (F.col("pos") + 1).cast("int").alias("line"), "content")


def analyse(pipelines: DataFrame) -> Tables:
    """pipelines: pipeline (id), source, and maybe format, which overrides detection."""
    ship(pipelines.sparkSession)
    found = format_of(F.col("source"))
    fmt = F.coalesce("format", found) if "format" in pipelines.columns else found
    known = pipelines.select("pipeline", F.coalesce("source", F.lit("")).alias("source"), fmt.alias("format")).withColumn("dialect", dialect_of(F.col("format"), F.col("source")))
    known = materialise(known, "pipelines-known")  # detection runs once, not in each rule that reads the texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            rows = []
            for pid, source, f in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found, facts, warnings = parse_one(f, source)
                rows += [(pid, rel, k, type_, line, col, list(a.items())) for k, (rel, type_, line, col, a) in enumerate(found)]
                rows.append((pid, "facts", 0, f or "", 0, 0, list(facts.items())))
                rows += [(pid, "warning", k, "parse", 0, 0, [("message", w)]) for k, w in enumerate(warnings)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["pipeline", "rel", "ord", "type", "line", "col", "a"])

    # each text is parsed once; the rules read only the relations that they ask for
    tall = materialise(known.select("pipeline", "source", "format").mapInArrow(run, SCHEMA), "pipelines", "rel")
    facts = tall.where("rel = 'facts'").select("pipeline", F.col("a").alias("facts"))
    return Tables(known.join(facts, "pipeline", "left"), tall)


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(texts.items()), "pipeline string, source string")
