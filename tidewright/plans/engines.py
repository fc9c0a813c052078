"""What follows from the representation and the issues: lineage, cost, impact, score, tests to write, and KPIs.

All of it is joins, aggregations and column arithmetic over tables that hold many pipelines; nothing is looked at one
pipeline at a time. A pipeline's own graph is small, so walks over it are array expressions of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import security as S

# ---- Fixed values: the cost model's prices and bounds, the impact model, the score's weights.
ROW_BYTES, ASSUMED_COLUMNS, LEAST_WIDTH = 200, 20, 0.15
SCAN_CAP, MULTIPLIER_CAP, CTE_CAP = 16, 500, 4
ROW_CAP, RUN_CAP = 10**13, 100_000
TIB, LEAST_BILLED = 1024**4, 10 * 1024**2
SNOWFLAKE_CREDIT, SNOWFLAKE_BYTES = 3.0, 80e9
BIGQUERY_TIB = 6.25
REDSHIFT_HOUR, REDSHIFT_RATE, REDSHIFT_OVERHEAD, REDSHIFT_SHARE = 3.26, 300e6, 15, 0.25
DATABRICKS_DBU, DATABRICKS_DBUS, DATABRICKS_RATE, DATABRICKS_OVERHEAD = 0.55, 4, 400e6, 60
MULTIPLIERS = {"CARTESIAN_JOIN": 10.0, "EXPLODING_JOIN": 3.0, "UNBOUNDED_FULL_SCAN": 2.5, "MISSING_PARTITION_FILTER": 2.0, "SELECT_STAR": 1.4, "WINDOW_FUNCTION_ON_FULL_TABLE": 1.6, "CORRELATED_SUBQUERY": 1.8, "NESTED_LOOP_RISK": 2.0}
HIGH_RISK, MEDIUM_RISK = 500, 50
DIMENSIONS = {"efficiency": 0.25, "reliability": 0.25, "observability": 0.20, "maintainability": 0.15, "security": 0.15}
DEDUCTIONS = {"CRITICAL": 22, "WARNING": 7, "INFO": 2}
#: rule: (latency, cost, failure) as SQL over r (rows), d (runs a day), w (warehouse); clamp is least(greatest()).
IMPACT = {
    "CARTESIAN_JOIN": ("clamp(r/1e3,1,100)", "clamp(r/1e5,1,50)", "CASE WHEN r > 1e7 THEN 0.35 ELSE 0.10 END"),
    "EXPLODING_JOIN": ("clamp(r/4e3,1,60)", "clamp(r/4e5,1,25)", "CASE WHEN r > 1e7 THEN 0.25 ELSE 0.08 END"),
    "UNBOUNDED_FULL_SCAN": ("clamp(1+r/5e6,1,20)", "clamp(1+r/1e7,1,12)", "0.05"),
    "MISSING_PARTITION_FILTER": ("CASE WHEN w = 'bigquery' THEN clamp(1+r/2.5e6,1,30) ELSE clamp(1+r/6e6,1,12) END", "CASE WHEN w = 'bigquery' THEN clamp(1+r/1.5e6,1,25) ELSE clamp(1+r/8e6,1,8) END", "CASE WHEN w = 'bigquery' THEN 0.08 ELSE 0.05 END"),
    "NESTED_LOOP_RISK": ("clamp(1+r/2e6,1,40)", "clamp(1+r/1.5e7,1,8)", "0.12"),
    "CORRELATED_SUBQUERY": ("clamp(1+r/1e6,1,50)", "clamp(1+r/2e7,1,6)", "0.08"),
    "SELECT_STAR": ("1.15", "CASE WHEN w = 'bigquery' THEN 1.6 ELSE 1.25 END", "0.01"),
    "WINDOW_FUNCTION_ON_FULL_TABLE": ("clamp(1+r/4e6,1,15)", "clamp(1+r/4e7,1,4)", "0.10"),
    "SENSOR_POKE_MODE": ("clamp(1+d/12.0,1,6)", "clamp(1+d/48.0,1,2.5)", "0.10"),
    "MISSING_WATERMARK": ("clamp(1+r/5e7,1,4)", "1.25", "clamp(0.10+r/2e8,0.10,0.50)"),
    "UNBOUNDED_STATE": ("clamp(1+r/1e8,1,3)", "1.3", "clamp(0.05+r/1e9,0.05,0.60)"),
    "UNOPTIMIZED_CTE_REUSE": ("1.8", "1.6", "0.03"),
    "NO_RETRIES": ("1.0", "1.0", "0.22"),
    "NO_CATCHUP_SET": ("1.1", "1.4", "0.07"),
    "XCOMS_LARGE_DATA": ("1.35", "1.05", "0.15"),
    "NO_SLA": ("1.0", "1.0", "0.05"),
    "SEQUENTIAL_HEAVY_TASKS": ("2.5", "1.0", "0.04"),
    "NO_CHECKPOINTING": ("1.3", "1.3", "0.30"),
    "DELETE_WITHOUT_WHERE": ("1.0", "2.0", "0.90"),
    "UPDATE_WITHOUT_WHERE": ("1.0", "2.0", "0.90"),
    "HARDCODED_CREDENTIALS": ("1.0", "25.0", "0.02"),
}
FALLBACK = {"CRITICAL": (2.5, 1.8, 0.15, 0.35), "WARNING": (1.4, 1.2, 0.05, 0.12), "INFO": (1.05, 1.02, 0.01, 0.03)}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cases(key: Column, values: dict[str, object], other: object) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# ---- lineage


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def lineage_nodes(tables: DataFrame, deps: DataFrame, lineage: DataFrame, formats: DataFrame) -> DataFrame:
    """pipeline, node, kind, columns. tables: pipeline, ord, name, access, columns; names are compared as they are written."""
    t = tables.withColumn("name", F.trim("name")).groupBy("pipeline", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "columns"))).alias("c"), F.collect_set("access").alias("accesses"))
    access = F.when(F.size("accesses") == 1, F.col("accesses")[0]).otherwise("readwrite")
    t = t.select("pipeline", "name", access.alias("access"), F.array_distinct(F.flatten(F.transform("c", lambda x: x["columns"]))).alias("columns"))
    onward = deps.select("pipeline", F.col("source").alias("name")).unionByName(lineage.select("pipeline", F.col("source_table").alias("name"))).distinct().withColumn("onward", F.lit(True))
    t = t.join(onward, ["pipeline", "name"], "left")
    kind = F.when(F.col("access") == "read", "source").when(F.col("access") == "readwrite", "model").when(F.col("access") == "write", F.when(F.col("onward"), "model").otherwise("output")).otherwise("table")
    known = t.select("pipeline", F.col("name").alias("node"), kind.alias("kind"), "columns")
    ends = deps.select("pipeline", F.explode(F.array("source", "target")).alias("node")).unionByName(lineage.select("pipeline", F.explode(F.array("source_table", "output_table")).alias("node"))).distinct()
    ends = ends.join(known.select("pipeline", "node"), ["pipeline", "node"], "left_anti").join(formats, "pipeline", "left")
    hint = F.exists(F.split(F.lower("node"), "[^a-z0-9]+"), lambda x: x.isin("raw", "source", "src", "stg", "staging", "landing", "bronze", "ingest"))
    made = ends.select("pipeline", "node", F.when(F.col("format").isin("airflow", "prefect", "kafka"), "task").when(hint, "source").otherwise("table").alias("kind"), F.array().cast("array<string>").alias("columns"))
    out = known.unionByName(made)
    empty = formats.join(out.select("pipeline").distinct(), "pipeline", "left_anti").select("pipeline", F.lit("pipeline").alias("node"), F.lit("table").alias("kind"), F.array().cast("array<string>").alias("columns"))
    return out.unionByName(empty)


def lineage_edges(deps: DataFrame, lineage: DataFrame) -> DataFrame:
    """pipeline, edge_id, source, target, type, links, transformation: one row an edge; the first dependency names its type."""
    d = deps.groupBy("pipeline", "source", "target").agg(F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
    links = lineage.select("pipeline", F.col("source_table").alias("source"), F.col("output_table").alias("target"), "transformation", F.struct(F.col("source_column").alias("from"), F.col("output_column").alias("to"), "transformation").alias("link"))
    counted = links.groupBy("pipeline", "source", "target", "transformation").agg(F.countDistinct("link").alias("n"), F.collect_set("link").alias("links"))
    rank = cases(F.col("transformation"), {"aggregation": 0, "window": 1, "expression": 2}, 9)
    main = F.when(~F.col("transformation").isin("direct", "unknown"), F.struct((-F.col("n")).alias("n"), rank.alias("rank"), "transformation"))
    by = counted.groupBy("pipeline", "source", "target").agg(F.array_sort(F.flatten(F.collect_list("links"))).alias("links"), F.min(main).alias("main"), F.min(F.col("transformation") == "direct").alias("all_direct"))
    by = by.select("pipeline", "source", "target", "links", F.when(F.col("all_direct"), "direct").otherwise(F.coalesce("main.transformation", F.lit("expression"))).alias("transformation"))
    out = d.join(by, ["pipeline", "source", "target"], "full")
    base = F.concat(F.lit("e-"), slug(F.col("source")), F.lit("-"), slug(F.col("target")))
    w = Window.partitionBy("pipeline", "base").orderBy(F.col("ord").asc_nulls_last(), "source", "target")
    out = out.withColumn("base", base).withColumn("k", F.row_number().over(w))
    return out.select("pipeline", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("edge_id"), "source", "target", F.coalesce("type", F.lit("reads_from")).alias("type"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), F.coalesce("transformation", F.lit("unknown")).alias("transformation"), "links")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pipeline, node, depth: the longest path to the node; as many rounds as nodes, so a cycle ends it too."""
    g = edges.select("pipeline", "source", "target").distinct().groupBy("pipeline").agg(F.collect_list(F.struct("source", "target")).alias("edges"))
    n = nodes.groupBy("pipeline").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    g = n.join(g, "pipeline", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string>>")))
    start = F.map_from_entries(F.transform("nodes", lambda x: F.struct(x, F.lit(0))))
    relax = lambda m, _: F.transform_values(m, lambda k, v: F.greatest(v, F.coalesce(F.array_max(F.transform(F.filter("edges", lambda e: (e["target"] == k) & (e["source"] != k)), lambda e: F.coalesce(m[e["source"]], F.lit(-1)) + 1)), F.lit(0))))
    out = g.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.size("nodes")), start, relax))
    return out.select("pipeline", F.size("nodes").alias("most"), F.explode("m").alias("node", "depth")).select("pipeline", "node", F.least("depth", F.col("most")).alias("depth"))


def mermaid(edges: DataFrame) -> DataFrame:
    """pipeline, graph: a text drawing."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), safe(F.col("source")), F.lit("[\""), F.col("source"), F.lit("\"] --> "), safe(F.col("target")), F.lit("[\""), F.col("target"), F.lit("\"]"))
    return edges.groupBy("pipeline").agg(F.concat_ws("\n", F.lit("graph LR"), F.array_sort(F.collect_set(line))).alias("graph"))


# ---- cost


def price(size: Column, warehouse: Column) -> Column:
    """Dollars for one run over so many bytes; nothing for none."""
    usd = (
        F.when(warehouse == "snowflake", size / SNOWFLAKE_BYTES * SNOWFLAKE_CREDIT)
        .when(warehouse == "bigquery", F.floor(F.greatest(size, F.lit(float(LEAST_BILLED)))) / TIB * BIGQUERY_TIB)
        .when(warehouse == "redshift", (REDSHIFT_OVERHEAD + size / REDSHIFT_RATE) / 3600 * REDSHIFT_HOUR * REDSHIFT_SHARE)
        .when(warehouse == "databricks", (DATABRICKS_OVERHEAD + size / DATABRICKS_RATE) / 3600 * DATABRICKS_DBUS * DATABRICKS_DBU)
    )
    return F.when(size > 0, usd).otherwise(F.lit(0.0))


def cost(shapes: DataFrame, issues: DataFrame, params: DataFrame) -> DataFrame:
    """shapes: pipeline, n_reads, has_star, n_projected. issues: pipeline, rule. params (a small grid, met by every
    pipeline): n_rows, runs, warehouse. Dollars a run and a month, now and with the issues gone."""
    by_rule = issues.groupBy("pipeline", "rule").agg(F.count(F.lit(1)).alias("n"))
    plain = cases(F.col("rule"), MULTIPLIERS, 1.0)
    m = F.when(F.col("rule") == "UNOPTIMIZED_CTE_REUSE", F.pow(F.lit(1.5), F.least("n", F.lit(CTE_CAP)))).otherwise(plain)
    factors = by_rule.select("pipeline", "rule", m.alias("m")).groupBy("pipeline").agg(F.collect_list(F.struct("rule", "m")).alias("factors"))
    x = shapes.join(factors, "pipeline", "left").crossJoin(F.broadcast(params))  # params is a grid of a few rows
    x = x.withColumn("n_rows", F.least("n_rows", F.lit(ROW_CAP)).cast("double")).withColumn("runs", F.least("runs", F.lit(RUN_CAP)).cast("double"))
    width = F.when(F.col("has_star") | (F.col("n_projected") == 0), F.lit(1.0)).otherwise(clamp(F.col("n_projected") / ASSUMED_COLUMNS, LEAST_WIDTH, 1.0))
    scans = clamp(F.greatest(F.col("n_reads"), F.lit(1)).cast("double"), 1.0, float(SCAN_CAP))
    x = x.withColumn("base_bytes", F.col("n_rows") * ROW_BYTES * width * scans)
    bq = (F.col("warehouse") == "bigquery")
    one = lambda f: F.greatest(F.lit(1.0), F.when(bq & (f["rule"] == "MISSING_PARTITION_FILTER"), F.lit(4.0)).otherwise(f["m"]))
    product = F.aggregate(F.array_sort(F.coalesce("factors", F.array().cast("array<struct<rule:string,m:double>>"))), F.lit(1.0), lambda acc, f: acc * one(f))
    x = x.withColumn("multiplier", clamp(product, 1.0, float(MULTIPLIER_CAP))).withColumn("bytes", F.col("base_bytes") * F.col("multiplier"))
    x = x.withColumn("usd_run", price(F.col("bytes"), F.col("warehouse"))).withColumn("usd_month", F.col("usd_run") * F.col("runs") * 30)
    x = x.withColumn("usd_month_optimised", F.least(price(F.col("base_bytes"), F.col("warehouse")) * F.col("runs") * 30, F.col("usd_month")))
    saved = F.when(F.col("usd_month") > 0, (F.col("usd_month") - F.col("usd_month_optimised")) / F.col("usd_month") * 100).otherwise(F.lit(0.0))
    risk = F.when(F.col("usd_month") > HIGH_RISK, "HIGH").when(F.col("usd_month") > MEDIUM_RISK, "MEDIUM").otherwise("LOW")
    return x.select("pipeline", "n_rows", "runs", "warehouse", "multiplier", "bytes", "usd_run", "usd_month", "usd_month_optimised", saved.alias("savings_pct"), risk.alias("risk"))


def reasoning(costs: DataFrame, issues: DataFrame, most: int = 3) -> DataFrame:
    """pipeline, lines: how a cost came about: bytes, the largest multipliers, dollars, and the fix that saves most."""
    m = F.when(F.col("rule") == "UNOPTIMIZED_CTE_REUSE", F.pow(F.lit(1.5), F.least("n", F.lit(CTE_CAP)))).otherwise(cases(F.col("rule"), MULTIPLIERS, 1.0))
    by = issues.groupBy("pipeline", "rule").agg(F.count(F.lit(1)).alias("n")).select("pipeline", "rule", m.alias("m")).where("m > 1")
    w = Window.partitionBy("pipeline").orderBy(F.desc("m"), "rule")
    top = by.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy("pipeline").agg(F.array_sort(F.collect_list(F.struct("k", "rule", "m"))).alias("top"))
    x = costs.join(top, "pipeline", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<k:int,rule:string,m:double>>")))
    lines = F.concat(
        F.array(F.format_string("%.0f bytes are read a run, with all multipliers", "bytes")), F.transform("top", lambda t: F.format_string("%s multiplies the work by %.2f", t["rule"], t["m"])),
        F.array(F.format_string("%.4f USD a run on %s, %.2f USD a month", "usd_run", "warehouse", "usd_month"), F.format_string("the fixes would leave %.2f USD a month", "usd_month_optimised")),
        F.when(F.size("top") > 0, F.array(F.concat(F.lit("first fix: "), F.col("top")[0]["rule"]))).otherwise(F.array(F.lit("nothing stands out"))),
    )
    return x.select("pipeline", "n_rows", "runs", "warehouse", lines.alias("lines"))


# ---- impact


def _model(expr: str) -> str:
    import re

    return re.sub(r"clamp\(([^,]+),([^,]+),([^,)]+)\)", r"least(greatest(\1, \2), \3)", expr)


def impact_sql(part: int) -> str:
    """The model as one SQL expression over rule, severity, category, r, d, w (part: 0 latency, 1 cost, 2 failure)."""
    own = " ".join(f"WHEN rule = '{k}' THEN {_model(v[part])}" for k, v in IMPACT.items())
    soft = "category IN ('reliability', 'observability')"
    rest = " ".join(f"WHEN severity = '{s}' THEN " + (f"CASE WHEN {soft} THEN {f} ELSE {p} END" if part == 2 else f"CASE WHEN {soft} THEN {1 + (c - 1) / 4 if part else 1 + (latency - 1) / 2} ELSE {c if part else latency} END") for s, (latency, c, p, f) in FALLBACK.items())
    top = (1.0, 0.95) if part == 2 else (1.0, 1000.0)
    return f"least(greatest(CAST(CASE {own} {rest} END AS DOUBLE), {0.0 if part == 2 else top[0]}), {top[1]})"


def impact(issues: DataFrame, params: DataFrame, base_usd: Column | None = None) -> DataFrame:
    """issues: pipeline, rule, severity, category (and base_usd, a month's dollars). The most expensive first by rank."""
    x = issues.crossJoin(F.broadcast(params))  # a grid of a few rows
    x = x.withColumns({"r": F.col("n_rows").cast("double"), "d": F.col("runs").cast("double"), "w": F.col("warehouse")})
    x = x.withColumns({"latency": F.expr(impact_sql(0)), "cost": F.expr(impact_sql(1)), "failure": F.expr(impact_sql(2))})
    base = F.col("base_usd") if base_usd is None else base_usd
    x = x.withColumn("usd", base * (F.col("cost") - 1)).withColumn("incidents", F.col("d") * 30 * F.col("failure")).withColumn("latency_pct", F.bround((F.col("latency") - 1) * 100).cast("long"))
    w = Window.partitionBy("pipeline", "n_rows", "runs", "warehouse").orderBy(F.desc("usd"), F.desc("failure"), F.desc("latency_pct"), "rule")
    return x.select("pipeline", "n_rows", "runs", "warehouse", "rule", "latency", "cost", "failure", "latency_pct", "usd", "incidents", F.row_number().over(w).alias("place"))


# ---- score


def dimension(category: Column) -> Column:
    return F.when(category.isin("performance", "cost"), "efficiency").otherwise(category)


def score(traits: DataFrame, issues: DataFrame) -> DataFrame:
    """traits: pipeline, has_tests, has_sla, retries, described, has_aliases. One row a pipeline: each dimension and total."""
    i = issues.withColumn("dim", dimension(F.col("category"))).withColumn("points", cases(F.col("severity"), DEDUCTIONS, 0))
    by = i.groupBy("pipeline").agg(*[F.coalesce(F.sum(F.when(F.col("dim") == d, F.col("points"))), F.lit(0)).alias(f"minus_{d}") for d in DIMENSIONS], F.max((F.col("dim") == "security") & (F.col("severity") == "CRITICAL")).alias("breach"))
    x = traits.join(by, "pipeline", "left")
    floor = {d: F.greatest(F.lit(0), 100 - F.coalesce(f"minus_{d}", F.lit(0))) for d in DIMENSIONS}
    floor["observability"] = floor["observability"] + F.when(F.col("has_tests") | F.col("has_sla"), 10).otherwise(-10)
    floor["reliability"] = floor["reliability"] + F.when(F.coalesce("retries", F.lit(0)) >= 2, 5).otherwise(0)
    floor["maintainability"] = floor["maintainability"] + F.when(F.col("described"), 5).when(~F.col("has_aliases"), -5).otherwise(0)
    held = {d: F.least(F.greatest(v, F.lit(0)), F.lit(100)) for d, v in floor.items()}
    held["security"] = F.when(F.coalesce("breach", F.lit(False)), F.least(held["security"], F.lit(25))).otherwise(held["security"])
    total = sum((held[d] * w for d, w in DIMENSIONS.items()), F.lit(0.0))
    return x.select("pipeline", *[held[d].cast("int").alias(d) for d in DIMENSIONS], F.bround(F.round(total, 9)).cast("int").alias("total"))


def roadmap(issues: DataFrame, most: int = 5) -> DataFrame:
    """The issues whose removal gains most. issues: pipeline, rule, severity, category, ord."""
    gain = cases(F.col("severity"), DEDUCTIONS, 0) * cases(dimension(F.col("category")), DIMENSIONS, 0.0)
    w = Window.partitionBy("pipeline").orderBy(F.desc("gain"), cases(F.col("severity"), {"CRITICAL": 0, "WARNING": 1, "INFO": 2}, 3), "rule", "ord")
    return issues.withColumn("gain", F.round(gain, 1)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("pipeline", "place", "rule", "severity", "gain")


def optimisations(issues: DataFrame, most: int = 5) -> DataFrame:
    """The first rules that have a fix, each once."""
    first = issues.where("fix IS NOT NULL AND fix <> ''").groupBy("pipeline", "rule").agg(F.min(F.struct(cases(F.col("severity"), {"CRITICAL": 0, "WARNING": 1, "INFO": 2}, 3).alias("rank"), "ord", "fix")).alias("x"))
    w = Window.partitionBy("pipeline").orderBy("x.rank", "x.ord", "rule")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("pipeline", "place", "rule", "x.fix")


def kpis(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both: pipeline, score, usd_month, incidents. Gains a month, and savings a year."""
    b, a = (df.select("pipeline", *[F.col(c).alias(f"{c}_{s}") for c in ("score", "usd_month", "incidents")]) for df, s in ((before, "before"), (after, "after")))
    x = b.join(a, "pipeline")
    saved = F.col("usd_month_before") - F.col("usd_month_after")
    return x.select("pipeline", "score_before", "score_after", saved.alias("usd_saved_month"), (saved * 12).alias("usd_saved_year"), F.when(F.col("usd_month_before") > 0, saved / F.col("usd_month_before") * 100).otherwise(F.lit(0.0)).alias("savings_pct"), (F.col("incidents_before") - F.col("incidents_after")).alias("incidents_avoided"))


# ---- tests to write


#: Names that look like dates, measures and small sets of values.
DATE_ENDS, DATE_PARTS = ("at", "ts", "time", "date", "day"), ("date", "timestamp")
AMOUNT_PARTS = ("amount", "price", "cost", "total", "revenue", "balance", "quantity", "qty", "fee", "spend")
ENUM_PARTS = ("status", "type", "state")


def generated_tests(tables: DataFrame, lineage: DataFrame, max_tables: int = 8, max_columns: int = 25) -> DataFrame:
    """pipeline, name, column, test: what would guard the tables, by the columns' names; writers before readers, so many tables
    and columns of each as the feature shows. tables: pipeline, ord, name, access, columns."""
    first = tables.groupBy("pipeline", F.lower("name").alias("key")).agg(F.min_by(F.struct("ord", "name", "access", "columns"), F.struct((F.col("access") == "read").cast("int"), "ord")).alias("x")).select("pipeline", "x.*")
    w = Window.partitionBy("pipeline").orderBy((F.col("access") == "read").cast("int"), "ord")
    t = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_tables)
    t = t.select("pipeline", "name", "columns", F.posexplode(F.slice("columns", 1, max_columns)).alias("pos", "column"))
    low = F.lower("column")
    id_first = F.when(F.exists("columns", lambda c: F.lower(c) == "id"), F.lit("id")).otherwise(F.get(F.filter("columns", lambda c: F.lower(c).endswith("_id")), F.lit(0)))
    key = F.coalesce(low == F.lower(id_first), F.lit(False))
    parents = lineage.where("source_table <> output_table").select("pipeline", F.col("output_table").alias("name"), F.col("output_column").alias("column"), F.lit(True).alias("has_parent")).distinct()
    t = t.join(parents, ["pipeline", "name", "column"], "left")
    amount = N.contains_any(low, AMOUNT_PARTS)
    dated = N.contains_any(low, DATE_PARTS) | (low == "ts") | ((F.size(N.parts(low)) > 1) & N.last_part(low).isin(*DATE_ENDS))
    found = F.array_compact(F.array(
        F.when(key, "unique"), F.when(key | dated | amount, "not_null"), F.when(amount, "between"),
        F.when(N.last_part(low).isin(*ENUM_PARTS), "accepted_values"), F.when(low.endswith("_id") & F.col("has_parent"), "relationships"),
    ))
    return t.select("pipeline", "name", "column", F.explode(found).alias("test"))


def coverage_gaps(tables: DataFrame, issues: DataFrame, traits: DataFrame, most: int = 12) -> DataFrame:
    """What nobody watches: observability issues, a missing deadline, and outputs without a row count check (3 at most)."""
    seen = issues.where("category = 'observability'").select("pipeline", F.lit(0).alias("o"), F.col("rule").alias("gap")).distinct()
    late = traits.where(~F.col("has_sla")).select("pipeline", F.lit(1).alias("o"), F.lit("no deadline").alias("gap"))
    outs = tables.where(F.col("access").isin("write", "readwrite")).withColumn("k", F.row_number().over(Window.partitionBy("pipeline").orderBy("ord"))).where("k <= 3")
    counts = outs.select("pipeline", F.lit(2).alias("o"), F.concat(F.lit("row count of "), F.col("name")).alias("gap"))
    w = Window.partitionBy("pipeline").orderBy("o", "gap")
    return seen.unionByName(late).unionByName(counts).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("pipeline", "place", "gap")


def similar(titles: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of a pipeline's titles whose words overlap by `least`: pipeline, a, b, overlap. They meet by a shared word, not
    all with all."""
    t = titles.select("pipeline", "id", F.array_distinct(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda x: x != "")).alias("words"))
    words = t.select("pipeline", "id", "words", F.explode("words").alias("word"))
    x = words.select("pipeline", "word", F.col("id").alias("a"), F.col("words").alias("aw")).join(words.select("pipeline", "word", F.col("id").alias("b"), F.col("words").alias("bw")), ["pipeline", "word"]).where("a < b")
    x = x.select("pipeline", "a", "b", (F.size(F.array_intersect("aw", "bw")) / F.size(F.array_union("aw", "bw"))).alias("overlap")).distinct()
    return x.where(F.col("overlap") >= least)


def security_risk(flows: DataFrame, secrets: DataFrame, pii: DataFrame, pipelines: DataFrame) -> DataFrame:
    """HIGH with a secret or three unmasked personal columns in an output, MEDIUM with any personal column, else LOW."""
    out = flows.where(~S.masks(F.col("expression"))).join(pii.select("pipeline", F.col("name").alias("source_table"), F.col("column").alias("source_column")), ["pipeline", "source_table", "source_column"], "left_semi")
    n = out.groupBy("pipeline").agg(F.countDistinct("source_table", "source_column").alias("open"))
    s = secrets.groupBy("pipeline").agg(F.count(F.lit(1)).alias("secrets"))
    p = pii.groupBy("pipeline").agg(F.count(F.lit(1)).alias("pii"))
    x = pipelines.select("pipeline").join(n, "pipeline", "left").join(s, "pipeline", "left").join(p, "pipeline", "left").fillna(0)
    return x.select("pipeline", "open", "secrets", "pii", F.when((F.col("secrets") > 0) | (F.col("open") >= 3), "HIGH").when(F.col("pii") > 0, "MEDIUM").otherwise("LOW").alias("risk"))
