"""The 20 rules on orchestration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Tables
from . import a, at, rule, yes

AP, A = "airflow prefect", "airflow"


def listed(df: DataFrame, what: str, limit: int = 8) -> DataFrame:
    """One row a pipeline: its first line and the first names of `what`."""
    x = df.groupBy("pipeline").agg(F.array_sort(F.collect_list(F.struct("ord", "line", "col", F.col("a")[what].alias("name")))).alias("x"))
    return x.select("pipeline", F.col("x")[0]["line"].alias("line"), F.col("x")[0]["col"].alias("col"), F.array_join(F.slice(F.transform("x", lambda v: v["name"]), 1, limit), ", ").alias("names"), F.size("x").alias("n"))


def no_task(t: Tables, flag: str) -> DataFrame:
    """DAGs that lack the flag themselves and on every task."""
    have = t.ops("TASK").where(yes(flag)).select("pipeline").distinct()
    return t.ops("DAG").where(~yes(flag)).join(have, "pipeline", "left_anti")


@rule("NO_RETRIES", "CRITICAL", "reliability", AP, "Tasks are not retried", "Set retries and a retry delay in the defaults.")
def _(t: Tables) -> DataFrame:
    dag = t.ops("DAG").groupBy("pipeline").agg(F.max(a("default_retries").cast("int")).alias("default"))
    tasks = t.ops("TASK").join(dag, "pipeline", "left")
    bare = tasks.where(F.coalesce(a("retries").cast("int"), F.col("default"), F.lit(0)) == 0)
    first = listed(bare, "task_id").select("pipeline", "line", "col", F.format_string("%d task(s) fail for good on the first error: %s", "n", "names").alias("message"))
    alone = t.ops("DAG").where(F.coalesce(a("default_retries").cast("int"), F.lit(0)) == 0).join(t.ops("TASK").select("pipeline").distinct(), "pipeline", "left_anti")
    return first.unionByName(at(alone, "%s sets no retries", a("dag_id")))


@rule("NO_CATCHUP_SET", "CRITICAL", "reliability", A, "catchup is not set", "Set catchup=False, or True on purpose.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(a("catchup").isNull()), "%s may start all missed runs at once when it is switched on", a("dag_id"))


@rule("SEQUENTIAL_HEAVY_TASKS", "CRITICAL", "performance", AP, "Heavy tasks run one after another", "Run those side by side that don't need each other.")
def _(t: Tables) -> DataFrame:
    chains = linear_chains(t.deps.where("type = 'triggers'"))
    heavy = t.ops("TASK").where(yes("is_heavy")).select("pipeline", a("task_id").alias("task"), "ord", "line", "col", "a")
    by = chains.join(heavy, ["pipeline", "task"]).groupBy("pipeline", "chain").agg(F.array_sort(F.collect_list(F.struct("position", "line", "col", "task"))).alias("x")).where(F.size("x") >= 2)
    return by.select("pipeline", F.col("x")[0]["line"].alias("line"), F.col("x")[0]["col"].alias("col"), F.format_string("%d heavy tasks wait for each other: %s", F.size("x"), F.array_join(F.transform("x", lambda v: v["task"]), " > ")).alias("message"))


def linear_chains(edges: DataFrame) -> DataFrame:
    """pipeline, task, chain (its first task), position: maximal runs of tasks that each have one successor, itself with one
    predecessor. Each task walks up its own pipeline's graph, at most as many steps as that has links."""
    e = edges.select("pipeline", "source", "target").distinct()
    single_out = e.groupBy("pipeline", "source").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    single_in = e.groupBy("pipeline", "target").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    links = e.join(single_out, ["pipeline", "source"]).join(single_in, ["pipeline", "target"])
    # a pipeline's graph is small: the walk is one expression over its own edges
    by = links.groupBy("pipeline").agg(F.map_from_entries(F.collect_list(F.struct("target", "source"))).alias("up"))
    tasks = links.select("pipeline", F.explode(F.array("source", "target")).alias("task")).distinct().join(by, "pipeline")
    step = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.struct(F.col("task").alias("at"), F.lit(0).alias("n")), lambda s, _: F.when(F.col("up")[s["at"]].isNotNull(), F.struct(F.col("up")[s["at"]].alias("at"), (s["n"] + 1).alias("n"))).otherwise(s))
    return tasks.select("pipeline", "task", step.alias("s")).select("pipeline", "task", F.col("s.at").alias("chain"), F.col("s.n").alias("position"))


@rule("XCOMS_LARGE_DATA", "CRITICAL", "reliability", A, "Large data goes through the metadata store", "Write it to storage and pass its path.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("XCOM", "XCOM_PUSH", "XCOM_PULL").where(yes("large_data_hint")), "A %s looks like a whole data set", a("kind"))


@rule("NO_SLA", "WARNING", "observability", A, "No deadline is set", "Set an SLA for what others wait for.")
def _(t: Tables) -> DataFrame:
    return at(no_task(t, "has_sla"), "Nobody is told when %s is late", a("dag_id"))


@rule("NO_ON_FAILURE_CALLBACK", "WARNING", "observability", AP, "Failures call nobody", "Set a failure callback.")
def _(t: Tables) -> DataFrame:
    return at(no_task(t, "has_on_failure_callback"), "Nobody is told when %s fails", a("dag_id"))


@rule("SENSOR_POKE_MODE", "WARNING", "performance", A, "A sensor holds its worker", "Use mode='reschedule' or a deferrable sensor.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("SENSOR").where((a("mode") == "poke") & (a("poke_interval").isNull() | (a("poke_interval").cast("double") >= 60))), "%s keeps a worker while it waits", a("task_id"))


@rule("DYNAMIC_DAG_IN_LOOP", "WARNING", "maintainability", AP, "Tasks are made in a loop", "Use dynamic task mapping.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DYNAMIC_DAG"), "A %s loop defines tasks, so the graph changes as its data does", a("construct"))


@rule("MISSING_OWNER", "WARNING", "maintainability", AP, "No owner", "Name the team that answers for it.")
def _(t: Tables) -> DataFrame:
    named = ~F.coalesce(a("owner"), F.lit("")).isin("", "airflow")
    have = t.ops("TASK").where(named).select("pipeline").distinct()
    return at(t.ops("DAG").where(~named).join(have, "pipeline", "left_anti"), "%s has no owner", a("dag_id"))


@rule("NO_POOL_SET", "WARNING", "reliability", A, "A heavy task has no pool", "Give it a pool.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("TASK").where(yes("is_heavy") & a("pool").isNull()), "%s may run as often as there are slots", a("task_id"))


@rule("TASK_GROUP_MISSING", "WARNING", "maintainability", A, "Many tasks without groups", "Put related tasks in groups.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where((a("task_count").cast("int") >= 12) & ~yes("has_task_groups")), "%s tasks stand side by side", a("task_count"))


@rule("NO_DAGRUN_TIMEOUT", "WARNING", "reliability", A, "Runs may last for ever", "Set dagrun_timeout.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(~yes("has_dagrun_timeout")), "A run of %s has no limit", a("dag_id"))


@rule("NO_MAX_ACTIVE_RUNS", "WARNING", "reliability", A, "Runs may overlap", "Set max_active_runs.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(a("max_active_runs").isNull()), "Runs of %s may overlap", a("dag_id"))


@rule("DEPENDS_ON_PAST", "WARNING", "reliability", A, "A failed run stops the later ones", "Drop depends_on_past unless each run needs the last.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(yes("depends_on_past")), "One failed run of %s blocks all after it", a("dag_id"))


@rule("RETRY_DELAY_MISSING", "WARNING", "reliability", AP, "Retries follow at once", "Set a retry delay.")
def _(t: Tables) -> DataFrame:
    d = t.ops("DAG").where((a("default_retries").cast("int") > 0) & ~yes("has_retry_delay"))
    tasks = t.ops("TASK").where((a("retries").cast("int") > 0) & ~yes("has_retry_delay"))
    own = listed(tasks.join(d.select("pipeline"), "pipeline", "left_anti"), "task_id")
    return at(d, "%s retries without a pause", a("dag_id")).unionByName(own.select("pipeline", "line", "col", F.format_string("%d task(s) retry without a pause: %s", "n", "names").alias("message")))


@rule("NO_EXECUTION_TIMEOUT", "WARNING", "reliability", AP, "A heavy task may hang", "Set an execution timeout.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("TASK").where(yes("is_heavy") & ~yes("has_execution_timeout")), "%s has no time limit", a("task_id"))


@rule("NO_DAG_TAGS", "INFO", "maintainability", AP, "No tags", "Add tags.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(F.coalesce(a("tags"), F.lit("[]")) == "[]"), "%s has no tags", a("dag_id"))


@rule("NO_DOC_MD", "INFO", "maintainability", A, "No documentation", "Set doc_md.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(~yes("has_doc_md")), "%s has no documentation", a("dag_id"))


@rule("MANUAL_ONLY_SCHEDULE", "INFO", "observability", AP, "Runs only by hand", "Set a schedule, if it shall run by itself.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DAG").where(F.lower(F.coalesce(a("schedule"), F.lit(""))).isin("", "none", "null")), "%s has no schedule", a("dag_id"))


@rule("SINGLE_TASK_DAG", "INFO", "maintainability", AP, "One task only", "Join it with the pipeline that it serves.")
def _(t: Tables) -> DataFrame:
    counted = t.ops("TASK", "SENSOR").groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    d = t.ops("DAG").join(counted, "pipeline", "left")
    return at(d.where(F.coalesce(F.nullif(a("task_count").cast("int"), F.lit(0)), F.col("n")) == 1), "%s has a single task", a("dag_id"))
