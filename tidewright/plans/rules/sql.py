"""The 35 rules on SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import names as N
from ..ir import Tables
from . import a, at, cap, once, rule, yes

SDF, SD = "sql dbt flink", "sql dbt"
#: Names of partition columns, parts of names of large tables, keywords, and the shape of a date.
PARTITION_NAMES = ["date", "ds", "dt", "event_date", "created_at", "_partitiondate", "_partitiontime", "_table_suffix", "partition_date", "event_dt"]
LARGE_PARTS = ("fact", "facts", "event", "events", "log", "logs", "transaction", "transactions", "history", "click", "clicks", "impression", "impressions", "session", "sessions", "order", "orders", "sale", "sales", "pageview", "pageviews")
DATE = r"^'\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?'$"
KEYWORDS = ("select", "from", "where", "join", "group", "order", "having", "union", "insert", "update", "delete", "distinct", "case", "when", "with")


def under(part: str) -> Column:
    return F.coalesce(a("path").contains(part), F.lit(False))


def in_where() -> Column:
    return a("path").rlike(r"(Select|Statement)\.where(/|$)")


@rule("SELECT_STAR", "CRITICAL", "performance", SDF, "All columns are selected", "Name the columns that are needed.")
def _(t: Tables) -> DataFrame:
    stars = t.nodes("Star").where((a("role") == "projection") & ~yes("except") & ~a("path").rlike(r"Exists\.query/Select\.projection$|Exists\.query$"))
    used = t.nodes("Column").where(a("clause") != "projection").groupBy("pipeline").agg(F.slice(F.array_sort(F.collect_set(a("name"))), 1, 6).alias("used"))
    stars = stars.join(used, "pipeline", "left")
    return at(stars, "%s reads every column, also those that nothing uses", F.coalesce(F.col("a")["text"], F.lit("*")), fix=F.concat(F.lit("Name the columns that are needed, for instance: "), F.coalesce(F.array_join("used", ", "), F.lit("..."))))


@rule("CARTESIAN_JOIN", "CRITICAL", "performance", SDF, "A join has no condition", "Write the join with ON or USING.")
def _(t: Tables) -> DataFrame:
    j = t.nodes("Join").where(~yes("has_on_clause") & a("using").isNull() & ~a("kind").isin("NATURAL", "ASOF", "SEMI", "ANTI", "LATERAL") & ~a("right_kind").isin("Other"))
    return at(j, "%s and %s are joined without a condition; every row meets every row", a("left"), a("right"))


@rule("UNBOUNDED_FULL_SCAN", "CRITICAL", "performance", SD, "A table is read without any bound", "Add a filter or a limit, best on the partition column.")
def _(t: Tables) -> DataFrame:
    s = t.nodes("Statement").where(a("name").isin("select", "insert", "create") & (a("reads").cast("int") > 0) & ~yes("any_where") & ~yes("any_limit") & (F.coalesce(a("object"), F.lit("")) != "view") & a("query_kind").isin("Select", "SetOp"))
    return at(s, "The statement reads %s table(s) with no WHERE and no LIMIT", a("reads"))


@rule("IMPLICIT_CAST_IN_JOIN", "CRITICAL", "performance", SDF, "A join key is converted", "Give both keys one type where they are stored.")
def _(t: Tables) -> DataFrame:
    c = t.nodes("Compare").where((a("name") == "=") & a("path").rlike(r"Join\.on(/|$)") & ~under("Subquery."))
    wraps = lambda s, o: a(f"{s}.kind").isin("Cast", "Function") & (a(f"{s}.has_column") == "true")
    number = lambda s, o: (a(f"{s}.kind") == "Column") & (a(f"{o}.string") == "true") & a(f"{o}.text").rlike(r"^'-?\d+(\.\d+)?'$")
    return at(c.where(wraps("left", "right") | wraps("right", "left") | number("left", "right") | number("right", "left")), "The join condition %s converts a key", a("text"))


@rule("NESTED_LOOP_RISK", "CRITICAL", "performance", SD, "A subquery stands in the select list", "Aggregate once and join the result.")
def _(t: Tables) -> DataFrame:
    s = t.nodes("Subquery").where(a("path").rlike(r"Select\.projection(/(?!.*Select\.)|$)") & ~under("Exists.") & ~a("path").rlike(r"In\.(query|item)"))
    return at(s, "A subquery in the select list may run once for each row")


@rule("DELETE_WITHOUT_WHERE", "CRITICAL", "reliability", "sql", "All rows are deleted", "Add a WHERE, or use TRUNCATE if all rows shall go.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("DELETE").where(~yes("has_where")), "DELETE on %s has no WHERE", a("target"))


@rule("UPDATE_WITHOUT_WHERE", "CRITICAL", "reliability", "sql", "All rows are updated", "Add a WHERE.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("UPDATE").where(~yes("has_where")), "UPDATE on %s has no WHERE", a("target"))


@rule("CORRELATED_SUBQUERY", "WARNING", "performance", SD, "A subquery depends on the outer row", "Turn it into a join with an aggregate.")
def _(t: Tables) -> DataFrame:
    s = t.nodes("Subquery").where(yes("correlated") & a("clause").isin("where", "having") & ~under("Exists."))
    return at(s, "A subquery in %s refers to the outer query", F.upper(a("clause")))


@rule("OR_IN_WHERE_DEFEATS_INDEX", "WARNING", "performance", SDF, "OR in a filter", "Use IN for one column, else UNION ALL of two filters.")
def _(t: Tables) -> DataFrame:
    o = t.nodes("Or").where(in_where() & ~a("path").contains("Or.")).withColumn("block", a("block"))
    o = once(o, "block")
    same = F.coalesce(F.nullif(a("same_column"), F.lit("")), F.lit(None).cast("string"))
    return at(o, "The filter joins conditions by OR", fix=F.when(same.isNotNull(), F.concat(F.lit("Write "), same, F.lit(" IN (...)"))).otherwise(F.lit("Split the filter with UNION ALL.")))


@rule("LEADING_WILDCARD_LIKE", "WARNING", "performance", SDF, "A pattern begins with a wildcard", "Search by prefix, or keep a search index.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Like").where((a("right.string") == "true") & a("right.text").rlike(r"^'[%_]")), "The pattern %s can't use the order of values", a("right.text"))


@rule("UNOPTIMIZED_CTE_REUSE", "WARNING", "performance", SD, "A common table expression is used often", "Store its result in a table first.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Cte").where(a("references").cast("int") >= 3), "%s is referenced %s times and may be computed each time", a("name"), a("references"))


@rule("MISSING_PARTITION_FILTER", "WARNING", "cost", SD, "No filter on a partition column", "Filter by the partition column too.")
def _(t: Tables) -> DataFrame:
    p = t.pipelines.where(F.col("dialect").isin("snowflake", "bigquery")).select("pipeline", F.split(F.coalesce(F.col("facts")["partition_by"], F.lit("")), ",").alias("own"))
    s = t.nodes("Statement").where(yes("any_where") & (a("reads").cast("int") > 0) & a("name").isin("select", "insert", "create")).withColumn("stmt", a("stmt")).join(p, "pipeline")
    used = t.nodes("Column").where(in_where()).select("pipeline", a("stmt").alias("stmt"), F.lower(a("name")).alias("name")).groupBy("pipeline", "stmt").agg(F.collect_set("name").alias("used"))
    s = s.join(used, ["pipeline", "stmt"], "left")
    names = F.array_union(F.array(*map(F.lit, PARTITION_NAMES)), F.transform("own", F.lower))
    return at(s.where(~F.coalesce(F.arrays_overlap("used", names), F.lit(False))), "The filter names no partition column, so all partitions are read")


@rule("EXPLODING_JOIN", "WARNING", "performance", SDF, "A join may multiply rows", "Join on equal keys, and aggregate before joining a table twice.")
def _(t: Tables) -> DataFrame:
    j = t.nodes("Join").where(yes("has_on_clause") & ~yes("on_has_equality"))
    first = at(j, "The condition of the join with %s has no equality", a("right"))
    free = t.nodes("Select").where(~yes("has_group") & ~yes("has_agg") & ~yes("distinct")).select("pipeline", a("stmt").alias("stmt"), a("id").alias("block"))
    x = t.nodes("Join").where(yes("has_on_clause") & (a("right_bare") != "")).select("pipeline", "ord", "line", "col", "a", a("stmt").alias("stmt"), a("block").alias("block"), a("right_bare").alias("bare"), a("condition_folded").alias("cond"))
    heads = t.nodes("Table").where(a("role") == "from").select("pipeline", a("stmt").alias("stmt"), a("parent").alias("block"), F.lower(a("bare")).alias("bare"), F.lit("").alias("cond"), F.col("ord"), F.col("line"), F.col("col"), F.col("a"))
    both = x.unionByName(heads).join(free, ["pipeline", "stmt", "block"]).groupBy("pipeline", "stmt", "block", "bare").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cond").alias("conditions"), F.max(F.struct("ord", "line", "col")).alias("x"))
    twice = both.where("n >= 2 AND conditions >= 2").select("pipeline", "x.line", "x.col", F.format_string("%s is joined %d times without aggregation", "bare", "n").alias("message"))
    return first.unionByName(twice)


@rule("WINDOW_FUNCTION_ON_FULL_TABLE", "WARNING", "performance", SDF, "A window spans all rows", "Add PARTITION BY.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("WINDOW").where(yes("over_full_table")), "%s() OVER has no PARTITION BY, so one task sorts all rows", a("function"))


@rule("REDUNDANT_DISTINCT", "WARNING", "performance", SD, "DISTINCT changes nothing", "Leave DISTINCT out.")
def _(t: Tables) -> DataFrame:
    d = t.nodes("Select").where(yes("distinct"))
    inside = a("path").rlike(r"(Exists\.query|In\.query/Subquery\.query)$")
    return at(d.where(yes("has_group") | inside), F.when(yes("has_group"), F.lit("DISTINCT after GROUP BY removes nothing")).otherwise(F.lit("DISTINCT inside IN or EXISTS removes nothing that counts")))


@rule("ANTI_PATTERN_NOT_IN_NULL", "WARNING", "reliability", SD, "NOT IN with a subquery that may give NULL", "Use NOT EXISTS, or filter the NULLs out inside.")
def _(t: Tables) -> DataFrame:
    n = t.nodes("In").where(yes("has_query") & (yes("negated") | a("path").rlike(r"Not\.value(/Paren\.value)?$")))
    q = t.nodes("Compare").where((a("name") == "<>") & (a("quantifier") == "ALL") & yes("has_query"))
    return at(n.unionByName(q).where(~yes("guarded")), "One NULL from the subquery makes NOT IN keep no row")


@rule("FUNCTION_ON_FILTER_COLUMN", "WARNING", "performance", SDF, "A filtered column is wrapped", "Compare the bare column with a range.")
def _(t: Tables) -> DataFrame:
    c = t.nodes("Compare").where(in_where())
    wrapped = lambda s, o: a(f"{s}.kind").isin("Function", "Cast") & (a(f"{s}.has_column") == "true") & (a(f"{o}.has_column") != "true")
    day = F.upper(a("left.name")).isin("DATE", "TO_DATE", "CAST") & (a("name") == "=") & (a("right.string") == "true")
    text = F.concat(F.lit("Write "), a("left.column"), F.lit(" >= DATE "), a("right.text"), F.lit(" AND "), a("left.column"), F.lit(" < DATE "), a("right.text"), F.lit(" + INTERVAL '1' DAY"))
    return at(c.where(wrapped("left", "right") | wrapped("right", "left")), "%s hides the column from pruning", a("text"), fix=F.when(day, text).otherwise(F.lit("Compare the bare column with a range.")))


@rule("UNION_INSTEAD_OF_UNION_ALL", "WARNING", "performance", SDF, "UNION removes duplicates", "Use UNION ALL where the parts can't overlap.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("UNION").where(a("all") == "false"), "UNION sorts or hashes all rows to drop duplicates")


@rule("MISSING_INDEX_HINT", "WARNING", "performance", SD, "A large table is looked up without an index", "Create an index, or a sort or distribution key.")
def _(t: Tables) -> DataFrame:
    p = t.pipelines.where(F.col("dialect").isin("postgres", "redshift") & ~F.lower("source").rlike("index|sortkey|distkey")).select("pipeline")
    s = t.nodes("Statement").where(yes("any_join")).select("pipeline", a("stmt").alias("stmt")).join(p, "pipeline")
    tables = t.nodes("Table").select("pipeline", a("stmt").alias("stmt"), F.lower(F.coalesce(a("alias"), a("bare"))).alias("q"), a("bare").alias("bare")).where(N.has_part(F.col("bare"), LARGE_PARTS)).distinct()
    c = t.nodes("Compare").where((a("name") == "=") & in_where()).withColumn("stmt", a("stmt"))
    q = F.lower(F.when((a("left.kind") == "Column") & (a("right.kind") == "Literal"), a("left.qualifier")).when((a("right.kind") == "Column") & (a("left.kind") == "Literal"), a("right.qualifier")))
    hit = once(c.withColumn("q", q).join(s, ["pipeline", "stmt"]).join(tables, ["pipeline", "stmt", "q"]).drop("q", "bare"), "stmt")
    return at(hit, "%s looks a value up in a large table", a("text"))


@rule("ORDER_BY_WITHOUT_LIMIT", "WARNING", "performance", SD, "The whole result is sorted", "Add a LIMIT, or leave the order to who reads it.")
def _(t: Tables) -> DataFrame:
    s = t.nodes("Select", "SetOp").where((a("path") == "Statement.query") & yes("has_order") & ~yes("has_limit"))
    stmts = t.nodes("Statement").where(a("name") == "select").select("pipeline", a("stmt").alias("stmt"))
    return at(s.withColumn("stmt", a("stmt")).join(stmts, ["pipeline", "stmt"]), "The result is sorted in full without a LIMIT")


@rule("IMPLICIT_COLUMN_INSERT", "WARNING", "reliability", "sql flink", "INSERT names no columns", "List the target's columns.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("INSERT").where(a("columns") == "[]"), "INSERT into %s depends on the order of its columns", a("target"))


@rule("CROSS_DATABASE_JOIN", "WARNING", "performance", SD, "Catalogs are joined", "Bring the data into one catalog first.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Statement").where(F.size(F.split(a("catalogs"), ",")) >= 2), "The statement reads from the catalogs %s", a("catalogs"))


@rule("SCALAR_UDF_IN_PREDICATE", "WARNING", "performance", SD, "A filter calls an unknown function", "Use built-in functions, or compute the value once.")
def _(t: Tables) -> DataFrame:
    f = t.nodes("Function").where((a("known") == "false") & in_where()).withColumn("stmt", a("stmt")).withColumn("name", a("name"))
    f = once(f, "stmt", "name")
    w = Window.partitionBy("pipeline", "stmt").orderBy("ord")
    return at(f.withColumn("n", F.row_number().over(w)).where("n <= 3"), "%s() is evaluated for every row of the filter", "name")


@rule("DUPLICATE_JOIN_TABLE", "WARNING", "performance", SD, "A table is joined twice the same way", "Join it once.")
def _(t: Tables) -> DataFrame:
    j = t.nodes("Join").where((a("right_kind") == "Table") & (a("condition_folded") != "")).withColumn("stmt", a("stmt"))
    w = Window.partitionBy("pipeline", "stmt", a("block"), F.lower(a("right_name")), a("condition_folded")).orderBy("ord")
    return at(j.withColumn("n", F.row_number().over(w)).where("n = 2"), "%s is joined again on the same condition", a("right_name"))


@rule("DISTINCT_STAR", "WARNING", "performance", SD, "DISTINCT over all columns", "Name the columns, or find what makes the duplicates.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Select").where(yes("distinct") & yes("only_star")), "SELECT DISTINCT * compares every column of every row")


@rule("HAVING_WITHOUT_AGGREGATE", "WARNING", "performance", SDF, "HAVING could be WHERE", "Move the condition to WHERE.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Having").where(~yes("has_agg")), "HAVING holds no aggregate, so rows are grouped first for nothing")


@rule("NULL_COMPARISON", "WARNING", "reliability", SDF, "A comparison with NULL", "Use IS NULL or IS NOT NULL.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Compare").where(a("name").isin("=", "<>") & ((a("left.kind") == "Null") | (a("right.kind") == "Null"))), "%s is never true", a("text"))


@rule("MISSING_COLUMN_ALIAS", "INFO", "maintainability", SDF, "A computed column has no name", "Add AS and a name.")
def _(t: Tables) -> DataFrame:
    n = t.nodes("Function", "Binary", "Case", "Cast", "Paren", "Window").where((a("role") == "projection") & a("alias").isNull() & ~under("Exists."))
    return at(cap(n, 5), "%s has no alias", a("text"))


@rule("HARDCODED_DATE", "INFO", "maintainability", SDF, "A date is written into the query", "Pass the date as a parameter.")
def _(t: Tables) -> DataFrame:
    d = t.nodes("Literal").where(a("text").rlike(DATE) | (a("name").rlike(DATE))).where(a("path").rlike(r"\.(where|on|having|qualify)(/|$)")).withColumn("value", a("name"))
    return at(cap(once(d, "value"), 5), "The date %s is fixed in the text", "value")


@rule("INCONSISTENT_CASE_CONVENTION", "INFO", "maintainability", SDF, "Keywords in both cases", "Choose one case for keywords.")
def _(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("source", r"/\*(?s:.*?)\*/", ""), r"--[^\n]*", "")
    lines = t.pipelines.where(F.col("format").isin("sql", "dbt", "flink")).select("pipeline", F.posexplode(F.split(F.regexp_replace(bare, r"'[^'\n]*'", "''"), "\n")).alias("pos", "content"))
    words = lines.select("pipeline", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(r"(\w+)"), F.lit(1))).alias("w")).where(F.lower("w").isin(*KEYWORDS))
    words = words.withColumn("case", F.when(F.col("w") == F.upper("w"), "upper").when(F.col("w") == F.lower("w"), "lower")).where("case IS NOT NULL")
    by = words.groupBy("pipeline").agg(F.count_if(F.col("case") == "upper").alias("u"), F.count_if(F.col("case") == "lower").alias("l"), F.min(F.when(F.col("case") == "upper", F.col("line"))).alias("ul"), F.min(F.when(F.col("case") == "lower", F.col("line"))).alias("ll")).where("u >= 2 AND l >= 2")
    return by.select("pipeline", F.when(F.col("u") < F.col("l"), F.col("ul")).otherwise(F.col("ll")).cast("int").alias("line"), F.lit(0).alias("col"), F.format_string("%d keywords in capitals, %d in small letters", "u", "l").alias("message"))


@rule("GROUP_BY_ORDINAL", "INFO", "maintainability", SD, "GROUP BY counts columns", "Name the columns.")
def _(t: Tables) -> DataFrame:
    g = t.nodes("Literal").where((a("role") == "group") & a("text").rlike(r"^\d+$")).withColumn("stmt", a("stmt")).withColumn("block", a("block")).withColumn("k", a("text").cast("int"))
    p = t.nodes().where(a("role") == "projection").select("pipeline", a("stmt").alias("stmt"), a("block").alias("block"), F.col("ord").alias("p_ord"), F.coalesce(a("alias"), a("text")).alias("shown"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("pipeline", "stmt", "block").orderBy("p_ord"))).drop("p_ord")
    return at(g.join(p, ["pipeline", "stmt", "block", "k"], "left"), "GROUP BY %s stands for %s", a("text"), F.coalesce("shown", F.lit("no column")))


@rule("CASE_WITHOUT_ELSE", "INFO", "reliability", SDF, "CASE has no ELSE", "Say what applies otherwise.")
def _(t: Tables) -> DataFrame:
    return at(cap(t.nodes("Case").where(~yes("has_else")), 5), "CASE without ELSE gives NULL for the rest")


@rule("UNUSED_CTE", "INFO", "maintainability", SD, "A common table expression is never used", "Remove it.")
def _(t: Tables) -> DataFrame:
    return at(t.nodes("Cte").where(a("references") == "0"), "%s is never referenced", a("name"))


@rule("ORDER_BY_IN_SUBQUERY", "INFO", "performance", SD, "An inner query is sorted", "Sort the outer query only.")
def _(t: Tables) -> DataFrame:
    s = t.nodes("Select", "SetOp").where(a("path").rlike(r"(Subquery|Cte|Derived|Exists)\.query$") & yes("has_order") & ~yes("has_limit"))
    return at(s, "The order of an inner query is not kept")


@rule("LIKE_WITHOUT_WILDCARD", "INFO", "performance", SDF, "LIKE without a wildcard", "Use =.")
def _(t: Tables) -> DataFrame:
    n = t.nodes("Like").where((a("right.string") == "true") & (F.length(a("right.text")) > 2) & ~a("right.text").rlike(r"[%_\\]") & a("name").isin("LIKE", "ILIKE"))
    return at(cap(n, 5), "The pattern %s is a plain value", a("right.text"))
