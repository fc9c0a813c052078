"""URL filters as a temporal list join.

A list entry is (scope, pattern, action, listed_on). Scopes: `domain` (a host and all below it) and `path` (a host and the
first segment of the path). An entry holds from its date until the next entry of the same key, so the entries of a key
become validity intervals; action `drop` ends an entry without a new one. A capture is judged by the entries active when it
was fetched: its keys (every parent domain of two labels or more, and its host with the first path segment) meet the
intervals by key and time, and the most specific key decides (path before domain, longer before shorter).

Scale: an equi-join on the key with a time bound, after which one combining aggregation per capture is left. The list side
is broadcast only if Spark's own size check allows it; a host with a third of all captures is then no skew, and else the
skewed join is split.

Defined cases: a null or hostless URL and a null fetch date match no entry (verdict none); entries without a date or a
pattern are ignored; entries of one key and date: `block` before `allow` before `drop`; repeated captures are judged each;
empty captures give no rows, an empty list gives verdict none; other columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A small dated list for the registered query.
ENTRIES = [
    ("domain", "casino-win.example.com", "block", "2024-02-01"),
    ("domain", "casino-win.example.com", "drop", "2024-05-01"),
    ("domain", "casino-win.example.com", "block", "2024-08-15"),
    ("domain", "free-bets.example.com", "block", "2024-01-15"),
    ("domain", "cheap-pills.example.com", "block", "2023-06-01"),
    ("path", "www.cheap-pills.example.com/de", "allow", "2024-03-01"),
    ("domain", "example.net", "block", "2024-10-01"),
    ("domain", "example.net", "allow", "2024-11-01"),
    ("domain", "m.ththth.example.net", "block", "2024-04-10"),
    ("path", "blog.tionsh.example.com/fr", "block", "2024-06-01"),
    ("path", "blog.tionsh.example.com/fr", "drop", "2024-09-01"),
    ("domain", "tionsh.example.com", "allow", "2024-02-20"),
]
FETCH_START = "2024-01-01"


def entries(spark: SparkSession, rows: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    df = spark.createDataFrame(ENTRIES if rows is None else rows, "scope string, pattern string, action string, listed_on string")
    return df.withColumn("listed_on", F.to_date("listed_on"))


def intervals(listed: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (null: still valid) of the entries that say block or allow."""
    key = F.concat(F.when(F.col("scope") == "path", F.lit("p:")).otherwise(F.lit("d:")), F.lower("pattern"))
    order = F.array_position(F.array(F.lit("block"), F.lit("allow"), F.lit("drop")), F.col("action"))
    one = listed.where("pattern IS NOT NULL AND listed_on IS NOT NULL AND action IN ('block', 'allow', 'drop')").select(key.alias("key"), "listed_on", "action", order.alias("o"))
    one = one.groupBy("key", "listed_on").agg(F.min(F.struct("o", "action")).alias("x")).select("key", "listed_on", "x.action")
    then = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    return one.withColumn("valid_to", then).where("action <> 'drop'").select("key", "action", F.col("listed_on").alias("valid_from"), "valid_to")


def keys_of(url: Column) -> tuple[Column, Column]:
    """The host, and all keys that a list may hold for the URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), "."))))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    path = F.when(first != "", F.array(F.concat(F.lit("p:"), host, F.lit("/"), F.lower(first))))
    none = F.array().cast("array<string>")
    return host, F.when(host != "", F.concat(F.coalesce(domains, none), F.coalesce(path, none))).otherwise(none)


def judge(captures: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """capture (id), host, fetched_on, verdict (block, allow or none), rule_key and valid_from of every capture."""
    host, keys = keys_of(F.col("url"))
    base = captures.select(captures[id_col].alias("capture"), captures[url_col].alias("url"), captures[time_col].alias("fetched_on"))
    base = base.select("capture", "fetched_on", "url", F.coalesce(host, F.lit("")).alias("host"))
    seen = base.where("url IS NOT NULL AND fetched_on IS NOT NULL").select("url", "fetched_on", F.explode(keys).alias("key"))
    held = seen.join(intervals(listed), "key").where((F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    rank = F.struct((F.col("key").startswith("p:")).alias("is_path"), F.length("key").alias("long"), "key", "action", "valid_from")
    best = held.groupBy("url", "fetched_on").agg(F.max(rank).alias("x")).select("url", "fetched_on", "x.key", "x.action", "x.valid_from")
    out = base.join(best, ["url", "fetched_on"], "left")
    return out.select("capture", "host", "fetched_on", F.coalesce("action", F.lit("none")).alias("verdict"), F.col("key").alias("rule_key"), "valid_from")


ORACLE = f"""
WITH listed(scope, pattern, action, listed_on) AS (VALUES {", ".join(f"('{s}', '{p}', '{a}', DATE '{d}')" for s, p, a, d in ENTRIES)}),
spans AS (SELECT CASE scope WHEN 'path' THEN 'p:' ELSE 'd:' END || pattern AS key, action, listed_on AS valid_from,
                 lead(listed_on) OVER (PARTITION BY scope, pattern ORDER BY listed_on) AS valid_to FROM listed),
caps AS (SELECT page_id AS capture, url, DATE '{FETCH_START}' + CAST(page_id * 7 % 366 AS INTEGER) AS fetched_on,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)) AS host,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+/([^/?#]+)', 1)) AS seg FROM pages),
keys AS (SELECT capture, fetched_on, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS key
         FROM caps, unnest(range(1, len(string_split(host, '.')))) AS t(i)
         UNION ALL SELECT capture, fetched_on, 'p:' || host || '/' || seg FROM caps WHERE seg <> ''),
held AS (SELECT k.capture, s.key, s.action, s.valid_from,
                row_number() OVER (PARTITION BY k.capture ORDER BY s.key LIKE 'p:%' DESC, length(s.key) DESC) AS r
         FROM keys k JOIN spans s ON k.key = s.key AND s.action <> 'drop' AND s.valid_from <= k.fetched_on AND (s.valid_to IS NULL OR k.fetched_on < s.valid_to))
SELECT c.capture, c.host, c.fetched_on, coalesce(h.action, 'none') AS verdict, h.key AS rule_key, h.valid_from
FROM caps c LEFT JOIN held h ON h.capture = c.capture AND h.r = 1"""
