"""The 10 rules on security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ...functions import security as S
from ..ir import Tables
from . import a, at, rule, yes

#: Words of credentials (without marks between their parts), calls that fetch a secret safely, last parts of names
#: that only describe one, values that are none, schemes of URLs with a user, and marks of places that anyone may read.
WORDS = ("password", "passwd", "pwd", "secret", "apikey", "accesskey", "token", "privatekey", "credential")
SAFE_CALLS = ("os.environ", "getenv", "dbutils.secrets", "secretsmanager", "secrets_manager", "variable.get", "envvar", "env(")
DESCRIBING = ("type", "name", "file", "path", "url", "uri", "id", "prefix", "suffix", "env", "var", "alias", "label", "kind")
NO_SECRET = ["", "none", "null", "true", "false", "changeme", "change_me", "example", "redacted", "placeholder", "dummy", "test", "sample", "your_password_here"]
USER_SCHEMES = ("postgres", "postgresql", "snowflake", "mysql", "mssql", "mariadb", "mongodb", "mongodb+srv", "redis", "amqp", "amqps", "ftp")
BUCKET_SCHEMES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "abfs", "abfss")
PUBLIC_WORDS = ("public", "opendata", "open-data", "world", "anonymous", "everyone")
PUBLIC_RIGHTS = ("public-read", "allusers", "allauthenticatedusers")
#: A name, what ties it to a value, and the quoted value.
TIED = r"([\"']?)([\w.\-]+)[\"']?\s*([:=,])\s*[\"']([^\"'\n]{3,})[\"']"
AWS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"


def urls(content: Column) -> Column:
    """scheme and rest of what looks like a URL."""
    found = F.filter(F.split(content, r"[\s\"'(),;]+"), lambda w: w.contains("://"))
    return F.transform(found, lambda w: F.struct(F.regexp_extract(F.lower(F.substring_index(w, "://", 1)), r"([a-z0-9+.]*)$", 1).alias("scheme"), F.substring_index(w, "://", -1).alias("rest")))


def pii_columns(t: Tables) -> DataFrame:
    """pipeline, name (of the table, '' for an output), column, pii_type, confidence: once for a table and column."""
    declared = t.tables.select("pipeline", "name", F.explode("columns").alias("column"))
    flows = t.lineage.select("pipeline", F.col("source_table").alias("name"), F.col("source_column").alias("column"))
    x = declared.unionByName(flows).distinct().withColumn("pii_type", S.pii_type(F.col("column"))).where("pii_type IS NOT NULL")
    return x.withColumn("confidence", S.pii_confidence(F.col("pii_type")))


def masked_flow() -> Column:
    return S.masks(F.col("expression")) | S.masks(F.col("output_column")) | S.is_protected(F.col("output_column"))


def secrets(t: Tables) -> DataFrame:
    """pipeline, line, what: a secret in the text; the value isn't kept."""
    lines = t.lines.where(~N.contains_any(F.lower("content"), SAFE_CALLS))
    groups = [F.regexp_extract_all("content", F.lit(TIED), F.lit(k)) for k in (1, 2, 3, 4)]
    tied = lines.where(F.col("content").rlike(TIED)).select("pipeline", "line", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("quote", "name", "tie", "value"), strict=True)])).alias("x")).select("pipeline", "line", "x.*")
    templated = N.contains_any(F.col("value"), ("{{", "${", "%(", "***")) | F.col("value").startswith("$") | (F.col("value").startswith("<") & F.col("value").endswith(">"))
    option = (F.col("tie") != ",") | (F.col("quote") != "")
    named = tied.where(option & N.contains_any(N.squeezed(F.col("name"), "_-"), WORDS) & ~N.last_part(F.col("name")).isin(*DESCRIBING) & ~F.lower("value").isin(*NO_SECRET) & ~templated)
    with_user = F.exists(urls(F.col("content")), lambda u: u["scheme"].isin(*USER_SCHEMES) & F.substring_index(F.substring_index(u["rest"], "@", 1), "/", 1).contains(":") & u["rest"].contains("@"))
    out = named.select("pipeline", "line", F.col("name").alias("what"))
    out = out.unionByName(lines.where(with_user).select("pipeline", "line", F.lit("a URL with a password").alias("what")))
    return out.unionByName(lines.where(F.col("content").rlike(AWS_KEY)).select("pipeline", "line", F.lit("an access key id").alias("what"))).distinct()


def plaintext(t: Tables, kinds: list[str]) -> DataFrame:
    """Columns of the kinds that reach an output unmasked, or that have no recorded flow."""
    p = pii_columns(t).where(F.col("pii_type").isin(*kinds) & (F.col("confidence") >= 0.9))
    flows = t.lineage.select("pipeline", F.col("source_table").alias("name"), F.col("source_column").alias("column"), masked_flow().alias("masked"), "line").groupBy("pipeline", "name", "column").agg(F.min("masked").alias("all_masked"), F.min("line").alias("line"))
    return p.join(flows, ["pipeline", "name", "column"], "left").where(~F.coalesce("all_masked", F.lit(False))).select("pipeline", "name", "column", "pii_type", F.coalesce("line", F.lit(0)).alias("line"), F.lit(0).alias("col"))


@rule("HARDCODED_CREDENTIALS", "CRITICAL", "security", "all", "A secret in the text", "Read it from a secret store, and change it.")
def _(t: Tables) -> DataFrame:
    return at(secrets(t).withColumn("col", F.lit(0)), "%s stands in the text", "what")


@rule("SSN_PLAINTEXT", "CRITICAL", "security", "all", "An identity number in plain text", "Hash or tokenise it.")
def _(t: Tables) -> DataFrame:
    return at(plaintext(t, ["ssn", "passport", "tax_id"]), "%s.%s is used as it is", "name", "column")


@rule("CREDIT_CARD_PLAINTEXT", "CRITICAL", "security", "all", "A payment number in plain text", "Tokenise it.")
def _(t: Tables) -> DataFrame:
    return at(plaintext(t, ["credit_card", "cvv", "iban"]), "%s.%s is used as it is", "name", "column")


@rule("PII_IN_SELECT_STAR", "WARNING", "security", "all", "All columns, personal ones too", "Name the columns.")
def _(t: Tables) -> DataFrame:
    stars = t.ops("SELECT").where(yes("has_star")).select("pipeline", "ord", "line", "col", F.explode(F.from_json(a("star_tables"), "array<string>")).alias("name"))
    p = pii_columns(t).groupBy("pipeline", "name").agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns"))
    hit = stars.join(p, ["pipeline", "name"]).groupBy("pipeline", "line", "col").agg(F.array_join(F.array_sort(F.collect_set("columns")), ", ").alias("columns"))
    return at(hit, "The star also takes %s", "columns")


@rule("UNMASKED_PII_TO_OUTPUT", "WARNING", "security", "all", "Personal data reaches an output", "Mask or hash it.")
def _(t: Tables) -> DataFrame:
    f = t.lineage.where("transformation = 'direct'").where(~masked_flow()).join(pii_columns(t).select("pipeline", F.col("name").alias("source_table"), F.col("column").alias("source_column"), "pii_type"), ["pipeline", "source_table", "source_column"])
    return at(f.withColumn("col", F.lit(0)), "%s.%s goes to %s unchanged", "source_table", "source_column", "output_table")


@rule("PII_IN_JOIN_KEY", "WARNING", "security", "all", "Personal data joins tables", "Join on a surrogate key.")
def _(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", a("condition_sql"), a("condition"), a("using"))
    k = t.ops("JOIN").select("pipeline", "line", "col", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("key"))
    k = k.withColumn("pii_type", S.pii_type(F.col("key"))).where(S.pii_confidence(F.col("pii_type")) >= 0.8)
    return at(k, "The join uses %s", "key")


@rule("PUBLIC_CLOUD_PATH", "WARNING", "security", "all", "A public place", "Use a private bucket.")
def _(t: Tables) -> DataFrame:
    place = F.exists(urls(F.col("content")), lambda u: u["scheme"].isin(*BUCKET_SCHEMES) & N.contains_any(F.lower(u["rest"]), PUBLIC_WORDS))
    right = N.contains_any(F.lower("content"), PUBLIC_RIGHTS) | N.contains_any(N.squeezed(F.col("content"), " \t\"'"), ("acl=public", "acl:public"))
    return at(t.lines.where(place | right).withColumn("col", F.lit(0)), "The line names a place that anyone may read")


@rule("GRANT_BROAD_ACCESS", "WARNING", "security", "all", "Broad rights", "Grant single rights to single roles.")
def _(t: Tables) -> DataFrame:
    said = t.pipelines.select("pipeline", "source", F.posexplode(F.split("source", ";")).alias("k", "statement")).where(N.has_word(F.col("statement"), ["grant"]))
    broad = N.has_phrase(F.col("statement"), ["grant all"]) | N.has_phrase(F.col("statement"), ["to public", "to group public", "to role public"])
    until = F.concat(F.array_join(F.slice(F.split("source", ";"), 1, F.col("k")), ";"), F.regexp_extract("statement", r"(?is)^(.*?)\bgrant\b", 1))
    return at(said.where(broad).select("pipeline", F.size(F.split(until, "\n")).alias("line"), F.lit(0).alias("col")).distinct(), "The grant reaches too far")


@rule("PII_COLUMN_NAMED", "INFO", "security", "all", "Columns with personal data", "Keep a list of them, and who may read them.")
def _(t: Tables) -> DataFrame:
    x = pii_columns(t).groupBy("pipeline").agg(F.array_sort(F.collect_set(F.concat_ws(".", "name", "column"))).alias("x"))
    return x.select("pipeline", F.lit(0).alias("line"), F.lit(0).alias("col"), F.format_string("%d column(s) look personal: %s", F.size("x"), F.array_join(F.slice("x", 1, 8), ", ")).alias("message"))


@rule("MISSING_MASKING_HINT", "INFO", "security", "all", "Outputs with personal names", "Mask them, or show in the name that they are masked.")
def _(t: Tables) -> DataFrame:
    outs = t.lineage.where("transformation <> 'direct'").where(~masked_flow()).select("pipeline", F.col("output_table").alias("name"), F.col("output_column").alias("column"))
    copied = t.lineage.where("transformation = 'direct'").select("pipeline", F.col("output_table").alias("name"), F.col("output_column").alias("column"))
    written = t.tables.where(F.col("access").isin("write", "readwrite")).select("pipeline", "name", F.explode("columns").alias("column"))
    x = outs.unionByName(written).distinct().where(S.pii_type(F.col("column")).isNotNull()).join(copied, ["pipeline", "name", "column"], "left_anti")
    x = x.groupBy("pipeline", "name").agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns"))
    return at(x.withColumns({"line": F.lit(0), "col": F.lit(0)}), "%s shows %s", "name", "columns")
