"""PII names, secrets, masking and access patterns, as column expressions and small table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names as N

#: PII types in order of precedence, with confidence and the names (as snake_case token runs).
PII_TYPES = [
    ("ssn", 0.9, "ssn|social_security(_number|_num|_no)?"),
    ("passport", 0.9, "passport(_number|_num|_no)?"),
    ("credit_card", 0.9, "credit_card|card_number|card_num|card_no|cc_number|cc_num"),
    ("cvv", 0.9, "cvv2?|cvc"),
    ("iban", 0.9, "iban"),
    ("tax_id", 0.9, "tax_id|taxid|tax_identifier|national_id"),
    ("email", 0.8, "email|e_mail"),
    ("phone", 0.8, "phone|mobile|telephone|msisdn"),
    ("date_of_birth", 0.8, "dob|date_of_birth|birth_date|birthdate|birthday"),
    ("salary", 0.8, "salary|wage|compensation"),
    ("password", 0.8, "password|passwd|pwd"),
    ("address", 0.8, "address|street"),
    ("first_name", 0.6, "first_name|firstname|fname|given_name"),
    ("last_name", 0.6, "last_name|lastname|lname|surname|family_name"),
    ("full_name", 0.6, "full_name|fullname"),
    ("postal_code", 0.6, "zip|zip_code|zipcode|postal_code|postcode"),
    ("ip_address", 0.6, "ip|ip_address|ip_addr"),
    ("geolocation", 0.6, "latitude|longitude|lat|lng|lon"),
    ("gender", 0.6, "gender"),
]
#: Name tokens that say the value is protected already.
PROTECTED = (
    "hash", "hashed", "sha", "sha1", "sha2", "sha256", "sha512", "md5", "hmac", "mask", "masked", "tokenized", "tokenised", "encrypted", "redacted",
    "anonymized", "anonymised", "pseudonymized", "pseudonymised", "digest", "obfuscated",
)
#: How names of masking functions begin, and such names as a whole.
MASKING_STARTS = ("hash", "sha", "hmac", "mask", "tokeni", "encrypt", "redact", "anonymi", "pseudonymi", "crypt")
MASKING_NAMES = ("md5", "digest")
#: Shapes of secrets in source text.
CREDENTIAL_NAME = r"(?:[a-z0-9_]*(?:password|passwd|pwd|secret|api_?key|access_?key|auth_?token|token|private_?key|credential)[a-z0-9_]*)"
SECRET_SHAPES = {
    "assignment": rf"(?i)\b{CREDENTIAL_NAME}\s*[:=]\s*[\"'][^\"'\s]{{6,}}[\"']",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "url": r"(?i)\b[a-z][a-z0-9+.\-]*://[^/\s:@\"']+:[^/\s:@\"']+@",
}
PUBLIC_PATH = r"(?i)\b(?:s3a?|gs|gcs|wasbs?|abfss?|azure|hdfs)://[^\s\"'`)]*(?:public|opendata|open-data|world|anonymous|everyone)[^\s\"'`)]*"
BROAD_GRANT = r"(?is)\bGRANT\s+ALL\b|\bGRANT\b[^;]{0,300}?\bTO\s+PUBLIC\b"


def snake(name: Column) -> Column:
    """customerEmail, Customer-Email -> customer_email."""
    parted = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.trim(F.regexp_replace(parted, "[^a-z0-9]+", "_"), F.lit("_"))


def is_protected(name: Column) -> Column:
    return F.arrays_overlap(F.split(snake(name), "_"), F.array(*map(F.lit, PROTECTED)))


def pii_type(name: Column) -> Column:
    """The first type whose names stand in the name as whole tokens; null if none, or if the name says it is protected."""
    out = F.lit(None).cast("string")
    for kind, _, names in reversed(PII_TYPES):
        out = F.when(snake(name).rlike(f"(^|_)({names})(_|$)"), F.lit(kind)).otherwise(out)
    return F.when(~is_protected(name), out)


def pii_confidence(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, confidence, _ in PII_TYPES:
        out = F.when(kind == name, F.lit(confidence)).otherwise(out)
    return out


def masks(text: Column) -> Column:
    """Whether an expression or a name shows masking; null text shows none."""
    known = lambda w: N.any_of([*(w.startswith(x) for x in MASKING_STARTS), w.isin(*MASKING_NAMES)])
    return F.coalesce(F.exists(N.words(text), known), F.lit(False))


def mask_email(value: Column) -> Column:
    return F.regexp_replace(value, r"^(.)[^@]*@", "$1***@")


def mask_tail(value: Column, keep: int = 4) -> Column:
    """All letters and digits but the last `keep` characters become *."""
    head = F.substr(value, F.lit(1), F.greatest(F.length(value) - keep, F.lit(0)))
    return F.concat(F.regexp_replace(head, "[A-Za-z0-9]", "*"), F.right(value, F.lit(keep)))


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, line (from 1) and content of every line."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "content")).select(id_col, (F.col("pos") + 1).alias("line"), "content")


def secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, line and kind of every line that holds a secret; the value is never returned."""
    lines = numbered_lines(df, id_col, text_col)
    kinds = F.array_compact(F.array(*[F.when(F.col("content").rlike(shape), F.lit(kind)) for kind, shape in SECRET_SHAPES.items()]))
    return lines.select(id_col, "line", F.explode(kinds).alias("kind"))
