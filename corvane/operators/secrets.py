"""Secrets in source text: line patterns of our own, values by length and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pattern for each type.
PATTERNS = {
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "generic_secret": r"""(?i)(api_?key|secret|token|password|passwd)[A-Za-z0-9_]*["']?\s*[:=]\s*["'][^"']{8,}["']""",
    "bearer_token": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "email_pii": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "stripe_key": r"\bsk_live_[0-9A-Za-z]{16,}",
    "github_pat": r"\bghp_[0-9A-Za-z]{20,}",
}
BLOB = r"[A-Za-z0-9+/=_-]{32,}"
ENTROPY = 4.5
DIRECTIVE_LINES = 10


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.split(c, "")
    counts = F.map_from_entries(F.transform(F.array_distinct(chars), lambda x: F.struct(x, F.size(F.filter(chars, lambda y: y == x)).cast("double"))))
    n = F.size(chars).cast("double")
    return F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))


def is_ignored(content: Column, token: str = "ignore: secrets") -> Column:
    """Whether a comment in the first lines turns the analysis off."""
    return F.exists(F.slice(F.split(content, "\n"), 1, DIRECTIVE_LINES), lambda x: F.lower(x).contains(token))


def secrets(sources: DataFrame) -> DataFrame:
    """sources: path, content -> (path, line, secret_type, value): a row for each type that a line holds.

    A high-entropy blob is reported where no other type is. Values in triple quotes may start on the line after.
    """
    told = sources.where(F.col("content").isNotNull() & ~is_ignored(F.col("content")))
    joined = F.regexp_replace("content", r"""(?s)=\s*('''|\"\"\")\s*\n?([^\n]*?)\s*('''|\"\"\")""", '= "$2"')
    line = told.select("path", F.posexplode(F.split(joined, "\n")).alias("at", "t"))
    hits = F.array(*[F.struct(F.lit(k).alias("secret_type"), F.regexp_substr("t", F.lit(p)).alias("value")) for k, p in PATTERNS.items()])
    named = F.filter(hits, lambda h: h["value"].isNotNull())
    blob = F.regexp_substr("t", F.lit(BLOB))
    loose = F.when(blob.isNotNull() & (entropy(F.coalesce(blob, F.lit(""))) >= ENTROPY), F.array(F.struct(F.lit("high_entropy").alias("secret_type"), blob.alias("value")))).otherwise(F.filter(hits, lambda h: F.lit(False)))
    found = line.select("path", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.when(F.size(named) > 0, named).otherwise(loose)).alias("s"))
    return found.select("path", "line", "s.secret_type", "s.value")
