"""Text hygiene: token budgets, replacing, counting what is left, freshness."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TOKENS, WARN, CRITICAL = 200_000, 70, 85

#: (pattern, replacement), applied one after another; (?i) for any case.
RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "user@example.com"),
    (r"(?i)(password|passwd|secret|token)(\s*[:=]\s*)[^\s,;]+", "$1$2REDACTED"),
    (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "0.0.0.0"),
    (r"(?i)[a-z]:\\users\\[^\\\s]+", r"C:\\Users\\user"),
    (r"/home/[^/\s]+", "/home/user"),
)
#: What is looked for after replacing.
RESIDUAL = {"n_email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "n_secret": r"(?i)(password|passwd|secret|token)\s*[:=]", "n_ip": r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"}


def token_budget(turns: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """turns with tokens (a quarter of the characters), their running total, its percentage of `most`, and a level."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = turns.withColumn("tokens", F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).withColumn("total", F.sum("tokens").over(w))
    d = d.withColumn("pct", F.floor(F.col("total") / most * 100))
    return d.withColumn("level", F.when(F.col("pct") >= CRITICAL, "critical").when(F.col("pct") >= WARN, "warn").otherwise("ok"))


def rules_of(replacements: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """Rules of a map of patterns, in any case of letters; longer patterns go first, so the map's order says nothing. A pattern that isn't one is an error."""
    for p in replacements:
        re.compile(p)
    return tuple((f"(?i){p}", replacements[p]) for p in sorted(replacements, key=lambda p: (-len(p), p)))


def read_rules(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """The rules of a JSON file, {"pattern": "replacement", ...}."""
    return rules_of(json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def sanitized(text: str | Column, rules=RULES) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def leaks(docs: DataFrame, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """docs with counts of what each pattern still finds."""
    return docs.withColumns({n: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long") for n, p in (patterns or RESIDUAL).items()})


def stale(newest: Column, now: Column, minutes: int = 5) -> Column:
    """Whether the newest change is more than some minutes ago."""
    return (F.unix_timestamp(now) - F.unix_timestamp(newest)) > minutes * 60
