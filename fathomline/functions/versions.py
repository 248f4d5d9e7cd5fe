"""Versions: normalising, order, prefixes, resolving, names of collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, stripped

NORMAL = r"^(\p{Nd}+\.\p{Nd}+\.\p{Nd}+[^.]*)"


def normalized(version: str | Column) -> Column:
    """Three parts joined by dots, of a version that starts with three numbers; else null."""
    dotted = F.replace(stripped(version), F.lit("_"), F.lit("."))
    return F.nullif(F.regexp_extract(dotted, NORMAL, 1), F.lit(""))


def normalize(version: str) -> str:
    """The same on the driver; an error where the column form is null."""
    dotted = version.strip().replace("_", ".")
    if not re.match(r"\d+\.\d+\.\d+", dotted):
        raise ValueError(f"not a version: {version!r}")
    return ".".join(dotted.split(".")[:3])


def sort_key(version: str | Column) -> Column:
    """Numbers of the parts, for order; a part that isn't a number is null."""
    return F.transform(F.split(col(version), r"\."), lambda x: x.try_cast("int"))


def latest(versions: DataFrame, version: str = "version") -> DataFrame:
    """One row with the greatest version; null without any."""
    return versions.agg(F.max_by(F.col(version), sort_key(version)).alias(version))


def ordered(versions: DataFrame, version: str = "version") -> DataFrame:
    return versions.orderBy(F.desc(sort_key(version)), F.col(version))


def of_prefix(versions: DataFrame, prefix: str, version: str = "version") -> DataFrame:
    """The latest version that is the prefix or goes on with a dot behind it."""
    return latest(versions.filter((F.col(version) == prefix) | F.col(version).startswith(f"{prefix}.")), version)


def resolved(available: DataFrame, candidates: list[str | Column], version: str = "version") -> Column:
    """The first candidate that normalises; a join with `available` then tells whether it is there."""
    return F.coalesce(*[normalized(c) for c in candidates])


def resolve(available: list[str], *candidates: str | None) -> str | None:
    """The first candidate (argument, configuration, header, environment) that is there, else the latest; a prefix is its latest version."""
    key = lambda v: [int(x) if x.isdigit() else -1 for x in v.split(".")]
    known = sorted({normalize(v) for v in available}, key=key, reverse=True)
    for c in candidates:
        if not c:
            continue
        dotted = c.strip().replace("_", ".")
        exact = ".".join(dotted.split(".")[:3])
        if exact in known:
            return exact
        if re.fullmatch(r"\d+\.\d+", dotted):
            found = next((v for v in known if v.startswith(f"{dotted}.")), None)
            if found:
                return found
    return known[0] if known else None


def collection_name(version: str | Column, prefix: str = "help_") -> Column:
    return F.concat(F.lit(prefix), F.replace(col(version), F.lit("."), F.lit("_")))
