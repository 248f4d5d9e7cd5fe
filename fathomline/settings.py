"""Settings with types, defaults and bounds, read from text values; and checks of requests, one by one or as a column."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of a search service.
BOUNDS = {"default_search_limit": (1, 100), "max_search_limit": (1, 1000), "sparse_boost": (0.0, 1.0), "rrf_k": (1, 10_000), "batch_size": (1, 100_000)}


@dataclass(frozen=True)
class Settings:
    """What a search engine can be told; a value out of its bounds, or a default limit above the greatest, is a ValueError."""

    default_platform_version: str | None = None
    default_search_limit: int = 10
    max_search_limit: int = 100
    use_hybrid_search: bool = True
    sparse_boost: float = 0.5
    rrf_k: int = 60
    batch_size: int = 50

    def __post_init__(self):
        for name, (least, most) in BOUNDS.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} is from {least} to {most}")
        if self.default_search_limit > self.max_search_limit:
            raise ValueError("default_search_limit is at most max_search_limit")

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "") -> Settings:
        """From text values, such as os.environ or a session's conf; names in any case, others are passed over."""
        given = {k.lower(): v for k, v in values.items()}
        kinds = {"int": int, "float": float, "bool": lambda v: v.strip().lower() == "true", "str | None": lambda v: v or None}
        known = [(f, prefix.lower() + f.name) for f in fields(cls)]
        return cls(**{f.name: kinds[f.type](given[key]) for f, key in known if key in given})


# What a field of a request may be.
VERSION, FULL_VERSION = r"\d+\.\d+(\.\d+)?", r"\d+\.\d+\.\d+"
ELEMENT_TYPES = ("function", "method", "property", "type", "constructor")
MEMBER_TYPES = ("method", "property", "constructor")
ACTIONS = ("list", "list_versions", "list_indexed", "info", "version_info", "index", "reindex", "default_get", "default_set", "default_clear")


@dataclass(frozen=True)
class Text:
    """A text of 1 to `most` characters, white space at its ends apart; of a pattern as a whole, or one of several words."""

    most: int = 1000
    needed: bool = False
    pattern: str | None = None
    words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    """A number from least to most; the default where there is none."""

    least: int
    most: int
    default: int


LIMIT = Whole(1, 100, 10)
PLATFORM = Text(pattern=VERSION)
REQUESTS: dict[str, dict[str, Text | Whole]] = {
    "search": {"query": Text(500, True), "platform_version": PLATFORM, "limit": LIMIT},
    "search_elements": {"query": Text(200, True), "element_type": Text(words=ELEMENT_TYPES), "platform_version": PLATFORM, "limit": LIMIT},
    "get_element": {"element_name": Text(100), "element_type": Text(words=ELEMENT_TYPES), "parent_type": Text(100), "element_id": Text(200), "platform_version": PLATFORM},
    "type_members": {"type_name": Text(100, True), "platform_version": PLATFORM, "member_type": Text(words=MEMBER_TYPES)},
    "manage": {"action": Text(needed=True, words=ACTIONS), "version": Text(pattern=FULL_VERSION)},
}


def _fault(rule: Text | Whole, value) -> str | None:
    if isinstance(rule, Whole):
        return None if rule.least <= value <= rule.most else f"is from {rule.least} to {rule.most}"
    if value is None:
        return "is needed" if rule.needed else None
    if not 1 <= len(value) <= rule.most:
        return f"has 1 to {rule.most} characters"
    if rule.pattern and not re.fullmatch(rule.pattern, value, re.ASCII):
        return "has another form"
    return "is another word" if rule.words and value not in rule.words else None


def validated(kind: str, **given) -> dict:
    """The request's fields, trimmed, a query without NUL, CR and LF, numbers with their defaults; else ValueError that names every fault."""
    rules, out = REQUESTS[kind], {}
    for name, rule in rules.items():
        value = given.get(name)
        if isinstance(rule, Whole):
            value = rule.default if value is None else value
        elif value is not None:
            value = (re.sub(r"[\0\r\n]", "", value) if name == "query" else value).strip()
        out[name] = value
    faults = [f"{n} {f}" for n, rule in rules.items() if (f := _fault(rule, out[n]))]
    faults += [f"{n} is no field" for n in given if n not in rules]
    if faults:
        raise ValueError("; ".join(faults))
    return out


def faulty(requests: DataFrame, kind: str) -> Column:
    """The names of a request's fields that validated() would refuse, as an array, for tables of requests; a missing column is null throughout."""

    def bad(name: str, rule: Text | Whole) -> Column:
        if isinstance(rule, Whole):
            return ~F.coalesce(F.col(name), F.lit(rule.default)).between(rule.least, rule.most)
        c = F.col(name)
        c = F.regexp_replace(F.regexp_replace(c, r"[\x00\r\n]", "") if name == "query" else c, r"(?U)^\s+|\s+$", "")
        fine = F.length(c).between(1, rule.most)
        fine = fine & c.rlike(rf"^(?:{rule.pattern})\z") if rule.pattern else fine
        fine = fine & c.isin(*rule.words) if rule.words else fine
        return F.when(c.isNull(), F.lit(rule.needed)).otherwise(~fine)

    rules = {n: r for n, r in REQUESTS[kind].items() if n in requests.columns}
    missing = [F.lit(n) for n, r in REQUESTS[kind].items() if n not in requests.columns and isinstance(r, Text) and r.needed]
    return F.array_compact(F.array(*missing, *[F.when(bad(n, r), F.lit(n)) for n, r in rules.items()]))
