"""Names, ids and search text of elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

MEMBERS = ("method", "property", "constructor")
#: Which type of element wins where one name has several.
TYPE_PRIORITY = {"property": 5, "method": 4, "constructor": 3, "function": 2, "type": 1}


def present(c: str | Column) -> Column:
    """Null for the empty string."""
    return F.nullif(col(c), F.lit(""))


def full_name(element_type: str | Column, name: str | Column, parent: str | Column) -> Column:
    """parent.name, or the name; of a constructor "Новый parent", so overloads share it."""
    plain = F.concat_ws(".", present(parent), col(name))
    return F.when(col(element_type) == "constructor", F.concat(F.lit("Новый "), col(parent))).otherwise(plain)


def original_id(version: str | Column, element_type: str | Column, name: str | Column) -> Column:
    return F.concat_ws("_", col(version), col(element_type), col(name))


def element_key(text: str | Column) -> Column:
    """The first 60 bits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(col(text)), 1, 15), 16, 10).cast("bigint")


def build_id(element_type: str | Column, parent: str | Column, name: str | Column) -> Column:
    return F.concat_ws("_", col(element_type), present(parent), col(name))


def parse_id(element_id: str | Column) -> Column:
    """struct(element_type, parent_type, element_name): members take what stands before their last _ as the parent. Null type without _."""
    c = col(element_id)
    has = c.contains("_")
    kind = F.when(has, F.regexp_extract(c, r"(?s)^([^_]*)_(.*)$", 1))
    rest = F.when(has, F.regexp_extract(c, r"(?s)^([^_]*)_(.*)$", 2))
    member = kind.isin(*MEMBERS) & rest.contains("_")
    return F.struct(
        kind.alias("element_type"),
        F.when(member, F.regexp_extract(rest, r"(?s)^(.*)_([^_]*)$", 1)).alias("parent_type"),
        F.when(member, F.regexp_extract(rest, r"(?s)^(.*)_([^_]*)$", 2)).otherwise(rest).alias("element_name"),
    )


def search_text(element_type: str | Column, name, name_en, full, description, signature=None, parameters=None, return_type=None) -> Column:
    """What is indexed of an element: names and description; of a method also signature, parameter names and return type."""
    base = [present(c) for c in (name, name_en, full, description)]
    method = col(element_type) == "method"
    extra = [F.when(method, present(c)) for c in (signature,) if c is not None]
    extra += [F.when(method, F.array_join(col(c), " ")) for c in (parameters,) if c is not None]
    extra += [F.when(method, present(c)) for c in (return_type,) if c is not None]
    return F.concat_ws(" ", *base, *extra)


def source_priority(path: str | Column) -> Column:
    """How relevant the page is that an element comes from: greater is better; 0 without a path."""
    low = F.lower(col(path))
    has = lambda *parts: F.greatest(*[low.contains(p) for p in parts]) if len(parts) > 1 else low.contains(parts[0])
    return (
        F.when(F.coalesce(col(path), F.lit("")) == "", 0)
        .when(has("/methods/"), 10)
        .when(has("/properties/"), 9)
        .when(has("/constructors/", "/ctors/"), 8)
        .when(has("/object") & ~has("/events/"), 5)
        .when(has("/events/"), 2)
        .when(has("/functions/", "/global"), 3)
        .otherwise(1)
    )


def type_priority(element_type: str | Column) -> Column:
    out = F.lit(0)
    for kind, n in TYPE_PRIORITY.items():
        out = F.when(col(element_type) == kind, n).otherwise(out)
    return out
