"""Hits and elements as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ids import present
from fathomline.operators.extract import AVAILABLE

#: What an availability note looks like; it isn't a type.
AVAILABILITY = rf"(?iu){AVAILABLE}"


def shortened(text: str | Column, n: int) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def three_places(number: str | Column) -> Column:
    """A number with three decimals, rounded as printf does: by its exact binary value, ties to even. Java's %.3f rounds the shortest decimal half up."""
    c = F.col(number) if isinstance(number, str) else number
    # DecimalFormat takes 0.0005, which is a little more than half a thousandth, for a tie.
    return F.when(F.abs(c) == 0.0005, F.when(c > 0, "0.001").otherwise("-0.001")).otherwise(F.call_function("format_number", c, F.lit("0.000")))


def hits(ranked: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """ranked with `line`: "rank. title (score) - the first 150 characters"."""
    return ranked.withColumn(
        "line", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col(title), F.lit(" - "), shortened(F.regexp_replace(text, r"\s+", " "), 150))
    )


def inexact(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, inexact): whether no hit is an exact one."""
    return ranked.groupBy(by).agg((F.max("score") < 0.999).alias("inexact"))


# What the lines of a listing and the parts of a card are called, in their order, with the columns and how much of each is shown.
LISTED = (("Описание", "description", 150), ("Сигнатура", "signature", 100), ("Родительский тип", "parent_type", None), ("Доступно с версии", "since_version", None))
CARD = (
    ("Тип", "element_type", None), ("Родительский тип", "parent_type", None), ("Английское имя", "element_name_en", None), ("Сигнатура", "signature", 200), ("Параметры", "parameters", None),
    ("Возвращает", "returned", 200), ("Описание", "description", 500), ("Примеры", "examples", 3), ("Примечание", "notes", 300), ("Доступность", "availability", None), ("См. также", "related", 5),
    ("Доступно с версии", "since_version", None), ("Устарел с версии", "deprecated_since", None), ("Источник", "path", None),
)
INEXACT = "Имя элемента не совпало точно, показаны ближайшие совпадения по имени/семантике."
NOTHING = "По запросу ничего не найдено"
REQUIRED, OPTIONAL = "обязательный", "необязательный"
SYNTAX_LINE = r"(?:Синтаксис|Syntax):\s*([^\n]+)"


def _has(df: DataFrame, c: str) -> Column:
    """A text column that may be missing, without blank texts."""
    return present(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")


def entries(found: DataFrame) -> DataFrame:
    """found (rank, score, element_type, element_name ... as far as there) with `entry`: a hit in some lines; parts without a text are left out.

    A function or method without a signature has that of its content's syntax line.
    """
    syntax = F.when(F.col("element_type").isin("function", "method"), F.nullif(F.regexp_extract(F.coalesce(_has(found, "content"), F.lit("")), SYNTAX_LINE, 1), F.lit("")))
    text = {"description": F.coalesce(_has(found, "description"), _has(found, "content"), _has(found, "text")), "signature": F.coalesce(_has(found, "signature"), syntax)}
    own = F.concat_ws("_", "element_type", _has(found, "parent_type"), "element_name")
    head = F.concat(F.col("rank").cast("string"), F.lit(". element_id: "), own, F.lit(" | name: "), F.coalesce(_has(found, "full_name"), F.col("element_name")), F.lit(" | type: "), "element_type", F.lit(" | score: "), three_places("score"))
    lines = []
    for label, c, most in LISTED:
        v = text.get(c, _has(found, c))
        shown = v if most is None else shortened(v, most) if c == "description" else F.substring(v, 1, most)
        lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"   {label}: "), shown)))
    return found.withColumn("entry", F.concat_ws("\n", head, *lines))


def listing(found: DataFrame, by: str = "query_id", queries: DataFrame | None = None) -> DataFrame:
    """(by, listing): the entries of each query's hits in their order, and a line that says so where none is exact. queries (by): also those without hits.

    A query has as many hits as its limit, so they meet in one row.
    """
    each = entries(found).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("_t"), (F.max("score") < 0.999).alias("_near"))
    d = each.select(by, F.concat_ws("\n\n", "_t", F.when(F.col("_near"), F.lit(INEXACT))).alias("listing"))
    return d if queries is None else queries.select(by).join(d, by, "left").withColumn("listing", F.coalesce("listing", F.lit(NOTHING)))


def card(elements: DataFrame) -> DataFrame:
    """elements with `card`: the full name and the parts below it that an element has; columns may be missing.

    parameters: structs (name, type, required, description), as pages' records have them. A signature ends at its first closing bracket. A returned type that
    looks like an availability belongs to the description; a description that does is none.
    """
    kind, about = _has(elements, "return_type"), _has(elements, "return_description")
    lost = F.coalesce(kind.rlike(AVAILABILITY), F.lit(False))
    about = F.when(lost, F.nullif(F.concat_ws(" ", kind, about), F.lit(""))).otherwise(about)
    about = F.when(~F.coalesce(about.rlike(AVAILABILITY), F.lit(False)), F.substring(about, 1, 200))
    returned = F.nullif(F.concat_ws("\n   ", F.when(~lost & (kind != "Unknown"), F.concat(F.lit("Тип: "), kind)), about), F.lit(""))
    call = F.nullif(F.regexp_extract(_has(elements, "signature"), r"^([^(]+\([^)]*\))", 1), F.lit(""))
    joined = lambda c, most: F.when(F.size(c) > 0, F.concat(F.lit("\n   "), F.array_join(F.slice(c, 1, most), "\n   "))) if c in elements.columns else F.lit(None).cast("string")
    special = {"returned": returned, "signature": F.coalesce(call, _has(elements, "signature")), "description": F.coalesce(_has(elements, "description"), _has(elements, "content")), "examples": joined("examples", 3), "related": joined("related", 5)}
    if "parameters" in elements.columns:
        line = lambda p: F.concat_ws("\n     ", F.concat(F.lit("- "), p["name"], F.lit(": "), p["type"], F.lit(" ("), F.when(p["required"], F.lit(REQUIRED)).otherwise(F.lit(OPTIONAL)), F.lit(")")), F.nullif(F.substring(p["description"], 1, 100), F.lit("")))
        special["parameters"] = F.when(F.size("parameters") > 0, F.concat(F.lit("\n   "), F.array_join(F.transform("parameters", line), "\n   ")))
    parts = []
    for label, c, most in CARD:
        v = special.get(c, _has(elements, c))
        v = shortened(v, most) if most is not None and c not in ("examples", "related", "returned") else v
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v)))
    return elements.withColumn("card", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(_has(elements, "full_name"), F.col("element_name"))), *parts))
