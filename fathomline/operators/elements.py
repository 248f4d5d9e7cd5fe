"""Elements of an interface (types, methods, properties ...): normalising, dedup, look-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import ids

MEMBER_ORDER = ("constructor", "method", "property")
NAMES = ("element_name", "full_name", "content")


def best_source(items: DataFrame, path: str = "path", seq: str = "seq", id_col: str = "id") -> DataFrame:
    """Of items with one id that of the most relevant page; ties: the first seen, `seq` being an explicit order."""
    w = Window.partitionBy(id_col).orderBy(F.desc(ids.source_priority(path)), F.asc(seq))
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def flattened(pages: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One row an element of pages: groups names the array column of each element type; its structs have name and description.

    Columns: path, element_type, element (struct), pos.
    """
    parts = [pages.select("path", F.lit(kind).alias("element_type"), F.posexplode(c).alias("pos", "element")) for kind, c in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def routed(element_type: Column, parent: Column, name: Column) -> Column:
    """A function with a parent that isn't the global context is a method."""
    in_global = name.contains("Глобальный контекст") | name.contains("Global context")
    return F.when((element_type == "function") & ids.present(parent).isNotNull() & ~in_global, "method").otherwise(element_type)


def where(elements: DataFrame, types: list[str] | None = None, **equal: str | bool | None) -> DataFrame:
    """Rows that meet all equalities (case-sensitive) and whose type is one of `types`, if given; pushed to the scan."""
    for c, v in equal.items():
        if v is not None:
            elements = elements.filter(F.col(c) == F.lit(v))
    return elements.filter(F.col("element_type").isin(types)) if types else elements


def by_id(rows: DataFrame, n: int | None = None, id_col: str = "id", after=None) -> DataFrame:
    """Rows in the order of ids: all, or the first n, behind the id `after` if given. A scroll's pages are the n behind the last one's last id, until one is empty."""
    rows = rows if after is None else rows.filter(F.col(id_col) > F.lit(after))
    rows = rows.orderBy(id_col)
    return rows if n is None else rows.limit(n)


def named_like(query: str, names: tuple[str, ...] = ("element_name", "element_name_en", "full_name")) -> Column:
    low = query.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(n)).contains(low), F.lit(False)) for n in names])


def cascade(elements: DataFrame, query: str, dense: DataFrame | None = None, element_type: str | None = None, limit: int = 10, id_col: str = "id") -> DataFrame:
    """Look-up in stages; rows of the first stage that has some: (id, score, stage).

    1 the name is the query, score 1. 2 the full name is, for queries with a dot, 1. 3 of the `dense` hits (query's nearest elements
    (id, score, rank), over-fetched) those with the query in a name, in their order. 4 for ASCII queries of up to 20 characters the elements with
    the query in a name, 0.9. A stage's rows are the first `limit`, by rank in 3, else by id; all elements are looked through.
    """
    own = where(elements, [element_type] if element_type else None)
    no_order = F.lit(0).cast("long")
    stage = lambda d, n, score: by_id(d, limit, id_col).select(id_col, score.cast("double").alias("score"), F.lit(n).alias("stage"), no_order.alias("_order"))
    parts = [stage(own.filter(F.col("element_name") == query), 1, F.lit(1.0))]
    if "." in query:
        parts.append(stage(own.filter(F.col("full_name") == query), 2, F.lit(1.0)))
    if dense is not None:
        hits = dense.join(own.filter(named_like(query)), id_col).orderBy("rank").limit(limit)
        parts.append(hits.select(id_col, F.col("score").cast("double").alias("score"), F.lit(3).alias("stage"), F.col("rank").cast("long").alias("_order")))
    if query.isascii() and len(query) <= 20:
        parts.append(stage(own.filter(named_like(query)), 4, F.lit(0.9)))
    every = reduce(DataFrame.unionByName, parts)
    first = F.min("stage").over(Window.partitionBy())  # at most `limit` rows a stage
    return every.withColumn("_first", first).filter("stage = _first").select(id_col, "score", "stage", "_order").orderBy("_order", id_col).drop("_order")


def best_of(rows: DataFrame, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """Of elements of one name that of the preferred type (property, method, constructor, function, type; others last), ties by id."""
    order = [F.desc(ids.type_priority("element_type")), F.asc(id_col)]
    if not by:
        return rows.orderBy(*order).limit(1)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def element(elements: DataFrame, name: str | None = None, element_type: str | None = None, parent: str | None = None, element_id: str | None = None, id_col: str = "id") -> DataFrame:
    """One element by name, or by an id that is taken apart; with a parent the first by id, else the best of its types."""
    if element_id and "_" in element_id:
        element_type, _, rest = element_id.partition("_")
        if element_type in ids.MEMBERS and "_" in rest:
            parent, _, name = rest.rpartition("_")
        else:
            name = rest
    if not (element_id or name):
        raise ValueError("an element's name or id is needed")
    found = where(elements, [element_type] if element_type else None, element_name=name, parent_type=parent)
    return by_id(found, 1, id_col) if parent else best_of(found, id_col)


def members(elements: DataFrame, type_name: str, member_type: str | None = None, include_constructors: bool = True, id_col: str = "id") -> DataFrame:
    """All members of a type: constructors, methods, properties, in that order and by id; member_type overrides include_constructors."""
    types = [member_type] if member_type else [t for t in MEMBER_ORDER if include_constructors or t != "constructor"]
    place = reduce(lambda a, t: F.when(F.col("element_type") == t, MEMBER_ORDER.index(t)).otherwise(a), MEMBER_ORDER, F.lit(len(MEMBER_ORDER)))
    return where(elements, types, parent_type=type_name).withColumn("place", place).orderBy("place", id_col)


def member_counts(elements: DataFrame) -> DataFrame:
    """(parent_type, element_type, n)."""
    return elements.filter("parent_type IS NOT NULL").groupBy("parent_type", "element_type").agg(F.count("*").alias("n"))
