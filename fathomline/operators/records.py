"""Whole records of documentation pages, and the elements that they hold.

records() reads each page once, in columns: what a page's kind doesn't have is null. items() makes a row of each element of a page: its own,
and the members that a type's page lists. Nothing is shuffled; a member's own page wins over its type's list when items are indexed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import ids
from fathomline.functions.text import bound, col, stripped
from fathomline.operators import elements as el
from fathomline.operators import extract as ex

# Words and labels of members.
NEW = "Новый|New"
SYNTAX = "Синтаксис"
TYPE = "Тип"
READ_ONLY, WRITE_ONLY = r"Только\s*чтение|Read-only|readonly", r"Только\s*запись|Write-only|writeonly"
MEMBER_SECTIONS = {"method": ("Методы", "Methods"), "property": ("Свойства", "Properties"), "constructor": ("Конструкторы", "Constructors")}
OTHER_SECTIONS = ("События", "Events")
MEMBER_WORDS = {"method": ("Метод", "Method"), "property": ("Свойство", "Property"), "constructor": ("Конструктор", "Constructor")}

MEMBER = "struct<element_type:string,name:string,name_en:string,description:string,signature:string,type:string,read_only:boolean,write_only:boolean>"
#: The columns of a record beside path, seq and the page's own.
FIELDS = (
    "element_type", "element_name", "element_name_en", "parent_type", "signature", "parameters", "return_type", "return_description", "description", "notes", "availability",
    "since", "deprecated", "deprecated_since", "examples", "related", "base_types", "enum_values", "read_only", "write_only", "members",
)


def quoted(name: str | Column) -> Column:
    """A pattern that a name, as it is, meets."""
    return F.concat(F.lit(r"\Q"), F.replace(col(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def found(text: str | Column, *pattern: str | Column, n: int = 1) -> Column:
    """A group of the first match of a pattern of several parts, columns among them; null without one or where it is empty."""
    whole = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pattern])
    return F.nullif(F.call_function("regexp_extract", col(text), whole, F.lit(n)), F.lit(""))


def one_line(text: str | Column) -> Column:
    return stripped(F.regexp_replace(col(text), r"(?U)\s+", " "))


def call(text: str | Column) -> Column:
    """A text on one line, to its first closing bracket if it has an opening one; null if nothing is left."""
    return bound(one_line(text), lambda line: F.nullif(F.when(line.contains("("), F.regexp_replace(line, r"(?s)\).*$", ")")).otherwise(line), F.lit("")))


def syntax(html: str | Column, content: str | Column, cut: str | Column | None = None) -> Column:
    """The call that a page's chapter of syntax, else its text's section, gives; null without both."""
    marked = call(ex.without_tags(F.regexp_replace(ex.chapter(html, SYNTAX), r"(?is)<hr\b.*$", ""), ""))
    return F.coalesce(marked, F.get(F.filter(F.transform(ex.texts_of(content, "syntax", cut=cut), call), lambda t: t.isNotNull()), F.lit(0)))


def method_signature(given: str | Column, content: str | Column, name: str | Column) -> Column:
    """The call in the syntax, if it has the name, with () if it has no brackets; else where the text calls it; else name()."""
    given = col(given)
    named = F.contains(given, col(name))
    bare = F.concat(col(name), F.lit("()"))
    return F.coalesce(F.when(named & given.contains("("), given).when(named, bare), one_line(found(content, "(", quoted(name), r"\s*\([^)]*\))")), bare)


def function_signature(given: str | Column, content: str | Column, name: str | Column, params: str | Column) -> Column:
    """The call in the syntax, if it says more than the name; else where the text calls it; else built of the parameters."""
    given = col(given)
    return F.coalesce(F.when(F.length(given) > F.length(name), given), one_line(found(content, "(", quoted(name), r"\s*\([^)]*\))")), ex.built_signature(name, params))


def created(text: str | Column) -> Column:
    """The type behind "Новый" or "New"."""
    return found(text, rf"(?iu)\b(?:{NEW})\s+({ex.NAME})")


def constructor_parent(title: str | Column, signature: str | Column) -> Column:
    """The type of a constructor: the title's first dotted part, else what the title or the signature makes."""
    return F.coalesce(ex.parent_name(title), created(title), created(signature))


def given_constructor(given: str | Column, content: str | Column) -> Column:
    """The creating call of a page: of its syntax, with () if it has no brackets, else anywhere in its text; null without one."""
    given = col(given)
    whole = F.when(given.contains("("), given).otherwise(F.concat(found(given, rf"(?iu)\b({NEW})\s", n=1), F.lit(" "), created(given), F.lit("()")))
    return F.coalesce(F.when(given.rlike(NEW), whole), one_line(found(content, rf"(?iu)(\b(?:{NEW})\s+{ex.NAME}\s*\([^)]*\))")))


def constructor_signature(given: str | Column, parent: str | Column, params: str | Column) -> Column:
    """What the page gives; else "Новый parent(<a> (T), [<b>])"; '' where neither is known."""

    def one(p: Column) -> Column:
        s = F.concat(F.lit("<"), p["name"], F.lit(">"), F.when(p["type"] != "Unknown", F.concat(F.lit(" ("), p["type"], F.lit(")"))).otherwise(""))
        return F.when(p["required"], s).otherwise(F.concat(F.lit("["), s, F.lit("]")))

    return F.coalesce(col(given), F.concat(F.lit("Новый "), col(parent), F.lit("("), F.array_join(F.transform(col(params), one), ", "), F.lit(")")), F.lit(""))


def folder_parent(path: str | Column) -> Column:
    """The folder before /properties/."""
    return F.nullif(stripped(F.regexp_extract(col(path), r"([^/]+)/properties/", 1)), F.lit(""))


def property_type(html: str | Column, text: str | Column) -> Column:
    """What stands behind "Тип:", the first link in the markup before the text; else Unknown."""
    linked = found(html, rf"(?isu){TYPE}:(?:\s|</p\s*>)*<a\b[^>]*>([^<]+)</a")
    return F.coalesce(F.nullif(stripped(F.regexp_replace(ex.unescaped(linked), r"\.\s*$", "")), F.lit("")), F.nullif(stripped(found(text, rf"(?iu){TYPE}:\s*([^<\n.]+)")), F.lit("")), F.lit("Unknown"))


def only(text: str | Column, words: str) -> Column:
    return F.coalesce(col(text).rlike(rf"(?iu){words}"), F.lit(False))


def member_section(content: str | Column, kind: str) -> Column:
    """The text behind a kind's heading, to a blank line or the next heading; '' without one."""
    heads = "|".join([h for k in MEMBER_SECTIONS for h in MEMBER_SECTIONS[k]] + list(OTHER_SECTIONS))
    return F.coalesce(found(content, rf"(?isu)(?:{'|'.join(MEMBER_SECTIONS[kind])}):\s*(.+?)(?=\n\s*\n|\n\s*(?:{heads})\b|$)"), F.lit(""))


def member_names(html: str | Column, content: str | Column, kind: str) -> Column:
    """array of struct(name, name_en) of a type page's members of a kind, each name once: those that the text declares, those that the page links
    to, those that its section lists. Brackets right behind a name are a call's; an English name stands in brackets behind a space."""
    entry = rf"(?u)^({ex.NAME})\s*(?:\(([A-Z][a-zA-Z0-9_]+)\))?"
    both = lambda t: F.struct(F.regexp_extract(t, entry, 1).alias("name"), F.regexp_extract(t, entry, 2).alias("name_en"))
    declared = F.regexp_extract_all(col(content), F.lit(rf"(?u)\b(?:{'|'.join(MEMBER_WORDS[kind])})\s+({ex.NAME})" + (r"\s*\([^)]*\)" if kind != "property" else r"\s*[-–:]")), F.lit(1))
    if kind == "method":
        declared = F.concat(declared, F.regexp_extract_all(col(content), F.lit(rf"({ex.NAME})\([^)]*\)\s*[-–]"), F.lit(1)))
    linked = F.transform(F.filter(ex.links(html), lambda x: ex.any_of(x["href"], ex.MEMBER_LINKS[kind])), lambda x: x["text"])
    listed = F.transform(F.split(member_section(content, kind), r"[\n,;]"), stripped)
    every = F.filter(F.transform(F.concat(declared, linked, listed), both), lambda m: m["name"] != "")

    def once(every: Column) -> Column:
        first = lambda m, i: ~F.exists(F.slice(every, F.lit(1), i), lambda x: x["name"] == m["name"])
        english = lambda m: F.array_max(F.transform(F.filter(every, lambda x: x["name"] == m["name"]), lambda x: x["name_en"]))
        return F.transform(F.filter(every, first), lambda m: F.struct(m["name"].alias("name"), english(m).alias("name_en")))

    return F.coalesce(bound(every, once), F.expr("cast(array() AS array<struct<name:string,name_en:string>>)"))


def members(html: str | Column, content: str | Column, kind: str, names: str | Column) -> Column:
    """array of members with what the type's page says of each: the text behind its name, the call, and of a property its type and flags."""

    is_property = kind == "property"

    def one(m: Column, said: Column) -> Column:
        # Behind a space the brackets hold the English name.
        called = one_line(found(content, r"(?u)(?<![\p{L}\p{N}_.])(", quoted(m["name"]), r"\([^)]*\))"))
        return F.struct(
            F.lit(kind).alias("element_type"), m["name"].alias("name"), m["name_en"].alias("name_en"), F.coalesce(one_line(said), F.lit("")).alias("description"),
            (F.lit(None).cast("string") if is_property else F.coalesce(called, m["name"])).alias("signature"),
            (property_type(F.lit(""), said) if is_property else F.lit(None).cast("string")).alias("type"),
            (only(said, READ_ONLY) if is_property else F.lit(None).cast("boolean")).alias("read_only"),
            (only(said, WRITE_ONLY) if is_property else F.lit(None).cast("boolean")).alias("write_only"),
        )

    said = lambda m: found(content, r"(?isu)(?<![\p{L}\p{N}_.])", quoted(m["name"]), r"\s*(?:\([^)]*\))?\s*[-–:]\s*(.+?)(?=\n|$)")
    return F.transform(col(names), lambda m: bound(said(m), lambda x: one(m, x))).cast(f"array<{MEMBER}>")


def records(pages: DataFrame) -> DataFrame:
    """pages (path, html, and any others) with page_type, title, content and FIELDS.

    Null or empty markup gives a page of unknown type without a name. Every page gives one row; equal rows give equal records.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (*FIELDS, "page_type", "title", "content")]
    d = pages.select(*kept).withColumn("html", F.coalesce("html", F.lit("")))
    d = d.select("*", ex.title("html").alias("title"), ex.content("html").alias("content"))
    d = d.withColumn("page_type", ex.page_type("path", "title", "content"))
    kind = F.col("page_type")
    d = d.withColumn("element_type", F.when(kind == "function", F.when(ex.is_method("path", "title"), "method").otherwise("function")).when(kind == "object", "type").when(kind.isin("constructor", "property", "enum"), kind))
    kind = F.col("element_type")
    plain_title = stripped(F.regexp_replace("title", r"\s*\([^)]*\)", ""))
    name = F.when(kind.isin("method", "function"), ex.function_name("title")).when(kind == "type", ex.object_name("title")).when(kind == "enum", ex.enum_name("title"))
    name = name.when(kind == "constructor", "Новый").when(kind == "property", F.when(plain_title.contains("."), stripped(F.substring_index(plain_title, ".", -1))).otherwise(ex.function_name(plain_title)))
    called = kind.isin("method", "function", "constructor")
    named = kind.isNotNull()
    d = d.withColumn("_cut", F.when(named, ex.labelled("content")))
    d = d.select(
        "*", name.alias("element_name"), F.when(named, ex.english_name("title")).alias("element_name_en"), F.when(called, ex.marked_parameters("html", "content", "_cut")).alias("parameters"),
        F.when(called, syntax("html", "content", "_cut")).alias("_syntax"), F.when(kind.isin("method", "function"), ex.returned("content", "_cut")).alias("_returned"),
        F.when(named, ex.version_info("content")).alias("_version"),
    )
    d = d.withColumn("_given", F.when(kind == "constructor", given_constructor("_syntax", "content")))
    parent = F.when(kind == "method", ex.parent_name("title")).when(kind == "constructor", constructor_parent("title", "_given")).when(kind == "property", F.coalesce(ex.parent_name(plain_title), folder_parent("path")))
    # The title names the element with its English name in brackets: that is no call.
    body = F.when(F.col("title") == "", F.col("content")).otherwise(F.replace("content", F.col("title"), F.lit("")))
    d = d.select("*", parent.alias("parent_type"), body.alias("_body"))
    signature = F.when(kind == "method", method_signature("_syntax", "_body", "element_name")).when(kind == "function", function_signature("_syntax", "_body", "element_name", "parameters"))
    signature = signature.when(kind == "constructor", constructor_signature("_given", "parent_type", "parameters"))
    of_type = {k: f"_{k}" for k in MEMBER_SECTIONS}
    d = d.select("*", signature.alias("signature"), *[F.when(kind == "type", member_names("html", "content", k)).alias(n) for k, n in of_type.items()])
    out = {
        "return_type": F.when(kind == "property", property_type("html", "content")).otherwise(F.col("_returned.type")),
        "return_description": F.col("_returned.description"),
        "description": F.when(named, ex.description("content", "_cut")),
        "notes": F.when(named, ex.notes("content", "_cut")),
        "availability": F.when(named, ex.availability("content", "_cut")),
        "since": F.col("_version.since"),
        "deprecated": F.col("_version.deprecated"),
        "deprecated_since": F.col("_version.deprecated_since"),
        "examples": F.when(called, ex.marked_examples("html", "content")),
        "related": F.when(kind.isin("method", "function"), ex.related("content", "element_name")),
        "base_types": F.when(kind == "type", ex.base_types("content")),
        "enum_values": F.when(kind == "enum", ex.enum_values("content", "_cut")),
        "read_only": F.when(kind == "property", only("content", READ_ONLY)),
        "write_only": F.when(kind == "property", only("content", WRITE_ONLY)),
        "members": F.when(kind == "type", F.concat(*[members("html", "content", k, n) for k, n in of_type.items()])),
    }
    d = d.select("*", *[c.alias(n) for n, c in out.items()])
    return d.select(*kept, "page_type", "title", "content", *FIELDS)


#: Columns of an element, as items() gives them.
ITEM = ("element_type", "element_name", "element_name_en", "parent_type", "content", "signature", "parameters", "return_type", "return_description", "description", "notes", "availability", "since", "examples")


def items(pages: DataFrame, with_own: bool = True) -> DataFrame:
    """(path, seq, ITEM): the elements of pages (path, html, seq), ready for the index.

    A page of an element gives it, and a type's page each member it lists. Constructors and properties without a known type are left
    out, as nothing could name them. A page without an element gives itself, its type the page's. Without `with_own` only listed members come.
    """
    r = records(pages)
    types = {f.name: f.dataType.simpleString() for f in r.schema.fields}
    parent = F.col("parent_type")
    own = {c: F.col(c) for c in ITEM} | {
        "element_type": el.routed(F.coalesce("element_type", "page_type"), parent, F.coalesce(parent, F.lit(""))),
        "element_name": F.coalesce("element_name", "title"),
        "element_name_en": F.coalesce("element_name_en", F.lit("")),
    }

    def listed(m: Column) -> Column:
        name = F.when(m["element_type"] == "constructor", "Новый").otherwise(m["name"])
        told = {"element_type": m["element_type"], "element_name": name, "element_name_en": m["name_en"], "parent_type": F.col("element_name"), "content": m["description"], "signature": m["signature"], "return_type": m["type"], "description": m["description"]}
        return F.struct(*[told.get(c, F.lit(None)).cast(types[c]).alias(c) for c in ITEM])

    none = F.array().cast(f"array<struct<{','.join(f'{c}:{types[c]}' for c in ITEM)}>>")
    told = F.coalesce(F.transform("members", listed), none)
    every = F.concat(F.array(F.struct(*[c.alias(n) for n, c in own.items()])), told) if with_own else told
    # Each page is read once: the outer form has no filter inferred, which would make every record anew below, and what is left out goes after it.
    d = r.select("path", "seq", F.explode_outer(every).alias("e")).select("path", "seq", "e.*")
    return d.filter("element_type IS NOT NULL").filter(~F.col("element_type").isin("constructor", "property") | ids.present("parent_type").isNotNull())


def exported(elements: DataFrame, version: str, source: str = "") -> DataFrame:
    """elements with `record`, JSON of what an element is: its names, parent, description, version, page, archive, details and search text."""
    full = ids.full_name("element_type", "element_name", "parent_type")
    details = F.struct("signature", "parameters", "return_type", "return_description", "notes", "availability", F.col("since").alias("since_version"), "examples")
    text = ids.search_text("element_type", "element_name", "element_name_en", full, "description", "signature", F.transform("parameters", lambda p: p["name"]), "return_type")
    parts = {
        "element_type": F.col("element_type"), "name": F.col("element_name"), "name_en": F.col("element_name_en"), "full_name": full, "parent_type": F.col("parent_type"), "description": F.col("description"),
        "platform_version": F.lit(version), "file_path": F.col("path"), "hbk_source": F.lit(source), "hbk_html_path": F.col("path"), "details": details, "search_text": text,
    }
    return elements.withColumn("record", F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"}))


def metadata(record: DataFrame) -> DataFrame:
    """records with `metadata`, JSON: the page's type, and of a function, type or enum its name, description and parts."""
    names = lambda kind: F.transform(F.filter("members", lambda m: m["element_type"] == kind), lambda m: m["name"])
    function = F.struct(F.col("element_name").alias("name"), "description", "parameters", "return_type")
    object_ = F.struct(F.col("element_name").alias("name"), "description", names("method").alias("methods"), names("property").alias("properties"))
    enum = F.struct(F.col("element_name").alias("name"), "description", F.transform("enum_values", lambda v: v["name"]).alias("values"))
    kinds = (("functions", ("function", "method"), function), ("objects", ("type",), object_), ("enums", ("enum",), enum))
    parts = [F.when(F.col("element_type").isin(*of), F.array(c)).alias(n) for n, of, c in kinds]
    return record.withColumn("metadata", F.to_json(F.struct(F.col("page_type").alias("type"), *parts)))


def counted(rows: DataFrame, name: str = "counts", **when: Column):
    """(rows, observation): the numbers of rows and of those that meet each condition, taken while any later action runs; no pass of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in when.items()]), seen


def page_counts(pages: DataFrame, least: int = 1):
    """records of pages, and their counts: pages processed, and skipped as too short or without an element."""
    r = records(pages)
    short = F.length("content") < least
    return counted(r, "pages", processed=~short & F.col("element_type").isNotNull(), skipped=short | F.col("element_type").isNull(), with_members=reduce(lambda a, b: a & b, [F.col("element_type") == "type", F.size("members") > 0]))
