"""Line dedup by overlapping windows of three lines.

Each three consecutive lines are hashed (128 bits). A window that an earlier document, or an earlier place of its own,
already has is a later occurrence; the lines that later occurrences cover are removed. Nothing is gathered by window: the
first occurrence is a minimum, taken before and after the shuffle, and is told to its later occurrences in salted parts, so a window
that a third of all documents has goes to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .mixing import LEAST_ID

LINES = 3
#: Parts that the occurrences of a window are dealt to.
SALTS = 32


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _sid and _doc (id and contents), and _nth, which numbers rows that share both."""
    return docs.withColumn("_sid", F.coalesce("doc_id", F.lit(LEAST_ID))).withColumn("_doc", C.row_key("doc_id", "text"))


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_sid, _doc, at, h1, h2): each window of lines (white space at their ends apart) that isn't blank throughout."""
    d = _keyed(docs).select("_sid", "_doc", F.expr("transform(split(text, '\\n', -1), l -> btrim(l, ' \\t\\r'))").alias("l"))
    # The condition stands inside the expression, as filters may be put in another order.
    each = d.select("_sid", "_doc", F.expr(f"IF(size(l) >= {lines}, transform(sequence(0, size(l) - {lines}), i -> array_join(slice(l, i + 1, {lines}), '\\n')), NULL)").alias("w"))
    # The outer form: the plain one infers a filter on the array's size, which is pushed below and builds every window anew for each line.
    return each.select("_sid", "_doc", F.posexplode_outer("w").alias("at", "w")).filter(f"length(w) > {lines - 1}").select(
        "_sid", "_doc", "at", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("wide"), "w").alias("h2")
    )


def later(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_sid, _doc, starts): places of the windows, of each document that has some, that occur before.

    Before: in a document of a lesser doc_id (null is least; equal ids go by contents), or further up in the same one.
    """
    every = windows(docs, lines).withColumn("salt", F.pmod("_doc", F.lit(SALTS)).cast("int"))
    parts = every.groupBy("h1", "h2", "salt").agg(F.min(F.struct("_sid", "_doc", "at")).alias("first"), F.count("*").alias("n"))
    # At most SALTS rows a window.
    whole = Window.partitionBy("h1", "h2")
    firsts = parts.select("h1", "h2", "salt", F.min("first").over(whole).alias("first"), F.sum("n").over(whole).alias("n")).filter("n > 1").drop("n")
    again = every.join(firsts, ["h1", "h2", "salt"]).filter(F.struct("_sid", "_doc", "at") != F.col("first"))
    return again.groupBy("_sid", "_doc").agg(F.collect_set("at").alias("starts"))


def deduped(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with text less the lines that later occurrences cover, and n_lines, n_removed (long).

    The first occurrence of everything stays. Texts of fewer than three lines, empty ones and nulls stay as they are. Of rows equal in
    id and text all but one are later occurrences as a whole: they keep no line if they have three. A column of docs that has
    an output's name is replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = _keyed(docs.select(C.packed(docs), "doc_id", "text")).drop("doc_id")
    found = later(docs, lines)
    d = keyed.join(found, ["_sid", "_doc"], "left")
    # Rows that share id and contents share their windows, too: number them; only they have a number over 1.
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_sid", "_doc").orderBy(F.lit(0))))
    hit = F.col("starts").isNotNull() | (F.col("_nth") > 1)
    d = d.withColumn("_l", F.when(hit, F.split("text", "\n", -1)))
    # Covered places are merged into runs as they come; what lies between runs is kept.
    merged = f"""aggregate(array_sort(coalesce(starts, cast(array() AS array<int>))), named_struct('at', 0, 'parts', cast(array() AS array<array<string>>)),
        (a, s) -> IF(s < a.at, named_struct('at', s + {lines}, 'parts', a.parts),
                     named_struct('at', s + {lines}, 'parts', concat(a.parts, array(slice(_l, a.at + 1, s - a.at))))),
        a -> flatten(concat(a.parts, array(slice(_l, a.at + 1, size(_l))))))"""
    whole = (F.col("_nth") > 1) & (F.size("_l") >= lines)
    d = d.withColumn("_kept", F.when(whole, F.expr("cast(array() AS array<string>)")).when(hit, F.expr(merged)))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    d = d.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed", F.coalesce(F.size("_l") - F.size("_kept"), F.lit(0)).cast("long"))
    d = d.withColumn("text", F.when(F.col("n_removed") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text")))
    return d.select(*C.unpacked(docs, text=F.col("text")), "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and the text that is left."""
    return deduped(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
