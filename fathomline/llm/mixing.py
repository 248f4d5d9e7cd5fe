"""Mixing sources to target weights by systematic sampling.

Within a source each document is expected target / size times. Documents are put in order (largest first, so that what is
taken varies by about one document), the expected copies are added up along it, one offset a source shifts the sum, and a
document is emitted once for each integer that its step crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
LEAST_ID = -(1 << 63)


def size(text: str = "text") -> Column:
    """Words of a text; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the source's place from 1."""
    return (rank - 1) % 3 + 1


def targets(sources: DataFrame, weight=default_weight, most: int = 3) -> DataFrame:
    """(source, source_size) -> also target: shares by weight of all words, none over `most` times its source's words.

    What a full source can't take is shared by weight among the others, until none is above: in the order of most * size /
    weight the full sources come first, and the first that isn't full gives the share of one unit of weight. One row a
    source, so the windows over all of them are small.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    d = sources.withColumn("_weight", weight(F.row_number().over(by_name)).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") * most / F.col("_weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    d = (
        d.withColumn("_before", F.coalesce(F.sum(F.col("source_size") * most).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_unit", (F.col("_all") - F.col("_before")) / F.col("_rest"))
        .withColumn("_place", F.row_number().over(by_ratio))
        .withColumn("_open", F.col("source_size") * most / F.col("_weight") > F.col("_unit"))
    )
    unit = F.min(F.when(F.col("_open"), F.struct("_place", "_unit"))).over(everything)["_unit"]
    cap = (F.col("source_size") * most).cast("double")
    return d.withColumn("_share", unit * F.col("_weight")).select("source", "source_size", F.coalesce(F.least(cap, "_share"), cap).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) a source; null is a source of its own."""
    named = F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("n"))))
    return F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / 4294967296.0


def ranked(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """rows, stored, with their place from 1 by `order` within their group.

    Sorted by ranges over group and order together, so a hot group spreads over many tasks; a place is the one within the
    range plus what the ranges before hold of the group, which are a few numbers a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_last(group), *order]
    at = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = C.stored(at, "ranked").withColumn("_range", F.shiftright("_at", 33))
    runs = at.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed(group, "_g").withColumnRenamed("_range", "_r")
    # A run is a range's part of a group: with few groups about as many runs as ranges, else Spark shuffles both sides.
    return at.join(runs, (at["_range"] == runs["_r"]) & at[group].eqNullSafe(runs["_g"])).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop(
        "_at", "_range", "_r", "_g", "_first", "_n", "_before"
    )


def plan(docs: DataFrame, weight=default_weight, most: int = 3, seed: int = 1) -> DataFrame:
    """Per row of docs: doc_id, doc (key of its contents), source, size, source_size, target, copies.

    Order within a source: size, largest first, then doc_id, then contents; so reruns agree. A source without words has target 0
    and takes nothing; null is a source of its own, null texts have no words. Repeated rows are sampled apart, and may get
    different numbers of copies. Other columns of docs don't matter.
    """
    rows = docs.select("doc_id", C.row_key("doc_id", "source", "text").alias("doc"), "source", size().alias("size"))
    at = ranked(rows, "source", [F.desc("size"), F.asc("doc_id"), F.asc("doc")])
    totals = targets(at.groupBy("source").agg(F.sum("size").alias("source_size")), weight, most).withColumnRenamed("source", "_s")
    each = at.join(totals, at["source"].eqNullSafe(totals["_s"])).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = lambda k: F.floor(rate * k + offset(F.col("source"), seed))
    return each.withColumn("copies", step(F.col("rank")) - step(F.col("rank") - 1)).drop("rank")


def mixed(docs: DataFrame, weight=default_weight, most: int = 3, seed: int = 1) -> DataFrame:
    """docs, each row as many times as the plan says, with `copy` from 1 (a column of that name is replaced); rows of no copies go."""
    planned = plan(docs, weight, most, seed)
    sid = F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_sid")
    # Rows alike in every key get their numbers of copies in any order.
    numbers = planned.groupBy(sid, F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    keyed = docs.select(C.packed(docs), sid, C.row_key("doc_id", "source", "text").alias("_doc"))
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_sid", "_doc").orderBy(F.lit(0))))
    copies = F.element_at("_copies", F.col("_nth"))
    return keyed.join(numbers, ["_sid", "_doc"]).filter(copies > 0).select(
        *C.unpacked(docs.drop("copy")), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")
    )


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return plan(docs, seed=seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
