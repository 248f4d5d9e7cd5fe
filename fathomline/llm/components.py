"""Connected components of a graph of edges, by alternating large and small stars.

Each round replaces edges by stars around lesser nodes: two aggregations and joins over the edges, which become no more, and
a logarithmic number of rounds in practice. Rounds are stored in the shared folder; nothing comes to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Parts that the neighbours of a node are dealt to.
SALTS = 32


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least b of a; a node's edges are dealt to many tasks, and what meets at a node is one number of each."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    parts = parts.select("a", "salt", F.min("m").over(Window.partitionBy("a")).alias("m"))
    return salted.join(parts, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(a, b), any type with an order -> (node, root): each node that has an edge to another, the root being the least of its component.

    Edges to oneself and null ends don't count, repeated ones and directions don't matter. Roots have a row, too.
    """
    turned = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = C.stored(turned.distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = C.stored(small.distinct(), "edges")
        found = _state(then)
        now, done, state = then, found == state, found
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
