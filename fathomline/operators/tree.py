"""Trees of rows (id, parent_id) by pointer doubling: each round doubles how far up a row sees, so rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.sources.shared import shared_path


def _stored(df: DataFrame, what: str) -> DataFrame:
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def paths(rows: DataFrame, root: int = 0) -> DataFrame:
    """(id, parent_id, level, path): every way from the root down to a row; ids joined with /, level 0 for the root's own children.

    Rows that the root doesn't lead to are left out, circles among them, too; so are rows with a null. A repeated id has a path for each way to it. An id
    that is its own ancestor on a way from the root is an error.
    """
    up = F.when(F.col("parent_id") != F.lit(root), F.col("parent_id"))
    d = rows.filter("id IS NOT NULL AND parent_id IS NOT NULL").select("id", "parent_id", up.alias("up"), F.col("id").cast("string").alias("path"), F.lit(1).alias("n"))
    turns = F.size(F.array_distinct(F.split("path", "/"))) < F.col("n")
    d, left = _stored(d, "tree-paths"), None
    while True:
        done, on = d.filter("up IS NULL"), d.filter("up IS NOT NULL")
        if not done.filter("path IS NULL").isEmpty():
            raise ValueError("contents go round in a circle")
        left = d.count().bit_length() + 2 if left is None else left - 1
        if not left or on.isEmpty():  # what is still on its way by then is in a circle that the root doesn't lead to
            return done.select("id", "parent_id", (F.col("n") - 1).alias("level"), "path")
        above = d.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("n").alias("_n"))
        on = on.join(above, "up").select("id", "parent_id", F.col("_up").alias("up"), F.concat("_path", F.lit("/"), "path").alias("path"), (F.col("n") + F.col("_n")).alias("n"))
        # A stretch that has an id twice loses its path: it is no way, but the root may lead to it.
        round_ = F.col("path").isNull() | turns
        lost = on.filter(round_).select("id", "parent_id", "up", F.lit(None).cast("string").alias("path"), F.lit(0).alias("n")).distinct()
        d = _stored(done.unionByName(on.filter(~round_)).unionByName(lost), "tree-paths")


def totals(rows: DataFrame, root: int = 0, value: str | None = None) -> DataFrame:
    """(id, parent_id, level, n_below, total): of each row that the root leads to, how many rows are below it, and the sum of `value` over it and them.

    Ids are unique (others are refused). Rows with a null id or parent, and those that the root doesn't lead to, are left out and count nowhere.
    Each round a row takes what the rows 2**k below it have gathered of as many levels.
    """
    own = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    up = F.when(F.col("parent_id") != F.lit(root), F.col("parent_id"))
    d = rows.filter("id IS NOT NULL AND parent_id IS NOT NULL").select("id", "parent_id", up.alias("up"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n_below"), own.alias("total"))
    # First who is reached, and how far down: the same doubling without what is below.
    seen = _stored(d.select("id", "up", "level"), "tree-levels")
    size = seen.count()
    if seen.select("id").distinct().count() < size:
        raise ValueError("ids repeat")
    for _ in range(max(1, size.bit_length()) + 1):
        if seen.filter("up IS NOT NULL").isEmpty():
            break
        above = seen.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        j = seen.join(above, F.col("up") == F.col("_id"), "left").filter("up IS NULL OR _id IS NOT NULL")
        seen = _stored(j.select("id", F.when(F.col("up").isNotNull(), F.col("_up")).alias("up"), F.when(F.col("up").isNotNull(), F.col("level") + F.col("_level") + 1).otherwise(F.col("level")).alias("level")), "tree-levels")
    levels = seen.filter("up IS NULL").select("id", "level")  # circles never come to an end
    d = _stored(d.drop("level").join(levels, "id"), "tree-totals")
    while not d.filter("up IS NOT NULL").isEmpty():
        gathered = d.filter("up IS NOT NULL").groupBy(F.col("up").alias("_of")).agg(F.sum(F.col("n_below") + 1).alias("_n"), F.sum("total").alias("_t"))
        above = d.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        j = d.join(gathered, F.col("id") == F.col("_of"), "left").join(above, F.col("up") == F.col("_id"), "left")
        d = _stored(
            j.select("id", "parent_id", F.col("_up").alias("up"), (F.col("n_below") + F.coalesce("_n", F.lit(0))).alias("n_below"), (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"), "level"), "tree-totals"
        )
    return d.select("id", "parent_id", "level", "n_below", "total")
