"""Tables of a warehouse folder: one partition a version; default version; upserts.

Without a table format that merges, an upsert rewrites the partitions it touches (dynamic partition overwrite).
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION = "platform_version"


class Catalog:
    """The element tables below a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame | None:
        """The table; None where nothing is at its path. Every other fault is an error, so that no table is taken for a missing one and made anew."""
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def tables(self) -> list[str]:
        """Names of the tables, sorted."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []
        return sorted(n for n in names if n != "settings" and not n.startswith(("_", ".")))

    def exists(self, name: str, version: str | None = None) -> bool:
        df = self.read(name)
        return df is not None and (version is None or not df.filter(F.col(VERSION) == version).isEmpty())

    def ensure(self, name: str, rows: DataFrame, recreate: bool = False) -> None:
        """A table with the columns of rows; one with others is an error, unless it is to be made anew."""
        there = self.read(name)
        if there is None or (recreate and set(there.columns) != set(rows.columns)):
            rows.limit(0).write.mode("overwrite").partitionBy(VERSION).parquet(self.path(name))
        elif set(there.columns) != set(rows.columns):
            raise ValueError(f"{name} has columns {sorted(there.columns)}")

    def upsert(self, name: str, rows: DataFrame, id_col: str = "id", seq: str | None = None) -> None:
        """Put rows in: of one id the new one, of several new ones that of the greatest `seq`, stay. Only versions that rows have are rewritten."""
        there = self.read(name)
        new = rows.withColumn("_new", F.lit(1)).withColumn("_seq", F.col(seq) if seq else F.lit(0))
        if there is not None:
            versions = rows.select(VERSION).distinct()
            old = there.join(F.broadcast(versions), VERSION, "left_semi").withColumn("_new", F.lit(0)).withColumn("_seq", F.col(seq) if seq else F.lit(0))
            new = old.unionByName(new)
        done = last_wins(new, [VERSION, id_col], ["_new", "_seq"]).drop("_new", "_seq")
        if there is None:
            done.write.partitionBy(VERSION).parquet(self.path(name))
            return
        # What is read is replaced: write beside it first.
        done.write.mode("overwrite").partitionBy(VERSION).parquet(self.path(f"_{name}.next"))
        self.spark.read.parquet(self.path(f"_{name}.next")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(VERSION).parquet(self.path(name))
        self.remove(f"_{name}.next")

    def remove(self, name: str, version: str | None = None) -> None:
        """Delete a table, or one version of it."""
        jvm, at = self.spark._jvm, self.path(name) + (f"/{VERSION}={version}" if version else "")
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def info(self, name: str) -> DataFrame:
        """(platform_version, points_count, vectors_count)."""
        df = self.read(name)
        if df is None:
            return self.spark.createDataFrame([], f"{VERSION} string, points_count long, vectors_count long")
        return df.groupBy(F.col(VERSION).cast("string").alias(VERSION)).agg(F.count("*").alias("points_count"), F.count("*").alias("vectors_count"))

    def default_version(self) -> str | None:
        """The version that is set; None without one, or with settings that can't be read."""
        try:
            rows = self.spark.read.text(self.path("settings"), wholetext=True).collect()
            return json.loads(rows[0][0]).get(VERSION) if rows else None
        except (AnalysisException, ValueError):
            return None

    def set_default_version(self, version: str | None) -> None:
        if version is None:
            self.remove("settings")
        else:
            self.spark.createDataFrame([(json.dumps({VERSION: version}),)], "value string").coalesce(1).write.mode("overwrite").text(self.path("settings"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the one of the greatest order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def status(available: DataFrame, indexed: DataFrame) -> DataFrame:
    """available (version) with points_count and whether it is indexed; indexed has (version, points_count)."""
    return available.join(indexed, "version", "left").select("version", F.coalesce("points_count", F.lit(0)).alias("points_count"), F.col("points_count").isNotNull().alias("indexed"))


def not_indexed(available: DataFrame, indexed: DataFrame) -> DataFrame:
    return available.join(indexed, "version", "left_anti")


def version_dirs(spark: SparkSession, root: str, glob: str = "*_ru.{hbk,res}") -> DataFrame:
    """(version, path, n_files): folders with archives whose names are versions, as Spark's reader lists them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length")
    from fathomline.functions.versions import normalized

    folder = F.regexp_extract("path", r"/(\d+[._]\d+[._]\d+[^/]*)/", 1)
    return files.filter(folder != "").groupBy(normalized(folder).alias("version"), folder.alias("folder")).agg(F.count("*").alias("n_files"))
