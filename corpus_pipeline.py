"""A training corpus from the table of documents, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet to the shared folder and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import common, decontaminate, jaccard_join, line_dedup, mixing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least a half go on; the model learns from the labelled ones that aren't held out."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.scored(docs.select(common.packed(docs), "text"), model)
    return scored.filter("score >= 0.5").select(*common.unpacked(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines go; a document that loses all its lines goes, one that had no text stays."""
    d = line_dedup.deduped(docs.select(common.packed(docs), "doc_id", "text"))
    lost = F.col("n_removed") > 0
    n_chars = F.when(lost, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return d.filter(~lost | (F.trim("text") != "")).select(*common.unpacked(docs, text=F.col("text"), n_chars=n_chars))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, that of the least doc_id stays."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or a shorter item as a whole) go."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target asks for, with the number of the copy."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mix),
]

#: SQL can't express the classifier; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
