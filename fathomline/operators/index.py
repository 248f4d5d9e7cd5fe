"""Term statistics of a corpus: postings, document frequencies, BM25 weights.

All are aggregations with partial ones before the shuffle; statistics of parts add up. Vocabulary never comes to the driver.
Documents are tokenised once, and their postings gathered block by block where they are read: what is shuffled is a row a term and block, not one a posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from fathomline.functions.text import tokens

K1 = 1.5
#: Tokens of a block, about; a document isn't cut.
BLOCK_TOKENS = 1 << 21


def token_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by..., id, term): one row a token."""
    return docs.select(*(by or []), id_col, F.explode_outer(tokens(text, stops, stem)).alias("term")).filter("term IS NOT NULL")


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by..., id, term, tf). Counted inside each document's row, so nothing is shuffled."""
    ts = F.sort_array(tokens(text, stops, stem))
    # Runs of a sorted array: a term's count is the distance between its first places and the next term's.
    d = docs.select(*(by or []), id_col, ts.alias("_t")).withColumn(
        "_p", F.expr("filter(transform(_t, (t, i) -> IF(i = 0 OR t != _t[i - 1], named_struct('term', t, 'at', i), NULL)), x -> x IS NOT NULL)")
    )
    # The outer form: the plain one infers a filter on the array's size, which is pushed below and sorts the tokens anew for each of them.
    return d.select(*(by or []), id_col, F.explode_outer(F.expr("transform(_p, (x, i) -> named_struct('term', x.term, 'tf', CAST(IF(i + 1 < size(_p), _p[i + 1].at, size(_t)) - x.at AS BIGINT)))")).alias("_x")).select(
        *(by or []), id_col, "_x.term", "_x.tf"
    ).filter("term IS NOT NULL")


def blocks(docs: DataFrame, keep: list[str], text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by..., term, tf, keep...): the same postings, gathered: of a block of documents, a row a term and frequency, with the kept columns of all its documents as arrays of one order."""
    by = by or []
    # Stop-words are left out of a block's terms, not of each document's tokens; before stems they have to be.
    d = docs.select(*by, *keep, tokens(text, stops if stem else None, stem).alias("_t"))
    kind = StructType([*(d.schema[c] for c in by), StructField("term", StringType()), StructField("tf", IntegerType()), *(StructField(c, ArrayType(d.schema[c].dataType)) for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            row, code, tf, terms = _counted(b)
            if stops and not stem:
                own = ~pc.is_in(terms, value_set=pa.array(stops, terms.type)).to_numpy(zero_copy_only=False)[code]
                row, code, tf = row[own], code[own], tf[own]
            # By value, term and frequency: what is equal in all three is one row.
            key = (code * (group := _groups(b, by)).shape[0] + group[row]) * (int(tf.max(initial=0)) + 1) + tf
            order = np.argsort(key, kind="stable")
            key, row, code, tf = (x[order] for x in (key, row, code, tf))
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            cuts, at = pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(row)
            own = [b.column(c).take(pa.array(row[first])) for c in by]
            lists = [pa.ListArray.from_arrays(cuts, b.column(c).take(at)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, terms.take(pa.array(code[first])), pa.array(tf[first].astype(np.int32)), *lists], names=[*by, "term", "tf", *keep])

    return d.mapInArrow(run, kind)


def frequencies(docs: DataFrame, text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by..., term, df, tokens) in one pass: how many documents have a term, and how often; of the null term all documents and their tokens."""
    by = by or []
    d = docs.select(*by, tokens(text, stops, stem).alias("_t"))
    kind = StructType([*(d.schema[c] for c in by), StructField("term", StringType()), StructField("df", LongType()), StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            row, code, tf, terms = _counted(b)
            group = _groups(b, by)
            # Places of the by-values' first documents, to read them from.
            value, first = np.unique(group, return_index=True)
            key, place = np.unique(code * len(group) + group[row], return_inverse=True)
            n = np.bincount(pc.list_parent_indices(b.column("_t")).to_numpy(), minlength=len(group))
            all_docs, all_tokens = np.bincount(group), np.bincount(group, n)
            at = pa.array(np.concatenate((first, first[np.searchsorted(value, key % len(group))])))
            named = pa.concat_arrays([pa.nulls(len(value), pa.string()), terms.take(pa.array(key // len(group))).cast(pa.string())])
            df, sums = np.concatenate((all_docs[value], np.bincount(place, minlength=len(key)))), np.concatenate((all_tokens[value], np.bincount(place, tf, len(key))))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in by), named, pa.array(df.astype(np.int64)), pa.array(sums.astype(np.int64))], names=[*by, "term", "df", "tokens"])

    return d.mapInArrow(run, kind).groupBy(*by, "term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents (_t: tokens), of about BLOCK_TOKENS."""
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.list_value_length(b.column("_t")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        starts = np.flatnonzero(np.diff(n // BLOCK_TOKENS, prepend=-1)) if len(n) else np.zeros(0, np.int64)
        for i, j in zip(starts, np.append(starts, b.num_rows)[1:], strict=True):
            yield b.slice(i, j - i)


def _counted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A block's postings, by term and document: the document's row, the term's number, its frequency; and the terms of the numbers."""
    found = b.column("_t").flatten().dictionary_encode()
    key = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * b.num_rows + pc.list_parent_indices(b.column("_t")).to_numpy()
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    return key[first] % b.num_rows, key[first] // b.num_rows, tf, found.dictionary


def _groups(b: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """A number for each row, equal where all columns of `by` are, nulls too; below the number of rows."""
    out = np.zeros(b.num_rows, np.int64)
    for c in by:
        d = b.column(c).dictionary_encode(null_encoding="encode")
        out = np.unique(out * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def term_stats(posts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., term, df)."""
    return posts.groupBy(*(by or []), "term").agg(F.count("*").alias("df"))


def merged(parts: DataFrame) -> DataFrame:
    """Statistics of disjoint parts, added up."""
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by..., total_docs, avg_doc_length); one row without `by`."""
    n = F.size(tokens(text, stops, stem))
    return docs.groupBy(*(by or [])).agg(F.count("*").alias("total_docs"), F.avg(n).alias("avg_doc_length"))


def vocabulary(stats: DataFrame) -> DataFrame:
    """(term, term_index): places from 0 in code-point order.

    Ranges of terms are sorted apart and shifted by the counts of the ranges before, so no task sees the whole vocabulary.
    """
    n = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stats.select("term").distinct().repartitionByRange(n, "term").sortWithinPartitions("term").withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    # A few rows a range: one number each, whatever the vocabulary.
    counts = at.groupBy("_range").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return at.join(F.broadcast(counts), "_range").select("term", (F.col("_in") + F.col("_before")).cast("long").alias("term_index"))


def idf(total: str | Column = "total_docs", df: str | Column = "df") -> Column:
    total, df = (F.col(c) if isinstance(c, str) else c for c in (total, df))
    return F.log((total - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weight(k1: float = K1, b: float = 0.0) -> Column:
    """BM25 weight of (tf, df, total_docs). The engine's own search has no length normalisation (b = 0); with b, doc_length and avg_doc_length are used."""
    tf = F.col("tf").cast("double")
    length = F.lit(k1) if b == 0 else F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_length") / F.col("avg_doc_length"))
    return idf() * (tf * F.lit(k1 + 1)) / (tf + length)


def weights(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None, b: float = 0.0, digits: int | None = None) -> DataFrame:
    """(by..., id, term, weight) of all documents, rounded to `digits` if given; statistics are those of each value of `by`.

    Without lengths a weight is a term's and a frequency's, the same in all documents: it is computed for gathered postings, which are shuffled once, and handed to the documents last.
    """
    rounded = lambda d: d.withColumn("weight", F.round("weight", digits)) if digits is not None else d
    if b:
        posts = postings(docs, id_col, text, by, stops, stem)
        return rounded(weighted(posts, term_stats(posts, by), corpus_stats(docs, text, by, stops, stem), id_col, by, b))
    # Documents of one value of `by` side by side: else a block has few of each, and its rows gather next to nothing. By id too, as one value may have most of them.
    near = docs.select(*by, id_col, text).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, id_col) if by else docs
    # The term first: rows of one `by` are told apart by the first bytes that the sort compares.
    d = blocks(near, [id_col], text, by, stops, stem).withColumn("df", F.sum(F.size(id_col)).over(Window.partitionBy("term", *(by or []))))
    # One row a value of `by`: sent out, so that postings aren't gathered by it.
    totals = F.broadcast(docs.groupBy(*(by or [])).agg(F.count("*").alias("total_docs")))
    d = d.join(totals, by) if by else d.crossJoin(totals)
    return rounded(d.withColumn("weight", weight()).filter("weight > 0")).select(*(by or []), F.explode(id_col).alias(id_col), "term", "weight")


def weighted(posts: DataFrame, stats: DataFrame, totals: DataFrame, id_col: str = "doc_id", by: list[str] | None = None, b: float = 0.0) -> DataFrame:
    """(by..., id, term, weight) of postings by statistics at hand; terms that the statistics don't have are left out. totals: one row a value of `by`."""
    d = posts.join(stats, [*(by or []), "term"])
    d = d.join(totals, by) if by else d.crossJoin(F.broadcast(totals))
    if b:
        d = d.withColumn("doc_length", F.sum("tf").over(Window.partitionBy(*(by or []), id_col)))
    return d.withColumn("weight", weight(b=b)).filter("weight > 0").select(*(by or []), id_col, "term", "weight")


def save(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", by: list[str] | None = None, stops: list[str] | None = None, stem=None) -> None:
    """Build the statistics of a corpus and keep them: path/terms (by..., term, df) and path/totals (by..., total_docs, avg_doc_length).

    A corpus without documents is refused, as nothing could be weighed by it; what is at the path is replaced.
    """
    found = frequencies(docs, text, by, stops, stem).persist()
    try:
        totals = found.filter("term IS NULL").select(*(by or []), F.col("df").alias("total_docs"), (F.col("tokens") / F.col("df")).alias("avg_doc_length"))
        if totals.isEmpty():
            raise ValueError("a corpus without documents has no statistics")
        found.filter("term IS NOT NULL").select(*(by or []), "term", "df").write.mode("overwrite").parquet(f"{path}/terms")
        totals.write.mode("overwrite").parquet(f"{path}/totals")
    finally:
        found.unpersist()


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The statistics that `save` kept: (terms, totals)."""
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals")
