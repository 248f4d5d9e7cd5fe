"""Sparse, dense and rank-fused top-k search of many queries at once.

Queries are a stated, bounded set: they go out in blocks of bounded size against all rows, rows are scored block by block in numpy (Arrow
batches), and the rank limit goes before the shuffle, so a query sends at most k rows a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from fathomline.functions.text import tokens
from fathomline.sources.shared import shared_path

from . import index

RRF_K, SPARSE_BOOST = 60, 0.5
#: Queries broadcast at once.
QUERIES_A_PASS = 2000
#: Terms of queries that are looked for before tokens leave the JVM; more are looked for behind it.
TERMS_IN_PLAN = 500
#: Scores of vectors that a task holds at once: 4 MB.
SCORES_A_STEP = 1 << 19


def top(scored: DataFrame, k: int, by: str = "query_id", id_col: str = "doc_id", tie: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query with `rank` from 1; ties by `tie`, then id."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *(tie or []), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score at six places, then least id; scores that aren't finite are left out."""
    at = np.flatnonzero(np.isfinite(scores))
    s = np.floor(scores[at] * 1e6 + 0.5)
    if len(at) > k:
        bar = np.partition(s, len(s) - k)[len(s) - k]
        few = np.flatnonzero(s >= bar)
        at, s = at[few], s[few]
    return at[np.lexsort((ids[at], -s))][:k]


class Top:
    """The k best of each of n queries, over blocks of rows: all queries of a block at once."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.held = n, k, None

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: rows x queries (of the given numbers, or all); nan where there is none. Compared at six places, ties by least id."""
        s = np.floor(scores * 1e6 + 0.5)
        s[~np.isfinite(s)] = -np.inf
        bar = np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k] if len(s) > self.k else -np.inf
        row, column = np.nonzero((s >= bar) & (s > -np.inf))
        new = [column if queries is None else queries[column], ids[row], scores[row, column], s[row, column]]
        if self.held is not None:
            new = [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        q, i, _, r = new
        order = np.lexsort((i, -r, q))
        first = np.searchsorted(q[order], np.arange(self.n))
        self.held = [x[order[np.arange(len(order)) - first[q[order]] < self.k]] for x in new]

    def batch(self, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        q, ids, scores = self.held[:3] if self.held is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids).cast(id_type), pa.array(scores, pa.float64())], names=names)


def _ranked(found: DataFrame, names: list, kind: DataType, k: int, id_col: str, lone: bool = False) -> DataFrame:
    """found (_q, id, score): the k best of each task -> of all, with the queries' own ids, of type kind. lone: all rows are of the one query."""
    if lone:
        one = found.select(F.lit(names[0]).cast(kind).alias("query_id"), id_col, F.round("score", 6).alias("score"))
        return top(one, k, id_col=id_col)
    named = found.sparkSession.createDataFrame(list(enumerate(names)), StructType([StructField("_q", IntegerType()), StructField("query_id", kind)]))
    d = found.join(F.broadcast(named), "_q").select("query_id", id_col, F.round("score", 6).alias("score"))
    return top(d, k, id_col=id_col)


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", stops: list[str] | None = None, stem=None, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """queries (query_id, text): the k documents of greatest dot product of BM25 vectors; the terms' idf counts on both sides.

    Documents are tokenised once: what the queries' terms occur in each is stored, counted for the statistics (unless `stats`, from
    index.load, are given) and scored in the document's own row, so a task sends k rows a query. Queries, a stated set, go out in blocks.
    """
    asked = queries.select("query_id", tokens("text", stops, stem).alias("_t"))
    return over(asked, lambda block: _sparse_block(block, queries.schema["query_id"].dataType, docs, k, id_col, text, stops, stem, stats))


def _sparse_block(asked: list[Row], of_kind: DataType, docs, k, id_col, text, stops, stem, stats) -> DataFrame:
    spark = docs.sparkSession
    names = [r["query_id"] for r in asked]
    terms = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["_t"]}))}
    wanted = spark.sparkContext.broadcast(list(terms)) if hasattr(spark, "sparkContext") else None
    kind = docs.schema[id_col].dataType.simpleString()

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.array(wanted.value if wanted else list(terms), pa.string())
        for batch in index.cut(batches):
            at = pc.index_in(batch.column("_t").flatten().cast(pa.string()), of).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(batch.column("_t")).to_numpy()
            key, count = np.unique((row * len(terms) + at)[at >= 0], return_counts=True)
            has, first = np.unique(key // max(len(terms), 1), return_index=True)
            cuts = pa.array(np.append(first, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % max(len(terms), 1)).astype(np.int32), count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(has)), *lists], names=[id_col, "t", "tf"])

    found = tokens(text, stops, stem)
    if len(terms) <= TERMS_IN_PLAN:
        found = F.filter(found, lambda t: t.isin(list(terms)))
    held = docs.select(id_col, found.alias("_t")).mapInArrow(occur, f"{id_col} {kind}, t array<int>, tf array<long>")
    path = shared_path(spark, "query-postings")
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    df = np.zeros(len(terms))
    if stats is None:
        total = docs.count()
        for r in held.select(F.explode("t").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
    else:
        total = stats[1].first()["total_docs"]
        known = spark.createDataFrame(list(terms.items()), "term string, t int")
        for r in stats[0].join(F.broadcast(known), "term").select("t", "df").collect():
            df[r["t"]] = r["df"]
    idf = np.where(df > 0, np.log((total - df + 0.5) / (df + 0.5) + 1.0), 0.0)
    k1 = index.K1
    weigh = lambda t, tf: idf[t] * tf * (k1 + 1) / (tf + k1)
    # Postings of the queries: for each term, which query it is in and with what weight.
    rows = sorted((terms[t], j, n) for j, r in enumerate(asked) for t, n in Counter(r["_t"]).items())
    term, query, count = (np.array([x[i] for x in rows], dtype=np.int64) for i in range(3))
    own, starts = weigh(term, count.astype(float)), np.searchsorted(term, np.arange(len(terms) + 1))
    lists, n = (starts, query, own), len(names)
    step = max(1, (1 << 21) // max(n, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, query, own = lists
        best, id_type = Top(n, k), None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                lens = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                t = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                w = weigh(t, batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float))
                doc = np.repeat(np.arange(batch.num_rows), lens)
                times = starts[t + 1] - starts[t]
                # A document's term meets every query that has it.
                at = np.repeat(starts[t] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                pair = np.repeat(doc, times) * n + query[at]
                total = np.bincount(pair, np.repeat(w, times) * own[at], batch.num_rows * n).reshape(batch.num_rows, n)
                best.add(batch.column(0).to_numpy(zero_copy_only=False), np.where(total > 0, total, np.nan))
        if id_type is not None:
            yield best.batch(["_q", id_col, "score"], id_type)

    return _ranked(held.mapInArrow(score, f"_q int, {id_col} {kind}, score double"), names, of_kind, k, id_col)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """queries (query_id, query): the k rows of greatest cosine of each query; exact. Vectors without length or of another size than the query's have none.

    Queries, a stated set, go out in blocks as a matrix of unit rows; a batch of rows is scored in one product, and a task sends k rows a query.
    """
    asked = queries.filter("query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("query"))
    return over(asked, lambda block: _dense_block(block, queries.schema["query_id"].dataType, rows, k, id_col, embedding))


def _dense_block(asked: list[Row], of_kind: DataType, rows, k, id_col, embedding) -> DataFrame:
    asked = [r for r in asked if r["query"] and None not in r["query"]]
    kind = rows.schema[id_col].dataType.simpleString()
    names = [r["query_id"] for r in asked]
    sizes = sorted({len(r["query"]) for r in asked})
    unit = {}
    for d in sizes:
        at = [j for j, r in enumerate(asked) if len(r["query"]) == d]
        m = np.array([asked[j]["query"] for j in at])
        norm = np.sqrt((m * m).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit[d] = np.array(at), m / norm[:, None]

    # Rows that are scored at once.
    step = max(1, SCORES_A_STEP // max(len(names), 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = Top(len(names), k), None
        for batch in (whole.slice(first, step) for whole in batches for first in range(0, max(whole.num_rows, 1), step)):
            id_type = batch.schema.field(0).type
            lens = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d, (at, queries) in unit.items():
                own = batch.filter(pa.array(lens == d))
                if own.num_rows:
                    m = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    ids = own.column(0).to_numpy(zero_copy_only=False)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        m = m / np.sqrt((m * m).sum(axis=1))[:, None]
                    scores = np.full((len(ids), len(names)), np.nan)
                    scores[:, at] = m @ queries.T
                    best.add(ids, scores)
        if id_type is not None:
            yield best.batch(["_q", id_col, "score"], id_type)

    found = rows.select(id_col, embedding).filter(F.col(embedding).isNotNull()).mapInArrow(score, f"_q int, {id_col} {kind}, score double")
    return _ranked(found, names, of_kind, k, id_col)


def over(queries: DataFrame, search, size: int = QUERIES_A_PASS) -> DataFrame:
    """search(rows of queries), once for a set of up to `size`, which is computed once; else over blocks of about that many."""
    some = queries.limit(size + 1).collect()
    if len(some) <= size:
        return search(some)
    n = -(-queries.count() // size)
    return reduce(DataFrame.unionByName, [search(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()) for i in range(n)])


def in_blocks(queries: DataFrame, search, size: int = QUERIES_A_PASS) -> DataFrame:
    """search(block of queries), over blocks of at most about `size` queries: a larger set takes more passes, not more memory."""
    n = -(-queries.count() // size)
    if n <= 1:
        return search(queries)
    return reduce(DataFrame.unionByName, [search(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)])


def rrf(sparse: DataFrame, dense: DataFrame, k: int = 10, boost: float = SPARSE_BOOST, constant: int = RRF_K, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, score, rank): (query_id, id, score, rank, sparse_rank, dense_rank).

    Ties by sparse, then dense rank. Where a query has rows on one side only, that side's own scores and order are returned.
    """
    both = sparse.select("query_id", id_col, F.col("rank").alias("sparse_rank"), F.lit(None).cast("int").alias("dense_rank"), F.col("score").alias("_s")).unionByName(
        dense.select("query_id", id_col, F.lit(None).cast("int").alias("sparse_rank"), F.col("rank").alias("dense_rank"), F.col("score").alias("_s"))
    )
    one = both.groupBy("query_id", id_col).agg(F.max("sparse_rank").alias("sparse_rank"), F.max("dense_rank").alias("dense_rank"), F.max("_s").alias("_s"))
    per = Window.partitionBy("query_id")
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    fused = part("sparse_rank", float(boost)) + part("dense_rank", 1.0)
    d = one.withColumn("_ns", F.count("sparse_rank").over(per)).withColumn("_nd", F.count("dense_rank").over(per))
    d = d.withColumn("score", F.round(F.when((F.col("_ns") == 0) | (F.col("_nd") == 0), F.col("_s")).otherwise(fused), 6))
    tie = [F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("dense_rank")]
    return top(d, k, id_col=id_col, tie=tie).select("query_id", id_col, "score", "rank", "sparse_rank", "dense_rank")


def hybrid(
    queries: DataFrame, docs: DataFrame | None, rows: DataFrame, k: int = 10, boost: float = SPARSE_BOOST, stops: list[str] | None = None, id_col: str = "doc_id", stem=None,
    stats: tuple[DataFrame, DataFrame] | None = None, index=None, constant: int = RRF_K,
) -> DataFrame:
    """queries (query_id, text, query), docs (id, text), rows (id, embedding): sparse and dense top-k, fused. The queries are computed once.

    A query without known terms gets the dense list, one without a vector the sparse list. index: stored postings (inverted.Inverted) to search
    instead of docs; they have to be built with the same stops and stem.
    """
    kind = queries.schema["query_id"].dataType
    asked = queries.select("query_id", tokens("text", stops, stem).alias("_t"), F.col("query").cast("array<double>").alias("query"))

    def both(block: list[Row]) -> DataFrame:
        sparse = _sparse_block(block, kind, docs, k, id_col, "text", stops, stem, stats) if index is None else index.of_tokens(block, kind, k, id_col)
        return rrf(sparse, _dense_block(block, kind, rows, k, id_col, "embedding"), k, boost, constant, id_col=id_col)

    return over(asked, both)


def overfetched(hits: DataFrame, query: str, names: list[str], limit: int) -> DataFrame:
    """Of ranked hits those one of whose names has the query in it, in any case; the first `limit` in their order.

    How many to fetch first: fetch_size(). The fetch is a limit before the filter, so neither moves past the other.
    """
    low = query.lower()
    has = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(n)).contains(low), F.lit(False)) for n in names])
    return hits.filter(has).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= limit)


def fetch_size(query: str, limit: int) -> int:
    """Five times the limit for queries of up to eight characters, else three times."""
    return limit * (5 if len(query) <= 8 else 3)


def query_tokens(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select("query_id", tokens(text).alias("tokens"))
