"""A stored inverted index: postings on disk by term, with block maxima, and top-k search that reads the queried terms alone.

Layout. Documents belong to a shard and, in it, to a cell of about 128, both by a hash of their id. A row of `postings` is a term in a shard: how many
of its documents have it, and its blocks, one a cell, each with ids, term frequencies and the greatest of them. So a common term is many rows,
none larger than a shard. Rows lie in folders by a hash of the term, sorted by term within a file: a query's folders are picked when it is
planned, its row groups by the terms' least and greatest values. Postings are dealt out once, by folder and group of shards.

Search. All rows of a shard that a query needs meet in one task. A cell can't give more than the sum of its blocks' bounds; cells are taken from the
highest bound down, scored exactly, and the rest is left out once the k-th score is above what they could reach. Results are those of a full scan.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StructField, StructType

from fathomline.functions.text import tokens

from . import index, search

SHARD_DOCS, CELL_DOCS = 1 << 16, 128
#: Terms up to this many are a list in the scan's filter; more are joined to it, with the same folders picked.
TERMS_IN_FILTER = 2000
#: A file is one task's sort: some 150 MB of gathered postings.
POSTINGS_A_FILE, CHARS_A_POSTING, LEAST_BUCKETS, MOST_BUCKETS, MOST_TASKS = 4_000_000, 8, 8, 4096, 10_000
#: Shards whose postings travel together, so that lists stay long however many shards there are: a term's are 2 million at most.
SHARDS_A_SPAN = 32
#: Postings, about, that are put in order at once.
POSTINGS_A_STEP = 1 << 20
#: Cells that are scored before the bar is looked at again.
CELLS_A_STEP = 16


def bucket(term, n: int):
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def build(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", stops: list[str] | None = None, stem=None, shard_docs: int = SHARD_DOCS, cell_docs: int = CELL_DOCS, buckets: int | None = None
) -> None:
    """Write the index of docs below path: postings and totals. What is there is replaced.

    Each id has one text: of rows with the same id, all tokens are its document's. Texts that are null, empty or without tokens count as documents
    and have no postings. A corpus without documents is refused.
    """
    spark = docs.sparkSession
    total, chars = docs.agg(F.count("*"), F.sum(F.length(text))).first()
    if not total:
        raise ValueError("a corpus without documents has no index")
    n_shards = -(-total // shard_docs)
    n_cells = -(-min(shard_docs, total) // cell_docs)
    # Files of about POSTINGS_A_FILE: by folder first, then by group of shards.
    files = (chars or 0) // (POSTINGS_A_FILE * CHARS_A_POSTING) + 1
    n_buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, files))
    groups = min(-(-n_shards // SHARDS_A_SPAN), -(-files // n_buckets))
    h = F.xxhash64(F.lit(1), F.col(id_col))
    shard = F.pmod(h, F.lit(n_shards)).cast("int")
    placed = docs.select(F.floor(shard / SHARDS_A_SPAN).cast("int").alias("span"), shard.alias("shard"), F.pmod(F.shiftright(h, 32), F.lit(n_cells)).cast("int").alias("cell"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    posts = index.blocks(placed, ["shard", "cell", "_id"], "_text", ["span"], stops, stem)
    counted = Observation()
    posts = posts.observe(counted, F.sum(F.col("tf").cast("long") * F.size("_id")).alias("tokens")).select(bucket("term", n_buckets).alias("bucket"), "term", "span", "tf", "shard", "cell", "_id")
    # A task a file: by a hash of folder and group, several would meet in one task.
    dealt = posts.repartitionById(min(n_buckets * groups, MOST_TASKS), (F.col("bucket") * groups + F.pmod("span", F.lit(groups))).cast("int")).sortWithinPartitions("bucket", "term", "span")
    kind = placed.schema["_id"].dataType.simpleString()
    done = dealt.mapInArrow(_rows, f"bucket int, term string, shard int, n int, blocks array<struct<cell:int,most:int,ids:array<{kind}>,tfs:array<int>>>")
    done.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    facts = [(total, (counted.get["tokens"] or 0) / total, n_shards, n_cells, n_buckets)]
    spark.createDataFrame(facts, "total_docs long, avg_doc_length double, n_shards int, n_cells int, n_buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted gathered postings (bucket, term, span, tf, shards, cells, ids) -> a row a term and shard. What a batch ends in the middle of is held until its end comes."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        held += [b] if b is not None else []
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        changed = lambda a: pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], changed(t.column("term").combine_chunks()) | changed(t.column("span").combine_chunks()))))
        end = t.num_rows if b is None else int(starts[-1])
        held = [] if b is None else t.slice(end).to_batches()
        starts = starts[starts < end]
        # Some rows at a time, so that their lists stay small.
        sizes = np.cumsum(pc.list_value_length(t.column("_id").combine_chunks()).to_numpy(zero_copy_only=False), dtype=np.int64)
        step = sizes[starts] // POSTINGS_A_STEP if end else starts
        for part in np.split(starts, np.flatnonzero(np.diff(step)) + 1) if end else []:
            last = starts[starts > part[-1]]
            yield _merged(t.slice(part[0], (last[0] if len(last) else end) - part[0]), part - part[0])


def _merged(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Whole rows of the index: those of t from each of starts on are of one term and span."""
    flat = {c: pc.list_flatten(t.column(c)).combine_chunks() for c in ("shard", "cell", "_id")}
    own = pc.list_value_length(t.column("_id")).to_numpy()
    of, shard, cell = np.repeat(np.arange(len(starts)), np.add.reduceat(own, starts)), flat["shard"].to_numpy().astype(np.int64), flat["cell"].to_numpy()
    row = of * (shard.max() + 1) + shard
    order = np.argsort(row * (int(cell.max()) + 1) + cell, kind="stable")
    of, shard, cell, row, tf = of[order], shard[order], cell[order], row[order], np.repeat(t.column("tf").to_numpy(), own)[order]
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    blocks = np.flatnonzero(new_row | np.concatenate(([True], cell[1:] != cell[:-1])))
    rows = np.flatnonzero(new_row)
    cuts = pa.array(np.append(blocks, len(row)), pa.int32())
    parts = [pa.array(cell[blocks]), pa.array(np.maximum.reduceat(tf, blocks)), pa.ListArray.from_arrays(cuts, flat["_id"].take(pa.array(order))), pa.ListArray.from_arrays(cuts, pa.array(tf))]
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(blocks, rows), len(blocks)), pa.int32()), pa.StructArray.from_arrays(parts, ["cell", "most", "ids", "tfs"]))
    at, n = pa.array(starts[of[rows]]), pa.array(np.diff(np.append(rows, len(row))).astype(np.int32))
    bucket, term = (t.column(c).combine_chunks().take(at) for c in ("bucket", "term"))
    return pa.RecordBatch.from_arrays([bucket, term, pa.array(shard[rows].astype(np.int32)), n, lists], names=["bucket", "term", "shard", "n", "blocks"])


def build_next(docs: DataFrame, root: str, **how) -> str:
    """Build an index in a new folder below root; the folder. Readers of the one before are not disturbed, and a build that fails is never opened."""
    path = f"{root}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    build(docs, path, **how)
    return path


def latest(spark: SparkSession, root: str) -> str | None:
    """The folder below root of the newest complete index: totals are written last."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(p)), reverse=True)
    return next((f"{root}/{n}" for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/totals/_SUCCESS"))), None)


def tidied(spark: SparkSession, root: str, keep: set[str | None]) -> None:
    """Remove the builds below root that aren't to be kept."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(p):
        if f"{root}/{f.getPath().getName()}" not in keep:
            fs.delete(f.getPath(), True)


@dataclass
class Inverted:
    """An index that `build` wrote, opened for search; its files are listed once."""

    spark: SparkSession
    path: str
    stops: list[str] | None = None
    stem: Callable | None = None
    totals: dict = field(init=False)

    def __post_init__(self):
        self.rows = self.spark.read.parquet(f"{self.path}/postings")
        self.totals = self.spark.read.parquet(f"{self.path}/totals").first().asDict()

    def of(self, terms: Iterable[str]) -> DataFrame:
        """Postings of the terms alone: folders by their hashes, row groups by their values."""
        known = sorted(set(terms))
        if len(known) <= TERMS_IN_FILTER:
            hashes = _constant(self.spark, F.array(*[bucket(F.lit(t), self.totals["n_buckets"]) for t in known])) if known else []
            return self.rows.filter(F.col("bucket").isin(sorted(set(hashes))) & F.col("term").isin(known))
        asked = self.spark.createDataFrame([(t,) for t in known], "term string").withColumn("bucket", bucket("term", self.totals["n_buckets"]))
        return self.rows.join(F.broadcast(asked), ["bucket", "term"], "left_semi")

    def topk(self, queries: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
        """queries (query_id, text) -> (query_id, id, score, rank): what search.sparse_topk gives of the documents that were indexed. In blocks of queries."""
        asked = queries.select("query_id", tokens("text", self.stops, self.stem).alias("_t"))
        return search.over(asked, lambda block: self.of_tokens(block, queries.schema["query_id"].dataType, k, id_col))

    def one(self, text: str, k: int = 10, id_col: str = "doc_id") -> DataFrame:
        """The same for one text, as query 0."""
        return self.of_tokens([{"query_id": 0, "_t": self.words(text)}], LongType(), k, id_col)

    def words(self, text: str) -> list[str]:
        return _constant(self.spark, tokens(F.lit(text), self.stops, self.stem))

    def of_tokens(self, asked: list, kind: DataType, k: int, id_col: str) -> DataFrame:
        """asked: rows of query_id, of type kind, and tokens _t."""
        queries = [Counter(r["_t"]) for r in asked]
        id_type = self.rows.schema["blocks"].dataType.elementType["ids"].dataType.elementType
        schema = StructType([StructField("_q", IntegerType()), StructField(id_col, id_type), StructField("score", DoubleType())])
        rows = self.of({t for q in queries for t in q})
        # How many documents have each of the queries' terms, from one short column; a lone shard knows it itself.
        df = None if self.totals["n_shards"] == 1 else {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        score = _scorer(queries, df, self.totals["total_docs"], self.totals["n_cells"], k, id_col)
        found = rows.select("shard", "term", "n", "blocks").groupBy("shard").applyInArrow(score, schema)
        return search._ranked(found, [r["query_id"] for r in asked], kind, k, id_col, lone=len(asked) == 1)


def _constant(spark: SparkSession, column):
    """The value of an expression without inputs; over literal rows the optimizer computes it, without a job."""
    return spark.sql("SELECT * FROM VALUES (1) AS t(one)").select(column.alias("x")).collect()[0]["x"]


class Shard:
    """The postings of some terms in one shard, as arrays."""

    def __init__(self, table: pa.Table, df: dict[str, int], total: int, n_cells: int):
        self.n_cells, self.terms, self.scored = n_cells, {}, 0
        k1 = index.K1
        for term, blocks in zip(table.column("term").to_pylist(), _lists(table.column("blocks")), strict=True):
            cells, most, ids, tfs = (blocks.field(c) for c in ("cell", "most", "ids", "tfs"))
            starts = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))
            idf = np.log((total - df[term] + 0.5) / (df[term] + 0.5) + 1.0)
            weigh = lambda tf, idf=idf: idf * tf * (k1 + 1) / (tf + k1)
            own = weigh(tfs.flatten().to_numpy(zero_copy_only=False).astype(float))
            self.terms[term] = weigh, cells.to_numpy(), weigh(most.to_numpy().astype(float)), starts, ids.flatten().to_numpy(zero_copy_only=False), own

    def best(self, query: Counter, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents of the shard: greatest score at six places, then least id."""
        bound = np.zeros(self.n_cells)
        parts = []
        for t, n in query.items():
            if t in self.terms:
                weigh, cells, most, starts, ids, own = self.terms[t]
                w = weigh(float(n))
                bound[cells] += w * most
                at = np.full(self.n_cells, -1)
                at[cells] = np.arange(len(cells))
                parts.append((w, at, starts, ids, own))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        got_ids, got = None, np.zeros(0)
        for first in range(0, len(order), CELLS_A_STEP):
            step = order[first : first + CELLS_A_STEP]
            # Scores are compared at six places, so what may round up to the bar is looked at.
            if len(got) >= k and bound[step[0]] < got[k - 1] - 2e-6:
                break
            self.scored += len(step)
            ids, scores = [], []
            for w, at, starts, all_ids, own in parts:
                b = at[step]
                b = b[b >= 0]
                if len(b):
                    lens = starts[b + 1] - starts[b]
                    take = np.repeat(starts[b] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                    ids.append(all_ids[take])
                    scores.append(w * own[take])
            found, place = np.unique(np.concatenate(ids), return_inverse=True)
            total = np.bincount(place, np.concatenate(scores), len(found))
            got_ids = found if got_ids is None else np.concatenate((got_ids, found))
            got = np.concatenate((got, total))
            keep = search._best(np.where(got > 0, got, np.nan), got_ids, k)
            got_ids, got = got_ids[keep], got[keep]
        return (got_ids, got) if got_ids is not None else (np.zeros(0, np.int64), got)


def _lists(column: pa.ChunkedArray):
    for chunk in column.chunks:
        for i in range(len(chunk)):
            yield chunk[i].values


def _scorer(queries: list[Counter], df: dict[str, int] | None, total: int, n_cells: int, k: int, id_col: str):
    def score(rows: pa.Table) -> pa.Table:
        own = df if df is not None else dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
        shard = Shard(rows, own, total, n_cells)
        found = [(j, *shard.best(q, k)) for j, q in enumerate(queries)]
        q = np.concatenate([np.full(len(ids), j, np.int32) for j, ids, _ in found])
        some = [ids for _, ids, _ in found if len(ids)]
        ids = np.concatenate(some) if some else np.zeros(0, np.int64)
        return pa.table({"_q": pa.array(q, pa.int32()), id_col: pa.array(ids), "score": pa.array(np.concatenate([s for _, _, s in found]), pa.float64())})

    return score
