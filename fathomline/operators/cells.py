"""An index of vectors: cells round centres as folders, of which a search reads the few near its queries.

Centres come from spherical k-means over a bounded sample; every row is put into the cell of its nearest centre and stays there whole, so what is
read is scored exactly. A cell's widest angle is kept: no row of it is nearer to a query than the centre's angle less that, so a search can tell
which cells might still hold a better row, and with `exact` reads those, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Vectors that centres are learnt from, at most, and of each centre.
SAMPLE, SAMPLE_A_CELL = 50_000, 64
MOST_CELLS = 1 << 14
#: A cell's rows are dealt to this many tasks when they are written, so that no cell is one task.
PARTS_A_CELL = 4
#: Rows that are searched for, when an index is built, to find how many cells have to be looked into for a share of true neighbours.
TRIED, TRIED_K = 200, 10


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of a size, and which rows those are; null vectors, others' sizes and such without length are left out."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lens == size)
    m = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norm = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return m[ok] / norm[ok, None], at[ok]


def centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """n unit vectors: k-means by cosine from rows of the sample chosen far apart; a centre that loses all its rows begins anew at a row far from its own."""
    rng = np.random.default_rng(seed)
    if len(sample) <= n:
        return sample
    # One far row after the other, in proportion to the squared distance.
    chosen, best = [int(rng.integers(len(sample)))], np.full(len(sample), -1.0)
    for _ in range(n - 1):
        best = np.maximum(best, sample @ sample[chosen[-1]])
        far = np.clip(1 - best, 0, None) ** 2
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
    c = sample[chosen].copy()
    for _ in range(rounds):
        near = sample @ c.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def build(rows: DataFrame, path: str, id_col: str = "vec_id", embedding: str = "embedding", n_cells: int | None = None, size: int | None = None, recall: float = 0.97) -> None:
    """Write the index of rows (id, embedding and others) below path: rows by cell, and centres. What is there is replaced.

    size: that of the vectors, the first row's by id unless given. Rows whose vector is null, of another size or without length are in no cell, as no
    query has a cosine with them. n_cells: about the square root of the rows, unless given. recall: of the 10 nearest others of some 200 rows, which are
    looked for among all, this share lies in the cells that a search looks into by default: few where vectors cluster, most where they don't.
    """
    spark = rows.sparkSession
    some = rows.filter(F.size(embedding) > 0)
    total = some.count()
    if not total:
        raise ValueError("no vectors to index")
    n_cells = n_cells or int(min(MOST_CELLS, max(1, round(total**0.5))))
    most = min(SAMPLE, SAMPLE_A_CELL * n_cells)
    # The same rows each time: those of the least hashes.
    drawn = some.select(F.col(embedding).alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(most).toArrow().column("v").combine_chunks()
    size = size or len(drawn[0])
    c = centres(_unit(drawn, size)[0], n_cells)
    shared = spark.sparkContext.broadcast(c)
    at = rows.columns.index(embedding)
    if {"cell", "angle"} & set(rows.columns):
        raise ValueError("cell and angle are names of the index")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, own = _unit(b.column(at), size)
            near = unit @ shared.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            kept = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*kept.schema.names, "cell", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    put = rows.mapInArrow(assign, f"{schema}, cell int, angle double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    put.repartition(n, "cell", F.pmod(F.xxhash64(id_col), F.lit(PARTS_A_CELL))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    wide = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cell int, centre array<double>")
    given.join(wide, "cell").write.mode("overwrite").parquet(f"{path}/centres")
    probes = _needed(Cells(spark, path, embedding), some.select(F.col(id_col).alias("query_id"), F.col(embedding).alias("query"), F.xxhash64(id_col).alias("h")), id_col, recall)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def _needed(index: Cells, rows: DataFrame, id_col: str, share: float) -> int:
    """How many of the nearest cells hold the share of the true neighbours of the rows of least hashes."""
    queries = rows.orderBy("h").limit(TRIED).drop("h")
    asked = {r["query_id"]: r["query"] for r in queries.collect()}
    if not asked:
        return len(index.cell)
    fixed = index.spark.createDataFrame(list(asked.items()), queries.schema)
    true = index.topk(fixed, TRIED_K + 1, id_col, probes=len(index.cell)).filter(F.col("query_id") != F.col(id_col))
    where = index.rows.select(id_col, "cell")
    found = where.join(F.broadcast(true.select("query_id", id_col)), id_col).select("query_id", "cell").collect()
    place = {}
    for q, v in asked.items():
        order = np.argsort(-(index.centre @ np.asarray(v, float)), kind="stable")
        place[q] = dict(zip(index.cell[order].tolist(), range(1, len(order) + 1), strict=True))
    needed = np.sort([place[r["query_id"]][r["cell"]] for r in found])
    return int(needed[max(0, int(np.ceil(share * len(needed))) - 1)]) if len(needed) else 1


@dataclass
class Cells:
    """An index that `build` wrote, opened for search."""

    spark: SparkSession
    path: str
    embedding: str = "embedding"
    rows: DataFrame = field(init=False)
    probes: int = field(init=False)

    def __post_init__(self):
        self.rows = self.spark.read.parquet(f"{self.path}/rows")
        known = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        self.cell = np.array([r["cell"] for r in known])
        self.centre = np.array([r["centre"] for r in known])
        self.angle = np.array([r["angle"] for r in known])
        try:
            self.probes = self.spark.read.parquet(f"{self.path}/facts").first()["probes"]
        except AnalysisException:  # while it is being built
            self.probes = len(self.cell)

    def topk(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", probes: int | None = None, exact: bool = False, where=None) -> DataFrame:
        """queries (query_id, query) -> (query_id, id, score, rank): the k rows of greatest cosine in the `probes` cells nearest to each query; with `exact`, of
        all rows, as search.dense_topk gives them. where: a condition on rows, pushed to the scan. In blocks of queries."""
        return search.in_blocks(queries, lambda block: self._block(block, k, id_col, probes, exact, where))

    def _block(self, queries: DataFrame, k: int, id_col: str, probes: int | None, exact: bool, where) -> DataFrame:
        size = self.centre.shape[1]
        asked = queries.filter(F.size("query") == size).select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
        unit, at = _unit(asked.column("query").combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float64())), size)
        names = asked.column("query_id").take(pa.array(at)).to_pylist()
        near = unit @ self.centre.T
        probes = probes or self.probes
        order = np.argsort(-near, axis=1, kind="stable")
        look = np.zeros(near.shape, bool)
        np.put_along_axis(look, order[:, :probes], True, axis=1)
        found = self._scored(unit, look, k, id_col, where)
        if exact and len(names):
            # A first pass over the probed cells gives the score to beat; an angle's triangle tells which other cells could.
            bars = found.groupBy("_q").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s")).collect()
            bar = np.full(len(names), -np.inf)
            for r in bars:
                bar[r["_q"]] = r["s"][k - 1] if r["n"] >= k else -np.inf
            reach = np.cos(np.clip(np.arccos(np.clip(near, -1, 1)) - self.angle, 0, np.pi))
            found = self._scored(unit, look | (reach >= bar[:, None] - 2e-6), k, id_col, where)
        return search._ranked(found, names, queries.schema["query_id"].dataType, k, id_col)

    def _scored(self, unit: np.ndarray, look: np.ndarray, k: int, id_col: str, where) -> DataFrame:
        """(_q, id, score): the k best of each task and query, of the cells that the query looks into."""
        size, n = self.centre.shape[1], len(unit)
        lists = {int(self.cell[c]): np.flatnonzero(look[:, c]) for c in np.flatnonzero(look.any(axis=0))}
        rows = self.rows.filter(F.col("cell").isin(sorted(lists)))
        rows = rows if where is None else rows.filter(where)
        kind = rows.schema[id_col].dataType.simpleString()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, id_type = search.Top(n, k), None
            for b in batches:
                id_type = b.schema.field(0).type
                m, own = _unit(b.column(1), size)
                ids, cell = b.column(0).to_numpy(zero_copy_only=False)[own], b.column(2).to_numpy()[own]
                for c in np.unique(cell):
                    here = np.flatnonzero(cell == c)
                    best.add(ids[here], m[here] @ unit[lists[int(c)]].T, lists[int(c)])
            if id_type is not None:
                yield best.batch(["_q", id_col, "score"], id_type)

        return rows.select(id_col, self.embedding, "cell").mapInArrow(score, f"_q int, {id_col} {kind}, score double")


def recall(found: DataFrame, true: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, recall): the share of a query's true neighbours that were found. true: of an exact search."""
    hit = true.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("_hit")), ["query_id", id_col], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))
