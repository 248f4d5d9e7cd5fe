"""The stored indexes, against full scans."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.functions.text import stem_russian
from fathomline.operators import cells, index, inverted, search


def ranked(d, id_col):
    return sorted((r["query_id"], r["rank"], r[id_col], r["score"]) for r in d.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(40))) for _ in range(700)]
    texts += [None, "", "  ", texts[3], texts[3], "книги книгам the"]
    return spark.createDataFrame([(i * 7 - 50, t) for i, t in enumerate(texts)], "doc_id long, text string")


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


ASKED = ["w0 w1 w250", "w7 w7 w9", "w299", "nothing known", "", None, " ".join(f"w{i}" for i in range(100))]


@pytest.mark.parametrize(("shard", "cell"), [(1 << 16, 128), (100, 8), (64, 1000)])
def test_postings_give_what_a_scan_gives(spark, corpus, tmp_path, shard, cell):
    inverted.build(corpus, str(tmp_path / "i"), shard_docs=shard, cell_docs=cell, buckets=7)
    ix = inverted.Inverted(spark, str(tmp_path / "i"))
    for k in (1, 10, 2000):
        assert ranked(ix.topk(queries(spark, ASKED), k), "doc_id") == ranked(search.sparse_topk(queries(spark, ASKED), corpus, k), "doc_id")
    one = ranked(ix.one(ASKED[0], 5), "doc_id")
    assert one == [r for r in ranked(search.sparse_topk(queries(spark, ASKED), corpus, 5), "doc_id") if r[0] == 0]
    assert ix.one("").count() == 0 and ix.one("nothing known").count() == 0


def test_postings_with_stops_stems_many_terms_and_text_ids(spark, corpus, tmp_path, monkeypatch):
    named = corpus.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    inverted.build(named, str(tmp_path / "s"), id_col="id", stops=["the", "w0"], stem=stem_russian)
    ix = inverted.Inverted(spark, str(tmp_path / "s"), ["the", "w0"], stem_russian)
    assert [r["id"] for r in ix.one("книга", id_col="id").collect()] == [r["id"] for r in named.filter("text like 'книги%'").collect()]
    assert ix.one("the w0", id_col="id").count() == 0
    before = ranked(ix.topk(queries(spark, ASKED), 3, "id"), "id")
    monkeypatch.setattr(inverted, "TERMS_IN_FILTER", 5)
    assert ranked(ix.topk(queries(spark, ASKED), 3, "id"), "id") == before and before


def test_only_the_terms_folders_are_read_and_few_cells_are_scored(spark, corpus, tmp_path):
    inverted.build(corpus, str(tmp_path / "p"), buckets=50)
    ix = inverted.Inverted(spark, str(tmp_path / "p"))
    plan = ix.of(["w3", "w4"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w3,w4])" in plan.split("PushedFilters")[1] and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert ix.of(["w3", "w4"]).inputFiles() and len(ix.of(["w3"]).filter("term = 'w3'").select(F.input_file_name()).distinct().collect()) <= 1
    # One cell holds all that is worth reading; the bounds of the others say so.
    n, rows = 400, {"a": [(c, [(c * 1000 + i, 50 if c == 7 else 1) for i in range(20)]) for c in range(400)]}
    blocks = [[{"cell": c, "most": max(tf for _, tf in p), "ids": [i for i, _ in p], "tfs": [tf for _, tf in p]} for c, p in rows["a"]]]
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("most", pa.int32()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))]))
    shard = inverted.Shard(pa.table({"term": ["a"], "blocks": pa.array(blocks, kind)}), {"a": 8000}, 100_000, n)
    assert sorted(shard.best(Counter("a"), 10)[0]) == list(range(7000, 7010)) and shard.scored <= inverted.CELLS_A_STEP


def test_empty_corpora_are_refused(spark, corpus, tmp_path):
    with pytest.raises(ValueError, match="without documents"):
        inverted.build(corpus.limit(0), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="no vectors"):
        cells.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), str(tmp_path / "v"))


def vectors(spark, clustered, n=3000, d=24, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    if clustered:
        m = rng.normal(size=(40, d))[rng.integers(40, size=n)] * 2 + m * 0.3
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(m)]
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * d, 0), (n + 3, [1.0], 0), (n + 4, rows[5][1], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("clustered", [True, False])
def test_cells(spark, tmp_path, clustered):
    e = vectors(spark, clustered)
    at = str(tmp_path / f"c{clustered}")
    cells.build(e, at)
    ix = cells.Cells(spark, at)
    q = e.filter("vec_id % 50 = 1 OR vec_id >= 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = e.filter("size(embedding) = 24")
    true = search.dense_topk(q.filter("size(query) = 24"), rows)
    assert ranked(ix.topk(q, exact=True), "vec_id") == ranked(true, "vec_id")
    assert cells.recall(ix.topk(q), true).agg(F.avg("recall")).first()[0] >= 0.95
    assert ix.probes <= (4 if clustered else len(ix.cell))
    assert ranked(ix.topk(q, exact=True, where="label = 1"), "vec_id") == ranked(search.dense_topk(q.filter("size(query) = 24"), rows.filter("label = 1")), "vec_id")
    plan = ix.topk(q.filter("query_id = 1"), probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ix.rows.count() == 3001  # rows without a direction are in no cell


def test_top_keeps_ties_by_id():
    t = search.Top(2, 3)
    t.add(np.array([9, 4, 7]), np.array([[1.0, np.nan], [1.0, 2.0], [1.0000000001, np.nan]]))
    t.add(np.array([1, 8, 2]), np.array([[1.0, np.nan], [0.5, np.nan], [3.0, np.nan]]))
    b = t.batch(["q", "id", "score"], pa.int64()).to_pydict()
    assert list(zip(b["q"], b["id"], strict=True)) == [(0, 2), (0, 1), (0, 4), (1, 4)]


def test_a_task_writes_one_file_of_postings(spark, corpus, tmp_path):
    inverted.build(corpus, str(tmp_path / "o"), buckets=16)
    files = [f.name for f in (tmp_path / "o" / "postings").glob("bucket=*/part-*.parquet")]
    # A file's number is its task's: where two folders met in one task, so would their sorts.
    assert len({n.split("-")[1] for n in files}) == len(files) == 16


def test_spans_of_shards_and_steps_make_no_difference(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARDS_A_SPAN", 3)
    inverted.build(corpus, str(tmp_path / "x"), shard_docs=64, cell_docs=8)
    found = spark.read.parquet(str(tmp_path / "x" / "postings")).select("term", "shard", F.explode("blocks").alias("b")).select("term", "shard", F.explode(F.arrays_zip("b.ids", "b.tfs")).alias("x"))
    one = {(r["term"], r["x"]["ids"], r["x"]["tfs"]) for r in found.collect()}
    assert one == {(r["term"], r["doc_id"], r["tf"]) for r in index.postings(corpus).collect()}
    t = pa.table({"bucket": [0] * 4, "term": ["a", "a", "b", "b"], "span": [0] * 4, "tf": [1, 2, 1, 3], "shard": [[1, 0], [0], [2], [2]], "cell": [[5, 4], [1], [0], [0]], "_id": [[10, 11], [12], [13], [14]]})
    monkeypatch.setattr(inverted, "POSTINGS_A_STEP", 1)
    rows = [r for b in inverted._rows(iter(t.to_batches(max_chunksize=1))) for r in b.to_pylist()]
    assert [(r["term"], r["shard"], r["n"]) for r in rows] == [("a", 0, 2), ("a", 1, 1), ("b", 2, 2)]
    assert rows[0]["blocks"] == [{"cell": 1, "most": 2, "ids": [12], "tfs": [2]}, {"cell": 4, "most": 1, "ids": [11], "tfs": [1]}] and rows[2]["blocks"][0]["most"] == 3
