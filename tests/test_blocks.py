"""Postings gathered by blocks: the same as one row a posting, shuffled as fewer rows; whatever block a document falls into."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.operators import index

ROWS = [(1, "a", "red red blue"), (2, "a", "red"), (3, None, "green red"), (4, None, ""), (5, "b", None), (5, "b", "blue blue"), (6, "a", "red green red")]


def rows(d):
    return sorted((tuple(r) for r in d.collect()), key=repr)


def test_blocks_are_the_postings(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").repartition(2)
    for by in ([], ["source"]):
        one = index.blocks(docs, ["doc_id"], by=by).select(*by, F.explode("doc_id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))
        assert rows(one) == rows(index.postings(docs, by=by))
        found = index.frequencies(docs, by=by)
        assert rows(found.filter("term IS NOT NULL").select(*by, "term", "df")) == rows(index.term_stats(index.postings(docs, by=by), by))
        assert rows(found.filter("term IS NULL").select(*by, "df", (F.col("tokens") / F.col("df")).alias("n"))) == rows(index.corpus_stats(docs, by=by))
    assert index.blocks(docs.coalesce(1), ["doc_id"]).filter("term = 'red'").count() == 2  # not one a document
    assert index.blocks(docs.limit(0), ["doc_id"]).count() == index.frequencies(docs.limit(0)).count() == 0


def test_documents_are_whole_in_their_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK_TOKENS", 3)
    b = pa.RecordBatch.from_pydict({"k": [0, 1, 2, 3, 4], "_t": pa.array([["x", "y"], [], ["x"] * 7, ["y", "x"], ["z"]], pa.list_(pa.string()))})
    cut = list(index.cut([b, b.slice(0, 0)]))
    assert [k for c in cut for k in c.column("k").to_pylist()] == [0, 1, 2, 3, 4] and len(cut) > 1
    found = []
    for c in cut:
        row, code, tf, terms = index._counted(c)
        found += [(c.column("k")[int(r)].as_py(), terms[int(t)].as_py(), int(n)) for r, t, n in zip(row, code, tf, strict=True)]
    assert sorted(found) == [(0, "x", 1), (0, "y", 1), (2, "x", 7), (3, "x", 1), (3, "y", 1), (4, "z", 1)]


def test_weights_are_tokenised_and_shuffled_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    plan = index.weights(docs, digits=6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    by = index.weights(docs, by=["source"], digits=6)
    # The totals of a version go to its postings, not they to them.
    assert "SortMergeJoin" not in by._jdf.queryExecution().executedPlan().toString()
    weight = lambda n, df, tf: round(math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5), 6)
    a = [("a", 1, "blue", weight(3, 1, 1)), ("a", 1, "red", weight(3, 3, 2)), ("a", 2, "red", weight(3, 3, 1)), ("a", 6, "green", weight(3, 1, 1)), ("a", 6, "red", weight(3, 3, 2))]
    assert rows(by) == sorted([*a, ("b", 5, "blue", weight(2, 1, 2))], key=repr)


def test_stop_words_are_left_out_of_a_blocks_terms(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    for by in ([], ["source"]):
        one = index.blocks(docs, ["doc_id"], by=by, stops=["red", "none"]).select(*by, F.explode("doc_id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))
        assert rows(one) == rows(index.postings(docs, by=by, stops=["red", "none"])) != []
    assert index.blocks(docs, ["doc_id"], stops=["red", "blue", "green"]).count() == 0
    # No test of each token.
    assert "filter(" not in index.weights(docs, stops=["red"])._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_a_version_are_side_by_side(spark):
    """Rows shuffled are of a version, term and frequency each; with versions by turns in all blocks there would be one a document."""
    docs = spark.range(400).repartition(4).selectExpr("id AS doc_id", "CAST(id % 20 AS STRING) AS source", "'red blue' AS text")
    d = index.weights(docs, by=["source"])
    assert "rangepartitioning(source" in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 800
