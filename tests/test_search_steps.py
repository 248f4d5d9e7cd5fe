"""Search holds few rows at a time, and statistics are stored in one pass; results are the same."""

import numpy as np
from pyspark.sql import functions as F

from fathomline.functions import vectors
from fathomline.operators import index, search


def test_vectors_are_encoded_and_scored_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 11 == 0 else f"w{i % 7} w{i % 5}") for i in range(90)], "doc_id long, text string").coalesce(1)

    def made():
        def encode(texts):
            assert 1 <= len(texts) <= 4 and None not in texts
            return np.array([vectors.encode(t, 8) for t in texts])

        return encode

    e = docs.select("doc_id", vectors.encoded("text", encoder=made, batch=4).alias("embedding"))
    rounded = lambda v: [round(x, 9) for x in v]
    assert {r["doc_id"]: rounded(r["embedding"]) for r in e.collect()} == {r["doc_id"]: rounded(vectors.encode(r["text"], 8)) for r in docs.collect()}
    assert docs.limit(0).select(vectors.encoded("text")).count() == 0
    queries = e.filter("doc_id < 9").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    found = lambda: sorted(tuple(r) for r in search.dense_topk(queries, e, 5, "doc_id").collect())
    whole = found()
    monkeypatch.setattr(search, "SCORES_A_STEP", 30)
    assert whole and found() == whole


def test_statistics_are_stored_in_one_pass(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "red red blue"), (2, None), (3, "red")], "doc_id long, text string")
    calls, tokens = [], index.tokens
    monkeypatch.setattr(index, "tokens", lambda *a: calls.append(a) or tokens(*a))
    index.save(docs, str(tmp_path / "s"))
    terms, totals = index.load(spark, str(tmp_path / "s"))
    assert len(calls) == 1 and sorted(map(tuple, terms.collect())) == [("blue", 1), ("red", 2)] and [tuple(r) for r in totals.collect()] == [(3, 4 / 3)]
    asked = spark.createDataFrame([(0, "red blue"), (1, ""), (2, "none")], "query_id long, text string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(search.sparse_topk(asked, docs, stats=(terms, totals))) == rows(search.sparse_topk(asked, docs)) and rows(search.sparse_topk(asked.filter("query_id > 0"), docs)) == []
