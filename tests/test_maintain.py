"""Statistics of a stream of changes against those of the table that it leaves."""

import random

import pytest

from fathomline.operators import index, search
from fathomline.streaming import maintain as M

COLS = "id long, op string, seq long, text string"


def final(rows):
    last = {}
    for i, op, seq, text in rows:
        if i is not None and seq is not None and (i not in last or seq > last[i][1]):
            last[i] = op, seq, text
    return [(i, text) for i, (op, _, text) in last.items() if op != "delete"]


def same(spark, path, rows):
    docs = spark.createDataFrame(final(rows), "doc_id long, text string")
    terms, totals = M.statistics(spark, path)
    assert {tuple(r) for r in terms.collect()} == {tuple(r) for r in index.term_stats(index.postings(docs)).collect()}
    got, want = totals.first(), index.corpus_stats(docs).first()
    assert got["total_docs"] == want["total_docs"] and got["avg_doc_length"] == pytest.approx(want["avg_doc_length"])


def run(spark, at, **kw):
    q = M.maintain(spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(str(at / "in")), str(at / "stats"), str(at / "cp"), buckets=5, **kw)
    assert q.awaitTermination(120)


def put(spark, at, rows):
    spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(str(at / "in"))


def test_upserts_and_deletions_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for seq in range(120):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 8)))])
        rows.append((rng.randrange(25), rng.choice(["upsert", "upsert", "delete"]), seq, text))
    shuffled = rows[:]
    rng.shuffle(shuffled)  # changes arrive in any order
    shuffled += [(None, "upsert", 1, "w1"), (1, "upsert", None, "w1"), shuffled[0], shuffled[0]]  # and with faults and repeats
    seen = []
    for part in (shuffled[:50], shuffled[50:90], shuffled[90:]):
        put(spark, tmp_path, part)
        run(spark, tmp_path)
        seen += part
        same(spark, str(tmp_path / "stats"), seen)
        if len(seen) == 90:
            assert M.compact(spark, str(tmp_path / "stats")) == 1
            same(spark, str(tmp_path / "stats"), seen)
    # Such statistics serve a search.
    docs = spark.createDataFrame(final(seen), "doc_id long, text string")
    q = spark.createDataFrame([(0, "w1 w2")], "query_id long, text string")
    ranked = lambda d: sorted((r["rank"], r["doc_id"], r["score"]) for r in d.collect())
    assert ranked(search.sparse_topk(q, docs, stats=M.statistics(spark, str(tmp_path / "stats")))) == ranked(search.sparse_topk(q, docs))


def test_a_batch_run_again_counts_once(spark, tmp_path):
    put(spark, tmp_path, [(1, "upsert", 1, "a b"), (2, "upsert", 1, "b")])
    run(spark, tmp_path)
    # As after a failure between the batch's folder and the checkpoint: the commit is lost, the batch comes again.
    for p in (tmp_path / "cp/commits").iterdir():
        p.unlink()
    run(spark, tmp_path)
    assert {tuple(r) for r in M.statistics(spark, str(tmp_path / "stats"))[0].collect()} == {("a", 1), ("b", 2)}


def test_no_changes_and_stop_words(spark, tmp_path):
    terms, totals = M.statistics(spark, str(tmp_path / "none"))
    assert terms.count() == 0 and tuple(totals.first()) == (0, None) and M.compact(spark, str(tmp_path / "none")) == -1
    put(spark, tmp_path, [(1, "upsert", 1, "the fox"), (1, "delete", 2, None)])
    run(spark, tmp_path, stops=["the"])
    assert M.statistics(spark, str(tmp_path / "stats"))[0].count() == 0


def test_event_times_let_deleted_ids_be_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    steps = [[(1, "upsert", 5, "a b", at(0)), (2, "upsert", 1, "b", at(0))], [(1, "delete", 6, None, at(1))], [(3, "upsert", 1, "c", at(9))], [(4, "upsert", 1, "c", at(9))], [(1, "upsert", 2, "again", at(9))]]
    cols = f"{COLS}, at timestamp"
    for rows in steps:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        M.maintain(stream, str(tmp_path / "stats"), str(tmp_path / "cp"), time="at", late="1 hour", remembered_ms=3_600_000).awaitTermination(90)
    # The id was forgotten hours after its deletion, so a lesser seq is a new document's.
    assert {tuple(r) for r in M.statistics(spark, str(tmp_path / "stats"))[0].collect()} == {("b", 1), ("c", 2), ("again", 1)}


class Handle:
    """What a processor needs of Spark: one state and timers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)


class Times:
    now = 1000

    def getCurrentWatermarkInMs(self):
        return self.now


def test_deleted_ids_are_remembered_for_a_while(spark):
    import pandas as pd

    h, p = Handle(), M.Last(500)
    p.init(h)

    def change(*rows):
        d = pd.DataFrame([(*r, len(r[3])) for r in rows], columns=["id", "op", "seq", "terms", "length"])
        return [tuple(r) for d in p.handleInputRows((1,), iter([d]), Times()) for r in d.itertuples(index=False)]

    assert change(("1", "upsert", 1, ["a", "b"])) == [("a", 1, 0, 0), ("b", 1, 0, 0), (None, 0, 1, 2)]
    assert change(("1", "upsert", 2, ["b", "c", "d"])) == [("a", -1, 0, 0), ("c", 1, 0, 0), ("d", 1, 0, 0), (None, 0, 0, 1)]
    # Within a bucket what one id gives and another takes is added up.
    assert change(("2", "upsert", 9, ["b"]), ("1", "delete", 4, []), ("2", "upsert", 8, ["z"])) == [("c", -1, 0, 0), ("d", -1, 0, 0), (None, 0, 0, -2)]
    assert h.timers == [1500] and change(("1", "upsert", 3, ["late"])) == [(None, 0, 0, 0)]
    Times.now = 1500
    assert list(p.handleExpiredTimer((1,), Times(), None)) == [] and set(p._held()) == {"2"}
    assert change(("1", "upsert", 1, ["x"])) == [("x", 1, 0, 0), (None, 0, 1, 1)]
    list(p.handleExpiredTimer((1,), Times(), None))
    assert set(p._held()) == {"1", "2"}


def test_changes_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from fathomline.plans import catalogue

    docs = spark.createDataFrame([(i, f"word{i % 7} text", "s") for i in range(80)], "doc_id long, text string, source string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalogue, "shared_path", lambda spark, what: str(tmp_path / what))
    assert catalogue.QUERIES["stream_term_stats"](spark, str(tmp_path)).count() > 0
    # Three steps: one file each would mean that one task wrote, and so read, the whole table.
    assert len(list((tmp_path / "changes" / "in").glob("*.parquet"))) > 3
