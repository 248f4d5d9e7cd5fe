"""Rolling windows against brute force and SQL."""

import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import rolling
from fathomline.llm.queries import ORACLES, op12_rolling
from tests.llm.helpers import none, odd
from tests.oracle import TESTDATA, rows_of, rows_of_sql

Q = {"median_chars": Fraction(1, 2), "high_chars": Fraction(9, 10), "least": Fraction(0), "most": Fraction(1)}


def quantile(values, q):
    values = sorted(values)
    return values[max(1, -(-q.numerator * len(values) // q.denominator)) - 1] if values else None


def brute(rows, widths, qs):
    """rows: (id, key, time, value, category)."""
    out = []
    for i, k, t, _, _ in rows:
        for w in widths:
            seen = [r for r in rows if t is not None and r[2] is not None and r[1] == k and t - w <= r[2] < t]
            values = [r[3] for r in seen if r[3] is not None]
            out.append((i, w, t, len(seen), sum(values), len({r[4] for r in seen if r[4] is not None}), *(quantile(values, q) for q in qs)))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 2)), st.integers(1, 5)), max_size=60), st.integers(1, 40))
def test_sweep_equals_brute_force(cells, width):
    cells = sorted(cells, key=lambda c: c[0])
    asked = sorted({c[0] for c in cells} | {70})
    got = list(rolling.swept(*([c[i] for c in cells] for i in range(4)), asked, width, list(Q.values())))
    for t, g in zip(asked, got, strict=True):
        seen = [c for c in cells if t - width <= c[0] < t]
        values = [c[1] for c in seen if c[1] is not None for _ in range(c[3])]
        assert g == (sum(c[3] for c in seen), sum(values), len({c[2] for c in seen if c[2] is not None}), *(quantile(values, q) for q in Q.values()))


def test_heaps_throw_tombstones_away():
    h, rng = rolling.Quantile(Fraction(1, 2)), random.Random(1)
    there = {}
    for i in range(20_000):
        there[i] = rng.randrange(1000)
        h.add(i, there[i], 1)
        if len(there) > 100:
            gone = rng.choice(list(there))
            h.remove(gone)
            del there[gone]
        if i % 50 == 0:
            assert h.value() == quantile(there.values(), Fraction(1, 2))
    assert len(h.low) + len(h.high) < 400


ROWS = "id long, key string, time long, value long, category string, n_events string, _row int, _t string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "old", 1, "t") for r in rows], ROWS)


def run(d, **kw):
    got = rolling.rolling(d, "key", F.col("time"), F.col("value"), F.col("category"), [7, 100], Q, **kw)
    return sorted((tuple(r[c] for c in ("id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", *Q)) for r in got.collect()), key=repr)


@pytest.mark.parametrize("stretch", [3, 100, 1000, None])
def test_stretches_give_the_same(spark, stretch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-300, 300)]), rng.choice([None, 0, 5, 5, *range(50)]), rng.choice([None, "x", "y", "z"])) for i in range(300)]
    rows += [(900, "a", 17, 3, "x")] * 40 + [(901, "a", 18, None, None)] * 3  # repeated rows and ties
    assert run(table(spark, rows), stretch=stretch) == brute(rows, [7, 100], Q.values())


def test_other_columns_and_empty_tables(spark):
    d = table(spark, [(1, "a", 5, 2, "x"), (2, "a", 6, 2, "x")])
    r = rolling.rolling(d, "key", F.col("time"), F.col("value"), F.col("category"), [7], Q)
    assert r.columns == ["id", "key", "time", "value", "category", "_row", "_t", "window_s", "event_s", "n_events", "sum_chars", "n_langs", *Q]
    assert [(x["n_events"], x["_row"], x["_t"], x["key"]) for x in r.orderBy("id").collect()] == [(0, 1, "t", "a"), (1, 1, "t", "a")]
    assert run(table(spark, [])) == []
    assert rolling.report(none(spark)).count() == 0


def test_odd_documents(spark):
    at = lambda i: None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10000) // 6)
    texts = ["", "one two three", None, "x" * 100_000, "é𝒳", None]
    d = odd(spark, texts)
    rows = [(r["doc_id"], r["source"], at(r["doc_id"]), None if r["text"] is None else len(r["text"]), r["lang"]) for r in d.collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")) for r in rolling.report(d).collect()), key=repr)
    assert got == brute(rows, [600, 43200], [Fraction(1, 2), Fraction(9, 10)])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    assert rows_of(op12_rolling(spark, f"{TESTDATA}/{sf}")) == rows_of_sql(ORACLES["op12_rolling"], f"{TESTDATA}/{sf}")
