"""Joins by time against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline.operators import temporal as T

L = "id long, k string, g int, t long, match string"
R = "rid long, k string, g int, u long"


def data(seed, n=160, span=200):
    rng = random.Random(seed)
    key = lambda: (rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, 1, 2, None]))
    left = [(i, *key(), rng.choice([None, *range(-span, span)]), "old") for i in range(n)]
    right = [(i, *key(), rng.choice([None, *range(-span, span)])) for i in range(n)]
    return left + left[:3], right + right[:3]


def nearest(left, right, forward, within):
    out = []
    for i, k, g, t, _ in left:
        fit = [r for r in right if None not in (k, g, t, r[3]) and r[1:3] == (k, g) and (r[3] >= t if forward else r[3] <= t)]
        best = min(fit, key=lambda r: ((r[3] if forward else -r[3]), -r[0])) if fit else None
        out.append((i, best[0] if best and (within is None or abs(best[3] - t) <= within) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("forward", "within", "width"), [(False, None, 7), (True, None, 50), (False, 5, 1), (True, 0, None), (False, None, None)])
def test_asof(spark, forward, within, width):
    left, right = data(1)
    d = T.asof(spark.createDataFrame(left, L), spark.createDataFrame(right, R), {"k": "k", "g": "g"}, ("t", "u"), ["rid"], forward, within, width)
    assert d.columns == ["id", "k", "g", "t", "match"]
    assert sorted(((r["id"], r["match"] and r["match"]["rid"]) for r in d.collect()), key=repr) == nearest(left, right, forward, within)


def test_asof_of_empty_sides_and_kinds_of_times(spark):
    left, right = data(2, 20)
    a, b = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    assert T.asof(a, b.limit(0), {"k": "k"}, ("t", "u")).filter("match IS NOT NULL").count() == 0
    assert T.asof(a.limit(0), b, {"k": "k"}, ("t", "u")).count() == 0
    at = datetime(2024, 3, 31, 1, 30)
    for cast in ("timestamp_ntz", "timestamp", "date"):
        x = spark.createDataFrame([(1, at), (2, at + timedelta(days=2, microseconds=1)), (3, None)], "id long, t timestamp_ntz").withColumn("t", F.col("t").cast(cast)).withColumn("k", F.lit(1))
        y = spark.createDataFrame([(7, at), (8, at + timedelta(days=2))], "rid long, u timestamp_ntz").withColumn("u", F.col("u").cast(cast)).withColumn("k", F.lit(1))
        got = T.asof(x, y, {"k": "k"}, ("t", "u")).orderBy("id").collect()
        assert [r["match"] and r["match"]["rid"] for r in got] == [7, 8, None]
    one = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59, 999999), date(1970, 1, 2))], "a timestamp_ntz, b date")
    assert tuple(one.select(T.micros(one, "a"), T.micros(one, "b")).first()) == (-1, 86_400_000_000)


def test_a_hot_key_is_split(spark):
    a = spark.range(4000).select("id", F.lit("k").alias("k"), F.col("id").alias("t"))
    b = spark.range(0, 4000, 7).select(F.col("id").alias("rid"), F.lit("k").alias("k"), F.col("id").alias("u"))
    d = T.asof(a, b, {"k": "k"}, ("t", "u"), slice_width=100)
    assert d.filter("match.rid = id - id % 7").count() == 4000
    assert "hashpartitioning(_k0" in d._jdf.queryExecution().executedPlan().toString() and "_s" in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1, 10, 1000])
def test_intervals(spark, least):
    rng = random.Random(3)
    points, _ = data(3)
    spans = [(i, rng.choice(["hot", "a", None]), rng.choice([None, *range(-220, 220)]), rng.choice([0, 1, 3, 40, 400, -5, None])) for i in range(150)]
    spans = [(i, k, a, None if a is None or n is None else a + n) for i, k, a, n in spans]
    p, i = spark.createDataFrame(points, L), spark.createDataFrame(spans + spans[:2], "iid long, k string, a long, b long")
    got = T.in_intervals(p, i, {"k": "k"}, "t", "a", "b", least)
    want = [(x[0], y[0]) for x in points for y in spans + spans[:2] if None not in (x[1], x[3], y[1], y[2], y[3]) and x[1] == y[1] and y[2] <= x[3] < y[3]]
    assert sorted((r["point"]["id"], r["interval"]["iid"]) for r in got.collect()) == sorted(want) and want
    assert T.in_intervals(p, i.limit(0), {"k": "k"}, "t", "a", "b").count() == 0
