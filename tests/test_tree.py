"""Trees by pointer doubling, against walks."""

import random

import pytest

from fathomline.operators import tree
from fathomline.sources.archive import toc_paths

COLS = "id long, parent_id long, v long"


def walk(rows, root=0):
    """(id, parent, level, path) of all ways from the root."""
    below = {}
    for i, p, _ in rows:
        if i is not None and p is not None:
            below.setdefault(p, []).append(i)
    out, level = [], [(i, root, 0, str(i)) for i in below.get(root, [])]
    while level:
        out += level
        level = [(c, i, n + 1, f"{path}/{c}") for i, _, n, path in level for c in below.get(i, [])]
    return sorted(out)


def forest(seed, n=120):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, *range(max(1, i - 6), i)]) if i > 1 else 0, i % 7) for i in range(1, n)]
    # A circle, what hangs on it, an orphan, and nulls: no root leads to these.
    return rows + [(500, 501, 1), (501, 502, 1), (502, 500, 1), (503, 500, 1), (600, 9999, 1), (None, 0, 1), (601, None, 1)]


def test_paths(spark):
    rows = forest(1)
    got = toc_paths(spark.createDataFrame(rows, COLS).drop("v"))
    assert sorted(map(tuple, got.collect())) == walk(rows)
    twice = [(1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 2, 0), (4, 3, 0)]
    assert sorted(map(tuple, tree.paths(spark.createDataFrame(twice, COLS)).collect())) == walk(twice)
    assert tree.paths(spark.createDataFrame([], COLS)).count() == 0
    for circle in ([(1, 0, 0), (2, 1, 0), (1, 2, 0)], [(1, 0, 0), (1, 1, 0)], [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (2, 4, 0)]):
        with pytest.raises(ValueError, match="circle"):
            tree.paths(spark.createDataFrame(circle, COLS))


def test_totals(spark):
    rows = forest(2)
    ways = walk(rows)
    v = {i: x for i, _, x in rows}
    want = []
    for i, p, n, path in ways:
        under = [j for j, _, _, other in ways if other == path or other.startswith(f"{path}/")]
        want.append((i, p, n, len(under) - 1, sum(v[j] for j in under)))
    got = tree.totals(spark.createDataFrame(rows, COLS), 0, "v")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert tree.totals(spark.createDataFrame([], COLS)).count() == 0
    with pytest.raises(ValueError, match="repeat"):
        tree.totals(spark.createDataFrame([(1, 0, 0), (1, 0, 0)], COLS))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, stored = [], tree._stored
    monkeypatch.setattr(tree, "_stored", lambda df, what: rounds.append(what) or stored(df, what))
    n = 10_000
    got = tree.totals(spark.range(1, n + 1).selectExpr("id", "id - 1 AS parent_id"))
    assert got.filter(f"level != id - 1 OR n_below != {n} - id").count() == 0 and got.count() == n
    assert rounds.count("tree-levels") < 20 and rounds.count("tree-totals") < 20
