"""Merkle manifests against a plain tree in Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import merkle
from fathomline.llm.queries import op13_merkle
from tests.llm.helpers import none, odd
from tests.oracle import TESTDATA


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """The root, and for each node its siblings' digests, level by level, and steps (left, right)."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // fanout * fanout : a // fanout * fanout + fanout]
            steps[i].append((run[: a % fanout], run[a % fanout + 1 :]))
        nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], steps


def plain(rows, fanout=8):
    """rows (doc_id, source, lang, n_chars, text) -> the report's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, H(*map(field, r))))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subs = [], []
    for g in langs:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs.append(tree([h for _, h in groups[g]], fanout))
    if not langs:
        return []
    root, top = tree([s[0] for s in subs], fanout)
    for g, (sub, steps), above in zip(langs, subs, top, strict=True):
        for (r, h), own in zip(groups[g], steps, strict=True):
            text = r[4]
            given = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                given = H(*map(field, (*r[:4], low)))
            for left, right in own + above:
                given = H(*left, given, *right)
            out.append((r[0], h, sub, root, H(*[x for left, right in own + above for x in left + right]), given, given == root))
    return out


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def same(got, want):
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17, 63, 64, 65, 200])
def test_tower_and_paths(n):
    leaves = [H(str(i)) for i in range(n)]
    root, steps = tree(leaves, 4)
    t = merkle.tower(merkle._matrix("".join(leaves).encode()), 4, merkle.depth(n, 4))
    assert t[-1].tobytes().decode() == root and [len(m) for m in t][0] == n
    left, right = merkle.paths(t, 4)
    k = len(t) - 1
    assert [list(zip(left[i * k : (i + 1) * k], right[i * k : (i + 1) * k], strict=True)) for i in range(n)] == [[("".join(a), "".join(b)) for a, b in s] for s in steps]
    assert isinstance(t[0], np.ndarray)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 2), (8, 3)])
def test_blocks_of_any_size_give_the_same_tree(spark, fanout, levels):
    rows = [(i, "g%d" % (i % 3) if i % 11 else None) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, g string").withColumn("path", F.lit("old")).withColumn("_k", F.lit("clash"))
    got = merkle.manifest(d, merkle.leaf("id", "g"), "g", ["id"], fanout, levels)
    assert got.columns == ["id", "g", "_k", "leaf", "subroot", "root", "path"]
    assert got.filter(merkle.folded("leaf") != F.col("root")).count() == 0
    groups = {}
    for i, g in rows:
        groups.setdefault(g, []).append(H(field(i), field(g)))
    subs = [tree(groups[g], fanout) for g in [None, "g0", "g1", "g2"]]
    root, top = tree([s[0] for s in subs], fanout)
    steps = {leaf: own + t for g, s, t in zip([None, "g0", "g1", "g2"], subs, top, strict=True) for leaf, own in zip(groups[g], s[1], strict=True)}
    for r in got.collect():
        assert r["root"] == root and r["_k"] == "clash"
        assert [(s["left"], s["right"]) for s in r["path"]] == [("".join(a), "".join(b)) for a, b in steps[r["leaf"]]]


def test_odd_rows_repeats_and_empty_tables(spark):
    d = odd(spark, ["", "One TWO three", None, "É" * 70_000, "ABC", "abc"])
    d = d.unionByName(d.limit(1)).unionByName(d.limit(1).withColumn("text", F.lit("other text of the same id")))
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in d.collect()]
    same(merkle.report(d), plain(rows))
    same(merkle.report(none(spark)), [])
    same(merkle.report(d.filter("doc_id = 2")), plain([r for r in rows if r[0] == 2]))


def test_tampering_is_seen_and_only_tampering(spark):
    d = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    got = merkle.report(d).collect()
    changed = {r["doc_id"] for r in d.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r["text"])}
    assert {r["doc_id"] for r in got if not r["verified"]} == changed and changed


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_plain_tree(spark, sf):
    d = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet")
    same(op13_merkle(spark, f"{TESTDATA}/{sf}"), plain([tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in d.collect()]))
