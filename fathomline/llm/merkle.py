"""A Merkle manifest of a table: a digest a row, a tree of digests a group, a tree of the groups' roots, and a proof for each row.

Rows of a group get their places by a sort over ranges and the ranges' counts, so no task sees a whole group. A tree is built in aligned blocks of
fanout ** levels nodes: a block is one contiguous matrix of 64-byte digests, reshaped by the fanout and hashed row by row, level after level;
its root is a node of the next round, in which the block's number is its place. A row's siblings follow from its place alone. Rounds are few: each
divides the nodes by the block's size. On the way down each block gets the path of its own node and puts its rows' paths in front.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import packed, quoted_name, stored, unpacked

FANOUT, LEVELS = 8, 3
WIDTH = 64
STEPS = "array<struct<left:string,right:string>>"


def leaf(*fields: str | Column) -> Column:
    """The digest of a row: sha256, in hexadecimal, of its fields one after the other, each its length in bytes, a colon and its value, or - for null."""
    parts = []
    for f in fields:
        v = (F.col(quoted_name(f)) if isinstance(f, str) else f).cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def tower(leaves: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The matrices (nodes x 64 bytes) of leaves and the levels above them. A row of fanout nodes is hashed whole, the last one as long as it is."""
    out = [leaves]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // fanout
        rows = m[: full * fanout].reshape(full, fanout * WIDTH)
        up = [sha256(r).hexdigest() for r in rows]
        if full * fanout < len(m):
            up.append(sha256(np.ascontiguousarray(m[full * fanout :])).hexdigest())
        out.append(_matrix("".join(up).encode()))
    return out


def paths(tower_: list[np.ndarray], fanout: int) -> tuple[list[str], list[str]]:
    """Left and right siblings of each leaf at each level but the top, leaf by leaf: those in front of and behind its node in its run, joined."""
    flat = [m.tobytes().decode() for m in tower_[:-1]]
    left, right = [], []
    for i in range(len(tower_[0])):
        for m, text in zip(tower_, flat, strict=False):
            first = i - i % fanout
            left.append(text[first * WIDTH : i * WIDTH])
            right.append(text[(i + 1) * WIDTH : min(first + fanout, len(m)) * WIDTH])
            i //= fanout
    return left, right


def _matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, WIDTH)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of equal length lie one after the other in Arrow's own buffer."""
    a = column.cast(pa.string()).combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    first = np.frombuffer(a.buffers()[1], np.int32)[a.offset]
    return np.frombuffer(a.buffers()[2], np.uint8)[first : first + len(a) * WIDTH].reshape(-1, WIDTH)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with _i, the place from 0 within _k by the order, and _n, how many nodes _k has.

    Sorted over ranges, stored, and shifted by what the ranges before hold of the key: one row a range and key that it has. Rows of
    equal order are told apart by a number, so that they too are spread over ranges.
    """
    n = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = stored(nodes.withColumn("_seq", F.monotonically_increasing_id()), "merkle-nodes")
    by = [F.asc_nulls_first(c) for c in ["_k", *order, "_seq"]]
    d = nodes.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_seq")
    d = stored(d.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "merkle-ranges")
    had = d.groupBy("_k", "_range").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy("_k")
    had = had.withColumn("_n", F.sum("_c").over(w)).withColumn("_shift", F.sum("_c").over(w.orderBy("_range")) - F.col("_c") - F.col("_first")).drop("_c", "_first")
    return d.join(had, ["_k", "_range"]).withColumn("_i", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def climbed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of nodes (_k, _i, _n, _h ...): the given ones, the roots of their blocks, the roots of those, up to one a key."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    rounds, size = [nodes], fanout**levels
    schema = StructType([StructField("_k", StringType()), StructField("_i", LongType()), StructField("_n", LongType()), StructField("_h", StringType())])

    def up(key: tuple, block: pa.Table) -> pa.Table:
        n = block.column("_n")[0].as_py()
        up_by = min(levels, depth(n, fanout))
        m = _digests(block.sort_by("_i").column("_h"))
        top = tower(m, fanout, up_by)[-1]
        for _ in range(up_by):
            n = -(-n // fanout)
        return pa.table({"_k": [key[0].as_py()], "_i": [key[1].as_py()], "_n": [n], "_h": [top.tobytes().decode()]})

    for _ in range(-(-depth(most, fanout) // levels)):
        blocks = rounds[-1].select("_k", F.expr(f"_i div {size}").alias("_b"), "_i", "_n", "_h").groupBy("_k", "_b")
        rounds.append(stored(blocks.applyInArrow(up, schema), "merkle-round"))
    return rounds


def descended(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The first round's nodes with `path`, the steps from each to the very root, and what tops, a row a key, has: (_k, path, _subroot, _root)."""
    size = fanout**levels
    known = tops.select("_k", F.lit(0).cast("long").alias("_i"), "path", "_subroot", "_root")
    if len(rounds) == 1:
        return rounds[0].drop("_n").join(known.drop("_i"), "_k")
    for nodes in rounds[-2::-1]:
        names = [c for c in nodes.columns if c != "_n"]
        schema = StructType([nodes.schema[c] for c in names] + [known.schema[c] for c in ("path", "_subroot", "_root")])
        blocks = nodes.withColumn("_b", F.expr(f"_i div {size}")).groupBy("_k", "_b")
        known = blocks.cogroup(known.withColumnRenamed("_i", "_b").groupBy("_k", "_b")).applyInArrow(_down(names, fanout, levels), schema)
    return known


def _down(names: list[str], fanout: int, levels: int):
    def down(block: pa.Table, above: pa.Table) -> pa.Table:
        """A block's nodes, and the one row with its own node's path."""
        block = block.sort_by("_i")
        n, count = block.column("_n")[0].as_py(), block.num_rows
        t = tower(_digests(block.column("_h")), fanout, min(levels, depth(n, fanout)))
        left, right = paths(t, fanout)
        inner, steps = len(t) - 1, above.column("path")[0].as_py()
        lefts = [x for i in range(count) for x in (*left[i * inner : (i + 1) * inner], *[s["left"] for s in steps])]
        rights = [x for i in range(count) for x in (*right[i * inner : (i + 1) * inner], *[s["right"] for s in steps])]
        each = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * (inner + len(steps)), pa.int32()), each)
        same = [pa.array([above.column(c)[0].as_py()] * count, pa.string()) for c in ("_subroot", "_root")]
        return pa.table([*[block.column(c) for c in names], path, *same], names=[*names, "path", "_subroot", "_root"])

    return down


def manifest(rows: DataFrame, digest: Column, by: str, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All columns of rows, and leaf, subroot, root (hexadecimal) and path: array of (left, right), the siblings in front of and behind the row's node at each level, joined.

    Leaves of a group (`by`, null is one, the first) stand by `order`, nulls first, then by digest. While several nodes remain, each run of fanout of
    them, the last as long as it is, becomes the digest of their digests; a lone leaf is its group's root. The groups' roots, by the group's
    bytes, give the root in the same way. Repeated rows are leaves of their own. A table without rows has no root and gives none. Columns of
    rows named leaf, subroot, root or path are replaced. Texts of any length are digested in their row; only digests are dealt out.
    """
    new = ("leaf", "subroot", "root", "path")
    rest = rows.select(*[F.col(quoted_name(c)) for c in rows.columns if c not in new])
    key = F.col(quoted_name(by)).cast("string")
    d = rows.select(packed(rest), F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key)).alias("_k"), digest.alias("_h"), *[F.col(quoted_name(c)).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    tree = climbed(placed(d, [*keys, "_h"]).drop(*keys), fanout, levels)
    subroots = tree[-1].select(F.lit("").alias("_k"), F.col("_k").alias("_g"), "_h")
    top = climbed(placed(subroots, ["_g"]), fanout, levels)
    empty = F.expr(f"CAST(array() AS {STEPS})")
    root = top[-1].select("_k", empty.alias("path"), F.lit(None).cast("string").alias("_subroot"), F.col("_h").alias("_root"))
    groups = descended(top, root, fanout, levels).select(F.col("_g").alias("_k"), "path", F.col("_h").alias("_subroot"), "_root")
    done = descended(tree, stored(groups, "merkle-groups"), fanout, levels)
    return done.select(*unpacked(rest), F.col("_h").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), "path")


def folded(digest: str, path: str = "path") -> Column:
    """SQL: the root that a digest gives along a path; a native expression, so whoever has a path can check a row."""
    return F.expr(f"aggregate({path}, {digest}, (h, s) -> sha2(concat(s.left, h, s.right), 256))")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of documents, and what tampering with every third text does to it.

    Nulls in any column are part of a digest, null langs are the first group. Equal rows are leaves of their own, side by side.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    d = docs.select("doc_id", "lang", leaf(*fields, "text").alias("leaf_"), F.when(third, leaf(*fields, low)).alias("tampered"))
    m = manifest(d.select("doc_id", "lang", "tampered", "leaf_"), F.col("leaf_"), "lang", ["doc_id"]).withColumn("given", F.coalesce("tampered", "leaf"))
    siblings = F.expr("array_join(transform(path, s -> concat(s.left, s.right)), '')")
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded("given").alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
