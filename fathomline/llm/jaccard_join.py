"""N-gram Jaccard join: texts whose sets of word 5-grams have a similarity of 0.8 or more.

Texts that are equal count once, as one node. MinHash signatures are cut into bands, of numbers chosen for a target recall; a
shuffle on band hashes finds candidates. A bucket links its members to its least one only, so a bucket of any size makes as
many rows as it has members. The components of these links hold all candidate pairs; their sets are compared in full, block
against block in numpy, and only counts and a spanning forest leave a block: pairs are never rows. No bucket, component or
number of partners is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 80
#: Nodes of a component, and n-grams of theirs, that are compared in one block, on average; larger components are cut.
BLOCK, GRAMS = 1024, 1 << 22
#: Code points handled at once; hashes of that many n-grams at once.
PIECE, ROWS = 1 << 19, 1 << 14

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold shares a band with the recall's probability, within `most` hashes.

    A threshold so low that no number of bands within `most` reaches the recall is an error.
    """
    if threshold >= 1:
        return 1, most
    best = None
    for r in range(1, most + 1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        if b * r > most:
            break
        best = (b, r)
    if best is None:
        raise ValueError(f"no bands of at most {most} hashes find pairs of similarity {threshold} with probability {recall}")
    return best


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _classes(cp: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, and whether each belongs to a word (letters, numbers, _); `table` keeps what was looked up."""
    if not table:
        low = [chr(i).lower() for i in range(0x3000)]
        table["low"] = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], dtype=np.uint32)
        table["word"] = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(0x3000)])
    high = cp >= 0x3000
    at = np.where(high, 0, cp)
    low, word = table["low"][at], table["word"][at]
    if high.any():
        values, inverse = np.unique(cp[high], return_inverse=True)
        names = [chr(v) if not 0xD800 <= v < 0xE000 else " " for v in values]
        low[high] = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in names], dtype=np.uint32)[inverse]
        word[high] = np.array([x.isalnum() for x in names])[inverse]
    return low, word


def ngram_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set of hashed word n-grams, sorted; a text of fewer words, but not none, has one n-gram of them all."""
    table: dict = {}
    batch: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        batch.append(t)
        held += len(t) + 1
        if held >= PIECE or i + 1 == len(texts):
            yield from _sets(batch, n, table)
            batch, held = [], 0


def _sets(texts: list[str], n: int, table: dict) -> Iterator[np.ndarray]:
    cp = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low, word = _classes(cp, table)
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low.astype(np.uint64) * _powers(_P, len(low)))))
    hashes = _mix((sums[b] - sums[a]) * _powers(_PINV, len(low) + 1)[a])
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(a, ends)
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams = _mix(grams * _P + hashes[k : k + len(grams)]) if len(grams) else grams
    first = 0
    for last in bounds:
        if last - first >= n:
            yield np.unique(grams[first : last - n + 1])
        elif last > first:
            h = np.zeros(1, np.uint64)
            for x in hashes[first:last]:
                h = _mix(h * _P + x)
            yield h
        else:
            yield np.zeros(0, np.uint64)
        first = last


def band_hashes(grams: np.ndarray, shape: tuple[int, int], seed: int = 5) -> np.ndarray:
    """The hashes of a set's MinHash bands; none of an empty set."""
    b, r = shape
    if not len(grams):
        return np.zeros(0, np.int64)
    rnd = np.random.default_rng(seed)
    mul = rnd.integers(0, 1 << 63, b * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rnd.integers(0, 1 << 63, b * r, dtype=np.uint64)
    least = np.full(b * r, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), ROWS):
        np.minimum(least, (grams[k : k + ROWS, None] * mul + add).min(axis=0), out=least)
    h = np.zeros(b, np.uint64)
    for row in least.reshape(b, r).T:
        h = _mix(h * _P + row)
    return h.view(np.int64)


def _signatures(rows: DataFrame, words: int, shape: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [band_hashes(g, shape) for g in ngram_sets(batch["text"].tolist(), words)]
            yield pd.DataFrame({"node": batch["node"], "bands": found})

    return rows.select("node", "text").mapInPandas(run, "node binary, bands array<long>")


def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                sets = [g.view(np.int64) for g in ngram_sets(part["text"].tolist(), words)]
                yield pd.DataFrame({"node": part["node"], "component": part["component"], "copies": part["copies"], "grams": sets})

    return rows.select("node", "component", "copies", "text").mapInPandas(run, "node binary, component binary, copies long, grams array<long>")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each set of a has the similarity to each of b; sets are sorted, of distinct values."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    common = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    for k in range(0, len(both), 4096):
        part = both[k : k + 4096]
        hot = []
        for v, n in ((va, na), (vb, nb)):
            at = np.searchsorted(part, v)
            at[at == len(part)] = 0
            hit = part[at] == v
            m = np.zeros((len(n), len(part)), np.float32)
            m[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = 1
            hot.append(m)
        common += hot[0] @ hot[1].T
    common = common.astype(np.float64)
    union = na[:, None] + nb[None, :] - common
    return (common >= threshold * union - 1e-9) & (union > 0)


def _forest(nodes: list[bytes], linked: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A star for each component of a block's links, around its first node."""
    label = np.arange(len(nodes))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return [(nodes[i], nodes[r]) for i, r in enumerate(label) if i != r]
        label = new


FOUND = "node binary, texts long, docs long, other binary"


def _compare(threshold: float):
    """For the rows of one group: counts of links of each node, and edges that span what is linked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in rows.groupby(["component", "i", "j"], sort=False):
            sides = [part[part["block"] == k] for k in ((i,) if i == j else (i, j))]
            if any(not len(s) for s in sides):
                continue
            one, two = sides[0], sides[-1]
            linked = similar(one["grams"].tolist(), two["grams"].tolist(), threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            for side, m, far in ((one, linked, two), (two, linked.T, one))[: 1 if i == j else 2]:
                n, docs = m.sum(axis=1), m @ far["copies"].to_numpy(dtype=np.int64)
                out += [(x, int(a), int(d), None) for x, a, d in zip(side["node"], n, docs, strict=True) if a]
            nodes = one["node"].tolist() + (two["node"].tolist() if i != j else [])
            if i != j:
                full = np.zeros((len(nodes), len(nodes)), bool)
                full[: len(one), len(one) :] = linked
                linked = full | full.T
            out += [(a, 0, 0, b) for a, b in _forest(nodes, linked)]
        return pd.DataFrame(out, columns=["node", "texts", "docs", "other"])

    return run


def _own_id() -> Column:
    """An id as a value that is equal to itself and has an order where it is null: null is least."""
    return F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id")).alias("_sid")


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK
) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_copies, n_text_links, n_links, doc (key of its contents), root (key of its class, where ids repeat).

    class_id: the least doc_id of the documents that links lead to, copies included; null is least. n_copies: other rows with the
    very text; n_text_links: different texts linked to its text; n_links: other rows linked, copies of either text included. Null counts as
    the empty text. A text without words has no n-grams and is linked to its copies only. Repeated rows are copies of one another.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _own_id(), C.row_key("doc_id", "text").alias("doc"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("node"), text.alias("text"))
    heads = C.stored(rows.drop("text"), "heads")
    nodes = C.stored(heads.groupBy("node").agg(F.min("_sid").alias("_sid"), F.count("*").alias("copies")), "nodes")

    # Candidates.
    signed = C.stored(_signatures(rows, words, bands(threshold, recall, most_hashes)).dropDuplicates(["node"]), "signatures")
    each = signed.select("node", F.posexplode("bands").alias("band", "hash"))
    least = each.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = each.join(least, ["band", "hash"]).filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = C.stored(components(star).withColumnRenamed("root", "component"), "candidates")

    # Their sets: one row of each node, found by its key, so copies don't meet in one task.
    chosen = near.join(nodes, "node")
    same = lambda a, b: (a["node"] == b["node"]) & a["_sid.given"].eqNullSafe(b["_sid.given"]) & a["_sid.id"].eqNullSafe(b["_sid.id"])
    texts = rows.select("node", "_sid", "text")
    texts = texts.join(chosen, same(texts, chosen)).select(chosen["node"], "component", "copies", "text").dropDuplicates(["node"])
    sets = C.stored(_with_sets(texts, words), "sets")
    size = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams"))
    size = size.select("component", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") / GRAMS), F.lit(1)).alias("cuts"))
    placed = sets.join(size, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")))
    placed = placed.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    placed = placed.withColumn("i", F.least("block", "_x")).withColumn("j", F.greatest("block", "_x"))
    # Small components share groups of bounded size on average; each pair of blocks of a cut one is a group.
    held = sets.agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams")).first()
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held["n"] // (2 * block) + 1, (held["grams"] or 0) // GRAMS + 1)
    group = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "i", "j"))
    found = C.stored(
        placed.select("component", "i", "j", "block", "node", "copies", "grams", group.alias("group")).groupBy("group").applyInPandas(_compare(threshold), FOUND), "links"
    )

    # Classes.
    links = found.filter("other IS NULL").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("_sid").alias("first"))
    per_node = named.join(first, "root").join(links, "node", "left").select("node", "root", "first", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return heads.join(per_node, "node").select(
        "doc_id",
        F.col("first.id").alias("class_id"),
        (F.col("copies") - 1).alias("n_copies"),
        F.col("texts").alias("n_text_links"),
        (F.col("docs") + F.col("copies") - 1).alias("n_links"),
        "doc",
        "root",
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that a class keeps: one of those with its least doc_id, with all their columns."""
    found = classes(docs, **how).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Rows of one id in one class: the one of the least contents; equal rows: one of them. Keys tell a null id from all others.
    kept = found.groupBy("root").agg(F.min("doc").alias("_of"), F.min("doc_id").alias("_id"))
    keyed = docs.select(C.packed(docs), F.col("doc_id").alias("_sid"), C.row_key("doc_id", "text").alias("_doc"))
    kept = keyed.join(kept, (F.col("_doc") == F.col("_of")) & F.col("_sid").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_sid", "_doc"]).select(*C.unpacked(docs))
