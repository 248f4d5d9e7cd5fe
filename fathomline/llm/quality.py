"""Quality classifier: supervised subword embeddings.

Words, character n-grams and repeats of words near by are hashed to buckets, each bucket has a learned vector, a document is the mean of its
features' vectors, and a softmax layer tells the classes apart. Trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. A mean of vectors times a layer is a mean of numbers, so scoring needs one number a bucket:
executors get a table of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
NGRAMS = (3, 4, 5)
#: Labelled rows of each class that the model is fitted on, at most, chosen by hash; more don't raise held-out accuracy.
SAMPLE_A_CLASS = 1500
#: Code points handled at once.
PIECE = 1 << 19

_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _pieces(texts: list[str], size: int) -> Iterator[tuple[list[tuple[int, str, int]], bool, bool]]:
    """Lists of (document, piece with the code points that n-grams look ahead, own code points), of about `size` in all; whether the first piece goes on
    with a text that the list before ended in, and whether the last one's text goes on in the next. Every n-gram begins in one piece."""
    look, batch, held, goes_on = max(NGRAMS) - 1, [], 0, False
    for i, t in enumerate(texts):
        for a in range(0, len(t), size):
            b = min(len(t), a + size)
            batch.append((i, t[a : b + look], b - a))
            held += b - a
            if held >= size:
                yield batch, goes_on, b < len(t)
                batch, held, goes_on = [], 0, b < len(t)
    if batch:
        yield batch, goes_on, False


def features(texts: list[str], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, buckets): a pair of arrays for each list of pieces, one entry a feature, documents in order within an order of n.

    A text of any length has the features that it would have in one piece: the word that a cut goes through and the two words before it are carried on.
    """
    shift = np.uint32(32 - BITS)
    open_sum, open_len, last = np.uint64(0), 0, np.zeros(0, np.uint64)  # of a word that a cut went through, and the hashes of the words before it
    for batch, goes_on, more in _pieces(texts, size or PIECE):
        if not goes_on:
            open_sum, open_len, last = np.uint64(0), 0, np.zeros(0, np.uint64)
        lens = np.array([len(p) for _, p, _ in batch])
        own = np.array([n for _, _, n in batch])
        ends = np.cumsum(lens)
        starts = ends - lens
        cp = np.frombuffer("".join(p for _, p, _ in batch).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        piece = np.repeat(np.arange(len(batch)), lens)
        docs = np.array([i for i, _, _ in batch])
        inside = np.arange(len(cp)) - starts[piece]
        for n in NGRAMS:
            m = len(cp) - n + 1
            if m <= 0:
                continue
            h = cp[:m] * _ODD[0]
            for k in range(1, n):
                h ^= (h >> np.uint32(15)) + cp[k : m + k] * _ODD[k]
                h *= np.uint32(0x2C1B3C6D)
            keep = (inside[:m] < own[piece[:m]]) & (inside[:m] + n <= lens[piece[:m]])
            h = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            yield docs[piece[:m][keep]], (h >> shift)[keep]
        # Words: polynomial hashes of the stretches between white space, from running sums.
        word = (cp > 32) & (inside < own[piece])
        edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
        new = np.concatenate(([True], piece[1:] != piece[:-1])) if len(cp) else np.zeros(0, bool)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        joint = np.flatnonzero(new[1:] & word[1:] & word[:-1]) + 1
        a, b = np.sort(np.concatenate((a, joint))), np.sort(np.concatenate((b, joint)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(cp.astype(np.uint64) * _powers(_P, len(cp)))))
        h = (sums[b] - sums[a]) * _powers(_PINV, len(cp) + 1)[a]
        of, size_of = piece[a], b - a
        if open_len:
            # The word that was cut: it goes on at the first code point, or ended at the cut.
            if len(a) and a[0] == 0:
                h[:1] = open_sum + h[:1] * _powers(_P, open_len + 1)[open_len]
                size_of[0] += open_len
            else:
                h, of, a, b, size_of = np.append(open_sum, h), np.append(0, of), np.append(-1, a), np.append(0, b), np.append(open_len, size_of)
        open_sum, open_len = np.uint64(0), 0
        if more and len(b) and b[-1] == starts[-1] + own[-1] and of[-1] == len(batch) - 1:
            open_sum, open_len = h[-1], int(size_of[-1])
            h, of = h[:-1], of[:-1]
        h = h ^ (h >> np.uint64(29))
        yield docs[of], ((h * _P) >> np.uint64(64 - BITS)).astype(np.uint32)
        # A word that repeats the one, or the second, before it: a feature of its own for either, whatever the word.
        seen, at = np.concatenate((last, h)), np.concatenate((np.zeros(len(last), of.dtype), of))
        for back in (1, 2):
            same = (seen[back:] == seen[:-back]) & (at[back:] == at[:-back])
            same[: max(0, len(last) - back)] = False  # found in the piece before
            yield docs[at[back:][same]], np.full(int(same.sum()), back, np.uint32)
        last = seen[at == len(batch) - 1][-2:] if more else last[:0]


@dataclass(frozen=True)
class Model:
    """weights: each bucket's part of the log-odds of class 1; bias: theirs without features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of class 1; a text without features has the bias alone."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for docs, buckets in features(texts):
            total += np.bincount(docs, self.weights[buckets], len(texts))
            count += np.bincount(docs, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(rows: list[tuple[str, int]], prior: float | None = None, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 3) -> Model:
    """Fit embeddings and layer by stochastic gradient descent, one document a step, the rate falling to 0.

    prior: the share of class 1 where the rows are a sample of other proportions. With one class only, or no rows, the
    model is the prior alone (a half if unknown).
    """
    n, ones = len(rows), sum(y for _, y in rows)
    if prior is None:
        prior = ones / n if n else 0.5
    odds = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    if not n or ones in (0, n):
        return Model(np.zeros(1 << BITS, np.float32), odds)
    rnd = np.random.default_rng(seed)
    vectors = (rnd.random((1 << BITS, dim), dtype=np.float32) - np.float32(0.5)) / dim
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for text, y in rows:
        each = [b for _, b in features([text])]
        ids, counts = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint32), np.zeros(0))
        bags.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32), y))
    steps, step = epochs * n, 0
    for _ in range(epochs):
        for i in rnd.permutation(n):
            ids, share, y = bags[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * p
            # A feature's step is in proportion to its share of the document; scaled up, as shares are small.
            vectors[ids] = own - (lr * 20) * share[:, None] * back
    weights = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]) + odds - float(np.log(ones / (n - ones))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_A_CLASS) -> Model:
    """Train on at most `sample` labelled rows a class that aren't held out; their whole texts come to the driver.

    Which rows: those whose ids' hashes are least, so reruns agree. Null labels, ids and texts teach nothing. A label given twice
    counts once; an id with both labels is left out. Of an id with several texts the least one counts, so reruns agree.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_top"))
    known = known.filter("y = _top").select("doc_id", F.col("y").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.filter("y = 0").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("y = 1").orderBy(order, "doc_id").limit(sample))
    ids = chosen.collect()
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "doc_id long, y int")
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = [(r["text"], r["y"]) for r in sorted(rows.toLocalIterator(), key=lambda r: r["doc_id"])]
    return train(texts, prior=n.get(1, 0) / sum(n.values()) if n else None)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a score of each whole text; null scores as the empty text. A column named `out` is replaced."""
    weights, bias = model.weights, model.bias
    base = docs.drop(out)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for s in batches:
            yield pd.Series(own.scores([t or "" for t in s.tolist()]))

    udf = F.pandas_udf(score, "double")
    return base.withColumn(out, udf(F.col("text")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
