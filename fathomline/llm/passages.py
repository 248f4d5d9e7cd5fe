"""Passages of fifty words and more that occur before, wherever they begin and end.

Three steps, none of which gathers rows by passage. Of each document's 25-word hashes the least of each 26 in a row are taken
(winnowing): each window of 50 words holds one that its contents choose, so windows of 50 words that are equal share one. Only
windows that hold one which occurs more than once are hashed (128 bits). A window's first occurrence is a minimum;
the words that later ones cover are cut out. Nothing is sampled away: the first step only leaves out windows that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import line_dedup

WORDS = 50
#: Bytes of text hashed at once.
PIECE = 4_000_000
#: Spark's setting by which a query's shuffle files go when it ends; the steps of this one are stored.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    for k, m in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(k))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def _powers(m: int, n: int) -> np.ndarray:
    p = np.full(n, m, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """A hash of each values[start:end], mod 2**64, by differences of one running sum."""
    inverse = pow(m, -1, 1 << 64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(m, len(values)), dtype=np.uint64)))
    return _mixed((run[ends] - run[starts]) * _powers(inverse, len(values) + 1)[starts])


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end; ASCII white space parts them."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each word's text and place in it, and two hashes, for many texts at once."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_places(data)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(first, starts, "right") - 1
    at = np.arange(len(starts)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
    return doc, at, [_sums(data.astype(np.uint64) + np.uint64(1), starts, ends, m) for m in MULTIPLIERS]


def _grams(doc: np.ndarray, hashes: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n words from each word on, and whether they are all of one text."""
    k = len(doc) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    i = np.arange(k)
    return _sums(hashes, i, i + n, m), doc[:k] == doc[n - 1 :]


def _slid(a: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each n values in a row."""
    done, out = 1, a
    while done < n:
        by = min(done, n - done)
        out = f(out[: len(out) - by], out[by:])
        done += by
    return out


def chosen(h: np.ndarray, n: int) -> np.ndarray:
    """Whether a value is the least (or one of them) of some n in a row."""
    if len(h) < n:
        return np.zeros(len(h), bool)
    least = _slid(h, n, np.minimum)
    low = np.zeros(n - 1, np.uint64)
    return _slid(np.concatenate((low, least, low)), n, np.maximum) == h


def _pieces(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    texts = [t.encode() for t in batch["text"]]
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield batch.iloc[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(t) + 1
    if texts:
        yield batch.iloc[begin:], texts[begin:]


def _out(piece: pd.DataFrame, doc: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"_sid": piece["_sid"].to_numpy()[doc], "_doc": piece["_doc"].to_numpy()[doc], **columns})


def later(keyed: DataFrame, n: int = WORDS) -> DataFrame:
    """(_sid, _doc, starts) of rows of (_sid, _doc, text): the windows of n words, by their first word, that occur before."""
    g = n // 2
    long = keyed.select("_sid", "_doc", "text").filter(F.length("text") >= 2 * n - 1).dropDuplicates(["_sid", "_doc"])

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece, texts in _pieces(batch):
                doc, at, hashes = _words(texts)
                h, whole = _grams(doc, hashes[0], g, MULTIPLIERS[1])
                i = np.flatnonzero(chosen(h, n - g + 1) & whole)
                yield _out(piece, doc[i], at=at[i].astype(np.int32), h=h[i].view(np.int64))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece, texts in _pieces(batch):
                doc, at, hashes = _words(texts)
                h1, whole = _grams(doc, hashes[0], n, MULTIPLIERS[1])
                h2, _ = _grams(doc, hashes[1], n, MULTIPLIERS[0])
                first = np.searchsorted(doc, np.arange(len(texts)))
                near = np.zeros(len(doc) + 1, np.int64)
                for k, places in enumerate(piece["places"]):
                    p = np.asarray(places, np.int64) + first[k]
                    np.add.at(near, np.maximum(p - (n - g), first[k]), 1)
                    np.add.at(near, p + 1, -1)
                i = np.flatnonzero(whole & (np.cumsum(near)[: len(h1)] > 0))
                yield _out(piece, doc[i], at=at[i].astype(np.int32), h1=h1[i].view(np.int64), h2=h2[i].view(np.int64))

    # Each step is stored, so that none is computed for both sides of a join and its shuffle files go before the next.
    prints = C.stored(long.mapInPandas(fingerprints, "_sid long, _doc long, at int, h long"), "prints")
    twice = prints.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = C.stored(prints.join(twice, "h").groupBy("_sid", "_doc").agg(F.collect_list("at").alias("places")), "places")
    every = C.stored(long.join(places, ["_sid", "_doc"]).mapInPandas(windows, "_sid long, _doc long, at int, h1 long, h2 long"), "windows")
    firsts = every.groupBy("h1", "h2").agg(F.min(F.struct("_sid", "_doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = every.join(firsts, ["h1", "h2"]).filter(F.struct("_sid", "_doc", "at") != F.col("first"))
    return C.stored(again.groupBy("_sid", "_doc").agg(F.collect_list("at").alias("starts")), "starts")


def cut(text: str, starts: list[int], n: int = WORDS) -> tuple[str, int]:
    """The text less the words that windows cover, and how many these are. White space beside them stays."""
    data = text.encode()
    first, last = word_places(np.frombuffer(data, np.uint8))
    kept, done, gone, s = [], 0, 0, np.unique(starts)
    for run in np.split(s, np.flatnonzero(np.diff(s) > n) + 1):
        a, b = run[0], run[-1] + n
        kept.append(data[done : first[a]])
        done, gone = last[b - 1], gone + int(b - a)
    return b"".join([*kept, data[done:]]).decode(), gone


def deduped(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """docs with text less the words that later occurrences of n words in a row cover, and n_words_removed (long).

    Words are what ASCII white space parts, compared as they are. Before: in a document of a lesser doc_id (null is least; equal ids go by
    contents), or further up in the same one. The first occurrence stays. Texts of fewer than n words, empty ones and nulls stay as
    they are; of rows equal in id and text all but one lose all words if they have n. A column of docs that has an output's
    name is replaced.
    """
    docs = docs.drop("n_words_removed")
    keyed = line_dedup._keyed(docs.select(C.packed(docs), "doc_id", "text")).drop("doc_id")
    d = keyed.join(later(keyed, n), ["_sid", "_doc"], "left")
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_sid", "_doc").orderBy(F.lit(0))))

    @F.pandas_udf("text string, n long")
    def less(text: pd.Series, starts: pd.Series, nth: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, k in zip(text, starts, nth, strict=True):
            if t is not None and k > 1:
                m = len(word_places(np.frombuffer(t.encode(), np.uint8))[0])
                out.append(("", m) if m >= n else (t, 0))
            else:
                out.append((t, 0) if t is None or s is None else cut(t, s, n))
        return pd.DataFrame(out, columns=["text", "n"])

    d = d.withColumn("_less", less("text", "starts", "_nth"))
    return d.select(*C.unpacked(docs, text=F.col("_less.text")), F.col("_less.n").alias("n_words_removed"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines and n_removed of the line windows, n_words_removed of what they left, and the text that is left."""
    conf, kept = docs.sparkSession.conf, docs.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        lines = C.stored(line_dedup.deduped(docs.select("doc_id", "text")), "lines-deduped")
        return deduped(lines).select("doc_id", "n_lines", "n_removed", "n_words_removed", "text")
    finally:
        conf.unset(CLEANUP) if kept is None else conf.set(CLEANUP, kept)
