"""Dense vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

WORD = re.compile(r"\w+")


def doubles(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(v: str | Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def encode(text: str | None, dim: int = 64) -> list[float]:
    """Signed counts of hashed words, of length 1; zeros without words."""
    v = np.zeros(dim)
    for w in WORD.findall((text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    n = np.sqrt(v @ v)
    return (v / n if n else v).tolist()


#: Texts that an encoder gets at once, and that one request may hold.
SUB_BATCH, MOST_TEXTS = 32, 100
Encoder = Callable[[list[str]], np.ndarray]


def hashing(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a neural encoder."""
    one = encode
    return lambda texts: np.array([one(t, dim) for t in texts])


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def encoded(text: str | Column, dim: int = 64, encoder: Callable[[], Encoder] | None = None, batch: int = SUB_BATCH) -> Column:
    """Vectors of length 1, by an Arrow UDF. `encoder` makes the encoder once a task (a model is loaded there, not sent); it gets at most `batch`
    texts at once, null as ''. Without one words are hashed to dim numbers."""
    make, unit = encoder or (lambda: hashing(dim)), unit_rows

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for s in batches:
            # Of a batch of Spark's only `batch` texts are Python's at a time, and vectors are plain numbers.
            parts = [unit(np.asarray(model([t or "" for t in s.slice(i, batch).to_pylist()]), dtype=float)) for i in range(0, len(s), batch)]
            lens = np.concatenate([[0], *(np.full(len(p), p.shape[1]) for p in parts)])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(lens), pa.int32()), pa.array(np.concatenate([np.zeros(0), *(p.ravel() for p in parts)])))

    return run(col(text))


def embedded(texts: list[str], encoder: Encoder | None = None, most: int = MOST_TEXTS) -> list[list[float]]:
    """One request's vectors, without Spark; over `most` texts, or none, are a ValueError."""
    if not 1 <= len(texts) <= most:
        raise ValueError(f"a request has 1 to {most} texts")
    return unit_rows(np.asarray((encoder or hashing())(texts), dtype=float)).tolist()
