"""SentencePiece encoding by a table of distinct chunks.

Where no piece of a model crosses a whitespace marker, a text is encoded word by word: each distinct marked word is segmented once, by the
sentencepiece library, and its ids are put where the word stands.

1. Documents are read in blocks of whole rows. A block has a dictionary of its distinct words, and each document is the places of its words in
   it, one to three bytes each.
2. Words of all blocks meet by hash, packed, a row a block and bucket: a word comes once a block, however often it stands there, so a common
   word is no hot key. Each distinct word of a bucket is segmented once.
3. Ids go back to the block that asked and are joined to its documents by place.

Texts themselves are never shuffled, nothing goes to the driver, and a task holds one block or one bucket's table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked

MARK = "▁"
#: Code points of a block. A dictionary of more holds fewer words over all, but takes more of a task's memory.
BLOCK_CHARS = 16_000_000
#: Words of a block that are numbered by frequency, so that their places take one or two bytes.
FREQUENT = 16_383
#: Positions that are turned into ids at once.
SLICE = 250_000
#: A byte that UTF-8 doesn't have.
SEP = b"\xff"
#: Segmented words that a task remembers; more begin anew, so that memory is bounded.
TABLE = 500_000


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


class Words:
    """How a model's texts part into words that are encoded apart.

    A word is a run of markers and what follows it, or a line break and what follows it if no piece has one beside other characters. Its key
    is what the library has to be given: the first marker is left out, as the library puts it there. A model with a piece that crosses a
    marker, one that normalises its input, or one without the leading marker is refused.
    """

    def __init__(self, sp):
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces) or MARK not in pieces:
            raise ValueError("pieces of this model cross whitespace markers")
        if "".join(sp.encode("a  a", out_type=str)) != f"{MARK}a{MARK}{MARK}a" or sp.decode(sp.encode("\ufb01")) != "\ufb01":
            raise ValueError("this model changes texts before it segments them")
        self.sp, self.alone = sp, [sp.piece_to_id(MARK)]  # the library gives nothing for an empty text, so a marker alone is looked up
        self.lines = sp.is_byte(sp.piece_to_id("<0x0A>")) and not any("\n" in p and len(p) > 1 for p in pieces)
        self.skip = len(sp.encode("\n")) - 1
        self.pattern = re.compile(" +[^ \n]*|\n[^ \n]*" if self.lines else " +[^ ]*")

    def of(self, text: str) -> list[str]:
        """The keys of a text's words in order."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return [w[1:] if w[0] == " " else w for w in self.pattern.findall(" " + text)]
        return (text.replace("\n", " \n") if self.lines and "\n" in text else text).split(" ")

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of words by their keys."""
        found = self.sp.encode(words, num_threads=1)
        return [(i[self.skip :] if self.lines and w[:1] == "\n" else i) if w else self.alone for w, i in zip(words, found, strict=True)]


def _packed_ints(a: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2**28 as bytes of seven bits, low ones first, the last of a number with its high bit clear; and how many bytes each took."""
    a = a.astype(np.uint32)
    n = 1 + (a >= 1 << 7).astype(np.int64) + (a >= 1 << 14) + (a >= 1 << 21)
    most = int(n.max(initial=1))
    out = np.empty((len(a), most), np.uint8)
    for k in range(most):
        out[:, k] = (a >> (7 * k)) & 0x7F
        out[:, k] |= (n > k + 1).astype(np.uint8) << 7
    return out[np.arange(most) < n[:, None]].tobytes(), n


def _unpacked_ints(b: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    within = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 0x7F).astype(np.uint32) << (7 * within).astype(np.uint32), first).astype(np.int64) if len(last) else last


def _bytes_of(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    if not len(column):
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)


def _hash(word: bytes, n: int) -> int:
    """The bucket of a word; the same in every process."""
    from zlib import crc32

    return crc32(word) % n


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids", bos: bool = False, eos: bool = True, block_chars: int = BLOCK_CHARS, back: str | None = None) -> DataFrame:
    """docs without `text`, with `out`: array<int>, the ids that the sentencepiece library gives for the whole text, one row a row.

    model: path of a model on the driver, of any kind whose pieces don't cross markers; its bytes go out to tasks. A null text is an empty one (only bos and eos). Texts of any length are one
    row of a block, a word of any length is one entry. Equal rows each have their ids; columns of any name but `out` stay, which it replaces.
    back: a column with what the library decodes the ids to, made where they are put together.
    docs whose plan deals rows out anew are stored first, so that a block that has to be made again is the same.
    """
    spark = docs.sparkSession
    if "Exchange" in docs._jdf.queryExecution().sparkPlan().toString() or "Repartition" in docs._jdf.queryExecution().optimizedPlan().toString():
        docs = stored(docs, "pieces-input")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    proto = model_bytes(model)
    sp = processor(proto)
    Words(sp)  # a model that can't be used is refused here
    shared = spark.sparkContext.broadcast(proto)
    wide = np.uint16 if sp.get_piece_size() <= 1 << 16 else np.uint32
    ends = ([sp.bos_id()] if bos else []), ([sp.eos_id()] if eos else [])
    others = [c for c in docs.columns if c not in (text, out, back)]
    rest = docs.select(*others)
    row = packed(rest) if others else F.struct(F.lit(0).alias("_")).alias("_row")
    kind = docs.select(row).schema[0].dataType.simpleString()

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, task, seq = Words(processor(shared.value)).of, TaskContext.get().partitionId(), 0
        names: list[pa.RecordBatch] = []

        def anew():
            d: defaultdict = defaultdict()
            d.default_factory = d.__len__
            return d

        def closed(rows, places, d, key):
            """Rows of a block: its documents, in parts, and its words, one row a bucket."""
            # Number 0 stands before a text, 1 behind it.
            at = np.concatenate(places).astype(np.int64)
            keys = [w.encode() for w in d]
            count = np.bincount(at, minlength=len(keys) + 2)[2:]
            often = np.argsort(-count, kind="stable")[:FREQUENT]
            number = np.zeros(len(keys), np.int64)
            number[often] = 2 + np.arange(len(often))
            bucket = np.fromiter((_hash(w, n) for w in keys), np.int64, len(keys))
            is_often = np.zeros(len(keys), bool)
            is_often[often] = True
            later = sorted(np.flatnonzero(~is_often).tolist(), key=lambda i: (bucket[i], keys[i]))
            number[later] = 2 + len(often) + np.arange(len(later))
            number = np.concatenate(([0, 1], number))
            i = 0
            for part in rows:
                for start in range(0, part.num_rows, 500):
                    few = part.slice(start, 500)
                    own = places[i : i + few.num_rows]
                    i += few.num_rows
                    data, took = _packed_ints(number[np.concatenate(own)])
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                    offsets = np.concatenate(([0], np.cumsum(took)))[cuts].astype(np.int32)
                    col = pa.Array.from_buffers(pa.binary(), few.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield batch(few.num_rows, k=np.full(few.num_rows, key), row=few.column(0), at=col)
            often = often.tolist()
            firsts = np.searchsorted(bucket[later], np.arange(n + 1)) if later else np.zeros(n + 1, np.int64)
            top: dict[int, list[int]] = defaultdict(list)
            for i in often:
                top[int(bucket[i])].append(i)
            out = []
            for b in range(n):
                own = top.get(b, []) + later[firsts[b] : firsts[b + 1]]
                if own:
                    out.append((-1 - b, key, 2 + len(often) + int(firsts[b]), np.array([number[2 + i] for i in top.get(b, [])], np.uint16).tobytes(), SEP.join(keys[i] for i in own)))
            for start in range(0, len(out), 64):
                k, block, first, tops, text = zip(*out[start : start + 64], strict=True)
                yield batch(len(k), k=np.array(k), block=pa.array(block, pa.int64()), first=pa.array(first, pa.int64()), top=pa.array(tops, pa.binary()), words=pa.array(text, pa.binary()))

        def batch(size, k, row=None, at=None, block=None, first=None, top=None, words=None):
            cols = [pa.array(k, pa.int64()), row if row is not None else pa.nulls(size, row_type), at, block, first, top, words]
            kinds = [None, None, pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(size, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "_row", "at", "block", "first", "top", "words"])

        places, held, d, row_type = [], 0, anew(), None
        for whole in batches:
            row_type = whole.schema.field(0).type
            since = 0
            for i, t in enumerate(x or "" for first in range(0, whole.num_rows, 500) for x in whole.column(1).slice(first, 500).to_pylist()):
                places.append(np.array([0, *[d[w] + 2 for w in words_of(t)], 1], np.uint32))
                held += len(t)
                if held >= block_chars:
                    names.append(whole.slice(since, i + 1 - since).select([0]))
                    yield from closed(names, places, d, (task << 24) | seq)
                    names, places, held, d, since = [], [], 0, anew(), i + 1
                    seq += 1
            if since < whole.num_rows:
                names.append(whole.slice(since).select([0]))
        if places:
            yield from closed(names, places, d, (task << 24) | seq)

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of the buckets once; rows of documents, which are dealt out by the same shuffle, are passed over."""
        words, known = Words(processor(shared.value)), {}
        for b in batches:
            b = b.filter(b.column(3).is_valid())
            for start in range(0, b.num_rows, 16):
                few = b.slice(start, 16)
                counts, ids = [], []
                for joined in few.column(6).to_pylist():
                    keys = joined.split(SEP)
                    new = [w for w in keys if w not in known]
                    if len(known) + len(new) > TABLE:
                        known.clear()
                        new = keys
                    known.update(zip(new, words.ids([w.decode() for w in new]), strict=True))
                    own = [known[w] for w in keys]
                    counts.append(_packed_ints(np.fromiter(map(len, own), np.int64, len(own)))[0])
                    ids.append(np.array([x for i in own for x in i], wide).tobytes())
                cols = [few.column(3), few.column(4), few.column(5), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "first", "top", "counts", "own"])

    def joined(documents: Iterator[pa.RecordBatch], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents and the ids of its words. A bucket's words come as a group of their own, without ids: passed over."""
        parts = [(x.column("first")[i].as_py(), *(x.column(c)[i].as_py() for c in ("top", "counts", "own"))) for x in tables for i in range(x.num_rows)]
        numbers, lens, flat = [np.array([0, 1])], [np.array([len(ends[0]), len(ends[1])])], [np.array([*ends[0], *ends[1]], wide)]
        for first, top, counts, own in parts:
            top = np.frombuffer(top, np.uint16).astype(np.int64)
            n_ids = _unpacked_ints(np.frombuffer(counts, np.uint8))
            numbers.append(np.concatenate((top, first + np.arange(len(n_ids) - len(top)))))
            lens.append(n_ids)
            flat.append(np.frombuffer(own, wide))
        number, long, ids = np.concatenate(numbers), np.concatenate(lens), np.concatenate(flat)
        start, size = np.full(int(number.max()) + 1, -1), np.zeros(int(number.max()) + 1, np.int64)
        start[number], size[number] = np.cumsum(long) - long, long
        decode = processor(shared.value).decode if back else None
        for b in documents:
            b = b.filter(b.column("at").is_valid())
            step = 250
            for first in range(0, b.num_rows, step):
                few = b.slice(first, step)
                at = _unpacked_ints(_bytes_of(few.column("at")))
                if at.max(initial=0) >= len(start) or (start[at] < 0).any():
                    raise RuntimeError("a block's words differ from those that were segmented: the rows were read in another order")
                lens = size[at]
                stops = np.flatnonzero(at == 1)
                ends_at = np.cumsum(lens)
                values = np.empty(int(ends_at[-1]), np.int32)
                for s in range(0, len(at), SLICE):
                    a, n_own = at[s : s + SLICE], lens[s : s + SLICE]
                    lo = int(ends_at[s] - lens[s])
                    m = int(n_own.sum())
                    values[lo : lo + m] = ids[np.repeat(start[a] - (np.cumsum(n_own) - n_own), n_own) + np.arange(m)]
                offsets = np.concatenate(([0], ends_at[stops])).astype(np.int32)
                cols = [few.column("_row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                if decode:
                    cols.append(pa.array([decode(values[i:j].tolist()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["_row", "ids", "back"][: len(cols)])

    dealt = docs.select(row, F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(dictionaries, f"k long, _row {kind}, at binary, block long, first long, top binary, words binary")
    dealt = dealt.repartition(n, "k")
    tables = dealt.mapInArrow(segmented, "k long, first long, top binary, counts binary, own binary")
    done = _cogrouped(dealt, tables, joined, f"_row {kind}, ids array<int>" + (", back string" if back else ""))
    return done.select(*(unpacked(rest) if others else []), F.col("ids").alias(out), *([F.col("back").alias(back)] if back else []))


def _cogrouped(left: DataFrame, right: DataFrame, f, schema: str) -> DataFrame:
    """f over the batches of both sides of each k."""

    def whole(x: pa.Table, y: pa.Table) -> pa.Table:
        found = list(f(iter(x.combine_chunks().to_batches()), iter(y.to_batches())))
        return pa.Table.from_batches(found) if found else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return left.groupBy("k").cogroup(right.groupBy("k")).applyInArrow(whole, schema)


def decoded(ids: str | Column, model: str) -> Column:
    """The text that the library's decode gives for ids; null for null ids."""
    proto = model_bytes(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = processor(proto)
        for s in batches:
            yield pd.Series([None if x is None else sp.decode(x.tolist()) for x in s])

    return run(F.col(ids) if isinstance(ids, str) else ids)


def report(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: its ids with an end id, and what they decode to.

    A null text is an empty one: the end id alone. Repeated rows each have their row.
    """
    d = encode(docs.select("doc_id", "text"), model, back="decoded")
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
