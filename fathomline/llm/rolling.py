"""Features of sliding windows: counts, sums, distinct categories and quantiles of what came before each row.

A window depends on a row's key and time alone, so rows of one key, time, category and value are first counted together; a time with any number
of rows is one step. Keys are cut into stretches of time that each get the rows of the longest window before them, so a hot key goes through
many tasks and no row goes to more than a few. A task sweeps its stretch with two pointers a window: rows come in at the front and leave at the
back; each quantile keeps two heaps, whose border moves to the rank asked for as the window's size changes; what leaves is marked and thrown
away when it comes up; categories are counted by reference.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import quoted_name, unpacked


class Quantile:
    """The value of rank ceil(q * m) of m values that come and go, each with a weight: how often it is there.

    `low` holds the smallest values, so many that their weights reach the rank but wouldn't without the greatest of them, which is the answer;
    `high` has the rest. Removed values stay in their heap as tombstones until they are on top, or until half of a heap is such.
    """

    def __init__(self, q: Fraction):
        self.up, self.down = q.numerator, q.denominator
        self.low: list[tuple[int, int]] = []  # (-value, entry)
        self.high: list[tuple[int, int]] = []  # (value, entry)
        self.side: dict[int, tuple[bool, int]] = {}  # entry -> in low?, weight; an entry without one is a tombstone
        self.weight = [0, 0]  # of high, of low
        self.dead = [0, 0]

    def add(self, entry: int, value: int, weight: int) -> None:
        self._clean(self.low, 1)
        in_low = bool(self.low) and value <= -self.low[0][0]
        heapq.heappush(*((self.low, (-value, entry)) if in_low else (self.high, (value, entry))))
        self.side[entry] = in_low, weight
        self.weight[in_low] += weight

    def remove(self, entry: int) -> None:
        in_low, weight = self.side.pop(entry)
        self.weight[in_low] -= weight
        self.dead[in_low] += 1
        heap = self.low if in_low else self.high
        if self.dead[in_low] * 2 > len(heap) + 16:
            heap[:] = [x for x in heap if x[1] in self.side]
            heapq.heapify(heap)
            self.dead[in_low] = 0

    def _clean(self, heap: list[tuple[int, int]], in_low: int) -> None:
        while heap and heap[0][1] not in self.side:
            heapq.heappop(heap)
            self.dead[in_low] -= 1

    def value(self) -> int | None:
        """The answer, after the border is moved to the rank; None without values."""
        m = self.weight[0] + self.weight[1]
        if not m:
            return None
        rank = max(1, -(-self.up * m // self.down))
        while self.weight[1] < rank:
            self._clean(self.high, 0)
            self._move(self.high, self.low, True)
        self._clean(self.low, 1)
        while self.weight[1] - self.side[self.low[0][1]][1] >= rank:
            self._move(self.low, self.high, False)
            self._clean(self.low, 1)
        return -self.low[0][0]

    def _move(self, a: list[tuple[int, int]], b: list[tuple[int, int]], to_low: bool) -> None:
        value, entry = heapq.heappop(a)
        heapq.heappush(b, (-value, entry))
        weight = self.side[entry][1]
        self.side[entry] = to_low, weight
        self.weight[to_low] += weight
        self.weight[not to_low] -= weight


def swept(time: list[int], value: list[int | None], category: list[int | None], n: list[int], asked: Sequence[int], width: int, quantiles: Sequence[Fraction]) -> Iterator[tuple]:
    """(count, sum, distinct categories, *quantiles) of each asked time t over the cells with t - width <= time < t. Cells and asked times ascend.

    A cell stands for n rows of its time, category and value; quantiles and the sum leave null values out, the count has them.
    """
    heaps = [Quantile(q) for q in quantiles]
    seen: dict[int, int] = {}
    front = back = count = total = 0
    for t in asked:
        while front < len(time) and time[front] < t:
            count += n[front]
            if category[front] is not None:
                seen[category[front]] = seen.get(category[front], 0) + 1
            if value[front] is not None:
                total += value[front] * n[front]
                for h in heaps:
                    h.add(front, value[front], n[front])
            front += 1
        while back < front and time[back] < t - width:
            count -= n[back]
            c = category[back]
            if c is not None:
                seen[c] -= 1
                if not seen[c]:
                    del seen[c]
            if value[back] is not None:
                total -= value[back] * n[back]
                for h in heaps:
                    h.remove(back)
            back += 1
        yield (count, total, len(seen), *(h.value() for h in heaps))


def rolling(
    rows: DataFrame, key: str, time: Column, value: Column, category: Column, widths: Sequence[int], quantiles: dict[str, Fraction], keep: list[str] | None = None, stretch: int | None = None
) -> DataFrame:
    """Rows of rows, each as often as there are widths: the columns `keep` (all unless given), and window_s, event_s (the time), n_events, sum_chars, n_langs
    and a column a quantile, which replace columns of these names.

    The window of a row and a width W: all rows of its key (null is one) with time - W <= theirs < time, so neither the row, nor equal ones, nor others of
    its time are in it. time, value: integers. Rows without a time are in no window and their own is empty. Rows without a value count, but have no
    part in sum and quantiles, which are null where there is no value; rows without a category are of none. Repeated rows count each. An empty
    table gives none. stretch: seconds of a key that are swept at once, with the cells of the longest width before them; that width unless given.
    """
    n_parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    widths, names = sorted(set(widths)), ["n_events", "sum_chars", "n_langs", *quantiles]
    reach = widths[-1]
    stretch = stretch or reach

    cells = rows.select(F.col(key).alias("_k"), time.cast("long").alias("_t"), value.cast("long").alias("_v"), category.alias("_c")).filter("_t IS NOT NULL")
    cells = cells.groupBy("_k", "_t", "_v", "_c").agg(F.count("*").alias("_n"))
    at = "({0} - pmod({0}, {1}L)) div {1}L"
    dealt = cells.withColumn("_own", F.expr(at.format("_t", stretch))).withColumn("_s", F.explode(F.sequence("_own", F.expr(at.format(f"(_t + {reach}L)", stretch)))))
    dealt = dealt.select("_k", "_s", "_t", "_v", "_c", "_n", (F.col("_s") == F.col("_own")).alias("_mine"))
    # A number of partitions of our own: stretches are short, and are not to be put together in one task.
    dealt = dealt.repartition(n_parts, "_k", "_s").sortWithinPartitions("_k", "_s", "_t")
    fields = [("_k", rows.schema[key].dataType), ("_t", LongType()), *((f"{c}_{w}", LongType()) for w in widths for c in names)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches):
            t, v, c, n = (part.column(i).to_pylist() for i in (2, 3, 4, 5))
            asked = np.unique(part.column(2).to_numpy()[part.column(6).to_numpy()]).tolist()
            if asked:
                k = pa.concat_arrays(part.column(0).slice(0, 1).chunks).take(pa.array(np.zeros(len(asked), np.int64)))
                found = [pa.array(x, pa.int64()) for w in widths for x in zip(*swept(t, v, c, n, asked, w, list(quantiles.values())), strict=True)]
                yield pa.RecordBatch.from_arrays([k, pa.array(asked, pa.int64()), *found], names=[f[0] for f in fields])

    found = dealt.mapInArrow(sweep, StructType([StructField(c, t) for c, t in fields]))
    rest = rows.select(*[F.col(quoted_name(c)) for c in (rows.columns if keep is None else keep) if c not in {*names, "window_s", "event_s"}])
    own = [quoted_name(c) for c in rest.columns]
    base = rows.select(F.struct(*own, F.lit(0).alias("_")).alias("_row"), F.col(key).alias("_rk"), time.cast("long").alias("_rt"))
    d = base.join(found, base["_rk"].eqNullSafe(found["_k"]) & (base["_rt"] == found["_t"]), "left")
    zero = lambda c, w: F.coalesce(f"{c}_{w}", F.lit(0).cast("long")).alias(c)
    per = [F.struct(F.lit(w).cast("long").alias("window_s"), F.col("_rt").alias("event_s"), *[zero(c, w) for c in names[:3]], *[F.col(f"{q}_{w}").alias(q) for q in quantiles]) for w in widths]
    d = d.select("_row", F.explode(F.array(*per)).alias("_f"))
    return d.select(*unpacked(rest), *[F.col(f"_f.{c}").alias(c) for c in ("window_s", "event_s", *names)])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key and stretch (the first two columns) at a time; they stand together."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        code, s = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            here = b.column(0)[i].as_py(), int(s[i])
            if held and here != at:
                yield pa.Table.from_batches(held)
                held = []
            at = here
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def event_time(doc_id: str = "doc_id") -> Column:
    """60 * floor((doc_id + h mod 10000) / 6), h the crc32 of the id in decimal; in integers, so exact."""
    x = f"({doc_id} + CAST(crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) % 10000 AS BIGINT))"
    return F.expr(f"60L * (({x} - pmod({x}, 6L)) div 6L)")


def report(docs: DataFrame) -> DataFrame:
    """Two rows a row of documents: doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars.

    Lengths are the texts' own code points; a null text has none, an empty one has 0. Rows with a null doc_id have no time: their windows are empty.
    Null sources are one source. Repeated rows each have their two and count each in later windows.
    """
    return rolling(docs, "source", event_time(), F.length("text"), F.col("lang"), [600, 43200], {"median_chars": Fraction(1, 2), "high_chars": Fraction(9, 10)}, keep=["doc_id"])
