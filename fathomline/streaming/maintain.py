"""Term statistics kept up to date from a stream of changes, with what a change takes away.

Each id's last terms are state (transformWithState): a new text takes the old one's counts away, a deletion takes all of them. The state of some dozens
of ids, a bucket, is one value, so it is read and written once a batch. Only differences leave the operator, a row a bucket and term that came or
went, and each micro-batch's sums are a folder of their own, written anew if the batch is run again, so a restart neither loses nor doubles any.
Statistics are the sum of the folders; `compact` puts those so far into one.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fathomline.functions.text import tokens

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELTA = "term string, df long, docs long, length long"
#: How long a deleted id is remembered where times are given, so that changes of it from before the deletion, arriving behind it, are known to be old.
REMEMBERED_MS = 24 * 3600 * 1000
BUCKETS = 4096


class Last(StatefulProcessor):
    """Per id of a bucket: the greatest seq seen, whether it is deleted, its length and its distinct terms. Gives the differences to the state before."""

    def __init__(self, remembered_ms: int | None = None):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "held binary")

    def _held(self) -> dict[str, list]:
        """id -> [seq, when a deleted one is forgotten or null, length or null if deleted, terms]."""
        return json.loads(zlib.decompress(self.state.get()[0])) if self.state.exists() else {}

    def _hold(self, held: dict[str, list]) -> None:
        if held:
            self.state.update((zlib.compress(json.dumps(held).encode(), 1),))
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for chunk in rows:  # of any number of changes of one id only the last is held
            for r in chunk.sort_values("seq", kind="stable").drop_duplicates("id", keep="last").itertuples(index=False):
                if str(r.id) not in last or r.seq > last[str(r.id)].seq:
                    last[str(r.id)] = r
        held, df, docs, length = self._held(), Counter(), 0, 0
        new_timer = False
        for i, r in last.items():
            seq, _, had, old = held.get(i, (None, None, None, ()))
            if seq is not None and int(r.seq) <= seq:
                continue
            gone = r.op == "delete"
            new = [] if gone or r.terms is None else [str(t) for t in r.terms]
            df.update(new)
            df.subtract(old)
            docs += int(not gone) - int(had is not None)
            length += (0 if gone else int(r.length)) - (had or 0)
            ends = timerValues.getCurrentWatermarkInMs() + self.remembered_ms if gone and self.remembered_ms is not None else None
            new_timer |= ends is not None
            held[i] = [int(r.seq), ends, None if gone else int(r.length), new]
        if last:
            self._hold(held)
            self._wake(held, new_timer)
            changed = [(t, n, 0, 0) for t, n in sorted(df.items()) if n] + [(None, 0, docs, length)]
            yield pd.DataFrame(changed, columns=["term", "df", "docs", "length"])

    def _wake(self, held: dict[str, list], needed: bool) -> None:
        ends = [x[1] for x in held.values() if x[1] is not None]
        if needed and ends:
            self.handle.registerTimer(min(ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Deleted ids whose time is over are forgotten; ones that have come back since stay."""
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        held = {i: x for i, x in held.items() if x[1] is None or x[1] > now}
        self._hold(held)
        self._wake(held, True)
        return iter(())

    def close(self) -> None:
        pass


def differences(changes: DataFrame, stops: list[str] | None = None, time: str | None = None, late: str = "1 hour", remembered_ms: int = REMEMBERED_MS, buckets: int = BUCKETS) -> DataFrame:
    """changes, a stream of (id, op, seq, text), op upsert or delete -> (term, df, docs, length): what each adds to or takes from the statistics.

    Of one id the change of the greatest seq counts, in whatever order they arrive; equal seqs are one change, repeated. An upsert with a null or
    empty text is a document without terms. Rows without id or seq are left out. The row of a null term has documents and lengths. Deleted ids
    are remembered; ids are told apart by their texts; where `time` names a column of event times, which arrive at most `late`, until the watermark is remembered_ms past the deletion.
    buckets: of ids, for good (a checkpoint keeps them); some dozens of documents in each are a fair number.
    """
    own = tokens("text", stops)
    changes = changes if time is None else changes.withWatermark(time, late)
    d = changes.filter("id IS NOT NULL AND seq IS NOT NULL").select(
        F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("id").cast("string").alias("id"), "op", F.col("seq").cast("long").alias("seq"), F.array_distinct(own).alias("terms"), F.size(own).cast("long").alias("length"), *([time] if time else [])
    )
    # Timers in event time: those in processing time would keep a run that ends with its input going for ever.
    return d.groupBy("bucket").transformWithStateInPandas(Last(remembered_ms if time else None), DELTA, "Update", "EventTime" if time else "None")


def maintain(changes: DataFrame, path: str, checkpoint: str, stops: list[str] | None = None, trigger: dict | None = None, **times) -> StreamingQuery:
    """Keep the statistics below path up to date with a stream of changes; by default until all that is there is read. times: as differences() has them.

    A session's state store has to be RocksDB (PROVIDER), which is set here if it isn't.
    """
    spark = changes.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")]).filter("df != 0 OR docs != 0 OR length != 0")
        summed.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    d = differences(changes, stops, **times).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return d.trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, path: str, number: str) -> DataFrame:
    """The folders below path by their number; no rows where none is."""
    try:
        return spark.read.schema(f"{DELTA}, {number} long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{DELTA}, {number} long")


def _sums(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All differences: the newest compacted folder and the batches behind it; and the number of the last batch, -1 without any."""
    folded, batches = _read(spark, f"{path}/compacted", "upto"), _read(spark, f"{path}/batches", "batch")
    upto = folded.agg(F.max("upto")).first()[0]
    upto = -1 if upto is None else upto
    last = batches.agg(F.max("batch")).first()[0]
    own = ("term", "df", "docs", "length")
    return folded.filter(F.col("upto") == upto).select(*own).unionByName(batches.filter(F.col("batch") > upto).select(*own)), max(upto, -1 if last is None else last)


def statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, totals) as index.load gives them: (term, df) and one row (total_docs, avg_doc_length)."""
    d, _ = _sums(spark, path)
    terms = d.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    sums = d.filter("term IS NULL").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total_docs"), F.sum("length").alias("_length"))
    return terms, sums.select("total_docs", F.try_divide("_length", "total_docs").alias("avg_doc_length"))


def compact(spark: SparkSession, path: str) -> int:
    """Put the statistics of all batches so far into one folder, named by the last one's number, which is returned (-1 without any).

    Readers pass over batches up to the greatest such number. Run it between batches: one that is being written is taken for whole.
    """
    d, upto = _sums(spark, path)
    if upto >= 0:
        own = d.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")]).filter("df != 0 OR docs != 0 OR length != 0")
        own.write.mode("overwrite").parquet(f"{path}/compacted/upto={upto}")
    return upto
