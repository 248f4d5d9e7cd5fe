"""Refreshing an index from a stream of documents, and windowed counts with late data. Extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators import index
from fathomline.operators.catalog import Catalog


def refresh(stream: DataFrame, catalog: Catalog, checkpoint: str, table: str = "elements", id_col: str = "id") -> StreamingQuery:
    """Upsert each micro-batch into the table; a batch that fails ends the query, so none is lost."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            catalog.upsert(table, batch, id_col)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Running document frequencies of a stream of documents (complete or update mode)."""
    return index.postings(stream, "doc_id", text).groupBy("term").agg(F.count("*").alias("df"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in windows of event time; those later than `late` don't count."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(win, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total"
    )
