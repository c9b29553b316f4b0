"""Micro-batch ingestion of items that have stopped changing.

Changes come as (path, size, at) rows. sessions closes a path after a gap without
changes, on a batch or on a stream; ingest takes settled items batch by batch and
writes those whose content is new to a versioned table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import rendered
from ..sources.store import Store


def sessions(event: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of changes by user with no gap above gap_seconds."""
    by = W.partitionBy("user_id").orderBy("at")
    wide = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(by).cast("timestamp")) <= gap_seconds * 1_000_000
    marked = event.select("user_id", "at", F.when(wide, 0).otherwise(1).alias("fresh"))
    numbered = marked.withColumn("session", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(rendered(F.min("at")).alias("first_at"), rendered(F.max("at")).alias("last_at"), F.count("*").alias("changes")).drop("session")


def settled(changes: DataFrame, settle: str = "4 seconds", late: str = "10 minutes") -> DataFrame:
    """On a stream: a path with its last size once it hasn't changed for the settle time. Rows later than late are dropped."""
    watched = changes.withWatermark("at", late).groupBy("path", F.session_window("at", settle))
    last = F.max(F.struct("at", "size", "hash")).alias("last")
    return watched.agg(last, F.count("*").alias("changes")).select("path", "last.size", "last.hash", "changes", F.col("session_window.start").alias("since"))


def windowed_counts(event: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """On a stream: events by kind in tumbling windows."""
    return event.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def ingest(store: Store, stream: str, table: str = "asset") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: what the table doesn't hold yet is appended, once a batch even if the batch repeats.

    stream names the query, as its batch numbers are its own; give a new name with a new checkpoint.
    """

    def body(batch: DataFrame, number: int) -> None:
        if store.mark(table, stream) >= number + 1:
            return
        firsts = batch.groupBy("hash").agg(F.min(F.struct("path", "size")).alias("x")).select("hash", "x.path", "x.size")
        store.insert_ignore(table, firsts, ["hash"], mark={stream: number + 1})

    return body


def replicated(store: Store, stream: str, replicas: list[str], source: str = "asset", table: str = "placement") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function of the whole order: ingest first, then a placement on each replica, then the staged rows are cleared.

    Each step has its own mark, so a batch that failed between two goes on where it stopped.
    """
    first = ingest(store, stream, source)

    def body(batch: DataFrame, number: int) -> None:
        first(batch, number)
        if store.mark(table, stream) < number + 1:
            rows = batch.select("hash").distinct().select("hash", F.explode(F.array(*map(F.lit, replicas))).alias("replica"), F.lit("present").alias("state"))
            store.insert_ignore(table, rows, ["hash", "replica"], mark={stream: number + 1})
        if store.exists("staged") and store.mark("staged", stream) < number + 1:
            store.delete("staged", batch.select("path").distinct(), ["path"], mark={stream: number + 1})

    return body


def run(changes: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a stream of settled items into body: once over what is there, or at an interval. Returns the query, whose stop and lastProgress serve to cancel and to watch."""
    writer = settled(changes).writeStream.outputMode("append").foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
