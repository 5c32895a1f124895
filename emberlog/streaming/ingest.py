"""Streams: events upserted batch by batch with a resumable checkpoint, sessions that close by watermark, silence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.store import Change, Store


def without_replays(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Late rows within delay count once; overlapping re-reads are absorbed."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source", "source_id", "text"])


def closed_sessions(stream: DataFrame, keys: list[str], gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions in append mode: emitted once closed. session_window splits at gaps from its length on, the batch form
    only beyond, hence the microsecond."""
    window = F.session_window("ts", f"{gap_seconds} seconds 1 microseconds")
    got = stream.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n"))
    return got.drop("w")


def tumbling_counts(stream: DataFrame, width: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    got = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("bin_start"), *keys, "n")


def archive_stream(stream: DataFrame, store: Store, change_of: Callable[[DataFrame], Change], checkpoint: str, name: str = "events", once: bool = True) -> StreamingQuery:
    """Every batch is one commit of the store, made by change_of(batch); the batch's number is committed with it, so a batch
    that is given again after its commit changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        note = f"stream {name}"
        if store.manifest()["notes"].get(note, -1) >= number:
            return
        change = change_of(batch)
        change.notes[note] = number
        change.commit()

    return upsert_stream(stream, apply, checkpoint, once)


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """apply(batch, batch id) must be idempotent: a batch is given again if its commit was lost."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
