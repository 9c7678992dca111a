"""Structured Streaming variants: snapshots by micro-batch, windows over late events, last-writer-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import store
from ..operators import snapshots
from ..sources import pages


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, ts: str, key: str, value: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst of writes."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.max_by(value, ts).alias(value), F.count("*").alias("writes"))


def last_writer(events: DataFrame, key: str, stamp: str, client: str, value: str) -> DataFrame:
    """Running last-writer-wins state; write it in update mode."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(stamp, client)).alias(value), F.max(stamp).alias(stamp))


def snapshot_batches(stream: DataFrame, publish, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``publish(batch, batch_id)`` for each micro-batch of what has arrived; the id makes retries idempotent."""
    return stream.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(records: DataFrame, path: str, key: str, stamp: str, client: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch into the table at ``path`` (``store.upsert``): a batch that comes again after a restart changes nothing."""
    return snapshot_batches(records, lambda batch, i: store.upsert(batch, path, key, stamp, client, i, buckets), checkpoint)


def run_stream(items: DataFrame, reports_of, path: str, vertical: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Each micro-batch as one run of a vertical: what its sources could not deliver is retained, what changed is written beside it, and all of it is published at once.

    ``reports_of(batch)``: the reports of the run's sources (``pages.REPORT``).  items: as ``snapshots.reconcile`` takes them, with sources array<string>; of a repeated id the last by
    ``ord`` counts.  The batch's number is published with its snapshot, so that a batch that comes again after a crash, before or after publishing, changes nothing.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= (store.note(spark, path, vertical, "batch") if store.note(spark, path, vertical, "batch") is not None else -1):
            return
        now = snapshots.last_of(batch, key)
        reports = reports_of(batch)
        before = store.read_snapshot(spark, path, vertical)
        if before is None:
            kept, changes = now.withColumn("status", F.lit("new")), None
        else:
            kept = snapshots.retain(before, now.withColumn("status", F.lit(None).cast("string")), pages.impaired(reports), key)
            kept, changes = snapshots.reconcile(before, kept), snapshots.item_changes(before, kept, key)
        tables = {"items": kept, "reports": reports} | ({"changes": changes} if changes is not None else {})
        store.write_snapshot(spark, path, vertical, tables, str(number), {"batch": number})

    return snapshot_batches(items, publish, checkpoint)
