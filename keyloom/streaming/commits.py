"""Streams of records and of resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.scalars import outcome_class
from keyloom.operators.complete import settled
from keyloom.operators.resolve import resolve_exact
from keyloom.plans.store import Conflict, SnapshotStore
from keyloom.sources.records import parse


def commit_batch(batch: DataFrame, batch_id: int, store: SnapshotStore, stream: str, *, attempts: int = 5) -> bool:
    """Commits one batch of (seq, json) unless the store holds it already; says whether it did.

    If another writer publishes meanwhile, the batch is committed on top of what that one published.
    """
    for attempt in range(attempts):
        snapshot = store.read()
        if store.last_batch(stream) >= batch_id:
            return False
        try:
            store.publish(snapshot.with_clusters(settled(resolve_exact(parse(batch), snapshot.clusters))), stream=stream, batch=batch_id)
            return True
        except Conflict:
            if attempt + 1 == attempts:
                raise
    return False


def commit_stream(records: DataFrame, store: SnapshotStore, checkpoint: str, *, stream: str | None = None) -> StreamingQuery:
    """Commits a stream of (seq, json) batch by batch, each as one new version of the snapshot.

    The version records the stream's name (its checkpoint, if not given) and the number of the batch in one step with the
    change itself. So a batch that is run again after a failure is passed over exactly if it was
    published, and versions that others publish between batches make no difference.
    """
    name = stream or checkpoint.rstrip("/")
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: commit_batch(batch, batch_id, store, name) and None).start()


def windowed_miss_rate(resolutions: DataFrame, *, ts: str = "ts", reason: str = "reason_tag", length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, total, miss, miss_rate over tumbling or sliding windows; static or streaming input."""
    own = resolutions.withWatermark(ts, late) if resolutions.isStreaming else resolutions
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    miss = F.sum(F.when(outcome_class(F.col(reason)) == "miss", 1).otherwise(0))
    out = own.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("total"), miss.cast("long").alias("miss"))
    return out.select(F.col("w.start").alias("window_start"), "total", "miss", (F.col("miss") / F.col("total")).alias("miss_rate"))


def sessions(resolutions: DataFrame, key: str, *, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n: runs of requests without a longer gap."""
    own = resolutions.withWatermark(ts, late) if resolutions.isStreaming else resolutions
    return own.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
