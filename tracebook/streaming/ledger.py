"""The event log as a stream: windowed counts, and upserts of running totals.

The reference data model has a run log at rest; that it can also be followed
as it grows is an addition of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracebook.operators.merging import upsert
from tracebook.sources.store import SnapshotStore


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str, lateness: str) -> DataFrame:
    """Counts per tumbling window and group; rows later than `lateness` are
    dropped in a stream, none in a batch."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def follow_into(stream: DataFrame, store: SnapshotStore, table: str, keys: list[str], checkpoint: str, part: Callable[[DataFrame], Column]) -> StreamingQuery:
    """Upsert each micro-batch of finished windows into tables of the store, one
    for each value of `part` (such as the day of the window), named
    `table/value`; only those that the batch touches are written again."""

    def write(batch: DataFrame, _: int) -> None:
        now = store.current()
        cut = batch.withColumn("_part", part(batch).cast("string")).persist()
        try:
            changed = {}
            for (value,) in cut.select("_part").distinct().collect():
                name, rows = f"{table}/{value}", cut.filter(F.col("_part").eqNullSafe(F.lit(value))).drop("_part")
                changed[name] = upsert(store.table(name), rows, keys) if name in now["tables"] else rows
            if changed:
                store.commit(changed, expected=now["id"])
        finally:
            cut.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def followed(store: SnapshotStore, table: str) -> DataFrame:
    """All parts of a followed table."""
    parts = [store.table(n) for n in sorted(store.current()["tables"]) if n.startswith(f"{table}/")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
