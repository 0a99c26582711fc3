"""Pairing records with the nearest record in time: a stateful streaming join.

Both sides are buffered per entity. A left row comes out once the watermark
has passed its tolerance horizon, when no nearer right row can arrive any
more; right rows that no left row to come can reach are evicted. Entities are
put in buckets, and the buffers of a bucket lie in one state, cut into slices
of time; slices that are counted as hot are salted: the left rows are spread,
the right rows copied to each salt, so no task ever holds more than one salted
slice of a bucket. A table at rest goes through the same stream in waves of
ascending time, so that its state moves on and shrinks as a live one's does.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracebook.sources.tables import broadcast_if_small, staging_path

LEFT, RIGHT, MARKER = 0, 1, 2
#: The buffered rows as one Arrow record batch, of columns HELD.
STATE = "rows binary"
HELD = ["side", "of", "us", "id", "tol_us"]
BATCH = pa.schema([("side", pa.int32()), ("of", pa.string()), ("us", pa.int64()), ("id", pa.string()), ("tol_us", pa.int64())])
#: Rows of both sides in one stream. id: the left id, or what stands for the right row.
ROWS = "bucket int, slice bigint, salt int, at timestamp, side int, of string, us bigint, id string, tol_us bigint"
OUT = "id string, row string, distance_us bigint"
#: What a right row's name begins with, so that an empty one stands for none.
NAMED = "="


def nearest(l_of: np.ndarray, l_at: np.ndarray, r_of: np.ndarray, r_at: np.ndarray) -> np.ndarray:
    """For each left row the index of the nearest right row of its entity (the
    earlier one on a tie), -1 where there is none. The right rows ascend by
    entity code and time and hold each time of an entity once."""
    if not len(r_at) or not len(l_at):
        return np.full(len(l_at), -1)
    base = min(l_at.min(), r_at.min())
    span = max(l_at.max(), r_at.max()) - base + 1
    after = np.searchsorted(r_of * span + (r_at - base), l_of * span + (l_at - base))
    far = np.iinfo("int64").max
    gaps = []
    for i in (after - 1, after):
        inside = np.clip(i, 0, len(r_at) - 1)
        gaps.append(np.where((i == inside) & (r_of[inside] == l_of), np.abs(l_at - r_at[inside]), far))
    found = np.where(gaps[0] <= gaps[1], after - 1, after)
    return np.where(np.minimum(*gaps) == far, -1, found)


def _step(horizon_us: int):
    """The state machine of one salted slice."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.read_record_batch(bytes(state.get[0]), BATCH).to_pandas()] if state.exists else []
        if not state.hasTimedOut:
            parts += [f[HELD] for f in frames if len(f)]
        held = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0] if parts else pd.DataFrame(columns=HELD)
        held = held[held.side != MARKER]
        mark = state.getCurrentWatermarkMs() * 1000
        past = held.us.to_numpy("int64") + horizon_us < mark
        is_left = held.side.to_numpy() == LEFT
        if (past & is_left).any():
            yield _matched(held[past & is_left], held[~is_left])
        kept = held[~past]
        if len(kept):
            state.update((pa.RecordBatch.from_pandas(kept[HELD], BATCH, preserve_index=False).serialize().to_pybytes(),))
            due = (int(kept.us.min()) + horizon_us) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return step


def _matched(ripe: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
    """OUT for the ripe left rows. Of right rows at one instant the smallest counts."""
    ripe = ripe.drop_duplicates(["of", "us", "id"])
    codes = pd.Index(np.unique(np.concatenate([ripe.of.to_numpy(object), rights.of.to_numpy(object)])))
    rights = rights.assign(of=codes.get_indexer(rights.of)).sort_values(["of", "us"])
    if rights.duplicated(["of", "us"]).any():
        rights = rights.sort_values(["of", "us", "id", "tol_us"]).drop_duplicates(["of", "us"])
    r_us, tol, names = rights.us.to_numpy("int64"), rights.tol_us.to_numpy("int64"), rights.id.to_numpy(object)
    l_us = ripe.us.to_numpy("int64")
    found = nearest(codes.get_indexer(ripe.of), l_us, rights.of.to_numpy("int64"), r_us)
    far = np.abs(l_us - r_us[found]) if len(r_us) else np.zeros(len(l_us), "int64")
    hit = (found >= 0) & (far <= tol[found]) if len(r_us) else np.zeros(len(l_us), bool)
    row = np.where(hit, names[found], "") if len(r_us) else np.full(len(l_us), "", object)
    return pd.DataFrame({"id": ripe.id.to_numpy(object), "row": row, "distance_us": np.where(hit, far, -1)})


def slice_of(us: Column, slice_hours: int) -> Column:
    return F.floor(us / slice_hours / 3_600_000_000).cast("long")


def bucket_of(entity: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in entity)), F.lit(buckets)).cast("int")


def complete(entity: list[str], time: str) -> Column:
    whole = F.col(time).isNotNull()
    for c in entity:
        whole = whole & F.col(c).isNotNull()
    return whole


def hot_slices(left: DataFrame, entity: list[str], time: str, slice_hours: int, buckets: int, rows_per_task: int) -> DataFrame:
    """Buckets and slices of a bounded left side with more rows than one task
    should hold, and how many salts they get. Has at most
    rows / rows_per_task rows."""
    counted = left.filter(complete(entity, time)).groupBy(bucket_of(entity, buckets).alias("bucket"), slice_of(F.unix_micros(time), slice_hours).alias("slice")).count()
    return counted.filter(F.col("count") > rows_per_task).withColumn("salts", F.ceil(F.col("count") / rows_per_task).cast("int")).drop("count")


def nearest_time_rows(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: list[str],
    left_id: str,
    left_time: str,
    right_time: str,
    right_row: str,
    right_tolerance_us: str,
    horizon_minutes: int,
    slice_hours: int = 672,
    buckets: int = 64,
    hot: DataFrame | None = None,
) -> DataFrame:
    """ROWS of both sides, streaming or at rest; stateless. Parameters as in
    `nearest_time_stream`. Rows with a null in their entity or time are left out."""
    us = {"l": F.unix_micros(left_time), "r": F.unix_micros(right_time)}
    of = F.to_json(F.array(*(F.col(c).cast("string") for c in entity))).alias("of")
    bucket = bucket_of(entity, buckets).alias("bucket")
    rows_l = left.filter(complete(entity, left_time)).select(bucket, slice_of(us["l"], slice_hours).alias("slice"), F.col(left_time).alias("at"), F.lit(LEFT).alias("side"), of, us["l"].alias("us"), F.col(left_id).cast("string").alias("id"), F.lit(0).cast("long").alias("tol_us"))
    horizon_us = horizon_minutes * 60_000_000
    reach = F.sequence(slice_of(us["r"] - horizon_us, slice_hours), slice_of(us["r"] + horizon_us, slice_hours))
    rows_r = right.filter(complete(entity, right_time)).select(bucket, F.explode(reach).alias("slice"), F.col(right_time).alias("at"), F.lit(RIGHT).alias("side"), of, us["r"].alias("us"), F.concat(F.lit(NAMED), F.col(right_row)).alias("id"), F.col(right_tolerance_us).cast("long").alias("tol_us"))
    if hot is None:
        rows_l, rows_r = (x.withColumn("salt", F.lit(0)) for x in (rows_l, rows_r))
    else:
        few = broadcast_if_small(hot, 100_000)
        rows_l = rows_l.join(few, ["bucket", "slice"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        rows_r = rows_r.join(few, ["bucket", "slice"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    names = [x.split()[0] for x in ROWS.split(", ")]
    return rows_l.select(*names).union(rows_r.select(*names))


def matched_stream(rows: DataFrame, horizon_minutes: int, lateness: str) -> DataFrame:
    """OUT of a stream of ROWS: the state machine of all salted slices."""
    met = rows.withWatermark("at", lateness).groupBy("bucket", "slice", "salt").applyInPandasWithState(_step(horizon_minutes * 60_000_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    hit = F.col("row") != ""
    return met.select("id", F.when(hit, F.substring("row", len(NAMED) + 1, 2**31 - 1)).alias("row"), F.when(hit, F.col("distance_us")).alias("distance_us"))


def without_partner(left: DataFrame, entity: list[str], left_id: str, left_time: str) -> DataFrame:
    """OUT of the left rows that can have no partner."""
    return left.filter(~F.coalesce(complete(entity, left_time), F.lit(False))).select(F.col(left_id).cast("string").alias("id"), F.lit(None).cast("string").alias("row"), F.lit(None).cast("long").alias("distance_us"))


def nearest_time_stream(left: DataFrame, right: DataFrame, *, entity: list[str], left_id: str, left_time: str, right_time: str, right_row: str, right_tolerance_us: str, horizon_minutes: int, lateness: str = "0 seconds", slice_hours: int = 672, buckets: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """Streaming left join of each left row with the right row nearest in time.

    Both frames are streaming and hold the columns of `entity`. `right_row` is
    a string that stands for the right row, and `right_tolerance_us` how far a
    left row may lie from it, at most `horizon_minutes`. Of right rows at
    equal distance the earlier counts, at one instant the smaller `right_row`.
    Returns id (the left id as a string), row and distance_us, both null where
    nothing is near enough.

    A left row with a null in its entity or time comes out at once without a
    partner; a right row with one is never a partner. Rows older than the
    watermark (newest time seen less `lateness`) are late and dropped, so
    `lateness` must cover the disorder of the source. A row repeated within
    the buffer comes out once. Other columns, whatever their names, are
    not read.
    """
    rows = nearest_time_rows(left, right, entity=entity, left_id=left_id, left_time=left_time, right_time=right_time, right_row=right_row, right_tolerance_us=right_tolerance_us, horizon_minutes=horizon_minutes, slice_hours=slice_hours, buckets=buckets, hot=hot)
    return matched_stream(rows, horizon_minutes, lateness).unionByName(without_partner(left, entity, left_id, left_time))


def nearest_time_at_rest(left: DataFrame, right: DataFrame, *, entity: list[str], left_id: str, left_time: str, right_time: str, right_row: str, right_tolerance_us: str, horizon_minutes: int, slice_hours: int = 672, rows_per_task: int = 100_000, waves: int = 4) -> tuple[DataFrame, list]:
    """As `nearest_time_stream` for bounded frames, whose rows are in no useful
    order: they are written once by `waves` ranges of time (equal in left rows)
    and stream in one after the other, so nothing is late, and the watermark
    moves as it would live. Returns the result and the progress of the batches."""
    spark = left.sparkSession
    us = F.unix_micros(left_time)
    cuts = [i / waves for i in range(1, waves)] or [1.0]
    bounds, n = left.filter(complete(entity, left_time)).agg(F.percentile_approx(us, cuts), F.count(F.lit(1))).first()
    # one call of the state machine costs as much as some thousand rows in it
    buckets = max(1, min(2**20, n // 10_000))
    hot = hot_slices(left, entity, left_time, slice_hours, buckets, rows_per_task)
    rows = nearest_time_rows(left, right, entity=entity, left_id=left_id, left_time=left_time, right_time=right_time, right_row=right_row, right_tolerance_us=right_tolerance_us, horizon_minutes=horizon_minutes, slice_hours=slice_hours, buckets=buckets, hot=hot)
    wave = F.lit(0)
    for b in sorted(set(bounds or [])):
        wave = wave + (F.col("us") > b).cast("int")
    staged = staging_path(spark, "waves")
    rows.withColumn("wave", wave).write.partitionBy("wave").parquet(staged)
    there = spark.read.schema(ROWS + ", wave int").parquet(staged)
    size, latest = there.agg(F.count(F.lit(1)), F.max("at")).first()
    met, progress = _run_waves(there, staged, size, latest, horizon_minutes, rows_per_task, waves)
    return met.union(without_partner(left, entity, left_id, left_time)), progress


def _run_waves(there: DataFrame, staged: str, size: int, latest: dt.datetime | None, horizon_minutes: int, rows_per_task: int, waves: int) -> tuple[DataFrame, list]:
    """Stream the staged waves in ascending order, and then a marker beyond
    every horizon, that drains the buffers."""
    spark = there.sparkSession
    out, log, source = (staging_path(spark, x) for x in ("nearest", "nearest-log", "nearest-in"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(conf)
    files.mkdirs(path(source))
    end = (latest or dt.datetime(1970, 1, 2)) + dt.timedelta(minutes=2 * horizon_minutes + 1)
    marker = spark.createDataFrame([(-1, 0, 0, end, MARKER, "", 0, "", 0)], ROWS).withColumn("us", F.unix_micros("at"))
    marker.coalesce(1).write.parquet(f"{staged}/wave={waves}")
    # a session of its own, whose stateful tasks are as many as the rows need
    own = spark.newSession()
    tasks = max(-(-size // rows_per_task), min(-(-size // 20_000), spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.shuffle.partitions", max(1, min(tasks, 20_000)))
    rows = own.readStream.schema(ROWS).option("recursiveFileLookup", True).parquet(source)
    query = matched_stream(rows, horizon_minutes, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", log).start()
    try:
        for k in range(waves + 1):
            if files.exists(path(f"{staged}/wave={k}")):
                files.rename(path(f"{staged}/wave={k}"), path(f"{source}/wave-{k}"))
                query.processAllAvailable()
        progress = query.recentProgress
    finally:
        query.stop()
    return spark.read.schema(OUT).parquet(out), progress
