"""A log of runs, ids for them, and whole JSON documents."""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, stage string, event string, at timestamp, seconds double, exit_code int, error string, details map<string,string>"


def new_run_id(prefix: str, now: datetime | None = None) -> str:
    """prefix-YYYYMMDD-HHMMSS-xxxx: within a prefix later ids sort behind earlier ones."""
    return f"{prefix}-{(now or datetime.now(UTC)):%Y%m%d-%H%M%S}-{secrets.token_hex(2)}"


def settings_of(spark: SparkSession, names: Mapping[str, str]) -> dict[str, str]:
    """What a run was made with: the named settings of the session and its
    version. Names that look like those of secrets are refused."""
    for n in names.values():
        if any(w in n.lower() for w in ("secret", "password", "token", "key")):
            raise ValueError(f"{n} may be a secret")
    return {"spark": spark.version} | {k: spark.conf.get(n, "") for k, n in names.items()}


@contextmanager
def recorded(spark: SparkSession, path: str, stage: str, run_id: str, details: Mapping[str, str] | None = None) -> Iterator[dict[str, str]]:
    """Appends a row when a run begins and one when it ends, with its seconds;
    an exception is recorded with exit code 1 and raised again. What the body
    puts in the dictionary it is given stands in the last row."""

    def row(event: str, seconds: float | None, code: int | None, error: str | None, told: dict[str, str]) -> None:
        at = datetime.now(UTC).replace(tzinfo=None)
        spark.createDataFrame([(run_id, stage, event, at, seconds, code, error, told)], RUNS).coalesce(1).write.mode("append").parquet(path)

    told, began = dict(details or {}), time.monotonic()
    row("start", None, None, None, told)
    try:
        yield told
    except BaseException as e:
        row("end", time.monotonic() - began, 1, f"{type(e).__name__}: {e}"[:500], told)
        raise
    row("end", time.monotonic() - began, 0, None, told)


def finished_runs(log: DataFrame) -> DataFrame:
    """run_id, stage, started, ended, seconds, exit_code, error: one row per run;
    a run without an end has nulls."""
    begin = F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started")
    end = F.max_by(F.struct("at", "seconds", "exit_code", "error"), "at").alias("_end")
    ended = log.filter("event = 'end'").groupBy("run_id", "stage").agg(end)
    return log.groupBy("run_id", "stage").agg(begin).join(ended, ["run_id", "stage"], "left").select("run_id", "stage", "started", F.col("_end.at").alias("ended"), "_end.seconds", "_end.exit_code", "_end.error")


def read_document(spark: SparkSession, path: str, default: object = None) -> object:
    """A whole JSON document by the session's file system; the default if it is
    missing or no JSON."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(conf)
    if not files.exists(p):
        return default
    stream = files.open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text.removeprefix("﻿"))
    except ValueError:
        return default


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files, lines ending at LF only. A line's
    number is the count of lines in the parts of its file before it, and its
    place in its own part; parts are as large as the file source cuts them."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")).select("file", "block", "_before")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("_id"))
    return raw.withColumn("_i", inside).join(before, ["file", "block"]).select("file", (F.col("_before") + F.col("_i")).alias("line_no"), "line")
