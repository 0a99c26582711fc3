"""Parquet tables, and tables staged in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the staged tables of each session, for `sweep`.
_STAGED: dict[str, list[str]] = {}
#: The shared folder of each session.
_SHARED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it lies in the folder; nothing is read yet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. The path is written as a pattern,
    which the file source takes for a single file as well as for a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, with its scheme.

    Where that is unset a folder of our own is made and named, but only on one
    machine (tests, a laptop); on a cluster a machine-local folder would be
    seen by one machine and lost with it, so there ValueError is raised. A path
    without a scheme is one of the session's default file system.
    """
    context = spark.sparkContext
    if context.applicationId in _SHARED:
        return _SHARED[context.applicationId]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file:" + tempfile.mkdtemp(prefix="tracebook-")
    if "://" not in named and not named.startswith("file:"):
        path = context._jvm.org.apache.hadoop.fs.Path(named)
        named = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    _SHARED[context.applicationId] = named.rstrip("/")
    return _SHARED[context.applicationId]


def staging_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; `sweep` removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        atexit.register(_swept_at_exit, spark)
    _STAGED.setdefault(app, []).append(path)
    return path


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage at
    files that outlive any executor, and gives later readers column pruning.
    by: a column of few values, by which the files are kept apart."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _swept_at_exit(spark: SparkSession) -> None:
    """What is staged goes with the process at the latest; a session that is
    stopped before leaves it to `sweep` or to whoever owns the folder."""
    with suppress(Exception):
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Remove what this session has staged. Frames that read it end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting the rows; larger frames go by the
    shuffled join that Catalyst then picks."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def without_broadcast(df: DataFrame) -> DataFrame:
    """A frame that grows with the data: its joins are shuffled at every size,
    so that none waits for a broadcast that is small only today."""
    return df.hint("merge")
