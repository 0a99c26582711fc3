"""ZIP packages of one course: JSON lines and a manifest, out and in again."""

from __future__ import annotations

import io
import json
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.sources.tables import staging_path

#: Names that are devices on some systems.
RESERVED = {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))}
KEYS = {"kp": "kp_id", "evidence": "evidence_id", "pages": None}
VERSION = 1


def scoped(tables: dict[str, DataFrame], course: str) -> dict[str, DataFrame]:
    """The claims of a course, their quotes, and the pages those cite."""
    kp = tables["kp"].filter(F.col("course") == course)
    evidence = tables["evidence"].join(kp.select("kp_id").distinct(), "kp_id", "left_semi")
    pages = tables["pages"].join(evidence.select("source_file", "page_no").distinct(), ["source_file", "page_no"], "left_semi")
    return {"kp": kp.distinct(), "evidence": evidence.distinct(), "pages": pages.distinct()}


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """One file at a path of the session's file system, written row by row: what
    is held is one partition at a time, and the packed file on the driver's disk."""
    spark = next(iter(tables.values())).sparkSession
    with tempfile.NamedTemporaryFile(suffix=".zip") as local:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            counts = {}
            for name, df in tables.items():
                counts[name] = 0
                with z.open(f"{name}.jsonl", "w", force_zip64=True) as out:
                    for row in df.toJSON().toLocalIterator():
                        out.write(row.encode() + b"\n")
                        counts[name] += 1
            z.writestr("manifest.json", json.dumps({"version": VERSION, "tables": counts, "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}}))
        local.flush()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path("file:" + local.name), target)


def unsafe(name: str) -> bool:
    """Whether a name in a package leaves it or cannot be a file everywhere."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or any(c in name for c in ':*?"<>|\0') or any(p.split(".")[0].upper() in RESERVED or p != p.rstrip(" .") for p in parts if p)


def read_package(spark: SparkSession, data: bytes) -> dict[str, DataFrame]:
    """The tables of a package, unpacked line by line to the shared folder.
    ValueError for another version, for unsafe names, for keys that are null or
    stand twice, and for quotes of claims that it does not hold."""
    from pyspark.sql.types import StructType

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if unsafe(name):
                raise ValueError(f"unsafe name {name!r}")
        manifest = json.loads(z.read("manifest.json"))
        if manifest.get("version") != VERSION:
            raise ValueError(f"version {manifest.get('version')}")
        out = {}
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name, schema in manifest["schemas"].items():
            path = staging_path(spark, f"package-{name}") + ".jsonl"
            target = jvm.org.apache.hadoop.fs.Path(path)
            stream = target.getFileSystem(conf).create(target, True)
            try:
                with z.open(f"{name}.jsonl") as lines:
                    while part := lines.read(4_000_000):
                        stream.write(bytearray(part))
            finally:
                stream.close()
            raw = spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> ''")
            out[name] = raw.select(F.from_json("value", StructType.fromJson(schema)).alias("r")).select("r.*")
    for name, key in KEYS.items():
        if key and name in out and out[name].groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
            raise ValueError(f"{name}.{key} is not a key")
    if {"kp", "evidence"} <= out.keys() and out["evidence"].join(out["kp"], "kp_id", "left_anti").limit(1).count():
        raise ValueError("quotes of claims that are not in the package")
    return out


def additions(package: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of a package whose key is not there yet."""
    return package.join(current.select(key).distinct(), key, "left_anti")


def page_conflicts(package: DataFrame, current: DataFrame) -> DataFrame:
    """source_file, page_no of pages that both sides have with different text."""
    a, b = package.select("source_file", "page_no", F.md5("text").alias("a")), current.select("source_file", "page_no", F.md5("text").alias("b"))
    return a.join(b, ["source_file", "page_no"]).filter(~F.col("a").eqNullSafe(F.col("b"))).select("source_file", "page_no").distinct()
