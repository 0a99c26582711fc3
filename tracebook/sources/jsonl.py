"""JSON lines: a tolerant and a strict reader, and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracebook.sources.runs import numbered_lines


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All readable records; blank and malformed lines are skipped, a byte-order
    mark is no part of a record, a missing path is an empty frame."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("lineSep", "\n").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The readable records, and the malformed lines (file, line_no, line).
    Records end at LF only, so other line separators may stand within them."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    parsed = F.from_json(F.regexp_replace("line", "^\\x{FEFF}", ""), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = numbered_lines(spark, path).withColumn("r", parsed).filter("trim(line) <> ''")
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return lines.filter(~bad).select(*(F.col(f"r.{f.name}") for f in schema.fields)), lines.filter(bad).select("file", "line_no", "line")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; a field is quoted only where it must be."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType, decided: str) -> DataFrame:
    """Rows of a tab-separated worksheet whose `decided` column is filled in."""
    rows = spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    return rows.filter(F.trim(F.col(decided)) != "")
