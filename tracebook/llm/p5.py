"""Problem 5: faults of print and scan in pages, and the pages repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracebook.llm.reflow import repaired_pages
from tracebook.llm.scan_noise import page_faults
from tracebook.sources.tables import table


def p5_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_no, line_no, issue, wrong, fixed."""
    return page_faults(table(spark, sf_dir, "pages").select("file_id", "source_file", "page_no", "page_label", "text", "text_source"), table(spark, sf_dir, "skeleton").select("source_file", "num", "title"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_no, line_no, issue: one row per line with a fault."""
    return p5_faults(spark, sf_dir).select("file_id", "page_no", "line_no", "issue").distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_no, page_label, text: every page repaired."""
    return repaired_pages(table(spark, sf_dir, "pages"), p5_faults(spark, sf_dir))
