"""Problem 9: quality figures of documents, and those that are no prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracebook.llm.quality import text_quality
from tracebook.sources.tables import table


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the figures of every document; kind is that of its nearest profile."""
    documents, labels, words = (table(spark, sf_dir, t) for t in ("documents", "doc_labels", "common_words"))
    return text_quality(documents, labels, words, key="doc_id", text="text").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind of the documents that as a whole are a list, a table or junk."""
    documents, labels, words = (table(spark, sf_dir, t) for t in ("documents", "doc_labels", "common_words"))
    return text_quality(documents, labels, words, key="doc_id", text="text").filter("kind <> 'prose'").select("doc_id", "kind").distinct()
