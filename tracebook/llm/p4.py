"""Problem 4: passages that pages and quotes of different files share word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.llm.shared_spans import shared_portions, shared_span_pairs
from tracebook.sources.tables import table

LENGTH = 100


def span_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, grp (the source file), text: all pages and quotes."""
    pages = table(spark, sf_dir, "pages").select(F.concat("file_id", F.lit("#"), "page_no").alias("key"), F.col("source_file").alias("grp"), "text")
    return pages.union(table(spark, sf_dir, "evidence").select("evidence_id", "source_file", "quote"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_a, key_b: records of different source files that share 100 characters."""
    return shared_span_pairs(span_records(spark, sf_dir), length=LENGTH)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, n, spans, shared, share of every record that shares 100 characters with another file."""
    return shared_portions(span_records(spark, sf_dir), length=LENGTH)


P4_FOUND_SQL = """
WITH r AS (
  SELECT DISTINCT * FROM (
    SELECT file_id || '#' || page_no AS k, source_file AS f, regexp_replace(text, '[ \\t\\r\\n]', '', 'g') AS t FROM pages
    UNION ALL SELECT evidence_id, source_file, regexp_replace(quote, '[ \\t\\r\\n]', '', 'g') FROM evidence)
  WHERE length(t) >= 100
), g AS (
  SELECT k, f, hash(t[i : i + 99]) AS h FROM (SELECT k, f, t, unnest(range(1, length(t) - 98)) AS i FROM r)
), m AS (SELECT h FROM g GROUP BY h HAVING min(f) <> max(f)), s AS (SELECT DISTINCT k, f, h FROM g SEMI JOIN m USING (h))
SELECT DISTINCT a.k AS key_a, b.k AS key_b FROM s a JOIN s b ON a.h = b.h AND a.f <> b.f AND a.k < b.k
"""

P4_SHARES_SQL = """
WITH r AS (
  SELECT DISTINCT * FROM (
    SELECT file_id || '#' || page_no AS k, source_file AS f, regexp_replace(text, '[ \\t\\r\\n]', '', 'g') AS t FROM pages
    UNION ALL SELECT evidence_id, source_file, regexp_replace(quote, '[ \\t\\r\\n]', '', 'g') FROM evidence)
  WHERE length(t) >= 100
), g AS (
  SELECT k, f, i, length(t) AS n, hash(t[i : i + 99]) AS h FROM (SELECT k, f, t, unnest(range(1, length(t) - 98)) AS i FROM r)
), m AS (SELECT h FROM g GROUP BY h HAVING min(f) <> max(f)), s AS (SELECT DISTINCT k, n, i FROM g SEMI JOIN m USING (h)),
c AS (SELECT k, n, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM s)
SELECT k AS key, max(n)::INT AS n, count(*) FILTER (WHERE gap IS NULL OR gap > 100) AS spans, sum(least(coalesce(gap, 100), 100))::BIGINT AS shared, round(sum(least(coalesce(gap, 100), 100)) / max(n), 6) AS share FROM c GROUP BY k
"""
