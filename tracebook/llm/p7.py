"""Problem 7: documents that hold held-out evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.llm.string_tiling import tiled_items
from tracebook.sources.tables import table

SHARE = 0.5


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_length, longest, covered, tiles of each document and item of which
    half is covered, in whatever order, or a quarter by one tile."""
    met = tiled_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text", share=SHARE)
    return met.select(F.col("doc_key").cast("long").alias("doc_id"), F.col("item_key").cast("long").alias("item_id"), "item_length", "longest", "covered", "tiles")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: the document holds at least half of the item as one run."""
    return p7_coverage(spark, sf_dir).filter("2 * longest >= item_length").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, share, tiles: half or more of the item stands in the
    document, in pieces of 12 letters and digits or more and in whatever order."""
    met = p7_coverage(spark, sf_dir).withColumn("share", F.col("covered") / F.col("item_length"))
    return met.filter(F.col("share") >= SHARE).select("doc_id", "item_id", F.round("share", 6).alias("share"), "tiles")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, n_documents, most: every item that leaked, in how many documents, and the largest share of it."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("share").alias("most"))


# DuckDB has no compatibility folding: the forms that occur are translated.
_PLAIN = "regexp_replace(lower(translate({0}, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９²³℃', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz012345678923C')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

P7_FOUND_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("replace(text, '℃', '°C')")} AS t FROM documents), e AS (
  SELECT item_id, t, (length(t) + 1) // 2 AS half FROM (SELECT item_id, {_PLAIN.format("replace(text, '℃', '°C')")} AS t FROM eval_items) WHERE t <> ''
), k AS (SELECT least(8, min(half)) AS k FROM e),
ig AS (SELECT item_id, half, i, substr(t, i, k) AS g FROM (SELECT item_id, half, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM e, k)),
dg AS (SELECT doc_id, j, substr(t, j, k) AS g FROM (SELECT doc_id, t, k, unnest(range(1, length(t) - k + 2)) AS j FROM d, k)),
m AS (SELECT DISTINCT doc_id, item_id, half, j - i AS diagonal, i FROM dg JOIN ig USING (g)),
r AS (SELECT doc_id, item_id, half, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island, diagonal FROM m)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, half, count(*) AS n FROM r GROUP BY doc_id, item_id, half, diagonal, island), k WHERE n + k - 1 >= half
"""
