"""Problem 6: pages and skeleton sections longer than the limit, in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.llm.splitting import split_oversized
from tracebook.sources.tables import table

LIMIT, OVERLAP = 6000, 300


def section_pages(skeleton: DataFrame, pages: DataFrame) -> DataFrame:
    """item_key (the section's node_id), source_file, page_no of every page
    there is with text, by an equality join: the page ranges are expanded, cut
    to the pages their file has, so a file's pages never meet all its sections."""
    span = pages.groupBy("source_file").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"))
    sections = skeleton.select("source_file", F.explode("sections").alias("s")).select("source_file", F.col("s.node_id").alias("item_key"), F.col("s.page_start").alias("a"), F.col("s.page_end").alias("b")).filter("a <= b and item_key is not null").distinct()
    ranged = sections.join(span, "source_file").select("item_key", "source_file", F.greatest("a", "first").alias("a"), F.least("b", "last").alias("b")).filter("a <= b")
    return ranged.select("item_key", "source_file", F.explode(F.sequence("a", "b")).alias("page_no"))


def oversized_items(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """item_kind, item_key, text of the pages and sections longer than the
    limit. Lengths are summed first; texts are only moved for what is too long."""
    pages = table(spark, sf_dir, "pages").select("file_id", "source_file", "page_no", "text").filter(F.length("text") > 0)
    long = pages.filter(F.length("text") > limit).select(F.lit("page").alias("item_kind"), F.concat("file_id", F.lit("#"), "page_no").alias("item_key"), "text").filter("item_key is not null").distinct()
    # of texts of one page that differ the longest counts, of those one told by a hash, so that every run takes the same
    rank = F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    sized = pages.select("source_file", "page_no", rank.alias("r")).groupBy("source_file", "page_no").agg(F.max("r").alias("r")).select("source_file", "page_no", "r.n")
    held = section_pages(table(spark, sf_dir, "skeleton"), sized)
    total = held.join(sized, ["source_file", "page_no"]).groupBy("item_key").agg((F.sum("n") + 2 * F.count(F.lit(1)) - 2).alias("n")).filter(F.col("n") > limit).select("item_key")
    wanted = held.join(total, "item_key", "left_semi")
    texts = pages.select("source_file", "page_no", "text").join(wanted.select("source_file", "page_no").distinct(), ["source_file", "page_no"], "left_semi").groupBy("source_file", "page_no").agg(F.max_by("text", rank).alias("text"))
    whole = wanted.join(texts, ["source_file", "page_no"]).groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return long.union(whole.select(F.lit("section"), "item_key", F.array_join(F.col("p.text"), "\n\n")))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_kind, item_key, piece_no, overlap, piece of every oversized item."""
    return split_oversized(oversized_items(spark, sf_dir), keys=["item_kind", "item_key"], text="text", limit=LIMIT, overlap=OVERLAP)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_kind, item_key of the items that the splitter cuts."""
    return p6_pieces(spark, sf_dir).filter("piece_no = 2").select("item_kind", "item_key")


P6_FOUND_SQL = """
WITH p AS (SELECT DISTINCT file_id, source_file, page_no, text FROM pages WHERE length(text) > 0),
s AS (SELECT DISTINCT source_file, x.node_id AS k, x.page_start AS a, x.page_end AS b FROM (SELECT source_file, unnest(sections) AS x FROM skeleton))
SELECT 'page' AS item_kind, file_id || '#' || page_no AS item_key FROM p WHERE length(text) > 6000
UNION ALL
SELECT 'section', k FROM s JOIN p ON s.source_file = p.source_file AND p.page_no BETWEEN a AND b WHERE a <= b GROUP BY k HAVING sum(length(text)) + 2 * count(*) - 2 > 6000
"""
