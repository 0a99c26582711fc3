"""Problem 2: knowledge points that tell the same thing with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.text import without_whitespace
from tracebook.llm.components import grouped
from tracebook.llm.minmax_hash import expand_pairs, near_duplicate_pairs
from tracebook.operators.courses import resolve_course
from tracebook.sources.tables import stage, table

THRESHOLD, SIZE = 0.6, 4


def similar_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts and who holds them, of all knowledge points. A course that
    resolves neither by its spelling nor by course_id is in no pair; texts of
    fewer than four characters have no substring to share and are in none."""
    kp = resolve_course(table(spark, sf_dir, "kp").select("kp_id", "course", "course_id", "name", "definition"), table(spark, sf_dir, "courses"), ["course", "course_id"])
    text = without_whitespace(F.lower(F.concat(F.coalesce("name", F.lit("")), F.coalesce("definition", F.lit("")))))
    return near_duplicate_pairs(kp, key="kp_id", text=text, block=F.col("resolved_course"), unit="char", size=SIZE, threshold=THRESHOLD)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kp_id_a, kp_id_b: near duplicates of one resolved course."""
    pairs, members = similar_points(spark, sf_dir)
    return expand_pairs(pairs, members).select(F.col("key_a").alias("kp_id_a"), F.col("key_b").alias("kp_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kp_id, group_key, n_links: one row per knowledge point and the group it belongs to."""
    pairs, members = similar_points(spark, sf_dir)
    return grouped(stage(pairs, "pairs"), members).withColumnRenamed("key", "kp_id")


P2_FOUND_SQL = """
WITH names AS (
  SELECT DISTINCT lower(regexp_replace(n, '[ \\t\\r\\n]', '', 'g')) AS k, course_id FROM (SELECT course_id, unnest(list_concat([course_id, name], coalesce(aliases, []))) AS n FROM courses)
), x AS (
  SELECT DISTINCT kp_id, coalesce(a.course_id, b.course_id) AS course, regexp_replace(lower(coalesce(name, '') || coalesce(definition, '')), '[ \\t\\r\\n]', '', 'g') AS t
  FROM kp LEFT JOIN names a ON lower(regexp_replace(kp.course, '[ \\t\\r\\n]', '', 'g')) = a.k LEFT JOIN names b ON lower(regexp_replace(kp.course_id, '[ \\t\\r\\n]', '', 'g')) = b.k
), s AS (
  SELECT DISTINCT kp_id, course, t[i : i + 3] AS g FROM (SELECT kp_id, course, t, unnest(range(1, length(t) - 2)) AS i FROM x WHERE length(t) >= 4)
), n AS (SELECT kp_id, count(*) AS n FROM s GROUP BY ALL), c AS (
  SELECT a.kp_id AS p, b.kp_id AS q, count(*) AS k FROM s a JOIN s b ON a.course = b.course AND a.g = b.g AND a.kp_id < b.kp_id GROUP BY ALL
)
SELECT p AS kp_id_a, q AS kp_id_b FROM c JOIN n u ON u.kp_id = p JOIN n v ON v.kp_id = q WHERE k >= 0.6 * (u.n + v.n - k)
"""

P2_GROUPS_SQL = """
WITH RECURSIVE names AS (
  SELECT DISTINCT lower(regexp_replace(n, '[ \\t\\r\\n]', '', 'g')) AS k, course_id FROM (SELECT course_id, unnest(list_concat([course_id, name], coalesce(aliases, []))) AS n FROM courses)
), x AS (
  SELECT DISTINCT kp_id, coalesce(a.course_id, b.course_id) AS course, regexp_replace(lower(coalesce(name, '') || coalesce(definition, '')), '[ \\t\\r\\n]', '', 'g') AS t
  FROM kp LEFT JOIN names a ON lower(regexp_replace(kp.course, '[ \\t\\r\\n]', '', 'g')) = a.k LEFT JOIN names b ON lower(regexp_replace(kp.course_id, '[ \\t\\r\\n]', '', 'g')) = b.k
), d AS (SELECT course, t, min(kp_id) AS r FROM x WHERE length(t) >= 4 AND course IS NOT NULL AND kp_id IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT r, course, t[i : i + 3] AS g FROM (SELECT r, course, t, unnest(range(1, length(t) - 2)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT a.r AS p, b.r AS q, count(*) AS k FROM s a JOIN s b ON a.course = b.course AND a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT p, q FROM c JOIN n u ON u.r = p JOIN n v ON v.r = q WHERE k >= 0.6 * (u.n + v.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.q FROM reach JOIN l ON reach.b = l.p), least AS (SELECT a AS r, min(b) AS g FROM reach GROUP BY a),
degree AS (SELECT p AS r, count(*) AS n FROM l GROUP BY p)
SELECT x.kp_id, least.g AS group_key, coalesce(degree.n, 0) AS n_links FROM x JOIN d USING (course, t) JOIN least USING (r) LEFT JOIN degree USING (r) WHERE x.kp_id IS NOT NULL
"""
