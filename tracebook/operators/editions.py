"""What an edition of a course is made of: cards, outline, numbers, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebook.functions.display import card_type, stars
from tracebook.functions.text import first_number

LAST = 10**9


def in_skeleton_order(claims: DataFrame, skeleton: DataFrame, missing: int = 9999) -> DataFrame:
    """The claims with `chapter_order`: the place of their chapter (by file and
    title) in the skeleton, `missing` where it has none, and `page`, the number
    in their label, or the last there can be."""
    place = skeleton.groupBy("source_file", F.col("title").alias("chapter")).agg(F.min("ord").alias("_ord"))
    page = F.coalesce(first_number(F.col("page_label_start")), F.lit(LAST))
    return claims.join(place, ["source_file", "chapter"], "left").withColumns({"chapter_order": F.coalesce("_ord", F.lit(missing)), "page": page}).drop("_ord")


def cards(claims: DataFrame, least_importance: int = 1) -> DataFrame:
    """course, card_no, kp_id, card_type, stars, question, answer: the claims of
    each course by importance (the highest first), chapter, page and id.
    Numbers are given within ranges of importance and chapter first, so that no
    task sorts a course: card_no is the count of cards in the groups before and
    the place in the own one."""
    rows = claims.groupBy("kp_id").agg(F.max(F.struct("course", "name", "definition", "type", "importance", "numbers", "chapter", "page_label_start")).alias("x")).select("kp_id", "x.*")
    rank = F.coalesce(F.col("importance").cast("int"), F.lit(3))
    kept = rows.withColumn("importance", rank).filter(F.col("importance") >= least_importance).withColumns({"chapter": F.coalesce("chapter", F.lit("")), "page": F.coalesce(first_number(F.col("page_label_start")), F.lit(LAST))})
    group = ["course", "importance", "chapter"]
    before = Window.partitionBy("course").orderBy(F.col("importance").desc(), "chapter")
    sizes = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    inside = Window.partitionBy(*group).orderBy("page", "kp_id")
    sums = sizes.select(F.col("course").alias("_c"), F.col("importance").alias("_r"), F.col("chapter").alias("_t"), "_before")
    placed = kept.withColumn("_i", F.row_number().over(inside)).join(sums, F.col("course").eqNullSafe(F.col("_c")) & (F.col("importance") == F.col("_r")) & (F.col("chapter") == F.col("_t")))
    return placed.select("course", (F.col("_before") + F.col("_i")).cast("int").alias("card_no"), "kp_id", card_type(F.col("numbers"), F.col("type")).alias("card_type"), stars(F.col("importance")).alias("stars"), F.col("name").alias("question"), F.col("definition").alias("answer"))


def outline(claims: DataFrame) -> DataFrame:
    """course, chapter, claims, with_numbers, mean_importance."""
    rows = claims.groupBy("kp_id").agg(F.max(F.struct("course", "chapter", "numbers", "importance")).alias("x")).select("x.*")
    has = F.size(F.coalesce("numbers", F.array().cast("array<string>"))) > 0
    return rows.groupBy("course", F.coalesce("chapter", F.lit("")).alias("chapter")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(has).alias("with_numbers"), F.round(F.avg(F.coalesce(F.col("importance").cast("double"), F.lit(3.0))), 4).alias("mean_importance"))


def number_table(claims: DataFrame) -> DataFrame:
    """kp_id, course, name, position, number: the numbers of all claims, one by one."""
    return claims.select("kp_id", "course", "name", "numbers").distinct().select("kp_id", "course", "name", F.posexplode("numbers").alias("position", "number"))


def alternates(kept: DataFrame, claims: DataFrame) -> DataFrame:
    """keep, note: the other claims that one stands for (kept: kp_id, keep), in
    one line with their sources and up to four numbers of each."""
    rows = claims.groupBy("kp_id").agg(F.max(F.struct("source_file", "page_label_start", "numbers")).alias("x")).select("kp_id", "x.*")
    others = kept.filter("kp_id <> keep").join(rows, "kp_id")
    few = F.slice(F.coalesce("numbers", F.array().cast("array<string>")), 1, 4)
    told = F.concat(F.coalesce("source_file", F.lit("")), F.lit(" "), F.coalesce("page_label_start", F.lit("")), F.lit(" · "), "kp_id", F.when(F.size(few) > 0, F.concat(F.lit("（"), F.array_join(few, "、"), F.lit("）"))).otherwise(""))
    return others.groupBy("keep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kp_id", told.alias("t")))), lambda x: x["t"]), "；").alias("note"))


def edition_manifest(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """source_file, claims, digests: the files that claims come from and how
    many contents of each are on record; not one means the edition must not be made."""
    used = claims.select("kp_id", "source_file").distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("claims"))
    known = pages.groupBy("source_file").agg(F.count_distinct("source_sha1").alias("digests"))
    return used.join(known, "source_file", "left").select("source_file", "claims", F.coalesce("digests", F.lit(0)).alias("digests"))


def same_claims(before: DataFrame, after: DataFrame, key: str = "kp_id") -> DataFrame:
    """key, side: what only one of two editions has; empty if they hold the same claims."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("before").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("after")))
