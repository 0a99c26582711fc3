"""Resolving uneven course spellings by the course dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebook.functions.text import without_whitespace
from tracebook.sources.tables import broadcast_if_small


def course_key(text: Column) -> Column:
    """Compared without whitespace and letter case."""
    return F.lower(without_whitespace(text))


def course_names(courses: DataFrame) -> DataFrame:
    """One row per key under which a course is known: course_key, resolved."""
    names = F.explode(F.array_distinct(F.concat(F.array("course_id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    known = courses.select(F.col("course_id").alias("resolved"), names.alias("n")).select(course_key(F.col("n")).alias("course_key"), "resolved")
    return known.filter(F.col("course_key") != "").groupBy("course_key").agg(F.min("resolved").alias("resolved"))


def resolve_course(df: DataFrame, courses: DataFrame, columns: list[str], out: str = "resolved_course", max_rows: int = 100_000) -> DataFrame:
    """Add `out`: the course_id that the first of `columns` that resolves stands
    for, null if none does. The dimension is broadcast up to `max_rows` keys."""
    names = broadcast_if_small(course_names(courses), max_rows)
    found = []
    for i, c in enumerate(columns):
        df = df.withColumn(f"_key{i}", course_key(F.col(c))).join(names.select(F.col("course_key").alias(f"_key{i}"), F.col("resolved").alias(f"_found{i}")), f"_key{i}", "left")
        found.append(f"_found{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found, *(f"_key{i}" for i in range(len(columns))))


def match_course(df: DataFrame, courses: DataFrame, columns: list[str], out: str = "matched_course", shortest: int = 3) -> DataFrame:
    """As `resolve_course`, and where nothing resolves the course one of whose
    names (of `shortest` characters or more) holds a candidate or is held by
    it: the first candidate that fits any, and of several courses the one with
    the longest name, then the smallest id. Distinct candidates meet the course
    dimension, not rows."""
    exact = resolve_course(df, courses, columns, "_exact")
    names = course_names(courses).filter(F.length("course_key") >= shortest)
    loose, found = exact, []
    for i, c in enumerate(columns):
        asked = exact.filter(F.col("_exact").isNull()).select(course_key(F.col(c)).alias(f"_k{i}")).filter(F.col(f"_k{i}") != "").distinct()
        near = asked.join(broadcast_if_small(names, 100_000), F.contains(f"_k{i}", "course_key") | F.contains("course_key", f"_k{i}"))
        best = near.groupBy(f"_k{i}").agg(F.min_by("resolved", F.struct(-F.length("course_key"), "resolved")).alias(f"_near{i}"))
        loose = loose.withColumn(f"_k{i}", course_key(F.col(c))).join(best, f"_k{i}", "left")
        found.append(f"_near{i}")
    return loose.withColumn(out, F.coalesce("_exact", *found)).drop("_exact", *found, *(f"_k{i}" for i in range(len(columns))))
