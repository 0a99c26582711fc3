"""Substring search over pages, snippets, and lexical ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebook.functions.text import flattened, search_tokens


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text holds, letter case aside."""
    return reduce(lambda a, b: a + b, (F.contains(F.lower(text), F.lit(t.lower())).cast("int") for t in terms))


def snippet(text: Column, terms: list[str], width: int) -> Column:
    """The text around the earliest hit, hits in 【】, longer terms first."""
    at = F.array_min(F.filter(F.array(*(F.locate(t.lower(), F.lower(text)) for t in terms)), lambda p: p > 0))
    begin = F.greatest(at - width // 2, F.lit(1))
    part = F.substring(text, begin, F.lit(2 * width))
    for t in sorted(terms, key=len, reverse=True):
        part = F.regexp_replace(part, rf"(?i)(?<!【)(\Q{t}\E)(?![^【]*】)", "【$1】")
    return F.concat(F.when(begin > 1, "…").otherwise(""), part, F.when(begin + 2 * width <= F.length(text), "…").otherwise(""))


def search(pages: DataFrame, terms: list[str], *, match_any: bool = False, course: str | None = None, width: int = 60, limit: int | None = None) -> DataFrame:
    """source_file, page_no, n_hits, snippet of the pages with all (or any) of
    the terms; null texts match nothing; repeated rows count once. With a limit
    the first in the order of file and page."""
    flat = flattened(F.col("text"))
    rows = pages if course is None else pages.filter(F.contains("course", F.lit(course)))
    found = rows.select("source_file", "page_no", flat.alias("flat")).withColumn("n_hits", hits(F.col("flat"), terms)).filter(F.col("n_hits") >= (1 if match_any else len(terms)))
    out = found.select("source_file", "page_no", "n_hits", snippet(F.col("flat"), terms, width).alias("snippet")).distinct()
    return out if limit is None else out.orderBy("source_file", "page_no", "n_hits", "snippet").limit(limit)


def rank_lexical(queries: DataFrame, items: DataFrame, *, query_id: str, query: str, item_id: str, fields: list[str], title: str, top: int = 8, eligible: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, score, place: the `top` items of each query.

    The score sums ln(1 + N / (1 + df)) over the tokens common to both, three
    times for tokens of the title, and divides by the fourth root of the number
    of tokens. Items are matched by token, not by scanning all items for each
    query; ties go to the smaller item_id. `eligible`: the items (column item_id)
    that may be given; the others only count in the statistics.
    """
    whole = F.concat_ws(" ", *fields)
    texts = items.groupBy(F.col(item_id).alias("item_id")).agg(F.max(F.struct(whole.alias("whole"), F.coalesce(F.col(title), F.lit("")).alias("title"))).alias("x"))
    docs = texts.select("item_id", search_tokens(F.col("x.whole")).alias("t"), search_tokens(F.col("x.title")).alias("in_title"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(search_tokens(F.col(query))).alias("token")).distinct()
    posted = docs.select("item_id", F.size("t").alias("size"), F.explode("t").alias("token"), "in_title").select("item_id", "size", "token", F.array_contains("in_title", F.col("token")).alias("titled"))
    wanted = posted.join(asked.select("token").distinct(), "token", "left_semi")
    df = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    weight = F.log1p(F.lit(float(total)) / (1 + F.col("df"))) * F.when(F.col("titled"), 3).otherwise(1)
    given = wanted if eligible is None else wanted.join(eligible.select(F.col(item_id).alias("item_id")).distinct(), "item_id", "left_semi")
    scored = asked.join(given, "token").join(df, "token").groupBy("query_id", "item_id").agg((F.sum(weight) / F.pow(F.greatest(F.max("size"), F.lit(1)), F.lit(0.25))).alias("raw"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), "item_id")
    ranked = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return ranked.select(F.col("query_id").alias(query_id), F.col("item_id").alias(item_id), F.round("raw", 6).alias("score"), "place")


def interleave(ranked: DataFrame, group: str, item: str, limit: int) -> DataFrame:
    """The rankings of a group of queries merged round robin: each item once,
    at its best place, in the order of (place, query)."""
    best = ranked.groupBy(group, item).agg(F.min(F.struct("place", "query_no")).alias("b"))
    order = Window.partitionBy(group).orderBy("b.place", "b.query_no", item)
    return best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select(group, item, "n")
