"""Answering questions from verified claims: parts of a question, ranking, round robin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebook.operators.search import rank_lexical

#: A numbered part begins a line, and counts from this length on.
PART_BEGIN = r"(?m)^\s*(?:\d{1,3}[.、．)]|第\s*\d{1,3}\s*题[:：]?)"
SHORTEST_PART, MOST_PARTS = 8, 12
#: Begins of a turn that only makes sense after the one before.
FOLLOW_UP = r"^\s*(?:继续|为什么|那[么个些]?|这[个些样]|它|上述|前面|再解释|再算)"


def question_parts(text: Column) -> Column:
    """The numbered parts of a question, at most MOST_PARTS; the whole text
    where it has fewer than two of SHORTEST_PART characters."""
    parts = F.filter(F.transform(F.split(text, PART_BEGIN), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: F.length(x) >= SHORTEST_PART)
    return F.when(F.size(parts) < 2, F.array(text)).otherwise(F.slice(parts, 1, MOST_PARTS))


def with_context(current: Column, previous: Column) -> Column:
    """A short turn that refers to what was said, with the turn before it."""
    short = (F.length(current) < 60) & current.rlike(FOLLOW_UP) & (F.coalesce(previous, F.lit("")) != "")
    return F.when(short, F.concat(previous, F.lit("\n"), current)).otherwise(current)


def round_robin(rankings: list[list[tuple[str, float]]], limit: int) -> list[tuple[str, float]]:
    """Each ranking in turn gives its next item that none has given yet."""
    places, taken, out = [0] * len(rankings), set(), []
    while len(out) < limit:
        before = len(out)
        for i, ranked in enumerate(rankings):
            while places[i] < len(ranked) and ranked[places[i]][0] in taken:
                places[i] += 1
            if places[i] < len(ranked) and len(out) < limit:
                out.append(ranked[places[i]])
                taken.add(ranked[places[i]][0])
                places[i] += 1
        if len(out) == before:
            break
    return out


def retrieved(queries: DataFrame, items: DataFrame, evidence: DataFrame, *, query_id: str, query: str, item_id: str, fields: list[str], title: str) -> DataFrame:
    """query_id, item_id, score, place: the items that answer each query.

    `items` are the claims in scope (verified ones); all of them make the
    statistics. Only those with an accepted quote that is not blank (evidence:
    item_id, accepted, quote) are given. Each part of a query ranks them; the
    rankings give in turn, max(8, 2 * parts) in all and at most 24. As no more
    are given, no more of each ranking are ever needed; one task merges at most
    12 * 24 rows. Ties go to the smaller item_id.
    """
    asked = queries.select(F.col(query_id).alias("_q"), F.posexplode(question_parts(F.col(query))).alias("_part", "_text"))
    parts = asked.select("_q", "_part", F.struct("_q", "_part").alias("_key"), "_text")
    eligible = evidence.filter(F.col("accepted") & (F.trim("quote") != "")).select(item_id).distinct()
    ranked = rank_lexical(parts, items, query_id="_key", query="_text", item_id=item_id, fields=fields, title=title, top=24, eligible=eligible)
    many = asked.groupBy("_q").agg(F.count(F.lit(1)).alias("_parts"))
    rows = ranked.select("_key.*", F.col(item_id).cast("string").alias("item"), "score", "place").join(many, "_q")
    kind = queries.schema[query_id].dataType.simpleString()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        rankings = [list(zip(p["item"], p["score"])) for _, p in f.sort_values(["_part", "place"]).groupby("_part")]
        found = round_robin(rankings, min(24, max(8, 2 * int(f["_parts"].iloc[0]))))
        return pd.DataFrame({"_q": f["_q"].iloc[0], "item": [x[0] for x in found], "score": [x[1] for x in found], "place": range(1, len(found) + 1)})

    merged = rows.groupBy("_q").applyInPandas(merge, f"_q {kind}, item string, score double, place int")
    return merged.select(F.col("_q").alias(query_id), F.col("item").cast(items.schema[item_id].dataType).alias(item_id), "score", "place")


def quotes_shown(evidence: DataFrame, pages: DataFrame, most: int = 1_800) -> DataFrame:
    """kp_id, excerpt: the quotes of each claim that stand in their page as they
    are, one a line in the order of evidence_id, cut to `most` characters."""
    there = pages.groupBy("source_file", "page_no").agg(F.max("text").alias("text"))
    held = evidence.filter("kp_id is not null and length(quote) > 0").select("kp_id", "evidence_id", "source_file", "page_no", "quote").distinct().join(there, ["source_file", "page_no"]).filter(F.contains("text", "quote"))
    listed = held.groupBy("kp_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "quote"))).alias("q"))
    return listed.select("kp_id", F.left(F.array_join(F.transform("q", lambda x: x["quote"]), "\n"), F.lit(most)).alias("excerpt"))

