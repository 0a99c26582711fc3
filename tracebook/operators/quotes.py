"""Verifying quotations against the pages they cite, in four tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = {"exact": 3, "partial": 2, "fabricated": 1, "not_found": 0}
ANCHOR = 24
SHORTEST = 12


def quote_tier(quote: Column, body: Column) -> Column:
    """exact, partial, fabricated or not_found, of a quote and a body that are
    both in one form already.

    The body holds the quote: exact. Else the first and last 24 characters of
    a quote of 12 or more are anchors. A number of the quote that the body has
    not even as part of another makes it fabricated, or not_found without an
    anchor; two anchors make it partial, one fabricated, none not_found. Null
    and empty quotes and bodies are not_found.
    """
    long = F.length(quote) >= SHORTEST
    head = long & F.contains(body, F.left(quote, F.lit(ANCHOR)))
    tail = long & F.contains(body, F.right(quote, F.lit(ANCHOR)))
    strange = F.exists(F.regexp_extract_all(quote, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: ~F.contains(body, n))
    return (
        F.when(F.coalesce(quote, F.lit("")) == "", "not_found")
        .when(F.coalesce(body, F.lit("")) == "", "not_found")
        .when(F.contains(body, quote), "exact")
        .when(strange, F.when(head | tail, "fabricated").otherwise("not_found"))
        .when(head & tail, "partial")
        .when(head | tail, "fabricated")
        .otherwise("not_found")
    )


def quote_ledger(evidence: DataFrame, pages: DataFrame, form) -> DataFrame:
    """evidence_id, kp_id, before (the tier on record), tier: each quote judged
    on the page it cites. Pages are put in form once, not once per quote;
    rows repeated in full count once; a page that is not there is an empty body."""
    bodies = pages.filter(F.length("text") > 0).select("source_file", "page_no", form(F.col("text")).alias("body")).dropDuplicates(["source_file", "page_no"])
    quotes = evidence.select("evidence_id", "kp_id", "source_file", "page_no", F.col("verify_method").alias("before"), form(F.col("quote")).alias("q")).distinct()
    return quotes.join(bodies, ["source_file", "page_no"], "left").select("evidence_id", "kp_id", "before", quote_tier(F.col("q"), F.col("body")).alias("tier"))


def confidence(tier: Column) -> Column:
    """An aggregate over the tiers of one claim: A if all are exact, B if any
    is exact or partial, else C."""
    return F.when(F.bool_and(tier == "exact"), "A").when(F.bool_or(tier.isin("exact", "partial")), "B").otherwise("C")


def transitions(ledger: DataFrame) -> DataFrame:
    """before, tier, n, change: the counts of a recheck, and whether it raised
    or lowered the tier."""
    rank = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), c)
    counted = ledger.groupBy("before", "tier").agg(F.count(F.lit(1)).alias("n"))
    gap = rank(F.col("tier")) - rank(F.col("before"))
    return counted.withColumn("change", F.when(F.col("before").isNull(), "new").when(gap > 0, "raised").when(gap < 0, "lowered").otherwise("same"))


def best_body(candidates: DataFrame, key: str, quote: str, body: str, order: str) -> DataFrame:
    """Of several bodies a quote may come from, the one with the best tier, the
    first in `order` on a tie: key, tier, order."""
    judged = candidates.select(key, order, quote_tier(F.col(quote), F.col(body)).alias("tier"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("tier"))
    return judged.groupBy(key).agg(F.max_by(F.struct("tier", order), F.struct(rank, -F.col(order))).alias("b")).select(key, "b.*")
