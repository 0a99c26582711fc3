"""Where a quote comes from: chunk keys, and the text of the chunk it was taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebook.operators.quotes import TIERS, quote_tier

#: course::tag::p8, course::tag::p8-12, with or without a hash of the text behind.
KEY = r"^(.+?)::(?:([^:]+)::)?p(\d{1,9})(?:-(\d{1,9}))?(?:::h[0-9a-f]{4,})?$"
LEGACY = r"::\d{4}$"


def parsed_key(key: Column) -> Column:
    """struct(course, tag, page_start, page_end) of a chunk key; null for keys
    of another form, also for legacy ones that end in a running number."""
    part = lambda i: F.regexp_extract(key, KEY, i)
    start = part(3).try_cast("int")
    end = F.when(part(4) == "", start).otherwise(part(4).try_cast("int"))
    made = F.struct(part(1).alias("course"), F.when(part(2) != "", part(2)).alias("tag"), start.alias("page_start"), end.alias("page_end"))
    return F.when(key.rlike(KEY) & (start <= end), made)


def is_legacy_key(key: Column) -> Column:
    return F.coalesce(key.rlike(LEGACY), F.lit(False))


def chunk_key(course: Column, tag: Column, start: Column, end: Column) -> Column:
    """The key of a chunk; one page is written once."""
    pages = F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat(course, F.lit("::"), F.coalesce(F.concat(tag, F.lit("::")), F.lit("")), F.lit("p"), pages)


def rechecked(evidence: DataFrame, chunks: DataFrame, pages: DataFrame, form) -> DataFrame:
    """evidence_id, before, tier, found_by, n_bodies: each quote judged again on
    the text it was taken from.

    evidence: evidence_id, chunk_id, quote, verify_method. chunks: course, tag,
    page_start, page_end, text. pages: course, page_no, text. The body is looked
    for by the whole key (`key`), else by course and pages whatever the file
    (`pages`), else a body is made of the course's pages in that range
    (`range`). Of several bodies the best tier counts. `unmatched` quotes have
    no body and keep their tier; where n_bodies is above one the choice was
    ambiguous. Rows repeated in full count once. Ranges are expanded to pages
    by equality, never compared with all pages of a course.
    """
    quotes = evidence.select("evidence_id", F.col("verify_method").alias("before"), form(F.col("quote")).alias("q"), parsed_key(F.col("chunk_id")).alias("k")).distinct().select("evidence_id", "before", "q", "k.*")
    there = chunks.select("course", "tag", "page_start", "page_end", form(F.col("text")).alias("body")).distinct()
    place = ["course", "page_start", "page_end"]
    exact = quotes.join(there, [*place, "tag"]).select("evidence_id", "q", "body", F.lit("key").alias("found_by"))
    rest = quotes.join(exact.select("evidence_id").distinct(), "evidence_id", "left_anti")
    loose = rest.join(there.drop("tag"), place).select("evidence_id", "q", "body", F.lit("pages").alias("found_by"))
    open_ = rest.join(loose.select("evidence_id").distinct(), "evidence_id", "left_anti").filter("page_start is not null")
    span = pages.groupBy("course").agg(F.min("page_no").alias("_low"), F.max("page_no").alias("_high"))
    wide = open_.join(span, "course").withColumns({"_a": F.greatest("page_start", "_low"), "_b": F.least("page_end", "_high")}).filter("_a <= _b")
    each = wide.select("evidence_id", "q", "course", F.explode(F.sequence("_a", "_b")).alias("page_no")).join(pages.select("course", "page_no", "text").filter("length(text) > 0").distinct(), ["course", "page_no"])
    joined = each.groupBy("evidence_id", "q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    ranged = joined.select("evidence_id", "q", form(F.col("text")).alias("body"), F.lit("range").alias("found_by"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("tier"))
    judged = exact.union(loose).union(ranged).withColumn("tier", quote_tier(F.col("q"), F.col("body")))
    best = judged.groupBy("evidence_id", "found_by").agg(F.max_by("tier", rank).alias("tier"), F.count(F.lit(1)).alias("n_bodies"))
    whole = quotes.select("evidence_id", "before").join(best, "evidence_id", "left")
    return whole.select("evidence_id", "before", F.coalesce("tier", "before").alias("tier"), F.coalesce("found_by", F.lit("unmatched")).alias("found_by"), F.coalesce("n_bodies", F.lit(0)).cast("long").alias("n_bodies"))


def recheck_summary(checked: DataFrame) -> DataFrame:
    """before, tier, n, unmatched, ambiguous of a recheck."""
    return checked.groupBy("before", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found_by") == "unmatched").alias("unmatched"), F.count_if(F.col("n_bodies") > 1).alias("ambiguous"))


def guard_recheck(checked: DataFrame, most: float = 0.1) -> DataFrame:
    """The recheck as it is; ValueError if more than `most` of it is unmatched
    or ambiguous, so that it is not written back."""
    row = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("found_by") == "unmatched") | (F.col("n_bodies") > 1)).alias("unsure")).first()
    if row["unsure"] > most * row["n"]:
        raise ValueError(f"{row['unsure']} of {row['n']} quotes are unmatched or ambiguous")
    return checked


def open_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks still to be worked on. chunks: chunk_id, fingerprint; done:
    key, fingerprint. A chunk is done if its key is, with the same fingerprint
    or where one of the two is not known."""
    seen = done.groupBy(F.col("key").alias("chunk_id")).agg(F.collect_set("fingerprint").alias("_fps"), F.bool_or(F.col("fingerprint").isNull()).alias("_any"))
    met = chunks.join(seen, "chunk_id", "left")
    is_done = F.col("_fps").isNotNull() & (F.col("_any") | F.col("fingerprint").isNull() | F.array_contains("_fps", F.coalesce("fingerprint", F.lit(""))))
    return met.filter(~is_done).drop("_fps", "_any")


def migrated_keys(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """old_key, new_key, fingerprint, outcome: done rows (key, fingerprint) under
    the keys that chunks (chunk_id, course, tag, page_start, page_end,
    fingerprint) have today, found by course and pages. outcome: kept, moved,
    unmatched (no such chunk), unreadable (no key of a known form), repeated
    (another row has the new key already; one with a fingerprint goes first)."""
    old = done.select(F.col("key").alias("old_key"), F.col("fingerprint").alias("_old"), parsed_key(F.col("key")).alias("k"))
    now = chunks.groupBy("course", "page_start", "page_end").agg(F.min(F.struct("chunk_id", "fingerprint")).alias("c"), F.count(F.lit(1)).alias("_n"))
    by_tag = chunks.select("course", "tag", "page_start", "page_end", F.struct("chunk_id", "fingerprint").alias("d"))
    flat = old.select("old_key", "_old", "k.*")
    place = ["course", "page_start", "page_end"]
    met = flat.join(by_tag, [*place, "tag"], "left").join(now, place, "left")
    found = F.coalesce("d", F.when(F.col("_n") == 1, F.col("c")))
    named = met.select("old_key", F.coalesce(found["chunk_id"], F.col("old_key")).alias("new_key"), F.coalesce(found["fingerprint"], F.col("_old")).alias("fingerprint"), F.when(F.col("page_start").isNull(), "unreadable").when(found.isNull(), "unmatched").when(found["chunk_id"] == F.col("old_key"), "kept").otherwise("moved").alias("outcome"))
    from pyspark.sql import Window

    place_in = F.row_number().over(Window.partitionBy("new_key").orderBy(F.col("fingerprint").isNull(), "old_key"))
    return named.withColumn("_i", place_in).withColumn("outcome", F.when(F.col("_i") > 1, "repeated").otherwise(F.col("outcome"))).drop("_i")
