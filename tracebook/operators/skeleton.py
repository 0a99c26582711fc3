"""Chapters of files: from tables of contents, running headers or headings, and their review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebook.functions.text import chinese_number
from tracebook.operators import titles as T

NUMERAL = "[0-9零一二三四五六七八九十百]{1,4}"
#: A line of contents: chapter number, title, leaders or blanks, page.
LINE_ZH = rf"^\s*第\s*({NUMERAL})\s*章[\s:：.、]*(.{{1,40}}?)[\s.·．…\-]{{2,}}(\d{{1,4}})\s*$"
LINE_EN = r"(?i)^\s*chapter\s+(\d{1,2})\b[\s:：.]*(.{1,40}?)[\s.·．…\-]{2,}(\d{1,4})\s*$"


def contents_entries(pages: DataFrame, least: int = 2) -> DataFrame:
    """source_file, num, title, printed: the chapters that a file's tables of
    contents list, each number once, by its first line; files with fewer than
    `least` of them have no table of contents."""
    lines = pages.filter("source_file is not null and length(text) > 0").select("source_file", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "x"))
    found = None
    for pattern, chinese in ((LINE_ZH, True), (LINE_EN, False)):
        part = lambda i, p=pattern: F.regexp_extract("x", p, i)
        number = chinese_number(part(1)) if chinese else part(1).try_cast("int")
        one = lines.filter(F.col("x").rlike(pattern)).select("source_file", "page_no", "line_no", number.alias("num"), F.trim(part(2)).alias("title"), part(3).try_cast("int").alias("printed"))
        found = one if found is None else found.union(one)
    first = found.filter("num is not null").groupBy("source_file", "num").agg(F.min(F.struct("page_no", "line_no", "title", "printed")).alias("x")).select("source_file", "num", "x.title", "x.printed", F.col("x.page_no").alias("listed_on"))
    many = first.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return first.join(many.select("source_file"), "source_file", "left_semi")


def headings(pages: DataFrame, head: int = 12) -> DataFrame:
    """source_file, num, title, page_no: the lines among the first `head` with
    text of a page that begin a numbered chapter and are no line of contents."""
    text = pages.filter("source_file is not null and length(text) > 0").groupBy("source_file", "page_no").agg(F.max("text").alias("text"))
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, head)
    each = text.select("source_file", "page_no", F.explode(lines).alias("x")).filter(~F.col("x").rlike(LINE_ZH) & ~F.col("x").rlike(LINE_EN))
    # made once a row: a projection would be merged with what uses it
    titled = each.select("source_file", "page_no", F.explode(F.array(T.clean_title(F.col("x")))).alias("title")).withColumn("num", T.chapter_number(F.col("title")))
    return titled.filter(F.col("num").isNotNull() & (F.length("title") <= 46)).groupBy("source_file", "num", "page_no").agg(F.min("title").alias("title"))


def built_skeleton(pages: DataFrame) -> DataFrame:
    """source_file, num, title, page_start, page_end, kind, found_by: the
    chapters of every file, by the first way that gives any: `contents` (a
    listed chapter begins at the first page behind the list with its heading; a
    listed one without a heading is left out), `headers` (running headers),
    `headings`. A chapter ends before the next one of its file, the last one
    with the file, and never before it begins."""
    marks = headings(pages)
    listed = contents_entries(pages)
    begun = listed.join(marks.select("source_file", "num", "page_no"), ["source_file", "num"]).filter("page_no > listed_on")
    by_contents = begun.groupBy("source_file", "num", "title").agg(F.min("page_no").alias("page_start")).withColumn("found_by", F.lit("contents"))
    running = T.header_chapters(pages)
    order = Window.partitionBy("source_file").orderBy("page_start", "key")
    by_header = running.select("source_file", F.coalesce(T.chapter_number(F.col("title")), F.row_number().over(order)).alias("num"), "title", "page_start", F.lit("headers").alias("found_by"))
    by_heading = marks.groupBy("source_file", "num").agg(F.min(F.struct("page_no", "title")).alias("x")).select("source_file", "num", "x.title", F.col("x.page_no").alias("page_start"), F.lit("headings").alias("found_by"))
    columns = ["source_file", "num", "title", "page_start", "found_by"]
    chosen = by_contents.select(*columns)
    for other in (by_header, by_heading):
        chosen = chosen.union(other.join(chosen.select("source_file").distinct(), "source_file", "left_anti").select(*columns))
    last = pages.groupBy("source_file").agg(F.max("page_no").alias("_last"))
    after = F.lead("page_start").over(Window.partitionBy("source_file").orderBy("page_start", "num", "title"))
    ended = chosen.join(last, "source_file").withColumn("page_end", F.greatest("page_start", F.coalesce(after - 1, F.col("_last"))))
    return ended.select("source_file", "num", "title", "page_start", "page_end", T.title_kind(F.col("title")).alias("kind"), "found_by")


def reviewed_skeleton(chapters: DataFrame, verdicts: DataFrame, heads: DataFrame) -> DataFrame:
    """The chapters (source_file, num, title, page_start, page_end) after review:
    source_file, num, no, title, page_start, page_end, verdict, by.

    The rule decides where it can; else a recorded verdict (source_file, title,
    verdict, quote) does, but only if its quote stands in the text of the page
    where the candidate begins (heads: source_file, page_no, text). What nobody
    decides stays a chapter. Noise goes; a section belongs to the chapter before
    it (to none before the first); matter is kept as such. Chapters are counted
    anew as num, sections of a chapter as no. Ranges that end before they begin
    raise ValueError."""
    if chapters.filter("page_end < page_start").limit(1).count():
        raise ValueError("a chapter that ends before it begins")
    rule = T.title_verdict(F.col("title"))
    said = verdicts.groupBy("source_file", "title").agg(F.min(F.struct("verdict", "quote")).alias("_v"))
    pages = heads.groupBy("source_file", "page_no").agg(F.max("text").alias("_text")).withColumnRenamed("page_no", "page_start")
    met = chapters.join(said, ["source_file", "title"], "left").join(pages, ["source_file", "page_start"], "left")
    proved = (F.trim("_v.quote") != "") & F.contains("_text", F.col("_v.quote"))
    verdict = F.coalesce(rule, F.when(proved, F.col("_v.verdict")), F.lit("chapter"))
    by = F.when(rule.isNotNull(), "rule").when(proved, "quote").otherwise("open")
    kept = met.select("source_file", "title", "page_start", "page_end", verdict.alias("verdict"), by.alias("by")).filter("verdict <> 'noise'")
    order = Window.partitionBy("source_file").orderBy("page_start", "page_end", "title")
    counted = kept.withColumn("num", F.count(F.when(F.col("verdict") != "section", 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    section = Window.partitionBy("source_file", "num", F.col("verdict") == "section").orderBy("page_start", "page_end", "title")
    return counted.withColumn("no", F.when(F.col("verdict") == "section", F.row_number().over(section))).select("source_file", "num", "no", "title", "page_start", "page_end", "verdict", "by")
