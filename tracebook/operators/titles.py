"""Titles of chapters and sections: what kind they are, and where they begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebook.functions.text import BLANKS

# Titles of front and back matter, in full and without blanks, and of appendices, by their begin.
MATTER = "index contents tableofcontents listofsymbols listoffigures listoftables notation preface foreword abouttheauthor author authors bibliography references 符号表 目录 前言 序言 致谢 参考文献 索引 作者简介".split()
MATTER_BEGIN = "acknowledg"
APPENDIX = "附录 附表 续附表 appendix".split()
# Further titles of matter in reviewing a skeleton, and what is no title at all.
REVIEW_MATTER = "content listofabbreviations bibliographies reference glossary abstract 摘要 中华人民共和国国家标准 国家标准 出版社 文库 丛书".split()
NO_TITLE = [r"doi\s*[:：]", r"https?://", r"www\.", r"^[0-9.\-—\s]{1,12}$", r"^[ivxlcdm]{1,6}$", "续表", r"^表\s*[0-9]", r"^图\s*[0-9]", r"^第\s*[0-9]+\s*页"]
# Marks of which a title has at most two.
PUNCTUATION = "，。；：！？,;:!?（）()《》\"'’“”"
PUNCTUATION_SQL = PUNCTUATION.replace("'", "''")


def bare(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), BLANKS, "")


def is_matter(title: Column) -> Column:
    b = bare(title)
    return F.coalesce(b.isin(MATTER) | b.rlike(rf"^{MATTER_BEGIN}\w*$"), F.lit(False))


def is_appendix(title: Column) -> Column:
    return F.coalesce(bare(title).rlike("^(?:" + "|".join(APPENDIX) + ")"), F.lit(False))


def title_kind(title: Column) -> Column:
    """matter, appendix or body; null and empty titles are body."""
    return F.when(is_matter(title), "matter").when(is_appendix(title), "appendix").otherwise("body")


def begins_chapter(title: Column) -> Column:
    return title.rlike(r"^\s*第\s*[0-9零一二三四五六七八九十百]{1,4}\s*[章篇部]") | title.rlike(r"(?i)^\s*chapter\s+\d{1,2}\b")


def title_verdict(title: Column) -> Column:
    """What a candidate title is by rule: noise, chapter, matter or section, the
    first that holds of: empty; with a chapter number; an appendix (kept as a
    chapter, for its tables of values); matter; an address, page number or rest
    of a table; shorter than two characters; without an ideograph or two Latin
    letters; with a number of the second or third level. Null if no rule tells."""
    t = F.trim(title)
    reviewed = F.regexp_replace(bare(t), r"[.。:：]+$", "")
    numbered = t.rlike(r"^\s*[0-9零一二三四五六七八九十百]{1,3}\s*[、.]\s*\S") & ~t.rlike(r"^\s*\d+\.\d") | t.rlike(r"^\s*[（(]\s*[0-9零一二三四五六七八九十百]{1,3}\s*[）)]\s*\S") | t.rlike(r"^\s*\d{1,2}(?:\.\d{1,2}){1,2}\s+\S")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "noise")
        .when(begins_chapter(t), "chapter")
        .when(is_appendix(t), "chapter")
        .when(is_matter(t) | reviewed.isin(MATTER + REVIEW_MATTER) | reviewed.rlike(r"^中华人民共和国.*公告$"), "matter")
        .when(t.rlike("(?i)" + "|".join(NO_TITLE)), "noise")
        .when(F.length(t) < 2, "noise")
        .when(~t.rlike(r"[\x{4E00}-\x{9FFF}]|[A-Za-z]{2}"), "noise")
        .when(numbered, "section")
    )


def plausible_title(title: Column) -> Column:
    """At most 46 characters, at most two punctuation marks, and an ideograph
    or three Latin letters in a row; null is not plausible."""
    marks = F.length(title) - F.length(F.translate(title, PUNCTUATION, ""))
    return F.coalesce((F.length(title) <= 46) & (marks <= 2) & title.rlike(r"[\x{4E00}-\x{9FFF}]|[A-Za-z]{3}"), F.lit(False))


def chapter_number(title: Column) -> Column:
    """The number of `第3章` or `Chapter 3`, also in Chinese numerals; else null."""
    from tracebook.functions.text import chinese_number

    zh, en = F.regexp_extract(title, r"^\s*第\s*([0-9零一二三四五六七八九十]{1,3})\s*章", 1), F.regexp_extract(title, r"(?i)^\s*chapter\s+(\d{1,3})\b", 1)
    return F.coalesce(chinese_number(F.when(zh != "", zh)), F.when(en != "", en.cast("int")))


def clean_title(line: Column) -> Column:
    """A header line without the page number before or after it, also where
    recognition has glued it to a Chinese title or to one with a chapter number,
    and without leaders; underscores are blanks."""
    plain = F.regexp_replace(line, r"[_\x{3000}]", " ")
    tail = F.regexp_replace(plain, r"(?:\s+(?:\d{1,4}|[ivxlc]{1,6})|[\s.·．…\-]+\d{1,4})\s*$", "")
    head = F.regexp_replace(F.regexp_replace(tail, r"^\s*(?:\d{1,4}|[ivxlc]{1,6})\s{2,}", ""), r"^\s*\d{1,4}\s*(?=[\x{4E00}-\x{9FFF}])", "")
    glued = F.when(head.rlike(r"^第\s*[0-9零一二三四五六七八九十百]{1,4}\s*[章节]"), F.regexp_replace(head, r"\d{1,4}\s*$", "")).otherwise(head)
    return F.regexp_replace(F.regexp_replace(glued, r"\s+", " "), r"^[ .·．…\-—]+|[ .·．…\-—]+$", "")


def title_key(title: Column) -> Column:
    """What titles are grouped by: the chapter's number, else the title without trailing digits."""
    number = chapter_number(title)
    return F.when(number.isNotNull(), F.concat(F.lit("#ch"), number.cast("string"))).otherwise(F.regexp_replace(bare(title), r"\d+$", ""))


def page_header(text: Column) -> Column:
    """The first of the first two lines with text that is a plausible title of at most 90 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: clean_title(x)), lambda x: x != "")
    return F.try_element_at(F.filter(F.slice(lines, 1, 2), lambda x: (F.length(x) <= 90) & plausible_title(x)), F.lit(1))


#: A header is the book's title if it stands on one of so many first pages, and how often it must stand, by number and share of the pages.
FRONT, OFTEN_IN_FRONT, OFTEN = 8, (3, 0.10), (5, 0.15)


def header_chapters(pages: DataFrame, least: int = 2) -> DataFrame:
    """source_file, key, title, page_start, page_end, pages, kind: chapters by
    running headers. Pages in order take the key of their header; the pages of
    one key, in one or more runs, are a chapter if there are `least` or more.

    A header without a chapter number is the book's title and no chapter if it
    stands in front (from one of the first FRONT pages on) and often, or if it
    is the commonest of the file and stands very often. The title of a chapter
    is its commonest spelling, of several the first in order.
    """
    rows = pages.filter("source_file is not null and page_no is not null and length(text) > 0").groupBy("source_file", "page_no").agg(F.max("text").alias("text")).select("source_file", "page_no", F.explode(F.array(page_header(F.col("text")))).alias("title"))
    keyed = rows.filter("title is not null").select("*", F.explode(F.array(title_key(F.col("title")))).alias("key")).filter("key <> ''")
    spelled = keyed.groupBy("source_file", "key", "title").agg(F.count(F.lit(1)).alias("n"), F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    per = spelled.groupBy("source_file", "key").agg(F.sum("n").alias("n"), F.min_by("title", F.struct(-F.col("n"), "title")).alias("title"), F.min("a").alias("page_start"), F.max("b").alias("page_end"))
    total = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("all"))
    top = per.filter(~F.col("key").startswith("#ch")).groupBy("source_file").agg(F.min_by("key", F.struct(-F.col("n"), "key")).alias("_top"))
    of = per.join(total, "source_file").join(top, "source_file", "left")
    often = lambda x: F.col("n") >= F.greatest(F.lit(float(x[0])), F.lit(x[1]) * F.col("all"))
    book = ((F.col("page_start") <= FRONT) & often(OFTEN_IN_FRONT)) | (F.col("key").eqNullSafe(F.col("_top")) & often(OFTEN))
    kept = of.filter((F.col("n") >= least) & (F.col("key").startswith("#ch") | ~book))
    return kept.select("source_file", "key", "title", "page_start", "page_end", F.col("n").alias("pages"), title_kind(F.col("title")).alias("kind"))


def detected_section(text: Column) -> Column:
    """The first line of the first twelve (within 400 characters) that begins a
    chapter, else that begins a numbered section; null without either."""
    lines = F.slice(F.filter(F.transform(F.split(F.left(text, F.lit(400)), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 12)
    found = [F.try_element_at(_matching(lines, p), F.lit(1)) for p in (r"^第\s*[0-9一二三四五六七八九十]{1,3}\s*章", r"(?i)^chapter\s+\d+", r"^第\s*[0-9一二三四五六七八九十]{1,3}\s*节", r"^\d{1,2}\.\d{1,2}(\.\d{1,2})?\s+\S")]
    return F.coalesce(*found)


def _matching(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: x.rlike(pattern) & (F.length(x) <= 60))


def renumbered(sections: DataFrame, group: str, order: str) -> DataFrame:
    """Sections with `no` counted anew within their chapter."""
    return sections.withColumn("no", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def head_text(text: Column, width: int = 150) -> Column:
    """The begin of a page as one line, as shown beside a candidate title."""
    return F.left(F.trim(F.regexp_replace(F.left(text, F.lit(20 * width)), f"{BLANKS}+", " ")), F.lit(width))
