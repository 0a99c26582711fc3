"""Pages: runs, intervals, chapters, printed numbers, windows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebook.functions.text import BLANKS, file_tag_of, first_number
from tracebook.sources.tables import stage


def page_keys(pages: DataFrame) -> DataFrame:
    """One row per page that has a key: file_id, source_file, course, page_no, size."""
    return pages.filter("file_id is not null and page_no is not null").groupBy("file_id", "page_no").agg(F.min("source_file").alias("source_file"), F.min("course").alias("course"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))


def page_runs(keys: DataFrame) -> DataFrame:
    """file_id, first_page, last_page, pages: the runs of consecutive numbers."""
    island = F.col("page_no") - F.row_number().over(Window.partitionBy("file_id").orderBy("page_no"))
    return keys.select("file_id", "page_no").distinct().withColumn("run", island).groupBy("file_id", "run").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("pages")).drop("run")


def page_intervals(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """source_file, pages, first_page, last_page in one numbering of all files
    in the order of their names. The files are cut in at most `parts` ranges of
    names of about equal size (as many as the session shuffles to); a running sum over the sums of the ranges, and
    within each range, gives the numbers, so no task sorts all files."""
    per_file = keys.groupBy("source_file").agg(F.count(F.lit(1)).alias("pages"))
    parts = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = per_file.repartitionByRange(parts, "source_file").withColumn("_p", F.spark_partition_id())
    # the partition of a row is fixed by writing it
    cut = stage(ranged, "intervals")
    sums = cut.groupBy("_p").agg(F.sum("pages").alias("_s"))
    before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    last = F.col("_before") + F.sum("pages").over(Window.partitionBy("_p").orderBy("source_file"))
    return cut.join(F.broadcast(before), "_p").withColumn("last_page", last).select("source_file", "pages", (F.col("last_page") - F.col("pages") + 1).alias("first_page"), "last_page")


def chapters_of(skeleton: DataFrame) -> DataFrame:
    return skeleton.select("node_id", "source_file", "ord", "num", "title", "kind", "page_start", "page_end").filter("node_id is not null").distinct()


def chapter_ends(chapters: DataFrame, last_pages: DataFrame) -> DataFrame:
    """node_id, page_start, page_end: a chapter ends before the next one of its
    file, in the order of chapter numbers, the last one with the file; never
    before it begins."""
    order = Window.partitionBy("source_file").orderBy("num", "page_start", "node_id")
    until = F.coalesce(F.lead("page_start").over(order) - 1, F.col("last_page"))
    return chapters.join(last_pages, "source_file").select("node_id", "page_start", F.greatest("page_start", until).alias("page_end"))


def expand_ranges(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """Each range (columns source_file, page_start, page_end and others) with
    each page of its file in it, by an equality join on file and page. Ranges
    without a begin or an end are of no page."""
    span = keys.groupBy("source_file").agg(F.min("page_no").alias("_low"), F.max("page_no").alias("_high"))
    cut = ranges.filter("page_start is not null and page_end is not null").join(span, "source_file").withColumns({"_a": F.greatest("page_start", "_low"), "_b": F.least("page_end", "_high")}).filter("_a <= _b")
    wide = cut.withColumn("page_no", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "_low", "_high")
    return wide.join(keys.select("source_file", "page_no", "file_id", "size"), ["source_file", "page_no"])


def page_owners(chapters: DataFrame, keys: DataFrame, with_matter: bool = False) -> DataFrame:
    """file_id, page_no, size, node_id, ord: the chapter that owns each page,
    of several the first in the order of the skeleton."""
    kept = chapters if with_matter else chapters.filter("coalesce(kind, '') <> 'matter'")
    claims = expand_ranges(kept.filter("page_start > 0 and page_end > 0"), keys)
    return claims.groupBy("file_id", "page_no").agg(F.min(F.struct("ord", "node_id")).alias("o"), F.max("size").alias("size"), F.max("source_file").alias("source_file")).select("file_id", "source_file", "page_no", "size", "o.node_id", "o.ord")


def section_owners(skeleton: DataFrame, owners: DataFrame) -> DataFrame:
    """file_id, page_no, node_id, section_id: the section that owns a page of a
    chapter. Sections are cut to their chapter, inverted ones left out, and of
    several the first counts; pages of no section are left out."""
    s = skeleton.select("node_id", "source_file", "page_start", "page_end", F.explode("sections").alias("s")).distinct()
    ranges = s.select("node_id", "source_file", F.greatest(F.coalesce("s.page_start", "page_start"), "page_start").alias("page_start"), F.least(F.coalesce("s.page_end", "page_end"), "page_end").alias("page_end"), F.col("s.ord").alias("sord"), F.col("s.node_id").alias("section_id"))
    claims = expand_ranges(ranges, owners.select("source_file", "page_no", "file_id", "size")).join(owners.select("file_id", "page_no", "node_id"), ["file_id", "page_no", "node_id"])
    return claims.groupBy("file_id", "page_no", "node_id").agg(F.min(F.struct("sord", "section_id")).alias("o")).select("file_id", "page_no", "node_id", "o.section_id")


def coverage(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """course, text_pages, covered_pages, share: pages with text, and those in
    any of the ranges."""
    covered = expand_ranges(ranges, keys).select("file_id", "page_no").distinct().withColumn("hit", F.lit(True))
    of = keys.filter("size > 0").join(covered, ["file_id", "page_no"], "left")
    share = F.round(100 * F.count("hit") / F.count(F.lit(1)), 1)
    return of.groupBy("course").agg(F.count(F.lit(1)).alias("text_pages"), F.count("hit").alias("covered_pages"), share.alias("share"))


def number_candidates(pages: DataFrame) -> DataFrame:
    """file_id, page_no, candidate: the numbers of 1 to 2000 in the first and
    last line with text, if that is of at most 60 characters; no years, no
    parts of decimals."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", "")), lambda x: x != "")
    both = F.when(F.size("ls") > 0, F.array(F.element_at("ls", 1), F.element_at("ls", -1)))
    cut = pages.filter("length(text) > 0").select("file_id", "page_no", lines.alias("ls")).select("file_id", "page_no", F.posexplode(both).alias("edge", "line")).filter(F.length("line") <= 60).distinct()
    number = F.explode(F.regexp_extract_all("line", F.lit(r"(?<![0-9.])([0-9]{1,4})(?![0-9.])"), F.lit(1))).alias("c")
    return cut.select("file_id", "page_no", "edge", number).filter("not c rlike '(19|20)[0-9]{2}'").select("file_id", "page_no", F.col("c").cast("int").alias("candidate")).filter("candidate between 1 and 2000")


def offset_votes(pages: DataFrame) -> DataFrame:
    """file_id, pages, best_offset, hits, ratio, tier, confident: the most
    frequent difference of printed and physical number. A tie goes to the
    difference nearest to zero, then to the lower one."""
    n = pages.filter("file_id is not null and page_no is not null").groupBy("file_id").agg(F.count_distinct("page_no").alias("pages"))
    votes = number_candidates(pages).groupBy("file_id", (F.col("candidate") - F.col("page_no")).alias("off")).agg(F.count(F.lit(1)).alias("hits"))
    best = votes.groupBy("file_id").agg(F.max(F.struct("hits", (-F.abs("off")).alias("near"), (-F.col("off")).alias("low"))).alias("b"))
    joined = n.join(best, "file_id", "left").select("file_id", "pages", (-F.col("b.low")).alias("best_offset"), F.coalesce("b.hits", F.lit(0)).alias("hits"))
    ratio = F.round(F.col("hits") / F.col("pages"), 3)
    tier = F.when(F.col("ratio") >= 0.75, "high").when(F.col("ratio") >= 0.5, "medium").otherwise("low")
    return joined.withColumn("ratio", ratio).withColumn("tier", tier).withColumn("confident", F.col("best_offset").isNotNull() & (F.col("hits") / F.col("pages") >= 0.3) & (F.col("hits") >= 5))


def offset_runners_up(pages: DataFrame, most: int = 4) -> DataFrame:
    """file_id, place, off, hits: the differences with the most votes of each
    file, at most `most`, the best first, as `offset_votes` ranks them."""
    votes = number_candidates(pages).groupBy("file_id", (F.col("candidate") - F.col("page_no")).alias("off")).agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy("file_id").orderBy(F.col("hits").desc(), F.abs("off"), "off")
    return votes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("file_id", "place", "off", "hits")


def course_offsets(votes: DataFrame, keys: DataFrame) -> DataFrame:
    """course, files, confident_files, offset, mixed, least_ratio: the offset of
    a course if all its confident files agree."""
    of = votes.join(keys.select("file_id", "course").distinct().groupBy("file_id").agg(F.min("course").alias("course")), "file_id")
    sure = F.col("confident")
    kinds = F.count_distinct(F.when(sure, F.col("best_offset")))
    return of.groupBy("course").agg(F.count(F.lit(1)).alias("files"), F.count_if(sure).alias("confident_files"), F.when(kinds == 1, F.max(F.when(sure, F.col("best_offset")))).alias("offset"), (kinds > 1).alias("mixed"), F.min(F.when(sure, F.col("ratio"))).alias("least_ratio"))


def label_anchors(pages: DataFrame) -> DataFrame:
    """file_id, index, printed: the first and last page of each file whose label has a number."""
    of = pages.select("file_id", "page_no", first_number(F.col("page_label")).alias("printed")).filter("printed is not null and file_id is not null and page_no is not null").distinct()
    ends = of.groupBy("file_id").agg(F.min(F.struct("page_no", "printed")).alias("a"), F.max(F.struct("page_no", "printed")).alias("b"))
    return ends.select("file_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("file_id", F.col("p.page_no").alias("index"), "p.printed")


def interpolate(keys: DataFrame, anchors: DataFrame) -> DataFrame:
    """file_id, page_no, printed, extrapolated: printed numbers on the line
    between the anchors around a page, and on the nearest line beyond them;
    half goes to the even number. Files with fewer than two anchors are left out.
    Products are taken as long numbers: those of a file of 46,342 pages no
    longer fit an int. A printed number that fits none is null."""
    order = Window.partitionBy("file_id").orderBy("index")
    line = anchors.withColumns({"next": F.lead("index").over(order), "next_printed": F.lead("printed").over(order), "no": F.row_number().over(order), "all": F.count(F.lit(1)).over(Window.partitionBy("file_id"))}).filter("next is not null")
    pages = keys.select("file_id", "page_no").distinct()
    span = pages.groupBy("file_id").agg(F.min("page_no").alias("_first"), F.max("page_no").alias("_last"))
    low = F.when(F.col("no") == 1, F.col("_first")).otherwise(F.greatest("index", "_first"))
    high = F.when(F.col("no") == F.col("all") - 1, F.col("_last")).otherwise(F.least(F.col("next") - 1, F.col("_last")))
    ranged = line.join(span, "file_id").withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    met = ranged.withColumn("page_no", F.explode(F.sequence("_low", "_high"))).join(pages, ["file_id", "page_no"])
    long = {c: F.col(c).cast("long") for c in ("page_no", "index", "next", "printed", "next_printed")}
    value = long["printed"] + (long["page_no"] - long["index"]) * (long["next_printed"] - long["printed"]) / (long["next"] - long["index"])
    outside = (F.col("page_no") < F.col("index")) | (F.col("page_no") > F.col("next"))
    return met.select("file_id", "page_no", F.bround(value, 0).try_cast("int").alias("printed"), outside.alias("extrapolated"))


def pack(sizes: Column, limit: int) -> Column:
    """Windows of consecutive pages: the window number of each element of an
    array of sizes. A page that would overflow the window begins the next one;
    an oversized page stands alone."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["held"] > 0) & (acc["held"] + n > limit)
        w = F.when(new, acc["w"] + 1).otherwise(acc["w"])
        held = F.when(new, n.cast("long")).otherwise(acc["held"] + n)
        return F.struct(w.alias("w"), held.alias("held"), F.array_append(acc["out"], w).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def page_windows(runs: DataFrame, group: list[str], limit: int, overhead: int = 20) -> DataFrame:
    """group, window, first_page, last_page, pages, weight: pages (page_no,
    size) packed in order. A group must be a file or less, so its list of page
    numbers and sizes, not their texts, is what one task folds."""
    listed = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("page_no", (F.col("size") + overhead).alias("n")))).alias("p"))
    placed = listed.select(*group, F.explode(F.arrays_zip(F.col("p.page_no").alias("page_no"), F.col("p.n").alias("n"), pack(F.col("p.n"), limit).alias("window"))).alias("z")).select(*group, "z.*")
    return placed.groupBy(*group, "window").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("weight"))


def chapter_chunks(skeleton: DataFrame, pages: DataFrame, *, limit: int = 11_000, least: int = 200) -> DataFrame:
    """chunk_id, node_id, section_id, file_id, page_start, page_end, pages, chars, text.

    Pages belong to the first chapter that claims them. A chapter whose pages,
    each under its label and joined by an empty line, fit the limit is one
    chunk; else its sections are, and sections that do not fit and pages of no
    section are packed in windows of consecutive pages. Chunks under `least`
    characters are dropped. Only page numbers and sizes are shuffled until the
    chunks are settled; texts are joined last.
    """
    keys = page_keys(pages).filter("size > 0")
    owners = page_owners(chapters_of(skeleton), keys)
    label = F.concat(F.lit("【"), F.coalesce("page_label", F.lit("")), F.lit("】\n"))
    texts = pages.filter("length(text) > 0").select("file_id", "page_no", F.concat(label, "text").alias("body")).groupBy("file_id", "page_no").agg(F.max("body").alias("body"))
    joined = texts.select("file_id", "page_no", F.length("body").alias("n"))
    sized = owners.join(joined, ["file_id", "page_no"]).join(section_owners(skeleton, owners), ["file_id", "page_no", "node_id"], "left")
    chapter = Window.partitionBy("file_id", "node_id")
    section = Window.partitionBy("file_id", "node_id", "section_id")
    fits = lambda w: F.sum("n").over(w) + 2 * F.count(F.lit(1)).over(w) - 2 <= limit
    grain = F.when(fits(chapter), "chapter").when(F.col("section_id").isNotNull() & fits(section), "section").otherwise("window")
    graded = sized.withColumn("grain", grain).withColumn("section_id", F.when(F.col("grain") != "chapter", F.col("section_id")))
    part = Window.partitionBy("file_id", "node_id", "section_id", "grain").orderBy("page_no")
    runs = graded.withColumn("run", F.when(F.col("grain") == "window", F.col("page_no") - F.row_number().over(part)).otherwise(0))
    group = ["file_id", "node_id", "section_id", "grain", "run"]
    listed = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("page_no", (F.col("size") + 20).alias("n")))).alias("p"))
    window = F.when(F.col("grain") == "window", pack(F.col("p.n"), limit)).otherwise(F.transform("p", lambda _: F.lit(0)))
    placed = listed.select(*group, F.explode(F.arrays_zip(F.col("p.page_no").alias("page_no"), window.alias("window"))).alias("z")).select(*group, "z.*")
    whole = placed.join(texts, ["file_id", "page_no"]).groupBy(*group, "window").agg(F.array_sort(F.collect_list(F.struct("page_no", "body"))).alias("p"))
    out = whole.select("file_id", "node_id", "section_id", F.array_min("p.page_no").alias("page_start"), F.array_max("p.page_no").alias("page_end"), F.size("p").alias("pages"), F.array_join("p.body", "\n\n").alias("text")).withColumn("chars", F.length("text")).filter(F.col("chars") >= least)
    base = F.concat(file_tag_of(F.col("file_id")), F.lit("::p"), "page_start", F.lit("-"), "page_end")
    same = F.count(F.lit(1)).over(Window.partitionBy(base))
    return out.withColumn("chunk_id", F.when(same > 1, F.concat(base, F.lit("::h"), F.left(F.md5("text"), F.lit(4)))).otherwise(base))


def sequential_chunks(pages: DataFrame, *, limit: int = 12_000, least: int = 250) -> DataFrame:
    """chunk_id, file_id, chapter, section, page_start, page_end, pages, chars, text:
    the pages of each file in order, cut where a chapter of another title
    begins or the next page would exceed the limit. For files without chapters.

    A chapter title carries on until the next one; the section is the last one
    named in the chunk. Blank pages are left out; chunks whose pages have less
    than `least` characters are dropped; an oversized page stands alone. What
    one task folds is the list of a file's page numbers, sizes and titles.
    """
    from tracebook.operators.titles import begins_chapter, detected_section

    texts = pages.filter("file_id is not null and page_no is not null").select("file_id", "page_no", "page_label", F.trim("text").alias("body")).filter("length(body) > 0").groupBy("file_id", "page_no").agg(F.max(F.struct("body", "page_label")).alias("x")).select("file_id", "page_no", "x.*")
    named = texts.select("file_id", "page_no", F.length("body").alias("n"), detected_section(F.col("body")).alias("t"))
    opens = F.coalesce(begins_chapter(F.col("t")), F.lit(False))
    listed = named.select("file_id", F.struct("page_no", F.col("n").cast("long").alias("n"), F.when(opens, F.col("t")).alias("chapter"), F.when(~opens, F.col("t")).alias("section")).alias("p")).groupBy("file_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    out = "array<struct<page_no:int,w:int,chapter:string,section:string>>"
    start = F.struct(F.lit(-1).alias("w"), F.lit(0).cast("long").alias("held"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"), F.array().cast(out).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        other = p["chapter"].isNotNull() & ~p["chapter"].eqNullSafe(acc["chapter"])
        new = (acc["w"] < 0) | other | (acc["held"] + p["n"] > limit)
        w = F.when(new, acc["w"] + 1).otherwise(acc["w"])
        chapter = F.coalesce(p["chapter"], acc["chapter"])
        section = F.when(new, p["section"]).otherwise(F.coalesce(p["section"], acc["section"]))
        row = F.struct(p["page_no"].alias("page_no"), w.alias("w"), chapter.alias("chapter"), section.alias("section"))
        return F.struct(w.alias("w"), F.when(new, p["n"]).otherwise(acc["held"] + p["n"]).alias("held"), chapter.alias("chapter"), section.alias("section"), F.array_append(acc["out"], row).alias("out"))

    placed = listed.select("file_id", F.explode(F.aggregate("ps", start, step, lambda acc: acc["out"])).alias("z")).select("file_id", "z.*")
    label = F.concat(F.lit("【"), F.coalesce("page_label", F.lit("")), F.lit("】\n"), "body")
    whole = placed.join(texts, ["file_id", "page_no"]).groupBy("file_id", "w").agg(F.array_sort(F.collect_list(F.struct("page_no", "chapter", "section", label.alias("text"), F.length("body").alias("n")))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    kept = whole.filter(size >= least)
    done = kept.select("file_id", F.col("p")[0]["chapter"].alias("chapter"), F.element_at("p", -1)["section"].alias("section"), F.array_min("p.page_no").alias("page_start"), F.array_max("p.page_no").alias("page_end"), F.size("p").alias("pages"), F.array_join("p.text", "\n\n").alias("text")).withColumn("chars", F.length("text"))
    return done.withColumn("chunk_id", F.concat(file_tag_of(F.col("file_id")), F.lit("::p"), "page_start", F.lit("-"), "page_end"))


def files_without_chapters(pages: DataFrame, skeleton: DataFrame, skipped: tuple[str, ...] = ("docx", "chat_network")) -> DataFrame:
    """The pages of files that no chapter of the skeleton is in, but for kinds
    that are never cut in chunks."""
    kept = pages.filter(~F.coalesce("source_kind", F.lit("")).isin(*skipped))
    return kept.join(skeleton.select("source_file").filter("source_file is not null").distinct(), "source_file", "left_anti")


def skeleton_totals(skeleton: DataFrame) -> DataFrame:
    """course, chapters, sections, matter, appendices."""
    rows = skeleton.select("course", "node_id", "kind", F.size(F.coalesce("sections", F.array().cast(skeleton.schema["sections"].dataType))).alias("n")).distinct()
    kind = F.coalesce("kind", F.lit("body"))
    return rows.groupBy("course").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("sections"), F.count_if(kind == "matter").alias("matter"), F.count_if(kind == "appendix").alias("appendices"))


def skipped_matter(skeleton: DataFrame, keys: DataFrame) -> DataFrame:
    """course, pages, chars: what front and back matter keeps from being read;
    pages that a chapter of another kind claims as well are not counted."""
    claims = lambda rows: expand_ranges(rows.select("source_file", "page_start", "page_end").filter("page_start <= page_end").distinct(), keys).select("file_id", "page_no").distinct()
    matter = F.coalesce("kind", F.lit("")) == "matter"
    skipped = claims(skeleton.filter(matter)).join(claims(skeleton.filter(~matter)), ["file_id", "page_no"], "left_anti")
    return keys.join(skipped, ["file_id", "page_no"], "left_semi").groupBy("course").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("chars"))


def digit_density(skeleton: DataFrame, pages: DataFrame, kind: str = "appendix") -> DataFrame:
    """node_id, pages, chars, digits, density: how much of the chapters of a
    kind is digits, which tells tables of values from prose."""
    counted = pages.filter("length(text) > 0").groupBy("file_id", "source_file", "page_no").agg(F.max("text").alias("text"))
    sizes = counted.select("file_id", "source_file", "page_no", F.length("text").alias("size"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"))
    ranges = skeleton.filter(F.col("kind") == kind).select("node_id", "source_file", "page_start", "page_end").distinct()
    held = expand_ranges(ranges, sizes).join(sizes.select("file_id", "page_no", "digits"), ["file_id", "page_no"])
    return held.groupBy("node_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("chars"), F.sum("digits").alias("digits")).withColumn("density", F.round(F.col("digits") / F.col("chars"), 6))
