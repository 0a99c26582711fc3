"""Printed page numbers from offsets and anchors, and references in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebook.operators.pages import interpolate

#: The order in which offsets count: of the file before the course, set by hand before found.
OFFSET_ORDER = {("file", "manual"): 0, ("file", "auto"): 1, ("course", "manual"): 2, ("course", "auto"): 3}


def effective_offsets(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """file_id, offset, scope, source: the offset that counts for each file.
    files: file_id, course. offsets: scope (file or course), name, source
    (manual or auto), offset."""
    rank = F.lit(None).cast("int")
    for (scope, source), n in OFFSET_ORDER.items():
        rank = F.when((F.col("scope") == scope) & (F.col("source") == source), n).otherwise(rank)
    known = offsets.filter("offset is not null").select("scope", "name", "source", "offset", rank.alias("_rank")).filter("_rank is not null")
    of_file = files.join(known.filter("scope = 'file'"), files["file_id"] == F.col("name")).select("file_id", "_rank", "offset", "scope", "source")
    of_course = files.join(known.filter("scope = 'course'"), files["course"] == F.col("name")).select("file_id", "_rank", "offset", "scope", "source")
    return of_file.union(of_course).groupBy("file_id").agg(F.min(F.struct("_rank", "offset", "scope", "source")).alias("b")).select("file_id", "b.offset", "b.scope", "b.source")


def printed_numbers(keys: DataFrame, offsets: DataFrame, anchors: DataFrame) -> DataFrame:
    """file_id, page_no, printed, extrapolated of the pages that a rule covers:
    two or more anchors (file_id, index, printed) of their file, else its
    offset (file_id, offset). Without a rule a page is left out."""
    pages = keys.select("file_id", "page_no").distinct()
    by_anchor = interpolate(pages, anchors.select("file_id", "index", "printed").distinct())
    by_offset = pages.join(by_anchor, ["file_id", "page_no"], "left_anti").join(offsets.select("file_id", "offset"), "file_id")
    return by_anchor.union(by_offset.select("file_id", "page_no", (F.col("page_no") + F.col("offset")).alias("printed"), F.lit(False)))


def page_reference(page_no: Column, label: Column, printed: Column, extrapolated: Column) -> Column:
    """A reference that never passes off the place in a file as a printed page:
    `书p294（PDF p311）`, `书p≈18（PDF 第10节，推算）`, or without a rule `PDF p8`."""
    place = F.coalesce(F.when(label != "", label), F.concat(F.lit("p"), page_no.cast("string")), F.lit("?"))
    guess = F.coalesce(extrapolated, F.lit(False))
    written = F.concat(F.when(guess, "书p≈").otherwise("书p"), printed.cast("string"), F.lit("（PDF "), place, F.when(guess, "，推算）").otherwise("）"))
    return F.when(printed.isNull(), F.concat(F.lit("PDF "), place)).otherwise(written)


def merged_offsets(kept: DataFrame, found: DataFrame) -> DataFrame:
    """scope, name, source, offset: found offsets put beside the ones on file.
    What was set by hand is never replaced; found ones replace found ones."""
    key = ["scope", "name"]
    columns = [*key, "source", "offset"]
    by_hand = kept.filter("source = 'manual'").select(*columns)
    new = found.join(by_hand, key, "left_anti").select(*columns)
    old = kept.filter("coalesce(source, '') <> 'manual'").join(new, key, "left_anti").select(*columns)
    return by_hand.union(new).union(old)
