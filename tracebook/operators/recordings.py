"""Dates and times in the names of recordings, and page selections in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"(20\d{2})\s*[-._年/]?\s*(1[0-2]|0?[1-9])\s*[-._月/]?\s*([12]\d|3[01]|0?[1-9])"
TIME = DATE + r"日?[\s_T]*(2[0-3]|[01]?\d)\s*[-.:：点时h]?\s*([0-5]\d)"


def name_time(name: Column) -> Column:
    """struct(day, minute): the date in a file's name and the time right after
    it; minute is null where there is none, day where the date does not exist."""
    part = lambda p, i: F.regexp_extract(name, p, i)
    written = F.concat_ws("-", part(DATE, 1), F.lpad(part(DATE, 2), 2, "0"), F.lpad(part(DATE, 3), 2, "0"))
    day = F.when(part(DATE, 1) != "", F.try_to_date(written))
    minute = F.when(day.isNotNull() & (part(TIME, 4) != ""), part(TIME, 4).cast("int") * 60 + part(TIME, 5).cast("int"))
    return F.struct(day.alias("day"), minute.alias("minute"))


FULL_DATE = r"(?<!\d)(20\d{2})[年._/-]?(\d{1,2})[月._/-]?(\d{1,2})日?"
SHORT_DATE = r"(\d{1,2})月(\d{1,2})日"
CLOCK = r"(\d{1,2})[点:：._时](\d{2})"
RUN_ON_CLOCK = r"^[T_\s-]+(\d{2})(\d{2})"


def recording_time(name: Column, modified: Column, semester_start: Column, total_weeks: Column, timezone: Column) -> Column:
    """struct(at, timed, basis): when a recording was made, by its name, else by
    the time its file was changed.

    A date without a year is the one that lies in the semester, if that is one.
    The time of day is what follows the date, in the afternoon if the name says
    so; without one it is noon, and timed is false. A name with a date or time
    that does not exist gives null (basis `invalid`), one without a year that
    fits no or two days of the semester as well (`ambiguous`). basis: name,
    name_date, name_time (the time of the name on the day of the file),
    modified, none, invalid, ambiguous.
    """
    part = lambda p, i, x=name: F.regexp_extract(x, p, i)
    full, short = part(FULL_DATE, 1) != "", part(SHORT_DATE, 1) != ""
    date_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    end = F.date_add(semester_start, total_weeks * 7)
    years = F.array_distinct(F.array(F.year(semester_start), F.year(end)))
    options = F.filter(F.transform(years, lambda y: date_of(y.cast("string"), part(SHORT_DATE, 1), part(SHORT_DATE, 2))), lambda x: (x >= semester_start) & (x < end))
    day = F.when(full, date_of(part(FULL_DATE, 1), part(FULL_DATE, 2), part(FULL_DATE, 3))).when(short & (F.size(options) == 1), F.get(options, F.lit(0)))
    found = F.when(full, part(FULL_DATE, 0)).otherwise(part(SHORT_DATE, 0))
    tail = F.when(full | short, F.substring(name, F.position(found, name) + F.length(found), F.length(name))).otherwise(name)
    clock = lambda p, i: F.regexp_extract(tail, p, i)
    hour = F.coalesce(*(F.when(clock(p, 1) != "", clock(p, 1).cast("int")) for p in (CLOCK, RUN_ON_CLOCK)))
    minute = F.coalesce(*(F.when(clock(p, 1) != "", clock(p, 2).cast("int")) for p in (CLOCK, RUN_ON_CLOCK)))
    late, early = tail.rlike(r"(?i)下午|晚上|午后|\bPM\b") & (hour < 12), tail.rlike(r"(?i)上午|凌晨|\bAM\b") & (hour == 12)
    timed = hour.isNotNull()
    of_day = F.when(~timed, 12).when(late, hour + 12).when(early, 0).otherwise(hour)
    local = lambda d, h, m: F.when((h < 24) & (m < 60), F.make_timestamp(F.year(d), F.month(d), F.day(d), h, m, F.lit(0), timezone))
    named = local(day, of_day, F.coalesce(minute, F.lit(0)))
    file_day = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(modified, F.current_timezone()), timezone))
    own_hour, own_minute = (F.when(part(r"(\d{1,2})[点:：时](\d{2})", 1) != "", part(r"(\d{1,2})[点:：时](\d{2})", i).cast("int")) for i in (1, 2))
    by_file = F.when(own_hour.isNotNull(), local(file_day, own_hour, own_minute)).otherwise(modified)
    dated = full | short
    at = F.when(dated, named).when(modified.isNotNull(), by_file)
    basis = F.when(dated & (~full) & (F.size(options) != 1), "ambiguous").when(dated & named.isNull(), "invalid").when(dated & timed, "name").when(dated, "name_date")
    basis = basis.when(modified.isNull(), "none").when(own_hour.isNotNull() & by_file.isNull(), "invalid").when(own_hour.isNotNull(), "name_time").otherwise("modified")
    return F.struct(at.alias("at"), F.when(dated, timed & named.isNotNull()).otherwise(by_file.isNotNull() & modified.isNotNull()).alias("timed"), basis.alias("basis"))


def recording_verdict(by_name: Column, by_time: Column, basis: Column) -> Column:
    """matched, review, conflict or unmatched, of the courses that a recording's
    name tells (array) and those whose session it falls in (array). Times of
    the file alone are only for review; several courses, or two that differ,
    are a conflict."""
    none = F.array().cast("array<string>")
    n, t = F.array_distinct(F.coalesce(by_name, none)), F.array_distinct(F.coalesce(by_time, none))
    both = F.array_union(n, t)
    sure = (F.size(n) == 1) | basis.isin("name", "name_time")
    return F.when(F.size(both) == 0, "unmatched").when(F.size(both) > 1, "conflict").when(sure & (basis != "modified"), "matched").otherwise("review")


def page_selection(text: Column, last: Column | int = 2**31 - 1) -> Column:
    """Ascending page numbers of a selection such as `5,20,1-10`, cut to the
    `last` page there is; parts that are neither a number nor a range are left
    out. Give `last` where the text is not your own: an open range is as long
    as it says."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), "[,，、]"), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    end = F.lit(last) if isinstance(last, int) else last

    def pages(p: Column) -> Column:
        a, b = F.element_at(F.split(p, "-"), 1).cast("int"), F.least(F.element_at(F.split(p, "-"), -1).cast("int"), end)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
