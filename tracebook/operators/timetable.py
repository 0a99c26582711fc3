"""Timetables: weekly slots and dated exceptions expanded to sessions.

Everything here is stateless and stays inside one row (array functions), so
the same code serves batch and streaming frames and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The dashes and commas found in lists of week numbers.
DASHES = "‐‑‒–—―−~～〜－至"
COMMAS = "，、;；"


def minutes_of_day(text: Column) -> Column:
    """Minutes since midnight of `8:05`, `08:05` or `08：05`; null if it is no time of day."""
    parts = F.regexp_extract(F.trim(text), r"^(\d{1,2})\s*[:：]\s*(\d{1,2})$", 1), F.regexp_extract(F.trim(text), r"^(\d{1,2})\s*[:：]\s*(\d{1,2})$", 2)
    hour, minute = (F.when(p != "", p.cast("int")) for p in parts)
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def week_numbers(weeks: Column, total: Column) -> Column:
    """Ascending week numbers within 1..total. Null or blank text means every
    week, 单 keeps the odd ones and 双 the even ones; parts that are neither a
    number nor a range are left out."""
    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    plain = F.translate(weeks, DASHES + COMMAS, "-" * len(DASHES) + "," * len(COMMAS))
    plain = F.regexp_replace(plain, r"[^0-9,\-]", "")
    parts = F.filter(F.split(plain, ","), lambda p: p.rlike(r"^\d{1,4}(-\d{1,4})?$"))

    def expand(part: Column) -> Column:
        low = F.element_at(F.split(part, "-"), 1).cast("int")
        high = F.element_at(F.split(part, "-"), -1).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    listed = F.filter(F.flatten(F.transform(parts, expand)), lambda w: (w >= 1) & (w <= total))
    named = F.when(weeks.isNull() | (F.trim(weeks) == ""), every).otherwise(listed)
    odd = F.coalesce(weeks.contains("单"), F.lit(False))
    even = F.coalesce(weeks.contains("双"), F.lit(False))
    kept = F.filter(named, lambda w: F.when(odd, w % 2 == 1).when(even, w % 2 == 0).otherwise(True))
    return F.array_sort(F.array_distinct(kept))


def expand_sessions(timetables: DataFrame) -> DataFrame:
    """One row per session: timetable_id, tolerance_minutes, timezone,
    course_id, session_date, start_minute, end_minute, start_at, end_at.

    Slots come first, then the exceptions in array order: `cancel` takes away
    the course's sessions of that date and start that are there so far, `add`
    (also a missing action) puts one in. Repeated slots count once. Sessions
    with an unreadable time, no course or no date are left out; an end before
    the start is taken as of the next day; a missing timezone as UTC.
    """
    none = F.array().cast("array<struct<course_id:string,session_date:date,start_minute:int,end_minute:int>>")
    exceptions = F.transform(
        F.coalesce("exceptions", F.array().cast(timetables.schema["exceptions"].dataType)),
        lambda e, i: F.struct(
            i.alias("i"), e["course_id"].alias("course_id"), e["date"].alias("session_date"), minutes_of_day(e["start"]).alias("start_minute"), minutes_of_day(e["end"]).alias("end_minute"), F.coalesce(F.lower(F.trim(e["action"])), F.lit("add")).alias("action")
        ),
    )

    def session(course: Column, day: Column, start: Column, end: Column) -> Column:
        return F.struct(course.alias("course_id"), day.alias("session_date"), start.alias("start_minute"), end.alias("end_minute"))

    def of_slot(s: Column) -> Column:
        weeks = week_numbers(s["weeks"], F.col("total_weeks"))
        return F.transform(weeks, lambda w: session(s["course_id"], F.date_add(F.col("semester_start"), (w - 1) * 7 + s["weekday"] - 1), minutes_of_day(s["start"]), minutes_of_day(s["end"])))

    def cancelled(x: Column, after: Column) -> Column:
        return F.exists(
            F.col("_ex"), lambda e: (e["action"] == "cancel") & (e["i"] > after) & e["course_id"].eqNullSafe(x["course_id"]) & e["session_date"].eqNullSafe(x["session_date"]) & e["start_minute"].eqNullSafe(x["start_minute"])
        )

    slots = F.flatten(F.transform(F.filter("slots", lambda s: s["weekday"].between(1, 7)), of_slot))
    staged = timetables.withColumn("_ex", exceptions).withColumn("_slots", F.array_distinct(F.coalesce(slots, none)))
    kept = F.filter("_slots", lambda x: ~cancelled(x, F.lit(-1)))
    added = F.transform(F.filter("_ex", lambda e: (e["action"] == "add") & ~cancelled(e, e["i"])), lambda e: session(e["course_id"], e["session_date"], e["start_minute"], e["end_minute"]))
    one = staged.select("timetable_id", "tolerance_minutes", F.coalesce("timezone", F.lit("UTC")).alias("timezone"), F.explode(F.array_distinct(F.concat(kept, added))).alias("s")).select("timetable_id", "tolerance_minutes", "timezone", "s.*")

    def instant(day: Column, minute: Column) -> Column:
        return F.make_timestamp(F.year(day), F.month(day), F.day(day), F.floor(minute / 60).cast("int"), (minute % 60).cast("int"), F.lit(0), F.col("timezone"))

    complete = F.col("course_id").isNotNull() & F.col("session_date").isNotNull() & F.col("start_minute").isNotNull() & F.col("end_minute").isNotNull()
    end_day = F.when(F.col("end_minute") < F.col("start_minute"), F.date_add("session_date", 1)).otherwise(F.col("session_date"))
    return one.filter(complete).withColumns({"start_at": instant(F.col("session_date"), F.col("start_minute")), "end_at": instant(end_day, F.col("end_minute"))})


def clock(minute: Column) -> Column:
    """`HH:MM` of minutes since midnight; null for null."""
    return F.when(minute.isNotNull(), F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int")))
