"""Problem 1: recordings and the class sessions nearest to their stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.llm.nearest_time import nearest_time_at_rest
from tracebook.operators.timetable import clock, expand_sessions
from tracebook.sources.tables import table


def session_ends(timetables: DataFrame) -> DataFrame:
    """Each session twice: its start for stamps of kind `title`, its end for `mtime`."""
    row = F.concat_ws(" ", F.date_format("session_date", "yyyy-MM-dd"), clock(F.col("start_minute")))
    ends = F.explode(F.array(F.struct(F.lit("title").alias("stamp_kind"), F.col("start_at").alias("at")), F.struct(F.lit("mtime").alias("stamp_kind"), F.col("end_at").alias("at"))))
    return expand_sessions(timetables).select("timetable_id", "course_id", (F.col("tolerance_minutes") * F.lit(60_000_000)).cast("long").alias("tol_us"), row.alias("row"), ends.alias("e")).select("timetable_id", "course_id", "tol_us", "row", "e.stamp_kind", "e.at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, session_date, session_start: one row per recording with a session.

    Recordings and sessions lie in no useful order; they stream in waves of
    ascending time through the stateful join. A recording without course,
    stamp or known kind has no session; repeated recordings count once.
    """
    recordings, timetables = (table(spark, sf_dir, t) for t in ("recordings", "timetable"))
    horizon = int(timetables.agg(F.coalesce(F.max("tolerance_minutes"), F.lit(0)).alias("m")).first()["m"])
    met, _ = nearest_time_at_rest(
        recordings, session_ends(timetables), entity=["timetable_id", "course_id", "stamp_kind"], left_id="rec_id", left_time="stamp_at", right_time="at", right_row="row", right_tolerance_us="tol_us", horizon_minutes=horizon,
    )
    there = met.filter(F.col("row").isNotNull())
    return there.select(F.col("id").cast("long").alias("rec_id"), F.split("row", " ")[0].alias("session_date"), F.split("row", " ")[1].alias("session_start")).distinct()


P1_FOUND_SQL = """
WITH t AS (
  SELECT timetable_id, semester_start, total_weeks, timezone, tolerance_minutes, slots, exceptions FROM timetable
), e AS (
  SELECT timetable_id, timezone, tolerance_minutes, i, x.course_id, x.date AS day, replace(x.start, '：', ':') AS s, replace(x."end", '：', ':') AS f, x.action
  FROM (SELECT timetable_id, timezone, tolerance_minutes, unnest(exceptions) AS x, generate_subscripts(exceptions, 1) AS i FROM t)
), ex AS (
  SELECT timetable_id, timezone, tolerance_minutes, i, course_id, day, action,
    split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT AS a, split_part(f, ':', 1)::INT * 60 + split_part(f, ':', 2)::INT AS b FROM e
), sl AS (
  SELECT timetable_id, timezone, tolerance_minutes, semester_start, total_weeks, x.course_id, x.weekday, replace(x.start, '：', ':') AS s, replace(x."end", '：', ':') AS f,
    coalesce(x.weeks, '') AS weeks, regexp_replace(translate(coalesce(x.weeks, ''), '—~，、', '--,,'), '[^0-9,-]', '', 'g') AS w
  FROM (SELECT timetable_id, timezone, tolerance_minutes, semester_start, total_weeks, unnest(slots) AS x FROM t)
), p AS (
  SELECT * EXCLUDE (w), unnest(string_split(CASE WHEN w = '' THEN '1-' || total_weeks ELSE w END, ',')) AS part FROM sl
), wk AS (
  SELECT *, unnest(range(split_part(part, '-', 1)::INT, split_part(part, '-', -1)::INT + 1)) AS k FROM p
), ss AS (
  SELECT DISTINCT timetable_id, timezone, tolerance_minutes, course_id, semester_start + ((k - 1) * 7 + weekday - 1)::INT AS day,
    split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT AS a, split_part(f, ':', 1)::INT * 60 + split_part(f, ':', 2)::INT AS b
  FROM wk WHERE k BETWEEN 1 AND total_weeks AND (NOT contains(weeks, '单') OR k % 2 = 1) AND (NOT contains(weeks, '双') OR k % 2 = 0)
), allss AS (
  SELECT timetable_id, timezone, tolerance_minutes, course_id, day, a, b FROM ss
    WHERE NOT EXISTS (FROM ex WHERE ex.timetable_id = ss.timetable_id AND ex.course_id = ss.course_id AND ex.day = ss.day AND ex.a = ss.a AND ex.action = 'cancel')
  UNION SELECT timetable_id, timezone, tolerance_minutes, course_id, day, a, b FROM ex AS y WHERE action = 'add'
    AND NOT EXISTS (FROM ex WHERE ex.timetable_id = y.timetable_id AND ex.course_id = y.course_id AND ex.day = y.day AND ex.a = y.a AND ex.action = 'cancel' AND ex.i > y.i)
), ends AS (
  SELECT timetable_id, course_id, tolerance_minutes, day, a, 'title' AS stamp_kind, timezone(timezone, day::TIMESTAMP + to_minutes(a)) AS t_at FROM allss
  UNION ALL SELECT timetable_id, course_id, tolerance_minutes, day, a, 'mtime', timezone(timezone, day::TIMESTAMP + to_minutes(b)) FROM allss
), m AS (
  SELECT r.rec_id, day, a, t_at, tolerance_minutes, abs(epoch_us(r.stamp_at) - epoch_us(t_at)) AS dist
  FROM (SELECT DISTINCT rec_id, timetable_id, course_id, stamp_kind, stamp_at FROM recordings) r JOIN ends USING (timetable_id, course_id, stamp_kind)
)
SELECT rec_id, strftime(day, '%Y-%m-%d') AS session_date, lpad((a // 60)::VARCHAR, 2, '0') || ':' || lpad((a % 60)::VARCHAR, 2, '0') AS session_start
FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY dist, t_at, day, a) AS n FROM m) WHERE n = 1 AND dist <= tolerance_minutes * 60000000
"""
