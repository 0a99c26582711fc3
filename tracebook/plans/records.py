"""Queries on timetables, recordings and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracebook.operators.recordings import name_time
from tracebook.operators.timetable import clock, expand_sessions
from tracebook.sources.tables import table
from tracebook.streaming.ledger import windowed_counts


def weekly_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session of every timetable, local date and time."""
    s = expand_sessions(table(spark, d, "timetable"))
    return s.select("timetable_id", "course_id", F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), clock(F.col("start_minute")).alias("starts"), clock(F.col("end_minute")).alias("ends"))


def session_match(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, n_courses, status of each recording by its stamp: matched if the
    sessions of its timetable that it falls in (tolerance before, end and
    tolerance after left open) are of its own course only, conflict if of
    others, unmatched if of none. The join is on timetable and day."""
    s = expand_sessions(table(spark, d, "timetable")).select("timetable_id", F.col("course_id").alias("of"), (F.unix_seconds("start_at") - F.col("tolerance_minutes") * 60).alias("a"), (F.unix_seconds("end_at") + F.col("tolerance_minutes") * 60).alias("b"))
    day = 86_400
    s = s.withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / day), F.floor(F.col("b") / day))))
    r = table(spark, d, "recordings").select("rec_id", "timetable_id", "course_id", F.unix_micros("stamp_at").alias("us")).filter("us is not null").distinct().withColumn("day", F.floor(F.col("us") / (day * 1_000_000)))
    met = r.join(s, ["timetable_id", "day"], "left").withColumn("hit", (F.col("us") >= F.col("a") * 1_000_000) & (F.col("us") < F.col("b") * 1_000_000))
    own = F.bool_and(F.when(F.col("hit"), F.col("of").eqNullSafe(F.col("course_id"))))
    n = F.count_distinct(F.when(F.col("hit"), F.col("of")))
    return met.groupBy("rec_id").agg(n.alias("n_courses"), F.when(n == 0, "unmatched").when(own, "matched").otherwise("conflict").alias("status"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind: the streaming operator over the table at rest."""
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "10 minutes")


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """user_id, run, started, ended, n, errors: a user's events without a pause of over an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > 3_600_000_000).cast("int"), F.lit(1))
    runs = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.col("ts").cast("timestamp").alias("at")).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("user_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """event_type, n, keys, mean_k from the JSON properties."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("keys"), F.round(F.avg("k"), 6).alias("mean_k"))


def recording_name_times(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, named_day, named_at of the recordings whose name tells a date."""
    r = table(spark, d, "recordings").select("rec_id", name_time(F.col("name")).alias("t")).filter("t.day is not null").distinct()
    return r.select("rec_id", F.date_format("t.day", "yyyy-MM-dd").alias("named_day"), clock(F.col("t.minute")).alias("named_at"))


QUERIES = {f.__name__: f for f in (recording_name_times, weekly_sessions, session_match, event_windows, event_runs, event_properties)}

_SESSIONS = """
ex AS (SELECT timetable_id, tolerance_minutes, timezone, i, x.course_id AS c, x.date AS day, replace(x.start, '：', ':') AS s, replace(x."end", '：', ':') AS e, x.action AS act FROM (SELECT timetable_id, tolerance_minutes, timezone, unnest(exceptions) AS x, generate_subscripts(exceptions, 1) AS i FROM timetable)),
exm AS (SELECT *, split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT AS a, split_part(e, ':', 1)::INT * 60 + split_part(e, ':', 2)::INT AS b FROM ex),
sl AS (SELECT t.*, x.course_id AS c, x.weekday AS wd, replace(x.start, '：', ':') AS s, replace(x."end", '：', ':') AS e, coalesce(x.weeks, '') AS w FROM (SELECT timetable_id, tolerance_minutes, timezone, semester_start, total_weeks, unnest(slots) AS x FROM timetable) t),
wk AS (SELECT DISTINCT timetable_id, tolerance_minutes, timezone, c, semester_start + ((k - 1) * 7 + wd - 1)::INT AS day, split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT AS a, split_part(e, ':', 1)::INT * 60 + split_part(e, ':', 2)::INT AS b
  FROM (SELECT *, unnest(range(split_part(p, '-', 1)::INT, split_part(p, '-', -1)::INT + 1)) AS k FROM (SELECT *, unnest(string_split(CASE WHEN w = '' THEN '1-' || total_weeks ELSE regexp_replace(translate(w, '—~，、', '--,,'), '[^0-9,-]', '', 'g') END, ',')) AS p FROM sl))
  WHERE k BETWEEN 1 AND total_weeks AND (NOT contains(w, '单') OR k % 2 = 1) AND (NOT contains(w, '双') OR k % 2 = 0)),
ses AS (SELECT * FROM wk WHERE NOT EXISTS (FROM exm WHERE exm.timetable_id = wk.timetable_id AND exm.c = wk.c AND exm.day = wk.day AND exm.a = wk.a AND act = 'cancel')
  UNION SELECT timetable_id, tolerance_minutes, timezone, c, day, a, b FROM exm AS y WHERE act = 'add' AND NOT EXISTS (FROM exm WHERE exm.timetable_id = y.timetable_id AND exm.c = y.c AND exm.day = y.day AND exm.a = y.a AND act = 'cancel' AND exm.i > y.i))
"""
_HM = "lpad(({0} // 60)::VARCHAR, 2, '0') || ':' || lpad(({0} % 60)::VARCHAR, 2, '0')"

_DATE = r"(20[0-9]{2})\s*[-._年/]?\s*(1[0-2]|0?[1-9])\s*[-._月/]?\s*([12][0-9]|3[01]|0?[1-9])"
_TIME = _DATE + r"日?[\s_T]*(2[0-3]|[01]?[0-9])\s*[-.:：点时h]?\s*([0-5][0-9])"
ORACLE_SQL = {
    "recording_name_times": f"""WITH r AS (SELECT DISTINCT rec_id, name, try_cast(regexp_extract(name, '{_DATE}', 1) || '-' || lpad(regexp_extract(name, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(name, '{_DATE}', 3), 2, '0') AS DATE) AS d FROM recordings)
      SELECT DISTINCT rec_id, strftime(d, '%Y-%m-%d') AS named_day, CASE WHEN regexp_extract(name, '{_TIME}', 4) <> '' THEN lpad(regexp_extract(name, '{_TIME}', 4), 2, '0') || ':' || regexp_extract(name, '{_TIME}', 5) END AS named_at FROM r WHERE d IS NOT NULL""",
    "weekly_sessions": f"WITH {_SESSIONS} SELECT timetable_id, c AS course_id, strftime(day, '%Y-%m-%d') AS session_date, {_HM.format('a')} AS starts, {_HM.format('b')} AS ends FROM ses",
    "session_match": f"""WITH {_SESSIONS}, t AS (SELECT timetable_id, c, epoch_us(timezone(timezone, day::TIMESTAMP + to_minutes(a))) - tolerance_minutes * 60000000 AS lo, epoch_us(timezone(timezone, day::TIMESTAMP + to_minutes(b))) + tolerance_minutes * 60000000 AS hi FROM ses),
      r AS (SELECT DISTINCT rec_id, timetable_id, course_id, epoch_us(stamp_at) AS us FROM recordings WHERE stamp_at IS NOT NULL)
      SELECT rec_id, count(DISTINCT c) AS n_courses, CASE WHEN count(c) = 0 THEN 'unmatched' WHEN bool_and(c IS NOT DISTINCT FROM course_id) THEN 'matched' ELSE 'conflict' END AS status FROM r LEFT JOIN t ON r.timetable_id = t.timetable_id AND us >= lo AND us < hi GROUP BY rec_id""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_runs": """WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
      SELECT user_id, run::BIGINT AS run, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM r GROUP BY user_id, run""",
    "event_properties": "SELECT event_type, count(*) AS n, count(k) AS keys, round(avg(k), 6) AS mean_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type",
}
