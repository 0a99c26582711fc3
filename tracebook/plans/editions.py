"""Queries on answers from claims, cards, outlines, worksheets and recordings' times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.display import course_of_path, source_name, source_place, source_type
from tracebook.functions.text import plain_form
from tracebook.operators import editions as E
from tracebook.operators import worklist as W
from tracebook.operators.recordings import recording_time
from tracebook.operators.retrieval import quotes_shown, retrieved
from tracebook.plans.evidence import ORACLE_SQL as EVIDENCE_SQL
from tracebook.plans.evidence import dedup_representative
from tracebook.plans.library import TOKENS
from tracebook.plans.sqltext import plain_form as plain_sql
from tracebook.sources.tables import table

KINDS = {"textbooks/": "textbook", "slides/": "courseware", "readers/": "reader", "handouts/": "handout"}


def retrieve_answers(spark: SparkSession, d: str) -> DataFrame:
    """item_id, kp_id, score, place: the verified claims with a verified quote
    that answer each evaluation item whose id is divisible by 100."""
    asked = table(spark, d, "eval_items").filter("item_id % 100 = 0")
    claims = table(spark, d, "kp").filter("status = 'verified'").withColumn("spoken", F.array_join(F.coalesce("numbers", F.array().cast("array<string>")), " "))
    evidence = table(spark, d, "evidence").withColumn("accepted", F.coalesce("quote_verified", F.lit(False)))
    return retrieved(asked, claims, evidence, query_id="item_id", query="text", item_id="kp_id", fields=["name", "definition", "spoken", "note"], title="name")


def claim_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return quotes_shown(table(spark, d, "evidence"), table(spark, d, "pages"))


def claim_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all claims of importance 2 or more, numbered within their course."""
    return E.cards(table(spark, d, "kp"), 2).select("course", "card_no", "kp_id", "card_type", "stars")


def claim_outline(spark: SparkSession, d: str) -> DataFrame:
    return E.outline(table(spark, d, "kp"))


def claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    return E.number_table(table(spark, d, "kp"))


def claim_order(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, chapter_order, page."""
    kp = table(spark, d, "kp").select("kp_id", "source_file", "chapter", "page_label_start").distinct()
    return E.in_skeleton_order(kp, table(spark, d, "skeleton")).select("kp_id", "chapter_order", "page")


def claim_alternates(spark: SparkSession, d: str) -> DataFrame:
    return E.alternates(dedup_representative(spark, d).select("kp_id", "keep"), table(spark, d, "kp"))


def edition_files(spark: SparkSession, d: str) -> DataFrame:
    return E.edition_manifest(table(spark, d, "kp"), table(spark, d, "pages"))


def edition_difference(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, side: claims by their own rows against those that quotes are of."""
    return E.same_claims(table(spark, d, "kp").filter("kp_id is not null"), table(spark, d, "evidence").filter("kp_id is not null"))


def unverified_worksheet(spark: SparkSession, d: str) -> DataFrame:
    """audit_id, kp_id, target, evidence_id, quote: one finding for each claim
    with quotes that are not verified, and the quote to look at."""
    bad = table(spark, d, "evidence").filter("kp_id is not null and not coalesce(quote_verified, false)").select("kp_id").distinct()
    findings = bad.select(F.concat(F.lit("AUD-"), F.left(F.sha2("kp_id", 256), F.lit(20))).alias("audit_id"), "kp_id", F.concat("kp_id", F.lit("-E2")).alias("target"))
    return W.finding_evidence(findings, table(spark, d, "evidence"))


def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """table, n: rows left once rejected claims are gone from all tables."""
    tables = {t: table(spark, d, t) for t in ("kp", "evidence")}
    left = W.cascade(tables, tables["kp"].filter("status = 'rejected'").select("kp_id"), {"kp": "kp_id", "evidence": "kp_id"})
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t, df in left.items()]
    return rows[0].union(rows[1])


def quote_anchors(spark: SparkSession, d: str) -> DataFrame:
    """evidence_id, anchor: the longest end of each quote that its page has."""
    pages = table(spark, d, "pages").filter("length(text) > 0").groupBy("source_file", "page_no").agg(F.max("text").alias("text")).select("source_file", "page_no", plain_form(F.col("text")).alias("body"))
    quotes = table(spark, d, "evidence").select("evidence_id", "source_file", "page_no", plain_form(F.col("quote")).alias("q")).distinct()
    return quotes.join(pages, ["source_file", "page_no"]).select("evidence_id", W.longest_anchor(F.col("q"), F.col("body")).alias("anchor")).filter("anchor is not null")


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """source_file, name, kind, folder, place of every file and label."""
    rows = table(spark, d, "pages").select("source_file", "page_label").filter("page_label is not null").distinct()
    return rows.select("source_file", "page_label", source_name(F.col("source_file")).alias("name"), source_type(F.col("source_file"), KINDS).alias("kind"), course_of_path(F.col("source_file")).alias("folder"), source_place(F.col("source_file"), F.col("page_label"), F.lit(None).cast("string")).alias("place"))


def recording_times(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, at, timed, basis of every recording, by its name, else its stamp."""
    semesters = table(spark, d, "timetable").groupBy("timetable_id").agg(F.max(F.struct("semester_start", "total_weeks", "timezone")).alias("t")).select("timetable_id", "t.*")
    rows = table(spark, d, "recordings").select("rec_id", "timetable_id", "name", "stamp_at").distinct().join(semesters, "timetable_id")
    made = rows.select("rec_id", recording_time(F.col("name"), F.col("stamp_at"), F.col("semester_start"), F.col("total_weeks"), F.col("timezone")).alias("r")).select("rec_id", "r.*")
    return made.select("rec_id", F.unix_micros("at").alias("at_us"), "timed", "basis").distinct()


QUERIES = {f.__name__: f for f in (retrieve_answers, claim_excerpts, claim_cards, claim_outline, claim_numbers, claim_order, claim_alternates, edition_files, edition_difference, unverified_worksheet, cascade_counts, quote_anchors, source_labels, recording_times)}
_KP = "(SELECT DISTINCT ON (kp_id) * FROM kp)"
_LABEL = "nullif(try_cast(regexp_extract(page_label_start, '([0-9]{1,9})', 1) AS INT), 0)"
_STAR = "repeat('★', greatest(1, least(5, i))) || repeat('☆', 5 - greatest(1, least(5, i)))"

ORACLE_SQL = {
    "retrieve_answers": f"""WITH k AS (SELECT DISTINCT ON (kp_id) * FROM kp WHERE status = 'verified'),
      docs AS (SELECT kp_id, {TOKENS.format("concat_ws(' ', name, definition, array_to_string(coalesce(numbers, []), ' '), note)")} AS t, {TOKENS.format("coalesce(name, '')")} AS titled FROM k),
      asked AS (SELECT item_id, unnest({TOKENS.format("text")}) AS token FROM eval_items WHERE item_id % 100 = 0), posted AS (SELECT kp_id, len(t) AS size, titled, unnest(t) AS token FROM docs), df AS (SELECT token, count(*) AS df FROM posted GROUP BY token),
      s AS (SELECT item_id, kp_id, sum(ln(1 + (SELECT count(*) FROM docs) / (1 + df)) * CASE WHEN list_contains(titled, token) THEN 3 ELSE 1 END) / greatest(max(size), 1) ** 0.25 AS raw FROM asked JOIN posted USING (token) JOIN df USING (token)
        WHERE kp_id IN (SELECT kp_id FROM evidence WHERE quote_verified AND trim(quote) <> '' AND kp_id IS NOT NULL) GROUP BY ALL)
      SELECT item_id, kp_id, round(raw, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, kp_id)::INT AS place FROM s) WHERE place <= 8""",
    "claim_excerpts": """WITH p AS (SELECT source_file, page_no, max(text) AS t FROM pages GROUP BY ALL), e AS (SELECT DISTINCT kp_id, evidence_id, source_file, page_no, quote FROM evidence WHERE kp_id IS NOT NULL AND length(quote) > 0)
      SELECT kp_id, left(string_agg(quote, chr(10) ORDER BY evidence_id, quote), 1800) AS excerpt FROM e JOIN p USING (source_file, page_no) WHERE contains(t, quote) GROUP BY kp_id""",
    "claim_cards": f"""WITH k AS (SELECT *, coalesce(importance, 3)::INT AS i FROM {_KP}) SELECT course, row_number() OVER (PARTITION BY course ORDER BY i DESC, coalesce(chapter, ''), coalesce({_LABEL}, 1000000000), kp_id)::INT AS card_no, kp_id,
      CASE WHEN len(coalesce(numbers, [])) > 0 THEN 'data' WHEN type IN ('方法', '原理') THEN 'method' ELSE 'concept' END AS card_type, {_STAR} AS stars FROM k WHERE i >= 2""",
    "claim_outline": f"SELECT course, coalesce(chapter, '') AS chapter, count(*) AS claims, count(*) FILTER (WHERE len(coalesce(numbers, [])) > 0) AS with_numbers, round(avg(coalesce(importance, 3)), 4) AS mean_importance FROM {_KP} GROUP BY 1, 2",
    "claim_numbers": "SELECT kp_id, course, name, (i - 1)::INT AS position, number FROM (SELECT kp_id, course, name, unnest(numbers) AS number, generate_subscripts(numbers, 1) AS i FROM (SELECT DISTINCT kp_id, course, name, numbers FROM kp))",
    "claim_order": f"SELECT kp_id, coalesce(o, 9999) AS chapter_order, coalesce({_LABEL}, 1000000000) AS page FROM (SELECT DISTINCT kp_id, source_file, chapter, page_label_start FROM kp) k LEFT JOIN (SELECT source_file, title AS chapter, min(ord) AS o FROM skeleton GROUP BY ALL) USING (source_file, chapter)",
    "edition_files": "SELECT source_file, claims, coalesce(digests, 0) AS digests FROM (SELECT source_file, count(DISTINCT kp_id) AS claims FROM kp GROUP BY 1) LEFT JOIN (SELECT source_file, count(DISTINCT source_sha1) AS digests FROM pages GROUP BY 1) USING (source_file)",
    "edition_difference": "WITH a AS (SELECT DISTINCT kp_id FROM kp WHERE kp_id IS NOT NULL), b AS (SELECT DISTINCT kp_id FROM evidence WHERE kp_id IS NOT NULL) SELECT kp_id, 'before' AS side FROM a ANTI JOIN b USING (kp_id) UNION ALL SELECT kp_id, 'after' FROM b ANTI JOIN a USING (kp_id)",
    "unverified_worksheet": """WITH q AS (SELECT DISTINCT evidence_id, kp_id, quote, coalesce(quote_verified, false) AS ok FROM evidence WHERE kp_id IS NOT NULL), f AS (SELECT DISTINCT kp_id FROM q WHERE NOT ok),
      o AS (SELECT kp_id, evidence_id, quote FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY ok, evidence_id, quote NULLS FIRST) AS i FROM q) WHERE i = 1), n AS (SELECT kp_id, evidence_id, min(quote) AS quote FROM q GROUP BY ALL)
      SELECT 'AUD-' || sha256(f.kp_id)[:20] AS audit_id, f.kp_id, f.kp_id || '-E2' AS target, coalesce(n.evidence_id, o.evidence_id) AS evidence_id, CASE WHEN n.evidence_id IS NULL THEN o.quote ELSE n.quote END AS quote FROM f LEFT JOIN n ON n.kp_id = f.kp_id AND n.evidence_id = f.kp_id || '-E2' LEFT JOIN o ON o.kp_id = f.kp_id""",
    "cascade_counts": "WITH g AS (SELECT kp_id FROM kp WHERE status = 'rejected' AND kp_id IS NOT NULL) SELECT 'kp' AS \"table\", count(*) AS n FROM kp WHERE kp_id IS NULL OR kp_id NOT IN (FROM g) UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE kp_id IS NULL OR kp_id NOT IN (FROM g)",
    "quote_anchors": f"""WITH p AS (SELECT source_file, page_no, {plain_sql("max(text)")} AS b FROM pages WHERE length(text) > 0 GROUP BY source_file, page_no), e AS (SELECT DISTINCT evidence_id, source_file, page_no, {plain_sql("quote")} AS q FROM evidence),
      j AS (SELECT evidence_id, coalesce({", ".join(f"CASE WHEN length(q) >= {n} AND contains(b, {cut}(q, {n})) THEN {cut}(q, {n}) END" for cut in ("left", "right") for n in (24, 16, 12))}) AS anchor FROM e JOIN p USING (source_file, page_no)) SELECT * FROM j WHERE anchor IS NOT NULL""",
    "source_labels": """SELECT DISTINCT source_file, page_label, left(trim(split_part(split_part(source_file, '/', -1), '(', 1)), 34) AS name, CASE WHEN starts_with(source_file, 'textbooks/') THEN 'textbook' WHEN starts_with(source_file, 'slides/') THEN 'courseware' WHEN starts_with(source_file, 'readers/') THEN 'reader' WHEN starts_with(source_file, 'handouts/') THEN 'handout' ELSE 'other' END AS kind,
      CASE WHEN len(string_split(source_file, '/')) >= 3 THEN split_part(source_file, '/', -2) ELSE '未分类' END AS folder, CASE WHEN lower(source_file) LIKE '%.pptx' AND regexp_matches(page_label, '[0-9]') THEN '幻灯片 ' || regexp_extract(page_label, '[0-9]+') ELSE page_label END AS place FROM pages WHERE page_label IS NOT NULL""",
}

ORACLE_SQL["claim_alternates"] = f"""WITH d AS ({EVIDENCE_SQL["dedup_representative"]}), k AS (SELECT DISTINCT ON (kp_id) * FROM kp)
  SELECT keep, string_agg(coalesce(source_file, '') || ' ' || coalesce(page_label_start, '') || ' · ' || kp_id || CASE WHEN len(coalesce(numbers, [])) > 0 THEN '（' || array_to_string(numbers[1:4], '、') || '）' ELSE '' END, '；' ORDER BY kp_id) AS note FROM d JOIN k USING (kp_id) WHERE kp_id <> keep GROUP BY keep"""
_AT = "epoch_us(timezone(timezone, {}))"
_FULL, _SHORT, _CLOCK, _RUN, _OWN = r"(20[0-9]{2})[年._/-]?([0-9]{1,2})[月._/-]?([0-9]{1,2})日?", r"([0-9]{1,2})月([0-9]{1,2})日", r"([0-9]{1,2})[点:：._时]([0-9]{2})", r"^[T_\s-]+([0-9]{2})([0-9]{2})", r"([0-9]{1,2})[点:：时]([0-9]{2})"
ORACLE_SQL["recording_times"] = f"""WITH t AS (SELECT timetable_id, max(semester_start) AS s, max(total_weeks) AS w, max(timezone) AS timezone FROM timetable GROUP BY 1), r AS (SELECT DISTINCT rec_id, name, stamp_at, s, w, timezone FROM recordings JOIN t USING (timetable_id)),
  f AS (SELECT *, regexp_extract(name, '(?:^|[^0-9]){_FULL}', 1) AS y, regexp_extract(name, '(?:^|[^0-9]){_FULL}', 2) AS m, regexp_extract(name, '(?:^|[^0-9]){_FULL}', 3) AS dd, regexp_extract(name, '{_SHORT}', 1) AS sm, regexp_extract(name, '{_SHORT}', 2) AS sd FROM r),
  g AS (SELECT *, y <> '' AS is_full, y <> '' OR sm <> '' AS dated, list_filter(list_distinct([year(s), year(s + (w * 7)::INT)]), lambda v: try_cast(v || '-' || lpad(sm, 2, '0') || '-' || lpad(sd, 2, '0') AS DATE) >= s AND try_cast(v || '-' || lpad(sm, 2, '0') || '-' || lpad(sd, 2, '0') AS DATE) < s + (w * 7)::INT) AS ys FROM f),
  h AS (SELECT *, CASE WHEN is_full THEN try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) WHEN dated AND len(ys) = 1 THEN try_cast(ys[1] || '-' || lpad(sm, 2, '0') || '-' || lpad(sd, 2, '0') AS DATE) END AS day,
    CASE WHEN is_full THEN regexp_replace(name, '^.*?{_FULL}', '') WHEN dated THEN regexp_replace(name, '^.*?{_SHORT}', '') ELSE name END AS tail FROM g),
  c AS (SELECT *, coalesce(try_cast(regexp_extract(tail, '{_CLOCK}', 1) AS INT), try_cast(regexp_extract(tail, '{_RUN}', 1) AS INT)) AS hh, coalesce(try_cast(regexp_extract(tail, '{_CLOCK}', 2) AS INT), try_cast(regexp_extract(tail, '{_RUN}', 2) AS INT)) AS mi, try_cast(regexp_extract(name, '{_OWN}', 1) AS INT) AS oh, try_cast(regexp_extract(name, '{_OWN}', 2) AS INT) AS om FROM h),
  e AS (SELECT *, CASE WHEN hh IS NULL THEN 12 WHEN regexp_matches(tail, '(?i)下午|晚上|午后|\bPM\b') AND hh < 12 THEN hh + 12 WHEN regexp_matches(tail, '(?i)上午|凌晨|\bAM\b') AND hh = 12 THEN 0 ELSE hh END AS h2 FROM c),
  n AS (SELECT *, CASE WHEN h2 < 24 AND coalesce(mi, 0) < 60 THEN {_AT.format("day::TIMESTAMP + to_minutes(h2 * 60 + coalesce(mi, 0))")} END AS named, CASE WHEN oh IS NULL THEN epoch_us(stamp_at) WHEN oh < 24 AND om < 60 THEN {_AT.format("date_trunc('day', timezone(timezone, timezone('UTC', stamp_at::TIMESTAMP))) + to_minutes(oh * 60 + om)")} END AS filed FROM e)
  SELECT DISTINCT rec_id, CASE WHEN dated THEN named WHEN stamp_at IS NOT NULL THEN filed END AS at_us, CASE WHEN dated THEN hh IS NOT NULL AND named IS NOT NULL ELSE filed IS NOT NULL AND stamp_at IS NOT NULL END AS timed,
    CASE WHEN dated AND NOT is_full AND len(ys) <> 1 THEN 'ambiguous' WHEN dated AND named IS NULL THEN 'invalid' WHEN dated AND hh IS NOT NULL THEN 'name' WHEN dated THEN 'name_date' WHEN stamp_at IS NULL THEN 'none' WHEN oh IS NOT NULL AND filed IS NULL THEN 'invalid' WHEN oh IS NOT NULL THEN 'name_time' ELSE 'modified' END AS basis FROM n"""
