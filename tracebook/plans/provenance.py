"""Queries on where text comes from: chunks and pages behind quotes, printed pages, skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.text import first_number, plain_form
from tracebook.operators import pages as P
from tracebook.operators import printed as R
from tracebook.operators import provenance as V
from tracebook.operators import skeleton as S
from tracebook.operators import titles as T
from tracebook.operators.courses import resolve_course
from tracebook.plans.pages import ORACLE_SQL as PAGES_SQL
from tracebook.plans.pages import VOTES
from tracebook.plans.sqltext import COURSE_NAMES, KEYS, MATTER_SQL, tier_sql
from tracebook.plans.sqltext import plain_form as plain_sql
from tracebook.sources.tables import table


def quote_recheck(spark: SparkSession, d: str) -> DataFrame:
    """evidence_id, before, tier, found_by, n_bodies: every quote on the chunk
    its key names. A chunk is a page here: course, hash in the file's id, page."""
    pages = resolve_course(table(spark, d, "pages").filter("length(text) > 0"), table(spark, d, "courses"), ["course"], "course_id")
    tag = F.element_at(F.split("file_id", "__"), -1)
    chunks = pages.select(F.col("course_id").alias("course"), tag.alias("tag"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "text").distinct()
    return V.rechecked(table(spark, d, "evidence"), chunks, chunks.select("course", F.col("page_start").alias("page_no"), "text"), plain_form)


def quote_recheck_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.recheck_summary(quote_recheck(spark, d))


def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, course, tag, page_start, page_end, again: the parts of every chunk key, and the key made of them."""
    k = table(spark, d, "evidence").select("chunk_id").distinct().select("chunk_id", V.parsed_key(F.col("chunk_id")).alias("k")).select("chunk_id", "k.*")
    return k.withColumn("again", V.chunk_key(F.col("course"), F.col("tag"), F.col("page_start"), F.col("page_end")))


def file_offsets(spark: SparkSession, d: str) -> DataFrame:
    """file_id, offset, scope, source: found offsets of confident files, else of their course."""
    pages = table(spark, d, "pages")
    keys = P.page_keys(pages)
    votes = P.offset_votes(pages)
    found = votes.filter("confident").select(F.lit("file").alias("scope"), F.col("file_id").alias("name"), F.lit("auto").alias("source"), F.col("best_offset").alias("offset"))
    courses = P.course_offsets(votes, keys).select(F.lit("course"), "course", F.lit("auto"), "offset")
    return R.effective_offsets(keys.groupBy("file_id").agg(F.min("course").alias("course")), found.union(courses))


def page_references(spark: SparkSession, d: str) -> DataFrame:
    """file_id, page_no, reference of every page: by the anchors of its labels, else by its offset."""
    pages = table(spark, d, "pages").filter("file_id is not null and page_no is not null")
    known = R.printed_numbers(P.page_keys(pages), file_offsets(spark, d), P.label_anchors(pages))
    labels = pages.groupBy("file_id", "page_no").agg(F.min("page_label").alias("page_label"))
    return labels.join(known, ["file_id", "page_no"], "left").select("file_id", "page_no", R.page_reference(F.col("page_no"), F.col("page_label"), F.col("printed"), F.col("extrapolated")).alias("reference"))


def skeleton_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.skeleton_totals(table(spark, d, "skeleton"))


def matter_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.skipped_matter(table(spark, d, "skeleton"), P.page_keys(table(spark, d, "pages")))


def appendix_density(spark: SparkSession, d: str) -> DataFrame:
    return P.digit_density(table(spark, d, "skeleton"), table(spark, d, "pages"))


def title_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """title, kind, verdict of all titles: of chapters, sections and pages."""
    s = table(spark, d, "skeleton")
    titles = s.select("title").union(s.select(F.explode("sections.title"))).union(table(spark, d, "pages").select("section_title")).union(table(spark, d, "kp").select("chapter")).filter("title is not null").distinct()
    return titles.select("title", T.title_kind(F.col("title")).alias("kind"), T.title_verdict(F.col("title")).alias("verdict"))


def sequential_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every file in the order of its pages, without regard to chapters of the skeleton."""
    return P.sequential_chunks(table(spark, d, "pages")).select("chunk_id", "file_id", "chapter", "section", "page_start", "page_end", "pages", "chars")


def offset_runners_up(spark: SparkSession, d: str) -> DataFrame:
    return P.offset_runners_up(table(spark, d, "pages"))


def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, chars, digest: the text that each claim comes from, its pages from
    the first to the last label in order, joined by an empty line."""
    kp = table(spark, d, "kp").select("kp_id", "source_file", first_number(F.col("page_label_start")).alias("a"), first_number(F.col("page_label_end")).alias("b")).distinct()
    ranges = kp.select("kp_id", "source_file", F.least("a", "b").alias("page_start"), F.greatest("a", "b").alias("page_end"))
    texts = table(spark, d, "pages").filter("length(text) > 0").groupBy("source_file", "page_no").agg(F.max("text").alias("text"))
    keys = texts.select("source_file", "page_no", F.lit(None).cast("string").alias("file_id"), F.length("text").alias("size"))
    held = P.expand_ranges(ranges, keys).select("kp_id", "source_file", "page_no").distinct().join(texts, ["source_file", "page_no"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    return held.groupBy("kp_id").agg(whole.alias("t")).select("kp_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def reference_ledger(spark: SparkSession, d: str) -> DataFrame:
    """source_file, page_rows, live_pages, chars, kp, evidence of every file
    that any table names; live pages have text."""
    pages = table(spark, d, "pages").groupBy("source_file").agg(F.count(F.lit(1)).alias("page_rows"), F.count_distinct(F.when(F.length("text") > 0, F.col("page_no"))).alias("live_pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    of = lambda t, k, n: table(spark, d, t).groupBy("source_file").agg(F.count_distinct(k).alias(n))
    out = pages.join(of("kp", "kp_id", "kp"), "source_file", "full").join(of("evidence", "evidence_id", "evidence"), "source_file", "full")
    return out.filter("source_file is not null").fillna(0)


def consistency_findings(spark: SparkSession, d: str) -> DataFrame:
    """level, code, subject, n: FAIL for files that quotes or claims name and no
    page is of, WARN for files with text that no chapter and no claim is of,
    INFO for files with chapters of front or back matter."""
    ledger = reference_ledger(spark, d)
    s = table(spark, d, "skeleton")
    chapters = s.groupBy("source_file").agg(F.count_distinct("node_id").alias("chapters"), F.count_distinct(F.when(F.col("kind") == "matter", F.col("node_id"))).alias("matter"))
    met = ledger.join(chapters, "source_file", "left").fillna(0)
    rows = [("FAIL", "no_pages", "page_rows = 0 and kp + evidence > 0", F.col("kp") + F.col("evidence")), ("WARN", "no_chapters", "live_pages > 0 and chapters = 0", F.col("live_pages")), ("WARN", "no_claims", "live_pages > 0 and kp = 0", F.col("live_pages")), ("INFO", "matter", "matter > 0", F.col("matter"))]
    each = F.array(*(F.when(F.expr(when), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("long").alias("n"))) for level, code, when, n in rows))
    return met.select(F.col("source_file").alias("subject"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.level", "f.code", "subject", "f.n")


def built_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of all files as their pages show them."""
    return S.built_skeleton(table(spark, d, "pages"))


def skeleton_review(spark: SparkSession, d: str) -> DataFrame:
    """All chapters of the skeleton after the review by rule, no verdicts recorded."""
    chapters = table(spark, d, "skeleton").select("source_file", "num", "title", "page_start", "page_end").distinct()
    heads = table(spark, d, "pages").select("source_file", "page_no", T.head_text(F.col("text")).alias("text"))
    none = spark.createDataFrame([], "source_file string, title string, verdict string, quote string")
    return S.reviewed_skeleton(chapters, none, heads)


QUERIES = {f.__name__: f for f in (quote_recheck, quote_recheck_summary, chunk_keys, file_offsets, page_references, skeleton_totals, matter_pages, appendix_density, title_verdicts, sequential_chunks, offset_runners_up, claim_texts, reference_ledger, consistency_findings, built_skeleton, skeleton_review)}

_RECHECK = rf"""{COURSE_NAMES},
c AS (SELECT DISTINCT resolved AS course, split_part(file_id, '__', -1) AS tag, page_no AS ps, {plain_sql("text")} AS body FROM pages LEFT JOIN names ON names.k = lower(regexp_replace(course, '[ \t\r\n]+', '', 'g')) WHERE length(text) > 0),
q AS (SELECT DISTINCT evidence_id, verify_method AS before, {plain_sql("quote")} AS q, regexp_extract(chunk_id, '^(.+)::([^:]+)::p([0-9]+)$', 1) AS course, regexp_extract(chunk_id, '^(.+)::([^:]+)::p([0-9]+)$', 2) AS tag, try_cast(regexp_extract(chunk_id, '::p([0-9]+)$', 1) AS INT) AS ps FROM evidence),
x AS (SELECT evidence_id, q, body, 'key' AS found_by FROM q JOIN c USING (course, tag, ps)),
l AS (SELECT evidence_id, q, body, 'pages' FROM q JOIN c USING (course, ps) WHERE evidence_id NOT IN (SELECT evidence_id FROM x)),
j AS (SELECT evidence_id, found_by, {tier_sql("q", "body")} AS tier FROM (FROM x UNION ALL FROM l)),
b AS (SELECT evidence_id, found_by, arg_max(tier, CASE tier WHEN 'exact' THEN 3 WHEN 'partial' THEN 2 WHEN 'fabricated' THEN 1 ELSE 0 END) AS tier, count(*) AS n_bodies FROM j GROUP BY ALL),
r AS (SELECT evidence_id, before, coalesce(tier, before) AS tier, coalesce(found_by, 'unmatched') AS found_by, coalesce(n_bodies, 0) AS n_bodies FROM (SELECT DISTINCT evidence_id, before FROM q) LEFT JOIN b USING (evidence_id))"""

_CN = "[0-9零一二三四五六七八九十百]"
_T = "regexp_replace(lower(title), '\\s', '', 'g')"

_LABEL = "nullif(try_cast(regexp_extract({}, '([0-9]{{1,9}})', 1) AS INT), 0)"
_LEDGER = """p AS (SELECT source_file, count(*) AS page_rows, count(DISTINCT page_no) FILTER (WHERE length(text) > 0) AS live_pages, sum(coalesce(length(text), 0))::BIGINT AS chars FROM pages GROUP BY 1),
  k AS (SELECT source_file, count(DISTINCT kp_id) AS kp FROM kp GROUP BY 1), e AS (SELECT source_file, count(DISTINCT evidence_id) AS evidence FROM evidence GROUP BY 1),
  ledger AS (SELECT source_file, coalesce(page_rows, 0) AS page_rows, coalesce(live_pages, 0) AS live_pages, coalesce(chars, 0) AS chars, coalesce(kp, 0) AS kp, coalesce(evidence, 0) AS evidence FROM p FULL JOIN k USING (source_file) FULL JOIN e USING (source_file) WHERE source_file IS NOT NULL)"""

ORACLE_SQL = {
    "reference_ledger": f"WITH {_LEDGER} SELECT * FROM ledger",
    "consistency_findings": f"""WITH {_LEDGER}, c AS (SELECT source_file, count(DISTINCT node_id) AS chapters, count(DISTINCT node_id) FILTER (WHERE kind = 'matter') AS matter FROM skeleton GROUP BY 1), m AS (SELECT * FROM ledger LEFT JOIN c USING (source_file))
      SELECT 'FAIL' AS level, 'no_pages' AS code, source_file AS subject, kp + evidence AS n FROM m WHERE page_rows = 0 AND kp + evidence > 0 UNION ALL SELECT 'WARN', 'no_chapters', source_file, live_pages FROM m WHERE live_pages > 0 AND coalesce(chapters, 0) = 0
      UNION ALL SELECT 'WARN', 'no_claims', source_file, live_pages FROM m WHERE live_pages > 0 AND kp = 0 UNION ALL SELECT 'INFO', 'matter', source_file, matter FROM m WHERE matter > 0""",
    "claim_texts": f"""WITH k AS (SELECT DISTINCT kp_id, source_file, {_LABEL.format("page_label_start")} AS a, {_LABEL.format("page_label_end")} AS b FROM kp), t AS (SELECT source_file, page_no, max(text) AS t FROM pages WHERE length(text) > 0 GROUP BY ALL),
      h AS (SELECT DISTINCT kp_id, page_no, t FROM k JOIN t ON k.source_file = t.source_file AND page_no BETWEEN least(a, b) AND greatest(a, b)), w AS (SELECT kp_id, string_agg(t, chr(10) || chr(10) ORDER BY page_no, t) AS t FROM h GROUP BY kp_id)
      SELECT kp_id, length(t)::INT AS chars, md5(t) AS digest FROM w""",
    "offset_runners_up": f"WITH {VOTES}, r AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, abs(off), off)::INT AS place, off, hits FROM vt) SELECT * FROM r WHERE place <= 4",
    "file_offsets": f"""WITH {KEYS}, {VOTES}, f AS (SELECT file_id, min(course) AS course FROM keys GROUP BY 1), o AS (SELECT course, CASE WHEN count(DISTINCT best_offset) FILTER (WHERE confident) = 1 THEN max(best_offset) FILTER (WHERE confident) END AS off FROM votes JOIN f USING (file_id) GROUP BY course)
      SELECT file_id, CASE WHEN confident THEN best_offset ELSE off END AS "offset", CASE WHEN confident THEN 'file' ELSE 'course' END AS scope, 'auto' AS source FROM votes JOIN f USING (file_id) LEFT JOIN o USING (course) WHERE confident OR off IS NOT NULL""",
    "quote_recheck": f"WITH {_RECHECK} SELECT * FROM r",
    "quote_recheck_summary": f"WITH {_RECHECK} SELECT before, tier, count(*) AS n, count(*) FILTER (WHERE found_by = 'unmatched') AS unmatched, count(*) FILTER (WHERE n_bodies > 1) AS ambiguous FROM r GROUP BY before, tier",
    "chunk_keys": r"SELECT DISTINCT chunk_id, regexp_extract(chunk_id, '^(.+)::([^:]+)::p([0-9]+)$', 1) AS course, regexp_extract(chunk_id, '^(.+)::([^:]+)::p([0-9]+)$', 2) AS tag, regexp_extract(chunk_id, '::p([0-9]+)$', 1)::INT AS page_start, regexp_extract(chunk_id, '::p([0-9]+)$', 1)::INT AS page_end, chunk_id AS again FROM evidence",
    "skeleton_totals": "SELECT course, count(*) AS chapters, sum(n)::BIGINT AS sections, count(*) FILTER (WHERE kind = 'matter') AS matter, count(*) FILTER (WHERE kind = 'appendix') AS appendices FROM (SELECT DISTINCT course, node_id, kind, coalesce(len(sections), 0) AS n FROM skeleton) GROUP BY course",
    "matter_pages": f"WITH {KEYS}, c AS (SELECT DISTINCT file_id, page_no, coalesce(kind, '') = 'matter' AS m FROM skeleton s JOIN keys k ON s.source_file = k.source_file AND page_no BETWEEN page_start AND page_end) SELECT course, count(*) AS pages, sum(size)::BIGINT AS chars FROM keys SEMI JOIN (SELECT file_id, page_no FROM c GROUP BY ALL HAVING bool_and(m)) USING (file_id, page_no) GROUP BY course",
    "appendix_density": """WITH p AS (SELECT file_id, source_file, page_no, max(text) AS t FROM pages WHERE length(text) > 0 GROUP BY ALL), s AS (SELECT DISTINCT node_id, source_file, page_start, page_end FROM skeleton WHERE kind = 'appendix')
      SELECT node_id, count(*) AS pages, sum(length(t))::BIGINT AS chars, sum(len(regexp_extract_all(t, '[0-9]')))::BIGINT AS digits, round(sum(len(regexp_extract_all(t, '[0-9]'))) / sum(length(t)), 6) AS density FROM s JOIN p ON s.source_file = p.source_file AND page_no BETWEEN page_start AND page_end GROUP BY node_id""",
    "title_verdicts": rf"""WITH t AS (SELECT DISTINCT title FROM (SELECT title FROM skeleton UNION ALL SELECT x.title FROM (SELECT unnest(sections) AS x FROM skeleton) UNION ALL SELECT section_title FROM pages UNION ALL SELECT chapter FROM kp) WHERE title IS NOT NULL),
      k AS (SELECT title, {MATTER_SQL.format(_T)} AS matter, regexp_matches({_T}, '^(附录|附表|续附表|appendix)') AS appendix, trim(title) AS tt FROM t)
      SELECT title, CASE WHEN matter THEN 'matter' WHEN appendix THEN 'appendix' ELSE 'body' END AS kind,
        CASE WHEN tt = '' THEN 'noise' WHEN regexp_matches(tt, '^\s*第\s*{_CN}{{1,4}}\s*[章篇部]') OR regexp_matches(tt, '(?i)^\s*chapter\s+[0-9]{{1,2}}\b') THEN 'chapter' WHEN appendix THEN 'chapter' WHEN matter THEN 'matter'
        WHEN regexp_matches(tt, '(?i)doi\s*[:：]|https?://|www\.|^[0-9.\-—\s]{{1,12}}$|^[ivxlcdm]{{1,6}}$|续表|^表\s*[0-9]|^图\s*[0-9]|^第\s*[0-9]+\s*页') THEN 'noise' WHEN length(tt) < 2 THEN 'noise' WHEN NOT regexp_matches(tt, '[\x{{4E00}}-\x{{9FFF}}]|[A-Za-z]{{2}}') THEN 'noise'
        WHEN (regexp_matches(tt, '^\s*{_CN}{{1,3}}\s*[、.]\s*\S') AND NOT regexp_matches(tt, '^\s*[0-9]+\.[0-9]')) OR regexp_matches(tt, '^\s*[（(]\s*{_CN}{{1,3}}\s*[）)]\s*\S') OR regexp_matches(tt, '^\s*[0-9]{{1,2}}(\.[0-9]{{1,2}}){{1,2}}\s+\S') THEN 'section' END AS verdict FROM k""",
}

ORACLE_SQL["page_references"] = f"""WITH i AS ({PAGES_SQL["anchor_interpolate"]}), o AS ({ORACLE_SQL["file_offsets"]}), p AS (SELECT file_id, page_no, min(page_label) AS label FROM pages WHERE file_id IS NOT NULL AND page_no IS NOT NULL GROUP BY ALL),
  j AS (SELECT p.file_id, p.page_no, coalesce(nullif(label, ''), 'p' || p.page_no) AS place, coalesce(i.printed, CASE WHEN i.page_no IS NULL THEN p.page_no + o."offset" END) AS n, coalesce(i.extrapolated, false) AS x FROM p LEFT JOIN i USING (file_id, page_no) LEFT JOIN o ON o.file_id = p.file_id)
  SELECT file_id, page_no, CASE WHEN n IS NULL THEN 'PDF ' || place WHEN x THEN '书p≈' || n || '（PDF ' || place || '，推算）' ELSE '书p' || n || '（PDF ' || place || '）' END AS reference FROM j"""
