"""Queries on pages, chapters, printed numbers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.text import flattened
from tracebook.operators import pages as P
from tracebook.operators import titles as T
from tracebook.operators.merging import segments
from tracebook.plans.sqltext import BLANK, KEYS, MATTER_SQL
from tracebook.sources.tables import table


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return P.page_keys(table(spark, d, "pages"))


def page_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive pages with text."""
    return P.page_runs(_keys(spark, d).filter("size > 0"))


def page_global_interval(spark: SparkSession, d: str) -> DataFrame:
    return P.page_intervals(_keys(spark, d))


def chapter_end_lead(spark: SparkSession, d: str) -> DataFrame:
    last = _keys(spark, d).groupBy("source_file").agg(F.max("page_no").alias("last_page"))
    return P.chapter_ends(P.chapters_of(table(spark, d, "skeleton")), last)


def page_owner(spark: SparkSession, d: str) -> DataFrame:
    return P.page_owners(P.chapters_of(table(spark, d, "skeleton")), _keys(spark, d)).select("file_id", "page_no", "node_id")


def page_section(spark: SparkSession, d: str) -> DataFrame:
    skeleton = table(spark, d, "skeleton")
    owners = P.page_owners(P.chapters_of(skeleton), _keys(spark, d))
    return P.section_owners(skeleton, owners)


def coverage_chapters(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(_keys(spark, d), table(spark, d, "skeleton").select("source_file", "page_start", "page_end").distinct())


def coverage_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "skeleton").select("source_file", F.explode("sections").alias("s")).select("source_file", "s.page_start", "s.page_end").filter("page_start <= page_end").distinct()
    return P.coverage(_keys(spark, d), sections)


def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each chapter packed in windows of at most 11,000 characters."""
    return P.page_windows(P.page_owners(P.chapters_of(table(spark, d, "skeleton")), _keys(spark, d)), ["file_id", "node_id"], 11_000)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by chapter, and of files that no chapter is in by their pages."""
    skeleton, pages = table(spark, d, "skeleton"), table(spark, d, "pages")
    by_chapter = P.chapter_chunks(skeleton, pages)
    return by_chapter.unionByName(P.sequential_chunks(P.files_without_chapters(pages, skeleton)).select("chunk_id", "file_id", "page_start", "page_end", "pages", "chars", "text"), allowMissingColumns=True)


def offset_votes(spark: SparkSession, d: str) -> DataFrame:
    return P.offset_votes(table(spark, d, "pages").distinct())


def offset_by_course(spark: SparkSession, d: str) -> DataFrame:
    return P.course_offsets(offset_votes(spark, d), _keys(spark, d))


def anchor_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return P.interpolate(_keys(spark, d), P.label_anchors(table(spark, d, "pages")))


def title_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages of a file under one section title."""
    rows = table(spark, d, "pages").select("file_id", "page_no", flattened(F.col("section_title")).alias("title")).filter("file_id is not null and page_no is not null").dropDuplicates(["file_id", "page_no"])
    return segments(rows, "file_id", "page_no", "title")


def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    """file_id, page_no, pending: PDF pages that are scans or nearly empty, and whether they still wait for recognition."""
    p = table(spark, d, "pages").filter("source_kind = 'pdf'").filter(F.coalesce("is_scan", F.lit(False)) | (F.coalesce(F.length("text"), F.lit(0)) < 30))
    return p.select("file_id", "page_no", (F.coalesce("text_source", F.lit("")) != "ocr").alias("pending")).distinct()


def title_kinds(spark: SparkSession, d: str) -> DataFrame:
    """title, kind, plausible, number of every chapter title."""
    t = table(spark, d, "skeleton").select("title").filter("title is not null").distinct()
    return t.select("title", T.title_kind(F.col("title")).alias("kind"), T.plausible_title(F.col("title")).alias("plausible"), T.chapter_number(F.col("title")).alias("number"))


def header_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of each file by its running headers."""
    return T.header_chapters(table(spark, d, "pages"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """file_id, page_no, section: the heading that each page begins with."""
    p = table(spark, d, "pages").filter("length(text) > 0").select("file_id", "page_no", T.detected_section(F.col("text")).alias("section")).filter("section is not null")
    return p.distinct()


QUERIES = {f.__name__: f for f in (title_kinds, header_chapters, page_sections, page_runs, page_global_interval, chapter_end_lead, page_owner, page_section, coverage_chapters, coverage_sections, greedy_windows, chunks, offset_votes, offset_by_course, anchor_interpolate, title_segments, scan_pages)}

_CHAPTERS = "ch AS (SELECT DISTINCT node_id, source_file, ord, num, kind, page_start, page_end FROM skeleton WHERE node_id IS NOT NULL)"
_OWNERS = f"""{KEYS}, {_CHAPTERS}, owners AS (SELECT file_id, source_file, page_no, size, node_id, ord FROM (
  SELECT keys.file_id, keys.source_file, keys.page_no, size, node_id, ord, row_number() OVER (PARTITION BY keys.file_id, keys.page_no ORDER BY ord, node_id) AS o FROM keys JOIN ch ON keys.source_file = ch.source_file AND page_no BETWEEN page_start AND page_end
  WHERE coalesce(kind, '') <> 'matter' AND page_start > 0 AND page_end > 0) WHERE o = 1)"""
_COVER = "SELECT course, count(*) AS text_pages, count(*) FILTER (WHERE hit) AS covered_pages, round(100 * count(*) FILTER (WHERE hit) / count(*), 1) AS share FROM (SELECT course, EXISTS (FROM r WHERE r.source_file = keys.source_file AND keys.page_no BETWEEN r.page_start AND r.page_end) AS hit FROM keys WHERE size > 0) GROUP BY course"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '')"
VOTES = rf"""pg AS (SELECT DISTINCT file_id, page_no, text FROM pages WHERE length(text) > 0), ln AS (SELECT file_id, page_no, {_LINES} AS ls FROM pg),
  ed AS (SELECT file_id, page_no, 0 AS e, ls[1] AS x FROM ln WHERE len(ls) > 0 UNION ALL SELECT file_id, page_no, 1, ls[-1] FROM ln WHERE len(ls) > 0),
  cd AS (SELECT file_id, page_no, unnest(regexp_extract_all(x, '[0-9.]+')) AS c FROM ed WHERE length(x) <= 60),
  vt AS (SELECT file_id, c::INT - page_no AS off, count(*) AS hits FROM cd WHERE regexp_matches(c, '^[0-9]{{1,4}}$') AND NOT regexp_matches(c, '(19|20)[0-9]{{2}}') AND c::INT BETWEEN 1 AND 2000 GROUP BY ALL),
  bs AS (SELECT file_id, off, hits FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, abs(off), off) AS o FROM vt) WHERE o = 1),
  n AS (SELECT file_id, count(DISTINCT page_no) AS pages FROM pages WHERE file_id IS NOT NULL AND page_no IS NOT NULL GROUP BY 1),
  votes AS (SELECT n.file_id, pages, off AS best_offset, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / pages, 3) AS ratio, CASE WHEN round(coalesce(hits, 0) / pages, 3) >= 0.75 THEN 'high' WHEN round(coalesce(hits, 0) / pages, 3) >= 0.5 THEN 'medium' ELSE 'low' END AS tier,
    off IS NOT NULL AND coalesce(hits, 0) / pages >= 0.3 AND coalesce(hits, 0) >= 5 AS confident FROM n LEFT JOIN bs USING (file_id))"""

_CN = "[0-9零一二三四五六七八九十百]"


def _cleaned(x: str) -> str:
    """clean_title of a line; what follows a leading number is put back, as there is no look-ahead."""
    plain = f"regexp_replace({x}, '[_\\x{{3000}}]', ' ', 'g')"
    tail = f"regexp_replace({plain}, '(?:\\s+(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})|[\\s.·．…\\-]+[0-9]{{1,4}})\\s*$', '')"
    head = f"regexp_replace(regexp_replace({tail}, '^\\s*(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})\\s{{2,}}', ''), '^\\s*[0-9]{{1,4}}\\s*([\\x{{4E00}}-\\x{{9FFF}}])', '\\1')"
    glued = f"CASE WHEN regexp_matches({head}, '^第\\s*{_CN}{{1,4}}\\s*[章节]') THEN regexp_replace({head}, '[0-9]{{1,4}}\\s*$', '') ELSE {head} END"
    return f"regexp_replace(regexp_replace({glued}, '\\s+', ' ', 'g'), '^[ .·．…\\-—]+|[ .·．…\\-—]+$', '', 'g')"


_PLAUSIBLE = f"length(x) <= 46 AND length(x) - length(translate(x, '{T.PUNCTUATION_SQL}', '')) <= 2 AND regexp_matches(x, '[\\x{{4E00}}-\\x{{9FFF}}]|[A-Za-z]{{3}}')"
_NUMBER = "coalesce(try_cast(regexp_extract(title, '(?i)^\\s*chapter\\s+([0-9]{1,3})\\b', 1) AS INT), try_cast(regexp_extract(title, '^\\s*第\\s*([0-9]{1,3})\\s*章', 1) AS INT))"
_HEADER_SQL = rf"""WITH p AS (SELECT source_file, page_no, max(text) AS text FROM pages WHERE source_file IS NOT NULL AND page_no IS NOT NULL AND length(text) > 0 GROUP BY ALL),
  h AS (SELECT source_file, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_cleaned("l")}), lambda x: x <> '')[1:2], lambda x: {_PLAUSIBLE})[1] AS title, page_no FROM p),
  k AS (SELECT *, CASE WHEN {_NUMBER} IS NOT NULL THEN '#ch' || {_NUMBER} ELSE regexp_replace(regexp_replace(lower(title), '{BLANK}', '', 'g'), '[0-9]+$', '') END AS key FROM h WHERE title IS NOT NULL),
  s AS (SELECT source_file, key, title, count(*) AS n, min(page_no) AS a, max(page_no) AS b FROM k WHERE key <> '' GROUP BY ALL),
  g AS (SELECT source_file, key, sum(n)::BIGINT AS n, first(title ORDER BY n DESC, title) AS title, min(a) AS page_start, max(b) AS page_end FROM s GROUP BY ALL), t AS (SELECT source_file, count(*) AS total FROM p GROUP BY 1),
  m AS (SELECT source_file, first(key ORDER BY n DESC, key) AS top FROM g WHERE NOT starts_with(key, '#ch') GROUP BY 1)
  SELECT source_file, key, title, page_start, page_end, n AS pages, CASE WHEN {MATTER_SQL.format("regexp_replace(lower(title), '" + BLANK + "', '', 'g')")} THEN 'matter' WHEN regexp_matches(regexp_replace(lower(title), '{BLANK}', '', 'g'), '^({"|".join(T.APPENDIX)})') THEN 'appendix' ELSE 'body' END AS kind
  FROM g JOIN t USING (source_file) LEFT JOIN m USING (source_file) WHERE n >= 2 AND (starts_with(key, '#ch') OR NOT ((page_start <= 8 AND n >= greatest(3, 0.1 * total)) OR (key IS NOT DISTINCT FROM top AND n >= greatest(5, 0.15 * total))))"""

_HEADS = [r"^第\s*[0-9一二三四五六七八九十]{1,3}\s*章", r"(?i)^chapter\s+[0-9]+", r"^第\s*[0-9一二三四五六七八九十]{1,3}\s*节", r"^[0-9]{1,2}\.[0-9]{1,2}(\.[0-9]{1,2})?\s+\S"]
_HEAD_LINES = "list_filter(list_transform(string_split(text[:400], chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:12]"
_PLAIN = f"regexp_replace(lower(title), '{BLANK}', '', 'g')"
ORACLE_SQL = {
    "title_kinds": f"""SELECT DISTINCT title, CASE WHEN {MATTER_SQL.format(_PLAIN)} THEN 'matter' WHEN regexp_matches({_PLAIN}, '^({"|".join(T.APPENDIX)})') THEN 'appendix' ELSE 'body' END AS kind,
      length(title) <= 46 AND length(title) - length(translate(title, '{T.PUNCTUATION_SQL}', '')) <= 2 AND regexp_matches(title, '[\\x{{4E00}}-\\x{{9FFF}}]|[A-Za-z]{{3}}') AS plausible,
      try_cast(regexp_extract(title, '(?i)^\\s*chapter\\s+([0-9]{{1,3}})\\b', 1) AS INT) AS number FROM skeleton WHERE title IS NOT NULL""",
    "page_sections": "SELECT DISTINCT file_id, page_no, section FROM (SELECT file_id, page_no, coalesce(" + ", ".join(f"list_filter(ls, lambda x: regexp_matches(x, '{h}') AND length(x) <= 60)[1]" for h in _HEADS) + f") AS section FROM (SELECT file_id, page_no, {_HEAD_LINES} AS ls FROM pages WHERE length(text) > 0)) WHERE section IS NOT NULL",
    "greedy_windows": f"""WITH RECURSIVE {_OWNERS}, o AS (SELECT file_id, node_id, page_no, size + 20 AS n, row_number() OVER (PARTITION BY file_id, node_id ORDER BY page_no) AS i FROM owners),
      w AS (SELECT file_id, node_id, page_no, n, i, 0 AS w, n::BIGINT AS held FROM o WHERE i = 1
        UNION ALL SELECT o.file_id, o.node_id, o.page_no, o.n, o.i, CASE WHEN held + o.n > 11000 THEN w.w + 1 ELSE w.w END, CASE WHEN held + o.n > 11000 THEN o.n ELSE held + o.n END FROM w JOIN o ON o.file_id = w.file_id AND o.node_id = w.node_id AND o.i = w.i + 1)
      SELECT file_id, node_id, w AS "window", min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS pages, sum(n)::BIGINT AS weight FROM w GROUP BY file_id, node_id, w""",
    "header_chapters": _HEADER_SQL,
    "page_runs": f"WITH {KEYS}, g AS (SELECT file_id, page_no, page_no - row_number() OVER (PARTITION BY file_id ORDER BY page_no) AS r FROM keys WHERE size > 0) SELECT file_id, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS pages FROM g GROUP BY file_id, r",
    "page_global_interval": f"WITH {KEYS}, f AS (SELECT source_file, count(*) AS pages FROM keys GROUP BY 1) SELECT source_file, pages, (sum(pages) OVER (ORDER BY source_file) - pages + 1)::BIGINT AS first_page, (sum(pages) OVER (ORDER BY source_file))::BIGINT AS last_page FROM f",
    "chapter_end_lead": f"WITH {KEYS}, {_CHAPTERS}, l AS (SELECT source_file, max(page_no) AS last_page FROM keys GROUP BY 1) SELECT node_id, page_start, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY source_file ORDER BY num, page_start, node_id) - 1, last_page)) AS page_end FROM ch JOIN l USING (source_file)",
    "page_owner": f"WITH {_OWNERS} SELECT file_id, page_no, node_id FROM owners",
    "page_section": f"""WITH {_OWNERS}, s AS (SELECT DISTINCT node_id, page_start AS cs, page_end AS ce, x.page_start AS a, x.page_end AS b, x.ord AS so, x.node_id AS section_id FROM (SELECT node_id, page_start, page_end, unnest(sections) AS x FROM skeleton)),
      r AS (SELECT file_id, page_no, node_id, section_id, row_number() OVER (PARTITION BY file_id, page_no ORDER BY so, section_id) AS o FROM owners JOIN s USING (node_id) WHERE page_no BETWEEN greatest(coalesce(a, cs), cs) AND least(coalesce(b, ce), ce)) SELECT file_id, page_no, node_id, section_id FROM r WHERE o = 1""",
    "coverage_chapters": f"WITH {KEYS}, r AS (SELECT source_file, page_start, page_end FROM skeleton) {_COVER}",
    "coverage_sections": f"WITH {KEYS}, r AS (SELECT source_file, x.page_start, x.page_end FROM (SELECT source_file, unnest(sections) AS x FROM skeleton) WHERE x.page_start <= x.page_end) {_COVER}",
    "offset_votes": f"WITH {VOTES} SELECT * FROM votes",
    "offset_by_course": f"WITH {KEYS}, {VOTES}, c AS (SELECT file_id, min(course) AS course FROM keys GROUP BY 1) SELECT course, count(*) AS files, count(*) FILTER (WHERE confident) AS confident_files, CASE WHEN count(DISTINCT best_offset) FILTER (WHERE confident) = 1 THEN max(best_offset) FILTER (WHERE confident) END AS \"offset\", count(DISTINCT best_offset) FILTER (WHERE confident) > 1 AS mixed, min(ratio) FILTER (WHERE confident) AS least_ratio FROM votes JOIN c USING (file_id) GROUP BY course",
    "anchor_interpolate": rf"""WITH {KEYS}, l AS (SELECT DISTINCT file_id, page_no, nullif(try_cast(regexp_extract(page_label, '([0-9]{{1,9}})', 1) AS INT), 0) AS p FROM pages WHERE file_id IS NOT NULL AND page_no IS NOT NULL),
      a AS (SELECT file_id, min({{'i': page_no, 'p': p}}) AS a, max({{'i': page_no, 'p': p}}) AS b FROM l WHERE p IS NOT NULL GROUP BY 1 HAVING min(page_no) < max(page_no)),
      v AS (SELECT DISTINCT keys.file_id, page_no, a.p + (page_no - a.i) * (b.p - a.p) / (b.i - a.i) AS v, page_no < a.i OR page_no > b.i AS extrapolated FROM keys JOIN a USING (file_id))
      SELECT file_id, page_no, round_even(v, 0)::INT AS printed, extrapolated FROM v""",
    "title_segments": f"""WITH p AS (SELECT DISTINCT ON (file_id, page_no) file_id, page_no, trim(regexp_replace(section_title, '{BLANK}+', ' ', 'g')) AS title FROM pages WHERE file_id IS NOT NULL AND page_no IS NOT NULL),
      c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR title IS DISTINCT FROM lag(title) OVER w THEN 1 ELSE 0 END AS ch FROM p WINDOW w AS (PARTITION BY file_id ORDER BY page_no)),
      r AS (SELECT *, sum(ch) OVER (PARTITION BY file_id ORDER BY page_no) AS run FROM c) SELECT file_id, any_value(title) AS title, min(page_no) AS first, max(page_no) AS last, count(*) AS "rows" FROM r GROUP BY file_id, run""",
    "scan_pages": "SELECT DISTINCT file_id, page_no, coalesce(text_source, '') <> 'ocr' AS pending FROM pages WHERE source_kind = 'pdf' AND (coalesce(is_scan, false) OR coalesce(length(text), 0) < 30)",
}
