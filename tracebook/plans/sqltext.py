"""Pieces of SQL that several oracle queries share."""

from __future__ import annotations

from tracebook.functions.numbers import LONGEST_FIRST, NUMBER, WIDE, WIDE_AS
from tracebook.operators.titles import MATTER, MATTER_BEGIN

BLANK = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def plain_form(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '{BLANK}', '', 'g'), '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g')"
    hyphen = f"regexp_replace(regexp_replace({bare}, '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g'), '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g')"
    return f"translate({hyphen}, '“”‘’—–−．，；：（）', '\"\"''''---.,;:()')"


LEDGER = f"""
b AS (SELECT DISTINCT source_file, page_no, {plain_form("text")} AS body FROM pages WHERE length(text) > 0),
q AS (SELECT DISTINCT evidence_id, kp_id, source_file, page_no, verify_method AS before, {plain_form("quote")} AS q FROM evidence),
j AS (SELECT evidence_id, kp_id, before, q, coalesce(body, '') AS body FROM q LEFT JOIN b USING (source_file, page_no)),
k AS (SELECT *, length(q) >= 12 AND contains(body, q[:24]) AS head, length(q) >= 12 AND contains(body, q[greatest(length(q) - 23, 1):]) AS tail,
  len(list_filter(regexp_extract_all(q, '[0-9]+(?:\\.[0-9]+)?'), lambda x: NOT contains(body, x))) > 0 AS strange FROM j),
ledger AS (SELECT evidence_id, kp_id, before, CASE WHEN coalesce(q, '') = '' OR body = '' THEN 'not_found' WHEN contains(body, q) THEN 'exact'
  WHEN strange THEN CASE WHEN head OR tail THEN 'fabricated' ELSE 'not_found' END WHEN head AND tail THEN 'partial' WHEN head OR tail THEN 'fabricated' ELSE 'not_found' END AS tier FROM k)
"""

MATTER_SQL = "({0} IN ('" + "', '".join(MATTER) + "') OR regexp_matches({0}, '^" + MATTER_BEGIN + r"\w*$'))"


def tier_sql(q: str, body: str) -> str:
    head = f"(length({q}) >= 12 AND contains({body}, {q}[:24]))"
    tail = f"(length({q}) >= 12 AND contains({body}, {q}[greatest(length({q}) - 23, 1):]))"
    strange = f"len(list_filter(regexp_extract_all({q}, '[0-9]+(?:\\.[0-9]+)?'), lambda z: NOT contains({body}, z))) > 0"
    return f"""CASE WHEN coalesce({q}, '') = '' OR coalesce({body}, '') = '' THEN 'not_found' WHEN contains({body}, {q}) THEN 'exact'
      WHEN {strange} THEN CASE WHEN {head} OR {tail} THEN 'fabricated' ELSE 'not_found' END WHEN {head} AND {tail} THEN 'partial' WHEN {head} OR {tail} THEN 'fabricated' ELSE 'not_found' END"""


COURSE_NAMES = r"""
names AS (SELECT k, min(course_id) AS resolved FROM (SELECT lower(regexp_replace(n, '[ \t\r\n]+', '', 'g')) AS k, course_id
  FROM (SELECT course_id, unnest(list_concat([course_id, name], coalesce(aliases, []))) AS n FROM courses)) WHERE k <> '' GROUP BY k)
"""

KEYS = "keys AS (SELECT file_id, page_no, min(source_file) AS source_file, min(course) AS course, max(coalesce(length(text), 0)) AS size FROM pages WHERE file_id IS NOT NULL AND page_no IS NOT NULL GROUP BY ALL)"


def quantities_sql(column: str) -> str:
    """List of structs v, u of the numbers of a text and their units. DuckDB's
    patterns have no look-ahead: a letter right after the unit is taken along,
    and then it is no unit."""
    wide = WIDE.replace("'", "''"), WIDE_AS.replace("'", "''")
    found = f"regexp_extract_all(coalesce(translate(replace({column}, '℃', '°C'), '{wide[0]}', '{wide[1]}'), ''), '{NUMBER}(?:\\s*(?i:{LONGEST_FIRST})[A-Za-z]?)?')"
    number = f"replace(regexp_extract(m, '{NUMBER}'), ',', '')"
    tail = f"CASE WHEN regexp_full_match(m, '{NUMBER}\\s*(?i:{LONGEST_FIRST})') THEN lower(trim(substr(m, length(regexp_extract(m, '{NUMBER}')) + 1))) ELSE '' END"
    unit = f"CASE WHEN {tail} IN ('hour', 'hours') THEN 'h' ELSE {tail} END"
    return f"list_transform({found}, lambda m: {{'v': coalesce(try_cast({number} AS DECIMAL(38, 18))::VARCHAR, {number}), 'u': {unit}}})"
