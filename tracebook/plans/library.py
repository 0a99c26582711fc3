"""Queries on the library as a whole: search, texts, contracts, ledgers, courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.text import file_id_of, file_tag_of, flattened, plain_form, search_tokens, short_fingerprint, tidied
from tracebook.operators.courses import resolve_course
from tracebook.operators.merging import declared_duplicates
from tracebook.operators.quality_gates import broken_references, contract_report, duplicate_keys, ledger, manifest_diff, subset_proof, summary_counts
from tracebook.operators.search import interleave, rank_lexical, search
from tracebook.plans.sqltext import BLANK, COURSE_NAMES
from tracebook.plans.sqltext import plain_form as plain_sql
from tracebook.sources.tables import table

TERMS_AND, TERMS_OR = ["smoke", "pressure"], ["烟气", "sprinkler"]


def search_and(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "pages"), TERMS_AND).select("source_file", "page_no", "n_hits")


def search_or(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "pages"), TERMS_OR, match_any=True).select("source_file", "page_no", "n_hits")


def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "pages"), ["evacuation", "vestibule"], match_any=True)


def text_library_stats(spark: SparkSession, d: str) -> DataFrame:
    """course, files, pages, scans, chars per resolved course."""
    pages = resolve_course(table(spark, d, "pages").select("course", "file_id", "page_no", "is_scan", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct(), table(spark, d, "courses"), ["course"], "course_id")
    return pages.groupBy("course_id").agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("is_scan", F.lit(False))).alias("scans"), F.sum("n").alias("chars"))


def status_overview(spark: SparkSession, d: str) -> DataFrame:
    return summary_counts(table(spark, d, "kp"), ["status", "confidence", "type", "importance"])


def text_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("text is not null").select("file_id", "page_no", F.md5(flattened(F.col("text"))).alias("digest")).distinct()


def text_tidy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(tidied(F.col("text"))).alias("digest"))


def text_plain_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(plain_form(F.col("text"))).alias("digest"))


def token_document_counts(spark: SparkSession, d: str) -> DataFrame:
    """token, n_docs over all documents."""
    return table(spark, d, "documents").filter("text is not null").select(F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def retrieve_rank(spark: SparkSession, d: str) -> DataFrame:
    """The eight best claims for each evaluation item whose id is divisible by 100."""
    asked = table(spark, d, "eval_items").filter("item_id % 100 = 0")
    return rank_lexical(asked, table(spark, d, "kp"), query_id="item_id", query="text", item_id="kp_id", fields=["name", "definition", "note"], title="name")


def retrieve_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Twelve claims per split of the evaluation items, the rankings merged round robin."""
    asked = table(spark, d, "eval_items").select("item_id", "split")
    ranked = retrieve_rank(spark, d).join(asked, "item_id").withColumn("query_no", F.col("item_id"))
    return interleave(ranked, "split", "kp_id", 12)


def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    kp = contract_report(table(spark, d, "kp"), "kp", required=["kp_id", "course", "name", "definition", "importance", "numbers"], enums={"status": ["draft", "verified", "rejected"], "confidence": ["A", "B"]})
    ev = contract_report(table(spark, d, "evidence"), "evidence", required=["evidence_id", "kp_id", "quote"], enums={"verify_method": ["exact", "partial", "fabricated", "not_found"]})
    return kp.union(ev).union(contract_report(table(spark, d, "pages"), "pages", required=["file_id", "text", "page_label"]))


def contract_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_keys(table(spark, d, "pages"), ["file_id", "page_no"])


def lineitem_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def fk_breaks(spark: SparkSession, d: str) -> DataFrame:
    """reference, value: quotes of no claim, claims naming quotes that are not there, quotes of no page."""
    kp, evidence, pages = (table(spark, d, t) for t in ("kp", "evidence", "pages"))
    place = lambda x: F.concat_ws("#", "source_file", F.col("page_no").cast("string"))
    parts = [
        ("evidence.kp_id", broken_references(evidence, "kp_id", kp, "kp_id")),
        ("kp.evidence_ids", broken_references(kp.select(F.explode("evidence_ids").alias("e")), "e", evidence, "evidence_id")),
        ("evidence.page", broken_references(evidence.select(place(0).alias("p")), "p", pages.select(place(0).alias("p")), "p")),
    ]
    out = [df.select(F.lit(n).alias("reference"), "value") for n, df in parts]
    return out[0].union(out[1]).union(out[2])


def orders_without_items(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


def ledger_by_file(spark: SparkSession, d: str) -> DataFrame:
    """source_file with its rows in each table, and the tables without any."""
    return ledger({t: table(spark, d, t).select("source_file") for t in ("pages", "skeleton", "kp", "evidence", "documents")}, "source_file")


def file_manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of pages and of documents: on one side only, or on both with the same or another number of rows."""
    of = lambda t: table(spark, d, t).filter("source_file is not null").groupBy("source_file").agg(F.count(F.lit(1)).alias("digest"))
    return manifest_diff(of("pages"), of("documents"), "source_file", "digest")


def run_subset_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether the claims of earlier runs are all there beside those of the last."""
    kp = table(spark, d, "kp").select("kp_id", "run_id")
    last = F.broadcast(kp.agg(F.max("run_id").alias("run_id")))
    return subset_proof(kp.join(last, "run_id", "left_anti"), kp, "kp_id")


def course_resolution(spark: SparkSession, d: str) -> DataFrame:
    """course (as spelt), resolved_course, n over all claims."""
    kp = resolve_course(table(spark, d, "kp").select("course"), table(spark, d, "courses"), ["course"])
    return kp.groupBy("course", "resolved_course").agg(F.count(F.lit(1)).alias("n"))


def file_identity(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("source_file", "file_id").filter("source_file is not null").distinct()
    return files.select("source_file", file_id_of(F.col("source_file")).alias("made_id"), file_tag_of(F.col("file_id")).alias("tag"))


def page_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("text is not null").select("file_id", "page_no", short_fingerprint(F.col("text"), F.col("page_no"), F.col("page_no")).alias("short"), F.sha2("text", 256).alias("full")).distinct()


def repeated_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, keep: documents whose text one with a smaller id has."""
    return declared_duplicates(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


QUERIES = {f.__name__: f for f in (search_and, search_or, search_snippet, text_library_stats, status_overview, text_flatten, text_tidy, text_plain_form, token_document_counts, retrieve_rank, retrieve_interleaved, contract_checks, contract_duplicate_keys, lineitem_duplicate_keys, fk_breaks, orders_without_items, ledger_by_file, file_manifest_diff, run_subset_proof, course_resolution, file_identity, page_fingerprints, repeated_documents)}

_FLAT = f"trim(regexp_replace(text, '{BLANK}+', ' ', 'g'))"
_EDGE = f"^{BLANK}+|{BLANK}+$"
TOKENS = r"list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{4E00}}-\x{{9FFF}}]+'), lambda r: list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: r[i : i + 1])))))"
_RANKED = f"""docs AS (SELECT DISTINCT ON (kp_id) kp_id, {TOKENS.format("concat_ws(' ', name, definition, note)")} AS t, {TOKENS.format("coalesce(name, '')")} AS titled FROM kp),
  asked AS (SELECT item_id, unnest({TOKENS.format("text")}) AS token FROM eval_items WHERE item_id % 100 = 0),
  posted AS (SELECT kp_id, len(t) AS size, titled, unnest(t) AS token FROM docs), df AS (SELECT token, count(*) AS df FROM posted GROUP BY token),
  s AS (SELECT item_id, kp_id, sum(ln(1 + (SELECT count(*) FROM docs) / (1 + df)) * CASE WHEN list_contains(titled, token) THEN 3 ELSE 1 END) / greatest(max(size), 1) ** 0.25 AS raw FROM asked JOIN posted USING (token) JOIN df USING (token) GROUP BY ALL),
  ranked AS (SELECT item_id, kp_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, kp_id)::INT AS place FROM s)"""
_MISSING = "SELECT 'missing' AS \"check\", '{0}' AS \"table\", '{1}' AS \"column\", count(*) FILTER (WHERE {1} IS NULL{2}) AS n FROM {0}"
_ENUM = "SELECT 'enum', '{0}', '{1}', count(*) FILTER (WHERE {1} NOT IN ({2})) FROM {0}"

ORACLE_SQL = {
    "search_and": f"SELECT DISTINCT source_file, page_no, 2::INT AS n_hits FROM (SELECT source_file, page_no, lower({_FLAT}) AS t FROM pages) WHERE contains(t, 'smoke') AND contains(t, 'pressure')",
    "search_or": f"SELECT DISTINCT source_file, page_no, contains(t, '烟气')::INT + contains(t, 'sprinkler')::INT AS n_hits FROM (SELECT source_file, page_no, lower({_FLAT}) AS t FROM pages) WHERE contains(t, '烟气') OR contains(t, 'sprinkler')",
    "text_library_stats": rf"""WITH {COURSE_NAMES}, p AS (SELECT DISTINCT course, file_id, page_no, is_scan, coalesce(length(text), 0) AS n FROM pages)
      SELECT resolved AS course_id, count(DISTINCT file_id) AS files, count(*) AS pages, count(*) FILTER (WHERE is_scan) AS scans, sum(n)::BIGINT AS chars FROM p LEFT JOIN names ON lower(regexp_replace(course, '[ \t\r\n]+', '', 'g')) = k GROUP BY resolved""",
    "status_overview": "SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM kp UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', coalesce({c}::VARCHAR, '(none)'), count(*) FROM kp GROUP BY 2" for c in ("status", "confidence", "type", "importance")),
    "text_flatten": f"SELECT DISTINCT file_id, page_no, md5({_FLAT}) AS digest FROM pages WHERE text IS NOT NULL",
    "text_tidy": rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(translate(text, chr(160) || chr(12288), '  '), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""",
    "text_plain_form": f"SELECT doc_id, md5({plain_sql('text')}) AS digest FROM documents WHERE text IS NOT NULL",
    "token_document_counts": f"SELECT token, count(*) AS n_docs FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token",
    "search_snippet": f"""WITH t AS (SELECT DISTINCT source_file, page_no, trim(regexp_replace(text, '{BLANK}+', ' ', 'g')) AS f FROM pages), h AS (SELECT *, contains(lower(f), 'evacuation')::INT + contains(lower(f), 'vestibule')::INT AS n_hits, list_min(list_filter([strpos(lower(f), 'evacuation'), strpos(lower(f), 'vestibule')], lambda p: p > 0)) AS p FROM t),
      b AS (SELECT *, greatest(p - 30, 1) AS b FROM h WHERE n_hits > 0)
      SELECT DISTINCT source_file, page_no, n_hits, CASE WHEN b > 1 THEN '…' ELSE '' END || regexp_replace(regexp_replace(substr(f, b, 120), '(?i)(evacuation)', '【\\1】', 'g'), '(?i)(vestibule)', '【\\1】', 'g') || CASE WHEN b + 120 <= length(f) THEN '…' ELSE '' END AS snippet FROM b""",
    "retrieve_rank": f"WITH {_RANKED} SELECT * FROM ranked WHERE place <= 8",
    "retrieve_interleaved": f"""WITH {_RANKED}, b AS (SELECT split, kp_id, min({{'place': place, 'q': item_id}}) AS b FROM ranked JOIN eval_items USING (item_id) WHERE place <= 8 GROUP BY ALL),
      o AS (SELECT split, kp_id, row_number() OVER (PARTITION BY split ORDER BY b.place, b.q, kp_id)::INT AS n FROM b) SELECT * FROM o WHERE n <= 12""",
    "contract_checks": " UNION ALL ".join([*(_MISSING.format("kp", c, "" if c in ("importance", "numbers") else f" OR {c} = ''") for c in ("kp_id", "course", "name", "definition", "importance", "numbers")), _ENUM.format("kp", "status", "'draft', 'verified', 'rejected'"), _ENUM.format("kp", "confidence", "'A', 'B'"), *(_MISSING.format("evidence", c, f" OR {c} = ''") for c in ("evidence_id", "kp_id", "quote")), _ENUM.format("evidence", "verify_method", "'exact', 'partial', 'fabricated', 'not_found'"), *(_MISSING.format("pages", c, f" OR {c} = ''") for c in ("file_id", "text", "page_label"))]),
    "contract_duplicate_keys": "SELECT file_id, page_no, count(*) AS n FROM pages GROUP BY ALL HAVING n > 1",
    "lineitem_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1",
    "fk_breaks": """SELECT DISTINCT 'evidence.kp_id' AS reference, kp_id AS value FROM evidence WHERE kp_id IS NOT NULL AND kp_id NOT IN (SELECT kp_id FROM kp WHERE kp_id IS NOT NULL)
      UNION ALL SELECT DISTINCT 'kp.evidence_ids', e FROM (SELECT unnest(evidence_ids) AS e FROM kp) WHERE e IS NOT NULL AND e NOT IN (SELECT evidence_id FROM evidence WHERE evidence_id IS NOT NULL)
      UNION ALL SELECT DISTINCT 'evidence.page', p FROM (SELECT concat_ws('#', source_file, page_no::VARCHAR) AS p FROM evidence) WHERE p NOT IN (SELECT concat_ws('#', source_file, page_no::VARCHAR) FROM pages)""",
    "orders_without_items": "SELECT DISTINCT o_orderkey AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "ledger_by_file": """WITH x AS (SELECT source_file, t, count(*) AS n FROM (SELECT source_file, 'pages' AS t FROM pages UNION ALL SELECT source_file, 'skeleton' FROM skeleton UNION ALL SELECT source_file, 'kp' FROM kp UNION ALL SELECT source_file, 'evidence' FROM evidence UNION ALL SELECT source_file, 'documents' FROM documents) WHERE source_file IS NOT NULL GROUP BY ALL),
      w AS (SELECT source_file, """ + ", ".join(f"coalesce(max(n) FILTER (WHERE t = '{t}'), 0) AS n_{t}" for t in ("pages", "skeleton", "kp", "evidence", "documents")) + """ FROM x GROUP BY source_file)
      SELECT *, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN n_{t} = 0 THEN '{t}' END" for t in ("pages", "skeleton", "kp", "evidence", "documents")) + """], lambda x: x IS NOT NULL), ',') AS missing_in FROM w""",
    "file_manifest_diff": """WITH a AS (SELECT source_file, count(*) AS n FROM pages WHERE source_file IS NOT NULL GROUP BY 1), b AS (SELECT source_file, count(*) AS m FROM documents WHERE source_file IS NOT NULL GROUP BY 1)
      SELECT source_file, CASE WHEN m IS NULL THEN 'left_only' WHEN n IS NULL THEN 'right_only' WHEN n = m THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (source_file)""",
    "run_subset_proof": """WITH a AS (SELECT DISTINCT kp_id FROM kp WHERE run_id IS DISTINCT FROM (SELECT max(run_id) FROM kp)), b AS (SELECT DISTINCT kp_id FROM kp)
      SELECT count(a.kp_id) AS n_before, count(b.kp_id) AS n_after, count(*) FILTER (WHERE b.kp_id IS NULL) AS n_lost, count(*) FILTER (WHERE a.kp_id IS NULL) AS n_added, count(*) FILTER (WHERE b.kp_id IS NULL) = 0 AS is_subset FROM a FULL JOIN b ON a.kp_id = b.kp_id""",
    "course_resolution": rf"WITH {COURSE_NAMES} SELECT course, resolved AS resolved_course, count(*) AS n FROM kp LEFT JOIN names ON lower(regexp_replace(course, '[ \t\r\n]+', '', 'g')) = k GROUP BY ALL",
    "file_identity": r"""SELECT DISTINCT source_file, regexp_replace(regexp_replace(string_split(source_file, '/')[-1], '\.[^.]*$', ''), '[^\w\-\x{80}-\x{10FFFF}]+', '_', 'g')[:40] || '__' || sha1(source_file)[:8] AS made_id,
      regexp_replace(regexp_replace(lower(file_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:28] || '-' || md5(file_id)[:8] AS tag FROM pages WHERE source_file IS NOT NULL""",
    "page_fingerprints": f"SELECT DISTINCT file_id, page_no, page_no || '-' || page_no || '|' || length(text) || '|' || md5(regexp_replace(text, '{BLANK}+', '', 'g')[:32])[:8] AS short, sha256(text) AS \"full\" FROM pages WHERE text IS NOT NULL",
    "repeated_documents": "SELECT DISTINCT doc_id, keep FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents WHERE text IS NOT NULL) WHERE doc_id <> keep",
}
