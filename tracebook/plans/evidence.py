"""Queries on quotations, numbers and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracebook.functions.links import statements
from tracebook.functions.numbers import canonical_numbers, quantities, stated_in
from tracebook.functions.text import first_number, match_form, plain_form
from tracebook.operators.courses import resolve_course
from tracebook.operators.merging import differing_numbers, last_by_key, longest_match, next_index, representatives, stratified, upsert
from tracebook.operators.names import similar_names
from tracebook.operators.pages import expand_ranges
from tracebook.operators.quotes import confidence, quote_ledger, transitions
from tracebook.plans.sqltext import LEDGER, quantities_sql
from tracebook.sources.tables import table


def quote_tier_ledger(spark: SparkSession, d: str) -> DataFrame:
    return quote_ledger(table(spark, d, "evidence"), table(spark, d, "pages"), plain_form)


def quote_tier_full(spark: SparkSession, d: str) -> DataFrame:
    return quote_ledger(table(spark, d, "evidence"), table(spark, d, "pages"), match_form)


def quote_confidence(spark: SparkSession, d: str) -> DataFrame:
    return quote_tier_ledger(spark, d).filter("kp_id is not null").groupBy("kp_id").agg(confidence(F.col("tier")).alias("confidence"), F.count(F.lit(1)).alias("n"))


def quote_transition(spark: SparkSession, d: str) -> DataFrame:
    return transitions(quote_tier_ledger(spark, d))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, number, has: each stated number of a claim with the quantities of
    each page that its quotes cite. If none of those exists, the pages from the
    first to the last label of the claim and its quotes, in its file, count; if
    there is none either, nothing is there. A page's quantities are taken once."""
    points, evidence, pages = (table(spark, d, t) for t in ("kp", "evidence", "pages"))
    kp = points.filter("kp_id is not null").select("kp_id", F.explode("numbers").alias("number")).distinct()
    texts = pages.groupBy("source_file", "page_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    bodies = texts.select("source_file", "page_no", F.length("text").alias("size"), quantities(F.col("text")).alias("has"))
    keys = bodies.select("source_file", "page_no", F.lit(None).cast("string").alias("file_id"), "size")
    cited = evidence.select("kp_id", "source_file", "page_no").distinct().join(keys.select("source_file", "page_no"), ["source_file", "page_no"], "left_semi").select("kp_id", "source_file", "page_no")
    rest = points.join(kp, "kp_id", "left_semi").join(cited, "kp_id", "left_anti")
    quoted = evidence.select("kp_id", first_number(F.col("page_label")).alias("n")).groupBy("kp_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    ends = [first_number(F.col("page_label_start")), first_number(F.col("page_label_end"))]
    ranges = rest.join(quoted, "kp_id", "left").select("kp_id", "source_file", F.least(*ends, "low").alias("page_start"), F.greatest(*ends, "high").alias("page_end")).distinct()
    found = cited.union(expand_ranges(ranges, keys).select("kp_id", "source_file", "page_no").distinct())
    nothing = F.array().cast("array<struct<value:string,unit:string>>")
    return kp.join(found.join(bodies, ["source_file", "page_no"]), "kp_id", "left").select("kp_id", "number", F.coalesce("has", nothing).alias("has"))


def number_missing(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, number: numbers of a claim that no page it cites states. Page
    numbers are extracted once per page."""
    kp = table(spark, d, "kp").select("kp_id", F.explode("numbers").alias("number")).distinct()
    cited = table(spark, d, "evidence").select("kp_id", "source_file", "page_no").distinct()
    there = table(spark, d, "pages").select("source_file", "page_no", F.coalesce("text", F.lit("")).alias("text")).groupBy("source_file", "page_no").agg(F.max("text").alias("text")).select("source_file", "page_no", canonical_numbers(F.col("text")).alias("has"))
    claimed = kp.withColumn("wanted", canonical_numbers(F.col("number")))
    met = claimed.join(cited, "kp_id").join(there, ["source_file", "page_no"])
    held = met.groupBy("kp_id", "number").agg(F.bool_or(F.size(F.array_except("wanted", "has")) == 0).alias("ok"))
    return held.filter(~F.col("ok")).select("kp_id", "number")


def number_check_units(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, number, ok with signs, exponents and units."""
    held = stated_in(quantities(F.col("number")), F.col("has"))
    return _claims(spark, d).groupBy("kp_id", "number").agg(F.bool_or(held).alias("ok"))


def claim_sources(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, pages, chars: the pages from the first to the last page label of a
    claim, in its file. Label ranges are cut to the pages of the file and
    expanded, not compared."""
    kp = table(spark, d, "kp").select("kp_id", "source_file", first_number(F.col("page_label_start")).alias("page_start"), first_number(F.col("page_label_end")).alias("page_end")).filter("page_start <= page_end").distinct()
    sizes = table(spark, d, "pages").select("source_file", "page_no", F.lit(None).cast("string").alias("file_id"), F.coalesce(F.length("text"), F.lit(0)).alias("size")).distinct()
    return expand_ranges(kp, sizes).groupBy("kp_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("chars"))


def dedup_representative(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "kp").select("kp_id", "course", "name", "definition", "numbers", first_number(F.col("page_label_start")).alias("page"))
    support = table(spark, d, "evidence").select("evidence_id", "kp_id", "quote_verified").distinct().filter("quote_verified").groupBy("kp_id").agg(F.count(F.lit(1)).alias("n"))
    return representatives(items, support)


def numeric_differences(spark: SparkSession, d: str) -> DataFrame:
    return differing_numbers(table(spark, d, "kp"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred claims, round robin over files and chapters: those with
    numbers first, then the more important."""
    has = (F.size(F.coalesce("numbers", F.array().cast("array<string>"))) > 0).cast("int")
    items = table(spark, d, "kp").select("kp_id", F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("chapter", F.lit("")).alias("chapter"), has.alias("has"), F.coalesce("importance", F.lit(3)).cast("int").alias("importance"))
    return stratified(items, ["source_file", "chapter"], [F.col("has").desc(), F.col("importance").desc()], "kp_id", 200)


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """course_id, name_a, name_b, ratio within resolved courses. What resolves
    to none is grouped by what it states, and together where it states nothing."""
    kp = resolve_course(table(spark, d, "kp").select("course_id", "course", "name"), table(spark, d, "courses"), ["course_id", "course"])
    stated = [F.when(F.trim(c) != "", F.trim(c)) for c in ("course_id", "course")]
    return similar_names(kp.select(F.coalesce("resolved_course", *stated, F.lit("未分类")).alias("course_id"), "name"), group="course_id", name="name")


def next_kp_index(spark: SparkSession, d: str) -> DataFrame:
    return next_index(table(spark, d, "kp").filter("course_id is not null"), "course_id", "kp_id")


def evidence_last_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The last extracted quote of each claim."""
    rows = table(spark, d, "evidence").filter("kp_id is not null").select("kp_id", "evidence_id", "extracted_at").distinct()
    return last_by_key(rows, ["kp_id"], [F.col("extracted_at"), F.col("evidence_id")])


def upsert_by_run(spark: SparkSession, d: str) -> DataFrame:
    """run_id, n: what the claims' table holds once the last run's claims have
    replaced those of the same course and name."""
    kp = table(spark, d, "kp").select("kp_id", "course", "name", "run_id").distinct().filter("course is not null and name is not null")
    last = kp.join(F.broadcast(kp.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")
    return upsert(kp, last, ["course", "name"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def reference_works(spark: SparkSession, d: str) -> DataFrame:
    """work, files, quotes: quotes by the kind of work their file is, the longest path that matches counts."""
    works = spark.createDataFrame([("textbooks/", "textbook"), ("textbooks/zc", "textbook_zh"), ("readers/", "reader"), ("slides/", "slides"), ("handouts/", "handout"), ("handouts/zc", "handout_zh"), ("slides/zc", "slides_zh")], "match string, work string")
    return longest_match(table(spark, d, "evidence").select("evidence_id", "source_file").distinct(), "source_file", works, "match", "work").groupBy("work").agg(F.count_distinct("source_file").alias("files"), F.count(F.lit(1)).alias("quotes"))


def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, n_quotes, first_at, longest_gap_s: the longest pause between the extractions of a claim's quotes."""
    rows = table(spark, d, "evidence").filter("kp_id is not null and extracted_at is not null").select("kp_id", "evidence_id", F.col("extracted_at").cast("timestamp").alias("at")).distinct()
    gap = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(Window.partitionBy("kp_id").orderBy("at", "evidence_id")))
    return rows.withColumn("gap", gap).groupBy("kp_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap_s"))


def claim_statements(spark: SparkSession, d: str) -> DataFrame:
    """kp_id, id, kind, text: the definition, numbers and note of every claim, one by one."""
    kp = table(spark, d, "kp").select("kp_id", F.explode(statements(F.col("definition"), F.col("numbers"), F.col("note"))).alias("s"))
    return kp.select("kp_id", "s.*").distinct()


QUERIES = {f.__name__: f for f in (claim_statements, quote_tier_ledger, quote_tier_full, quote_confidence, quote_transition, number_missing, number_check_units, claim_sources, dedup_representative, numeric_differences, stratified_sample, name_similarity, next_kp_index, evidence_last_by_key, upsert_by_run, reference_works, evidence_gaps)}

_RANK = "CASE {} WHEN 'exact' THEN 3 WHEN 'partial' THEN 2 WHEN 'fabricated' THEN 1 WHEN 'not_found' THEN 0 END"
_CANON = r"list_transform(regexp_extract_all({}, '[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?'), lambda x: regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(replace(x, ',', ''), '0+$', ''), '\.$', '') ELSE replace(x, ',', '') END, '^0+([0-9])', '\1'))"
_LABEL = "nullif(try_cast(regexp_extract({}, '([0-9]{{1,9}})', 1) AS INT), 0)"
_NUMS = "array_to_string(list_sort({}), chr(31))"

ORACLE_SQL = {
    "claim_statements": """SELECT DISTINCT kp_id, 'definition' AS id, 'definition' AS kind, coalesce(definition, '') AS text FROM kp
      UNION ALL SELECT DISTINCT kp_id, 'number-' || i, 'number', x FROM (SELECT kp_id, unnest(numbers) AS x, generate_subscripts(numbers, 1) AS i FROM kp) UNION ALL SELECT DISTINCT kp_id, 'note', 'note', note FROM kp WHERE trim(note) <> ''""",
    "quote_tier_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "quote_confidence": f"WITH {LEDGER} SELECT kp_id, CASE WHEN bool_and(tier = 'exact') THEN 'A' WHEN bool_or(tier IN ('exact', 'partial')) THEN 'B' ELSE 'C' END AS confidence, count(*) AS n FROM ledger WHERE kp_id IS NOT NULL GROUP BY kp_id",
    "quote_transition": f"WITH {LEDGER} SELECT before, tier, count(*) AS n, CASE WHEN before IS NULL THEN 'new' WHEN {_RANK.format('tier')} > {_RANK.format('before')} THEN 'raised' WHEN {_RANK.format('tier')} < {_RANK.format('before')} THEN 'lowered' ELSE 'same' END AS change FROM ledger GROUP BY before, tier",
    "number_missing": f"""WITH k AS (SELECT DISTINCT kp_id, unnest(numbers) AS number FROM kp), c AS (SELECT DISTINCT kp_id, source_file, page_no FROM evidence),
      p AS (SELECT DISTINCT source_file, page_no, {_CANON.format("coalesce(text, '')")} AS has FROM pages)
      SELECT kp_id, number FROM k JOIN c USING (kp_id) JOIN p USING (source_file, page_no) GROUP BY kp_id, number
      HAVING NOT bool_or(len(list_filter({_CANON.format('number')}, lambda x: NOT list_contains(has, x))) = 0)""",
    "number_check_units": rf"""WITH k AS (SELECT DISTINCT kp_id, unnest(numbers) AS number FROM kp WHERE kp_id IS NOT NULL), t AS (SELECT source_file, page_no, max(coalesce(text, '')) AS text FROM pages GROUP BY ALL),
      c AS (SELECT DISTINCT kp_id, source_file, page_no FROM evidence SEMI JOIN t USING (source_file, page_no)),
      n AS (SELECT kp_id, min({_LABEL.format("page_label")}) AS low, max({_LABEL.format("page_label")}) AS high FROM evidence GROUP BY kp_id),
      r AS (SELECT DISTINCT kp_id, source_file, least({_LABEL.format("page_label_start")}, {_LABEL.format("page_label_end")}, low) AS a, greatest({_LABEL.format("page_label_start")}, {_LABEL.format("page_label_end")}, high) AS b FROM kp LEFT JOIN n USING (kp_id) WHERE kp_id NOT IN (SELECT kp_id FROM c WHERE kp_id IS NOT NULL)),
      f AS (SELECT * FROM c UNION SELECT kp_id, r.source_file, page_no FROM r JOIN t ON r.source_file = t.source_file AND page_no BETWEEN a AND b),
      p AS (SELECT source_file, page_no, {quantities_sql("text")} AS has FROM t SEMI JOIN f USING (source_file, page_no)), w AS (SELECT DISTINCT number, {quantities_sql("number")} AS want FROM k)
      SELECT kp_id, number, bool_or(len(list_filter(want, lambda x: NOT list_contains(list_transform(coalesce(has, []), lambda y: CASE WHEN x.u = '' THEN y.v ELSE y.v || '|' || y.u END), CASE WHEN x.u = '' THEN x.v ELSE x.v || '|' || x.u END))) = 0) AS ok
      FROM k JOIN w USING (number) LEFT JOIN (SELECT kp_id, has FROM f JOIN p USING (source_file, page_no)) USING (kp_id) GROUP BY kp_id, number""",
    "claim_sources": r"""WITH k AS (SELECT DISTINCT kp_id, source_file, nullif(try_cast(regexp_extract(page_label_start, '([0-9]{1,9})', 1) AS INT), 0) AS a, nullif(try_cast(regexp_extract(page_label_end, '([0-9]{1,9})', 1) AS INT), 0) AS b FROM kp),
      p AS (SELECT DISTINCT source_file, page_no, coalesce(length(text), 0) AS n FROM pages)
      SELECT kp_id, count(*) AS pages, sum(n)::BIGINT AS chars FROM k JOIN p ON k.source_file = p.source_file AND page_no BETWEEN a AND b WHERE a <= b GROUP BY kp_id""",
    "dedup_representative": rf"""WITH i AS (SELECT DISTINCT ON (kp_id) kp_id, course, lower(trim(name)) AS nm, length(coalesce(definition, '')) AS dl, {_NUMS.format("coalesce(numbers, [])")} AS num,
        coalesce(nullif(try_cast(regexp_extract(page_label_start, '([0-9]{{1,9}})', 1) AS INT), 0), 1000000000) AS pg FROM kp WHERE course IS NOT NULL AND trim(name) <> ''),
      s AS (SELECT kp_id, count(*) AS n FROM (SELECT DISTINCT evidence_id, kp_id FROM evidence WHERE quote_verified) GROUP BY kp_id),
      r AS (SELECT i.*, coalesce(n, 0) AS n FROM i LEFT JOIN s USING (kp_id)),
      g AS (SELECT course, nm, count(DISTINCT num) AS kinds, count(*) AS n_members FROM r GROUP BY ALL),
      b AS (SELECT course, nm, kp_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY course, nm ORDER BY n DESC, dl DESC, pg, kp_id) AS o FROM r) WHERE o = 1)
      SELECT kp_id, CASE WHEN kinds = 1 THEN best ELSE kp_id END AS keep, n_members FROM r JOIN g USING (course, nm) JOIN b USING (course, nm)""",
    "numeric_differences": rf"SELECT course, regexp_replace(name, '[ \t\n\v\f\r]+', '', 'g') AS name, count(DISTINCT {_NUMS.format('numbers')}) AS n_variants FROM kp WHERE len(numbers) > 0 AND course IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2 HAVING n_variants > 1",
    "stratified_sample": """WITH i AS (SELECT DISTINCT ON (kp_id) kp_id, coalesce(source_file, '') AS source_file, coalesce(chapter, '') AS chapter, (len(coalesce(numbers, [])) > 0)::INT AS has, coalesce(importance, 3)::INT AS importance FROM kp),
      r AS (SELECT *, row_number() OVER (PARTITION BY source_file, chapter ORDER BY has DESC, importance DESC, kp_id) AS rank FROM i)
      SELECT kp_id, source_file, chapter, rank::INT AS rank, row_number() OVER (ORDER BY rank, source_file, chapter, kp_id)::INT AS place FROM r ORDER BY rank, source_file, chapter, kp_id LIMIT 200""",
    "next_kp_index": "SELECT course_id, max(regexp_extract(kp_id, '([0-9]{1,18})$', 1)::BIGINT) + 1 AS next_index FROM kp WHERE course_id IS NOT NULL AND regexp_matches(kp_id, '[0-9]$') GROUP BY course_id",
    "evidence_last_by_key": "SELECT kp_id, evidence_id, extracted_at FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY extracted_at DESC NULLS LAST, evidence_id DESC) AS o FROM (SELECT DISTINCT kp_id, evidence_id, extracted_at FROM evidence WHERE kp_id IS NOT NULL)) WHERE o = 1",
    "upsert_by_run": """WITH k AS (SELECT DISTINCT kp_id, course, name, run_id FROM kp WHERE course IS NOT NULL AND name IS NOT NULL), l AS (SELECT * FROM k WHERE run_id = (SELECT max(run_id) FROM k)),
      u AS (SELECT * FROM k ANTI JOIN l USING (course, name) UNION ALL SELECT * FROM l) SELECT run_id, count(*) AS n FROM u GROUP BY run_id""",
    "reference_works": """SELECT CASE WHEN contains(source_file, 'textbooks/zc') THEN 'textbook_zh' WHEN contains(source_file, 'handouts/zc') THEN 'handout_zh' WHEN contains(source_file, 'textbooks/') THEN 'textbook' WHEN contains(source_file, 'handouts/') THEN 'handout'
      WHEN contains(source_file, 'slides/zc') THEN 'slides_zh' WHEN contains(source_file, 'readers/') THEN 'reader' WHEN contains(source_file, 'slides/') THEN 'slides' END AS work, count(DISTINCT source_file) AS files, count(*) AS quotes
      FROM (SELECT DISTINCT evidence_id, source_file FROM evidence) GROUP BY 1""",
    "evidence_gaps": """WITH e AS (SELECT DISTINCT kp_id, evidence_id, extracted_at::TIMESTAMP AS ts FROM evidence WHERE kp_id IS NOT NULL AND extracted_at IS NOT NULL),
      g AS (SELECT *, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY kp_id ORDER BY ts, evidence_id))::BIGINT AS gap FROM e)
      SELECT kp_id, count(*) AS n_quotes, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, coalesce(max(gap), 0) AS longest_gap_s FROM g GROUP BY kp_id""",
}
