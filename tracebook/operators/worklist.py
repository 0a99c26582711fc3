"""Worksheets of findings, deletions that follow references, extraction results made rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebook.operators.quotes import confidence, quote_tier


def finding_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The findings (audit_id, kp_id, target) with the quote to look at: the one
    they name, else the first unverified one of their claim, else its first;
    null where the claim has none."""
    quotes = evidence.filter("kp_id is not null").select("evidence_id", "kp_id", "quote", F.coalesce("quote_verified", F.lit(False)).alias("ok")).distinct()
    named = quotes.select(F.col("evidence_id").alias("target"), F.col("kp_id"), F.struct("evidence_id", "quote").alias("_named"))
    first = quotes.groupBy("kp_id").agg(F.min(F.struct("ok", "evidence_id", "quote")).alias("f")).select("kp_id", F.struct("f.evidence_id", "f.quote").alias("_first"))
    met = findings.join(named.groupBy("target", "kp_id").agg(F.min("_named").alias("_named")), ["target", "kp_id"], "left").join(first, "kp_id", "left")
    shown = F.coalesce("_named", "_first")
    return met.select(*findings.columns, shown["evidence_id"].alias("evidence_id"), shown["quote"].alias("quote"))


def quality_findings(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """kp_id, verdict of claims whose finding is of their revision of today and is not `pass`."""
    return claims.select("kp_id", "revision").join(findings.select("kp_id", "revision", "verdict"), ["kp_id", "revision"]).filter("verdict <> 'pass'").select("kp_id", "verdict").distinct()


def worksheet(findings: DataFrame, previous: DataFrame) -> DataFrame:
    """The open findings with the verdicts that an earlier worksheet (audit_id,
    verdict) already holds; blank verdicts do not count. An earlier entry whose
    finding has gone is dropped."""
    given = previous.filter(F.trim("verdict") != "").groupBy("audit_id").agg(F.max("verdict").alias("verdict"))
    return findings.join(given, "audit_id", "left")


def cascade(tables: dict[str, DataFrame], keys: DataFrame, references: dict[str, str]) -> dict[str, DataFrame]:
    """The tables without the rows that refer to one of `keys` (one column):
    references names for each table the column that refers to it."""
    (name,) = keys.columns
    gone = keys.distinct()
    return {t: df.join(gone.select(F.col(name).alias(references[t])), references[t], "left_anti") if t in references else df for t, df in tables.items()}


def window_around(body: Column, quote: Column, width: int = 900) -> Column:
    """The part of a page where a quote stands, blanks aside: `width` characters
    around the place in proportion; the begin of the page where it is not found."""
    from tracebook.functions.text import BLANKS

    bare, wanted = (F.regexp_replace(F.lower(x), f"{BLANKS}+", "") for x in (body, quote))
    at = F.position(F.left(wanted, F.lit(24)), bare)
    place = F.when(at > 0, (at / F.greatest(F.length(bare), F.lit(1)) * F.length(body)).cast("int")).otherwise(0)
    return F.substring(body, F.greatest(place - width // 2, F.lit(1)), F.lit(width))


def longest_anchor(quote: Column, body: Column) -> Column:
    """The longest begin (24, 16 or 12 characters) of a quote that the body
    has, else the longest such end; null without any. Both in one form already."""
    tries = [F.when((F.length(quote) >= n) & F.contains(body, cut(quote, F.lit(n))), cut(quote, F.lit(n))) for cut in (F.left, F.right) for n in (24, 16, 12)]
    return F.coalesce(*tries)


def tier_on_record(verify_tier: Column, verify_method: Column, quote_verified: Column) -> Column:
    """The tier of a stored quote: the newer field, else the older one if it is
    a tier, else what the flag says."""
    known = F.when(verify_method.isin("exact", "partial", "fabricated", "not_found"), verify_method)
    return F.coalesce(verify_tier, known, F.when(quote_verified, "exact").otherwise("not_found"))


def extracted_claims(answers: DataFrame, form) -> tuple[DataFrame, DataFrame]:
    """Claims and quotes of recorded answers.

    answers: chunk_id, course_id, start_index, text, items (array of struct of
    name, definition, aliases, type, importance, numbers, note, evidence: array
    of struct of quote, page_label, evidence_type). An item without a name, or
    whose definition has under ten characters, is left out; up to five aliases,
    ten numbers and four quotes are kept; ids count on from start_index within
    a chunk. Every quote is judged on the text of its chunk, and the tiers give
    the claim's confidence; a claim without quotes has C.
    """
    name = lambda x: F.regexp_replace(F.trim(F.coalesce(x["name"], F.lit(""))), r"^[。.]+|[。.]+$", "")
    kept = F.filter("items", lambda x: (name(x) != "") & (F.length(F.trim(F.coalesce(x["definition"], F.lit("")))) >= 10))
    each = answers.select("chunk_id", "course_id", "start_index", "text", F.posexplode(kept).alias("i", "x"))
    kp_id = F.concat("course_id", F.lit("-KP-"), F.lpad((F.col("start_index") + F.col("i")).cast("string"), 4, "0"))
    rows = each.withColumn("kp_id", kp_id)
    quotes = rows.select("kp_id", "chunk_id", "text", F.posexplode(F.slice(F.coalesce("x.evidence", F.array().cast(answers.schema["items"].dataType.elementType["evidence"].dataType)), 1, 4)).alias("j", "e"))
    quote = F.trim(F.coalesce("e.quote", F.lit("")))
    judged = quotes.select(F.concat("kp_id", F.lit("-E"), (F.col("j") + 1).cast("string")).alias("evidence_id"), "kp_id", "chunk_id", quote.alias("quote"), F.coalesce("e.page_label", F.lit("")).alias("page_label"), F.coalesce("e.evidence_type", F.lit("讲解")).alias("evidence_type"), quote_tier(form(quote), form(F.col("text"))).alias("verify_method"))
    evidence = judged.withColumn("quote_verified", F.col("verify_method") == "exact")
    grades = evidence.groupBy("kp_id").agg(confidence(F.col("verify_method")).alias("confidence"), F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
    strings = F.array().cast("array<string>")
    importance = F.coalesce(F.when(F.col("x.importance").cast("string").rlike(r"^\d+$"), F.col("x.importance").cast("int")), F.lit(3))
    claims = rows.select(
        "kp_id", "course_id", "chunk_id", name(F.col("x")).alias("name"), F.trim("x.definition").alias("definition"), F.slice(F.filter(F.coalesce("x.aliases", strings), lambda a: F.trim(a) != ""), 1, 5).alias("aliases"),
        F.coalesce("x.type", F.lit("概念")).alias("type"), importance.alias("importance"), F.slice(F.coalesce("x.numbers", strings), 1, 10).alias("numbers"), F.trim(F.coalesce("x.note", F.lit(""))).alias("note"), F.lit("draft").alias("status"),
    )
    return claims.join(grades, "kp_id", "left").withColumns({"confidence": F.coalesce("confidence", F.lit("C")), "evidence_ids": F.coalesce("evidence_ids", strings)}), evidence


def new_files(offered: DataFrame, archive: DataFrame) -> DataFrame:
    """The offered files (name, size, sha256) with what becomes of them: `known`
    (the archive, or an offered file of a smaller name, has the content, told by
    size and hash), or `add` under `stored_as`: the own name, with the begin of
    the hash before the suffix where the archive has the name already."""
    from pyspark.sql import Window

    have = archive.select("size", "sha256").distinct().withColumn("_have", F.lit(True))
    names = archive.select("name").distinct().withColumn("_taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy("size", "sha256").orderBy("name"))
    met = offered.select("name", "size", "sha256").distinct().withColumn("_i", first).join(have, ["size", "sha256"], "left").join(names, "name", "left")
    again = F.row_number().over(Window.partitionBy("name").orderBy("sha256"))
    stem, suffix = F.regexp_replace("name", r"(\.[^./]*)$", ""), F.regexp_extract("name", r"(\.[^./]*)$", 1)
    known = F.col("_have").isNotNull() | (F.col("_i") > 1)
    other = F.coalesce("_taken", F.lit(False)) | (F.col("_same") > 1)
    return met.withColumn("_same", again).select("name", "size", "sha256", F.when(known, "known").otherwise("add").alias("outcome"), F.when(~known, F.when(other, F.concat(stem, F.lit("-"), F.left("sha256", F.lit(8)), suffix)).otherwise(F.col("name"))).alias("stored_as"))


def row_token(df: DataFrame) -> Column:
    """A hash of a whole row, its columns in the order of their names; it
    changes with any of them."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


#: What makes a claim another one if it is edited.
MEANING = ["name", "definition", "note", "numbers"]


def edited_claims(claims: DataFrame, edits: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims and findings after edits, and the edits that are refused.

    edits: kp_id, token, and any columns of claims; a null leaves the field. An
    edit is taken if its token is that of the row as it is (see `row_token`) and
    it is the only one of its claim; others are refused with a reason: stale,
    repeated or unknown. One that changes the meaning makes the claim `pending`,
    supersedes its findings (kp_id, status, superseded) and adds one of type
    `edited_content`; other edits leave status and findings. What changes
    nothing is taken without effect.
    """
    fields = [c for c in edits.columns if c not in ("kp_id", "token")]
    one = edits.groupBy("kp_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("token", *fields)).alias("_e"))
    met = claims.withColumn("_token", row_token(claims)).join(one, "kp_id", "left")
    taken = F.coalesce((F.col("_n") == 1) & (F.col("_e.token") == F.col("_token")), F.lit(False))
    changes = [taken & F.col(f"_e.{c}").isNotNull() & ~F.col(f"_e.{c}").eqNullSafe(F.col(c)) for c in fields if c in MEANING]
    other = F.array_contains(F.array(*changes), True) if changes else F.lit(False)
    made = {c: F.when(taken, F.coalesce(F.col(f"_e.{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    marked = met.withColumns({"_other": other, **{f"_new_{c}": v for c, v in made.items()}})
    status = F.when(F.col("_other"), F.lit("pending")).otherwise(F.col("status"))
    out = marked.select(*((status if c == "status" else F.col(f"_new_{c}") if c in fields else F.col(c)).alias(c) for c in claims.columns))
    touched = marked.filter("_other").select("kp_id").distinct()
    after = out.join(touched, "kp_id", "left_semi")
    kept = findings.join(touched.withColumn("_gone", F.lit(True)), "kp_id", "left")
    old = kept.select(*(F.when(F.col("_gone"), {"status": F.lit("ignored"), "superseded": F.lit(True)}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "superseded") else F.col(c) for c in findings.columns))
    new = after.select(F.concat(F.lit("edit-"), "kp_id", F.lit("-"), F.left(row_token(after), F.lit(16))).alias("audit_id"), "kp_id", F.lit("edited_content").alias("type"), F.lit("P0").alias("priority"), F.lit("pending").alias("status"), F.lit(False).alias("superseded"))
    now = claims.select("kp_id", row_token(claims).alias("_token")).distinct()
    several = edits.groupBy("kp_id").agg(F.count(F.lit(1)).alias("_n"))
    judged = edits.join(now, "kp_id", "left").join(several, "kp_id")
    reason = F.when(F.col("_token").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(F.col("token") != F.col("_token"), "stale")
    return out, old.unionByName(new, allowMissingColumns=True), judged.withColumn("reason", reason).filter("reason is not null").select("kp_id", "token", "reason")


def without_duplicates(rows: DataFrame, declared: DataFrame, used: DataFrame, column: str = "source_file") -> DataFrame:
    """The rows without the files that are declared (drop, keep) as copies of
    others. ValueError if one that stays is not there, or one that goes is still
    used (`used`: the same column)."""
    there = rows.select(column).distinct()
    missing = declared.select(F.col("keep").alias(column)).distinct().join(there, column, "left_anti")
    still = declared.select(F.col("drop").alias(column)).distinct().join(used.select(column).distinct(), column, "left_semi")
    for what, df in (("is not there to stay", missing), ("is still used", still)):
        if found := df.limit(1).collect():
            raise ValueError(f"{found[0][column]} {what}")
    return rows.join(declared.select(F.col("drop").alias(column)).distinct(), column, "left_anti")
