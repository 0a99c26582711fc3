"""Problem 3: names that look the same, and quotes found once they are read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebook.functions.text import without_whitespace
from tracebook.llm.lookalike import accepted_repairs, base_and_tokens, one_form, quote_and_tokens, readable_forms, vocabulary, widest_form, with_repairs
from tracebook.sources.tables import stage, table


def quotes_to_test(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence_id, page, source_file, page_no, quote: the quotes that are not in
    the page they cite as stored, but are once every look-alike is folded, which
    all quotes are that any repair can find. Only what is not there as stored is
    folded, and each page once."""
    p = pages.select("source_file", "page_no", F.concat("file_id", F.lit("#"), "page_no").alias("page"), without_whitespace(F.col("text")).alias("p"))
    met = evidence.select("evidence_id", "source_file", "page_no", "quote", without_whitespace(F.col("quote")).alias("q")).join(p, ["source_file", "page_no"]).filter(~F.contains("p", "q"))
    missing = stage(met.select("evidence_id", "page", "source_file", "page_no", "quote", F.md5("p").alias("h")).distinct(), "missing")
    wanted = pages.join(missing.select("source_file", "page_no").distinct(), ["source_file", "page_no"], "left_semi")
    wide = wanted.select(F.concat("file_id", F.lit("#"), "page_no").alias("page"), F.md5(without_whitespace(F.col("text"))).alias("h"), widest_form("text").alias("w"))
    held = missing.withColumn("v", widest_form("quote")).filter("v <> ''").join(wide, ["page", "h"]).filter(F.contains("w", "v"))
    return held.select("evidence_id", "page", "source_file", "page_no", "quote").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, key_a, key_b. Names and quotes that are null or blank in the one
    form are in no pair; a quote whose page is not there is in none either."""
    kp = table(spark, sf_dir, "kp").select("kp_id", "name").filter(F.col("kp_id").isNotNull() & F.col("name").isNotNull()).distinct()
    evidence = table(spark, sf_dir, "evidence").select("evidence_id", "source_file", "page_no", "quote").filter(F.col("quote") != "")
    pages = table(spark, sf_dir, "pages").select("file_id", "source_file", "page_no", "text").filter(F.col("text") != "")

    names = stage(kp.select("kp_id", "name", base_and_tokens("name").alias("b")).select("kp_id", "name", "b.*"), "names")
    tested = stage(quotes_to_test(evidence, pages), "tested")
    quotes = stage(tested.select("evidence_id", "page", quote_and_tokens("quote").alias("b")).select("evidence_id", "page", "b.*").withColumn("row", F.monotonically_increasing_id()), "quotes")
    cited = pages.join(tested.select("source_file", "page_no").distinct(), ["source_file", "page_no"], "left_semi")
    sheets = stage(cited.distinct().select(F.concat("file_id", F.lit("#"), "page_no").alias("page"), base_and_tokens("text").alias("b")).select("page", "b.*").withColumn("row", F.monotonically_increasing_id()), "sheets")

    token = F.explode("tokens").alias("token")
    words = stage(vocabulary([pages.select("text"), evidence.select(F.col("quote").alias("text")), kp.select(F.col("name").alias("text"))]), "vocabulary")
    accepted = stage(accepted_repairs(names.select(token).union(quotes.select(token)).union(sheets.select(token)), words), "repairs")

    formed = names.join(with_repairs(names, ["kp_id", "name"], F.col("tokens"), accepted), ["kp_id", "name"], "left").select("kp_id", "name", one_form("base", "repairs").alias("form")).filter("form <> ''")
    spellings = formed.groupBy("form").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low <> high").select("form")
    alike = formed.join(spellings, "form", "left_semi")
    pairs = alike.alias("a").join(alike.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.kp_id") < F.col("b.kp_id")) & (F.col("a.name") != F.col("b.name")))
    by_name = pairs.select(F.lit("kp.name").alias("field"), F.col("a.kp_id").alias("key_a"), F.col("b.kp_id").alias("key_b"))

    of_quote = quotes.join(with_repairs(quotes, ["row"], F.col("tokens"), accepted), "row", "left").select("evidence_id", "page", one_form("base", "repairs").alias("q"))
    of_page = sheets.join(with_repairs(sheets, ["row"], F.col("tokens"), accepted), "row", "left").select("page", one_form("base", "repairs").alias("p"))
    held = of_quote.join(of_page, "page").filter(F.contains("p", "q"))
    return by_name.union(held.select(F.lit("evidence.quote"), "evidence_id", "page")).distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, key, form: all page texts, quotes and names in the one form."""
    parts = [
        table(spark, sf_dir, "pages").select(F.lit("pages.text").alias("field"), F.concat("file_id", F.lit("#"), "page_no").alias("key"), "text"),
        table(spark, sf_dir, "evidence").select(F.lit("evidence.quote"), "evidence_id", "quote"),
        table(spark, sf_dir, "kp").select(F.lit("kp.name"), "kp_id", "name"),
    ]
    return readable_forms(parts[0].union(parts[1]).union(parts[2]), ["field", "key"])
