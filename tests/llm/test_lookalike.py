"""One form for text that looks the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebook.llm import lookalike as L


def test_base_form_keeps_what_counts():
    assert L.base_form("ﬁre　ＡＢ１​­x‑y") == "fire AB1x-y"
    assert L.base_form("Rôle") == "Rôle" != L.base_form("Role") and L.base_form("m²") != L.base_form("m2")
    assert L.base_form("⽕ 度") == "火 度" and L.base_form("ϲold") == "cold" and L.base_form("a  b\n c") == "a b\n c"


def test_spellings_by_dominant_script():
    assert L.spellings("cаnopy")[0] == "canopy" and L.spellings("canopy") == () and L.spellings("при") == ()
    assert L.spellings("нaсос")[0] == "насос" and L.scripts_in("нaсос") == ("CYRILLIC", "LATIN")
    assert L.spellings("νaός")[0] == "ναός"  # Greek with a Latin a
    assert L.spellings("саnору") == ("canopy",)  # more Cyrillic letters, but n has no look-alike there
    assert L.spellings("сор") == () and L.spellings("сор", True)[0] == "cop" and L.spellings("Т", True)[0] == "T"
    assert L.apply_repairs("cаnopy bеd", {"cаnopy": "canopy"}) == "canopybеd"
    assert L.substituted("аb аb аb", {"^аb": "Xb", "$аb": "aY"}) == "Xb аb aY"


def test_tokens_alone_of_their_script():
    assert L.repairable("the fаn іѕ on") == ["fаn", "іѕ"] and L.repairable("вынести сор из дома") == [] and L.repairable("the fan is on") == []
    assert L.repairable("вынести сор\nthe сор") == ["сор"]


def forms(spark, rows):
    return {r["k"]: r["form"] for r in L.readable_forms(spark.createDataFrame(rows, "k string, text string, base string"), ["k"]).collect()}


def test_both_directions_and_single_scripts(spark):
    rows = [("ru", "насос и сор", ""), ("mix", "большой нaсос", ""), ("one", "сор", ""), ("beside", "cop сор", ""), ("en", "cop", ""), ("gr", "ναός", ""), ("gm", "νaός", "")]
    assert forms(spark, rows) == {"ru": "насос и сор", "mix": "большой насос", "one": "сор", "beside": "cop сор", "en": "cop", "gr": "ναός", "gm": "ναός"}


def test_wrong_script_by_frequency(spark):
    rows = [(str(i), "it is on", "") for i in range(30)] + [("a", "it іѕ on", ""), ("b", "unit Т-12", ""), *[(f"t{i}", "unit T-12", "") for i in range(30)]]
    got = forms(spark, rows)
    assert got["a"] == "it is on" and got["b"] == "unit T-12"


def test_readable_forms(spark):
    rows = [("a", "the cаnopy  ｅxit", "x"), ("a", "the cаnopy  ｅxit", "x"), ("b", "the canopy", "x"), ("c", None, "x"), ("d", "", "x"), ("e", "zqxаv ﬁre\n on", "x")]
    assert forms(spark, rows) == {"a": "the canopy exit", "b": "the canopy", "c": None, "d": "", "e": "zqxаv fire on"}
    assert L.readable_forms(spark.createDataFrame([], "k string, text string"), ["k"]).count() == 0


def test_cut_words_at_the_edges_of_quotes(spark):
    words = spark.createDataFrame([("canopy", 3), ("exit", 1)], "word string, n long")
    quotes = spark.createDataFrame([(1, "nоpy or ехi")], "id int, quote string").select("id", L.quote_and_tokens("quote").alias("b")).select("id", "b.*")
    accepted = L.accepted_repairs(quotes.select(F.explode("tokens").alias("token")), words)
    assert {r["token"]: r["fixed"] for r in accepted.collect()} == {"^nоpy": "nopy", "$ехi": "exi"}
    got = quotes.join(L.with_repairs(quotes, ["id"], F.col("tokens"), accepted), "id", "left").select(L.one_form("base", "repairs").alias("f")).first()
    assert got["f"] == "nopyorexi"
