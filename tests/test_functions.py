from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracebook.functions.numbers import canonical_numbers, number_appears, quantities
from tracebook.functions.text import chinese_number, citation_form, first_number, flattened, full_match_form, match_form, plain_form, safe_name, search_tokens, tidied, without_whitespace


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


CLAIMS = [("1.5m", "15m", False), ("35m", "350m", False), ("-5", "5", False), ("1.5", ".15", False), ("1.5m", "1.5s", False), ("1.5", "1.50", True), ("0.5", ".5", True), ("1000", "1,000", True), ("1.5–2.5", "1.5 to 2.5", True), ("1.5–2.5", "1.5 to 3.5", False)]
CLAIMS += [("no digits", "", True), ("2e3", "2000", True), ("5 hours", "5h", True), ("20℃", "２０ °c", True), ("3 m2", "3 m²", True), ("5 mx", "5 m", True), ("5 m", "5 mx", False), ("7", None, False), (None, "7", True), ("1" * 40, "1" * 40, True), ("1" * 40, "1" * 39 + "2", False)]


def test_numbers_with_units(spark):
    rows = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(CLAIMS)], "i int, c string, t string").select("i", number_appears(F.col("c"), F.col("t")).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in rows} == {i: ok for i, (*_, ok) in enumerate(CLAIMS)}
    assert [tuple(q) for q in one(spark, "1,500 kPa, then -3.0 or 4 km/h", quantities)] == [("1500.000000000000000000", "kpa"), ("-3.000000000000000000", ""), ("4.000000000000000000", "km")]


def test_canonical_numbers(spark):
    assert one(spark, "1,000 and 1.50, 007 or 10.00", canonical_numbers) == ["1000", "1.5", "7", "10"]
    assert one(spark, None, canonical_numbers) is None


def test_plain_form_keeps_ranges_and_points(spark):
    assert one(spark, "Convec-\ntion  “A”", plain_form) == 'convection"a"'
    assert one(spark, "10-20 or 10–20", plain_form) == "1020or10-20"
    assert one(spark, "1.5", plain_form) != one(spark, "15", plain_form)


def test_match_form_folds_ligatures_and_marks(spark):
    assert full_match_form("ﬁre Q̇") == "fireq"
    rows = spark.createDataFrame([("ﬂow",), (None,), ("",)], "x string").select(match_form("x").alias("y"), citation_form("x").alias("z")).collect()
    assert [r["y"] for r in rows] == ["flow", "", ""] and rows[0]["z"] == "flow"


def test_text_helpers(spark):
    assert one(spark, " a\t\nb　c ", flattened) == "a b c"
    assert one(spark, " a \r\n\r\n\r\n\r\n b　", tidied) == "a\n\nb"
    assert one(spark, "a b\tc\r\nd　e", without_whitespace) == "abcd　e"
    assert sorted(one(spark, "Fire 火灾探 x1 火", search_tokens)) == sorted(["fire", "x1", "火灾", "灾探", "火"])
    assert one(spark, "第 12 页", first_number) == 12 and one(spark, "p. 0", first_number) is None and one(spark, "iv", first_number) is None
    assert one(spark, "a/b c:d", safe_name) == "a_b_c_d"
    assert [one(spark, x, chinese_number) for x in ("十", "十二", "二十", "三十一", "七", "15", "百")] == [10, 12, 20, 31, 7, 15, None]
