from __future__ import annotations

from pyspark.sql import functions as F

from tracebook.functions import links as L


def values(spark, items, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_addresses(spark):
    urls = ["https://www.a.example.com/p?q", "http://x.ac.uk:80/", "ftp://a.b", "https://user@a.b/", "https://a b.c", None, "https://localhost/x", "https://Data.Gov/x"]
    assert values(spark, urls, L.is_web_address) == [True, True, False, False, False, False, True, True]
    assert values(spark, urls, L.web_origin) == ["example.com", "x.ac.uk", None, None, None, None, "localhost", "data.gov"]
    assert values(spark, urls, L.is_primary) == [False, True, False, False, False, False, False, True]


def test_revision_and_statements(spark):
    df = spark.createDataFrame([("d", ["1", "2"], "n"), ("d", None, None), (None, [], " ")], "d string, n array<string>, o string")
    rows = df.select(L.revision(F.col("d"), F.col("o")).alias("r"), L.statements(F.col("d"), F.col("n"), F.col("o")).alias("s")).collect()
    assert len({r["r"] for r in rows}) == 3
    assert [[(x["id"], x["text"]) for x in r["s"]] for r in rows] == [[("definition", "d"), ("number-1", "1"), ("number-2", "2"), ("note", "n")], [("definition", "d")], [("definition", "")]]


def test_questions(spark):
    assert values(spark, ["1. a\n2、b\n 3) c", "1. only", "no", None], L.question_numbers) == [[1, 2, 3], [], [], []]
    got = spark.createDataFrame([([1, 3], [1, 2, 3])], "a array<int>, e array<int>").select(L.question_coverage(F.col("a"), F.col("e")).alias("c")).first()["c"]
    assert (got["answered"], got["missing"]) == ([1, 3], [2])


def test_choice_questions(spark):
    block = "1. which\nA. x B. y C. z\n2. why\nno choices\n第3题：how\nA、x\nB、y\nC、z\n4) and A. only"
    assert values(spark, [block, "1. a A. B. C.", None, "1. Q\nA. a\nB. b\nC. c\n2. Q\nA 一\nB 二\nC 三\n1. Q A. B. C.x"], L.choice_questions) == [[1, 3], [], [], [1, 2]]


def test_source_quality(spark):
    df = spark.createDataFrame([("https://x.gov.cn/a", None), ("https://www.springer.com/a", 0), ("https://b.com", 3), ("https://b.com", None)], "u string, a int")
    assert [r["y"] for r in df.select(L.source_quality(F.col("u"), F.col("a")).alias("y")).collect()] == [1.0, 1.0, 0.85, 0.6]
