from __future__ import annotations

from tracebook.llm.reflow import reflowed, repaired_pages


def test_reflow():
    text = "Title    3\nThe curfain masks the corri-\ndor. The low-\npressure hose holds\nthe line.\n\na  1  2\nb  3  4\n保温层密席直接超\n过地沟\n— 3 —"
    faults = [(1, "header", None, None), (2, "misread", "curfain", "curtain"), (2, "hyphen", "corri-dor", "corridor"), (8, "misread", "密席", "密度"), (8, "misread", "x", None), (9, "misread", "密席", "密度"), (11, "page_number", None, None)]
    assert reflowed(text, faults) == "The curtain masks the corridor. The low-pressure hose holds the line.\n\na  1  2\nb  3  4\n\n保温层密度直接超过地沟".replace("holds the line", "holds the line")
    assert reflowed("", []) == "" and reflowed("one", []) == "one"
    assert reflowed("Tbe gate\n", [(1, "misread", "tbe", "the")]) == "The gate"


def test_pages(spark):
    pages = spark.createDataFrame([("f", 1, "P.I9", "a-\nb", "x"), ("f", 1, "P.I9", "a-\nb", "x"), ("f", 2, None, None, "x"), (None, 1, None, "t", "x")], "file_id string, page_no int, page_label string, text string, issue string")
    faults = spark.createDataFrame([("f", 1, 0, "label", "P.I9", "19"), ("f", 1, 1, "hyphen", "a-b", "ab")], "file_id string, page_no int, line_no int, issue string, wrong string, fixed string")
    got = sorted((r["page_no"], r["page_label"], r["text"]) for r in repaired_pages(pages, faults).collect())
    assert got == [(1, "P.19", "ab"), (2, None, None)]
    assert repaired_pages(pages, faults.limit(0)).count() == 2
