"""Chapters from contents, headers and headings, and their review."""

from __future__ import annotations

import pytest

from tracebook.operators import skeleton as S

PAGES = "source_file string, page_no int, text string, title string"


def pages():
    toc = "目录\n第一章 烟气流动 ........ 1\n第二章  喷头 …… 9\n第三章 没有正文 .... 20"
    rows = [("a", 1, toc), ("a", 2, "第一章 烟气流动\n正文"), ("a", 3, "正文"), ("a", 4, "第 2 章 喷头\n正文"), ("a", 5, "正文"), ("a", 5, "正文")]
    rows += [("b", n, ("Chapter 1 Layers" if n < 4 else "Chapter 2 Hoses") + "\nwords of the page.") for n in range(1, 7)]
    rows += [("c", 1, "words. and words, more words, yes.\n第三章 单页\ntext"), ("c", 2, "plain, words, only, here.")]
    rows += [("d", 1, None), ("d", 2, "no chapter, at all, in, this.")]
    return [(*r, "clash") for r in rows]


def test_contents_before_headers_before_headings(spark):
    got = {(r["source_file"], r["num"]): (r["title"], r["page_start"], r["page_end"], r["found_by"]) for r in S.built_skeleton(spark.createDataFrame(pages(), PAGES)).collect()}
    assert got == {
        ("a", 1): ("烟气流动", 2, 3, "contents"), ("a", 2): ("喷头", 4, 5, "contents"), ("b", 1): ("Chapter 1 Layers", 1, 3, "headers"), ("b", 2): ("Chapter 2 Hoses", 4, 6, "headers"), ("c", 3): ("第三章 单页", 1, 2, "headings"),
    }
    assert S.built_skeleton(spark.createDataFrame([], PAGES)).count() == 0


def test_contents_list_each_chapter_once(spark):
    df = spark.createDataFrame([("a", 1, "Chapter 1 Smoke layers ..... 3\nChapter 2 Hoses    12"), ("a", 2, "Chapter 1 Again .... 9"), ("b", 1, "第一章 孤 ... 2")], "source_file string, page_no int, text string")
    assert sorted((r["num"], r["title"], r["printed"], r["listed_on"]) for r in S.contents_entries(df).collect()) == [(1, "Smoke layers", 3, 1), (2, "Hoses", 12, 1)]


def test_review(spark):
    rows = [("f", 1, "Preface", 1, 2), ("f", 2, "Chapter 1 Layers", 3, 9), ("f", 3, "1.2 Depth", 4, 5), ("f", 4, "Odd title", 6, 7), ("f", 5, "Other title", 8, 8), ("f", 6, "https://x", 9, 9), ("f", 7, "Third title", 10, 11), ("g", 1, "一、概述", 1, 1)]
    chapters = spark.createDataFrame(rows, "source_file string, num int, title string, page_start int, page_end int")
    verdicts = spark.createDataFrame([("f", "Odd title", "section", "odd words"), ("f", "Other title", "noise", "not there"), ("f", "Third title", "noise", " "), ("f", "Preface", "chapter", "p")], "source_file string, title string, verdict string, quote string")
    heads = spark.createDataFrame([("f", 6, "some odd words here"), ("f", 8, "text"), ("f", 1, "p")], "source_file string, page_no int, text string")
    got = {(r["source_file"], r["title"]): (r["num"], r["no"], r["verdict"], r["by"]) for r in S.reviewed_skeleton(chapters, verdicts, heads).collect()}
    assert got == {
        ("f", "Preface"): (1, None, "matter", "rule"), ("f", "Chapter 1 Layers"): (2, None, "chapter", "rule"), ("f", "1.2 Depth"): (2, 1, "section", "rule"), ("f", "Odd title"): (2, 2, "section", "quote"),
        ("f", "Other title"): (3, None, "chapter", "open"), ("f", "Third title"): (4, None, "chapter", "open"), ("g", "一、概述"): (0, 1, "section", "rule"),
    }
    with pytest.raises(ValueError):
        S.reviewed_skeleton(spark.createDataFrame([("f", 1, "x", 3, 2)], chapters.schema), verdicts, heads)
