"""Chunks behind quotes, printed pages, chunks without chapters, titles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracebook.functions.text import plain_form
from tracebook.operators import pages as P
from tracebook.operators import printed as R
from tracebook.operators import provenance as V
from tracebook.operators import titles as T


def values(spark, xs, make):
    return [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_chunk_keys(spark):
    got = values(spark, ["C::t-1::p8", "C::t::p8-12", "C::p8-12", "C::t::p8-12::h1a2b", "C::0007", "C::t::p9-3", "", None], V.parsed_key)
    assert [None if g is None else tuple(g) for g in got] == [("C", "t-1", 8, 8), ("C", "t", 8, 12), ("C", None, 8, 12), ("C", "t", 8, 12), None, None, None, None]
    assert values(spark, ["C::0007", "C::p7", None], V.is_legacy_key) == [True, False, False]
    made = spark.createDataFrame([("C", "t", 3, 3), ("C", None, 3, 5)], "c string, t string, a int, b int").select(V.chunk_key(F.col("c"), F.col("t"), F.col("a"), F.col("b")).alias("k"))
    assert {r["k"] for r in made.collect()} == {"C::t::p3", "C::p3-5"}


def test_quotes_rechecked_in_three_tiers(spark):
    text = "the smoke layer was thirty one metres deep in the hall of the tower"
    chunks = spark.createDataFrame([("C", "t", 1, 2, text), ("C", "u", 1, 2, "other words"), ("C", "u", 5, 6, text), ("C", "v", 5, 6, "nothing")], "course string, tag string, page_start int, page_end int, text string")
    pages = spark.createDataFrame([("C", 8, "the smoke layer was thirty one"), ("C", 9, "metres deep in the hall of the tower"), ("C", 9, "metres deep in the hall of the tower"), ("C", 10, None)], "course string, page_no int, text string")
    rows = [("a", "C::t::p1-2", text, "exact"), ("a", "C::t::p1-2", text, "exact"), ("b", "C::x::p5-6", text, "partial"), ("c", "C::x::p8-9999999", "thirty one metres deep", None), ("d", "C::x::p50", text, "exact"), ("e", "C::0001", text, None), ("f", "C::u::p1-2", text, "exact"), ("g", None, None, None)]
    evidence = spark.createDataFrame([(*r, "clash") for r in rows], "evidence_id string, chunk_id string, quote string, verify_method string, tag string")
    checked = V.rechecked(evidence, chunks, pages, plain_form)
    assert {r["evidence_id"]: tuple(r)[1:] for r in checked.collect()} == {
        "a": ("exact", "exact", "key", 1), "b": ("partial", "exact", "pages", 2), "c": (None, "exact", "range", 1), "d": ("exact", "exact", "unmatched", 0), "e": (None, None, "unmatched", 0), "f": ("exact", "not_found", "key", 1), "g": (None, None, "unmatched", 0),
    }
    assert {(r["before"], r["tier"]): (r["n"], r["unmatched"], r["ambiguous"]) for r in V.recheck_summary(checked).collect()}["partial", "exact"] == (1, 0, 1)
    with pytest.raises(ValueError, match="4 of 7"):
        V.guard_recheck(checked)
    assert V.guard_recheck(checked, 0.6) is checked and V.rechecked(evidence.limit(0), chunks, pages, plain_form).count() == 0


def test_chunks_still_open_and_keys_migrated(spark):
    chunks = spark.createDataFrame([("C::t::p1", "f1", "C", "t", 1, 1), ("C::t::p2-3", "f2", "C", "t", 2, 3), ("C::t::p4", "f4", "C", "t", 4, 4), ("C::u::p4", "f5", "C", "u", 4, 4), ("C::t::p9", None, "C", "t", 9, 9)], "chunk_id string, fingerprint string, course string, tag string, page_start int, page_end int")
    done = spark.createDataFrame([("C::t::p1", "f1"), ("C::t::p2-3", "old"), ("C::t::p9", "x"), ("C::t::p4", None)], "key string, fingerprint string")
    assert {r["chunk_id"] for r in V.open_chunks(chunks, done).collect()} == {"C::t::p2-3", "C::u::p4"}
    old = spark.createDataFrame([("C::p1", None), ("C::t::p1", "f0"), ("C::p4", "z"), ("C::p77", "z"), ("C::0003", "q")], "key string, fingerprint string")
    got = {r["old_key"]: (r["new_key"], r["fingerprint"], r["outcome"]) for r in V.migrated_keys(old, chunks).collect()}
    assert got == {"C::p1": ("C::t::p1", "f1", "moved"), "C::t::p1": ("C::t::p1", "f1", "repeated"), "C::p4": ("C::p4", "z", "unmatched"), "C::p77": ("C::p77", "z", "unmatched"), "C::0003": ("C::0003", "q", "unreadable")}


def test_printed_numbers_and_references(spark):
    files = spark.createDataFrame([("f1", "A"), ("f2", "A"), ("f3", "B"), ("f4", "B")], "file_id string, course string")
    rows = [("file", "f1", "auto", -17), ("file", "f1", "manual", -16), ("course", "A", "auto", 3), ("course", "A", "manual", 4), ("course", "B", "auto", None), ("file", "f3", "odd", 9)]
    offsets = R.effective_offsets(files, spark.createDataFrame(rows, "scope string, name string, source string, offset int"))
    assert {r["file_id"]: (r["offset"], r["scope"], r["source"]) for r in offsets.collect()} == {"f1": (-16, "file", "manual"), "f2": (4, "course", "manual")}
    keys = spark.createDataFrame([("f1", 311), ("f4", 4), ("f4", 5), ("f4", 6), ("f4", 10), ("f4", 1), ("f3", 8)], "file_id string, page_no int")
    anchors = spark.createDataFrame([("f4", 4, 11), ("f4", 5, 14), ("f4", 7, 21), ("f4", 7, 21), ("f1", 3, 3)], "file_id string, index int, printed int")
    known = {(r["file_id"], r["page_no"]): (r["printed"], r["extrapolated"]) for r in R.printed_numbers(keys, offsets, anchors).collect()}
    assert known == {("f1", 311): (295, False), ("f4", 4): (11, False), ("f4", 5): (14, False), ("f4", 6): (18, False), ("f4", 10): (32, True), ("f4", 1): (2, True)}
    shown = spark.createDataFrame([(311, None, 294, False), (10, "第10节", 18, True), (8, "", None, None), (None, None, None, None)], "n int, l string, p int, x boolean").select(R.page_reference(F.col("n"), F.col("l"), F.col("p"), F.col("x")).alias("r"))
    assert [r["r"] for r in shown.collect()] == ["书p294（PDF p311）", "书p≈18（PDF 第10节，推算）", "PDF p8", "PDF ?"]
    schema = "scope string, name string, source string, offset int"
    merged = R.merged_offsets(spark.createDataFrame([("file", "a", "manual", 1), ("file", "b", "auto", 2), ("file", "c", "auto", 3)], schema), spark.createDataFrame([("file", "a", "auto", 9), ("file", "b", "auto", 8), ("file", "d", "auto", 7)], schema))
    assert {r["name"]: (r["source"], r["offset"]) for r in merged.collect()} == {"a": ("manual", 1), "b": ("auto", 8), "c": ("auto", 3), "d": ("auto", 7)}


def test_page_references_of_a_long_file(spark, tmp_path):
    from tracebook.plans.provenance import page_references

    pages = [("f", "C", "f.pdf", n, str(n + 10) if n in (1, 60_000) else None, None) for n in (1, 30_000, 60_000, 60_001)]
    spark.createDataFrame(pages, "file_id string, course string, source_file string, page_no int, page_label string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_no"]: r["reference"] for r in page_references(spark, str(tmp_path)).collect()}
    assert got == {1: "书p11（PDF 11）", 30_000: "书p30010（PDF p30000）", 60_000: "书p60010（PDF 60010）", 60_001: "书p≈60011（PDF p60001，推算）"}


def sequential(rows, limit, least):
    """The same by a plain loop."""
    out, cur = [], None
    for f, n, text in sorted(set(r for r in rows if r[2] and r[2].strip(" "))):
        body = text.strip(" ")
        title = body.split("\n")[0] if body.startswith(("第", "1.")) else None
        chapter = title if title and title.startswith("第") else None
        if cur is None or cur["f"] != f or (chapter and chapter != cur["chapter"]) or cur["n"] + len(body) > limit:
            cur = {"f": f, "n": 0, "chapter": chapter or (cur["chapter"] if cur and cur["f"] == f else None), "section": None, "pages": []}
            out.append(cur)
        if title and not chapter:
            cur["section"] = title
        cur["n"] += len(body)
        cur["pages"].append(n)
    return sorted(((c["f"], c["chapter"], c["section"], c["pages"][0], c["pages"][-1], len(c["pages"])) for c in out if c["n"] >= least), key=repr)


def test_sequential_chunks_against_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for f in "ab":
        for n in range(1, 60):
            head = rng.choice(["", "", "", "第一章 烟气\n", "第二章 喷头\n", "1.2 Layer of smoke\n"])
            rows.append((f, n, head + "x" * rng.choice([0, 5, 40, 90, 400])))
    rows += [rows[3], ("a", 70, None), ("a", 71, "   ")]
    df = spark.createDataFrame([(*r, f"P{r[1]}", "clash") for r in rows], "file_id string, page_no int, text string, page_label string, w string")
    got = P.sequential_chunks(df, limit=300, least=60)
    assert sorted(((r["file_id"], r["chapter"], r["section"], r["page_start"], r["page_end"], r["pages"]) for r in got.collect()), key=repr) == sequential(rows, 300, 60)
    one = got.orderBy("chunk_id").first()
    assert one["text"].startswith("【P") and one["chars"] == len(one["text"]) and P.sequential_chunks(df.limit(0)).count() == 0


def test_files_without_chapters(spark):
    pages = spark.createDataFrame([("a", "pdf"), ("b", "docx"), ("c", None), ("d", "pdf")], "source_file string, source_kind string")
    assert {r["source_file"] for r in P.files_without_chapters(pages, spark.createDataFrame([("d",), (None,)], "source_file string")).collect()} == {"a", "c"}


def test_intervals_do_not_depend_on_ranges(spark):
    keys = spark.createDataFrame([(f"same/long/root/of/all/files/{i:03d}", n) for i in range(40) for n in range(i % 5 + 1)], "source_file string, page_no int")
    want, last = [], 0
    for i in range(40):
        want.append((f"same/long/root/of/all/files/{i:03d}", last + 1, last + i % 5 + 1))
        last += i % 5 + 1
    for parts in (1, 7, 200):
        assert sorted((r["source_file"], r["first_page"], r["last_page"]) for r in P.page_intervals(keys, parts).collect()) == want


def test_title_verdicts(spark):
    cases = {"": "noise", "第三章 烟气": "chapter", "Chapter 4 Layer": "chapter", "附 录 A": "chapter", "Appendix B": "chapter", "目 录": "matter", "Acknowledgements": "matter", "摘要": "matter", "国家标准。": "matter", "doi: 10.1": "noise", "xiv": "noise", "12 - 3": "noise", "表 3 参数": "noise", "x": "noise", "?!?": "noise", "一、概述": "section", "（二）流动": "section", "1.2 Smoke": "section", "3. Layers": "section", "Smoke layer": None}
    assert dict(zip(cases, values(spark, list(cases), T.title_verdict))) == cases and values(spark, [None], T.title_verdict) == ["noise"]
    assert values(spark, ["82防排烟工程", "第2 章_火灾烟气27", "24 防排烟工程", "3D打印", "Layer ..... 12", "第 2 章 流动 23"], T.clean_title) == ["防排烟工程", "第2 章 火灾烟气", "防排烟工程", "3D打印", "Layer", "第 2 章 流动"]
    assert values(spark, ["a \n\n b" + "c" * 300], T.head_text) == ["a b" + "c" * 147]


def test_header_chapters_leave_the_book_title_out(spark):
    rows = []
    for n in range(1, 41):
        head = "Book of Smoke" if n % 2 else ("Chapter 1 Layers" if n < 20 else "Chapter 2 Hoses")
        rows.append(("f", n, head + "\nsome text of the page."))
    rows += [("g", n, ("Late Header" if n > 20 else f"Only once number{'abcdefghijklmnopqrstuvwxyz'[n]}") + "\ntext.") for n in range(1, 31)]
    got = {(r["source_file"], r["title"]): (r["page_start"], r["page_end"], r["pages"]) for r in T.header_chapters(spark.createDataFrame(rows, "source_file string, page_no int, text string")).collect()}
    assert got == {("f", "Chapter 1 Layers"): (2, 18, 9), ("f", "Chapter 2 Hoses"): (20, 40, 11)}
