from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracebook.operators import titles as T
from tracebook.operators.answers import answer_segments, recovered
from tracebook.operators.layout import overlay, paragraphs_of, recognised_paragraphs
from tracebook.operators.recordings import name_time, page_selection
from tracebook.sources.package import additions, page_conflicts, read_package, scoped, write_package


def values(spark, items, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, ["目 录", "Appendix A Data", "附录1", "Contents of the tank", None], T.title_kind) == ["matter", "appendix", "appendix", "body", "body"]
    assert values(spark, ["Smoke layer", "a b", "x" * 47, "one, two, three, four", None, "烟"], T.plausible_title) == [True, False, False, False, False, True]
    assert values(spark, ["第十二章 烟气", "Chapter 3  Layer", "Layer", None], T.chapter_number) == [12, 3, None, None]
    assert values(spark, ["ii    Chapter 1  Layer", "Layer of hose    12", "Layer"], T.clean_title) == ["Chapter 1 Layer", "Layer of hose", "Layer"]
    assert values(spark, ["intro\n1.2 Heat of hose\n第3章 烟气", "1.2 Heat of hose", "plain", ""], T.detected_section) == ["第3章 烟气", "1.2 Heat of hose", None, None]


def test_header_chapters(spark):
    rows = [("s", n, f"{'Chapter 1  Heat' if n < 5 else 'Chapter 2  Mass'}    {n}\nbody text of the page, with words, and stops, here.") for n in range(1, 9)] + [("s", 9, "Alone\nx"), ("t", 1, None)] + [("u", n, "Book of all\nrest") for n in range(1, 6)]
    got = sorted((r["source_file"], r["key"], r["page_start"], r["page_end"], r["pages"]) for r in T.header_chapters(spark.createDataFrame(rows, "source_file string, page_no int, text string")).collect())
    assert got == [("s", "#ch1", 1, 4, 4), ("s", "#ch2", 5, 8, 4)]


def test_layout(spark):
    boxes = [(0, 0, 50, 10, "The", 0.9), (60, 1, 90, 11, "gate", 0.7), (0, 12, 50, 22, "holds", 0.8), (0, 60, 50, 70, "烟气", 1.0), (60, 60, 90, 70, "层", 0.5)]
    assert [(t, round(s, 2), n) for t, s, n in paragraphs_of(boxes)] == [("The gate holds", 0.8, 2), ("烟气层", 0.75, 1)]
    df = spark.createDataFrame([("s", 1, *b) for b in boxes] + [("s", 1, 0, 0, 1, 1, " ", 1.0)], "source_file string, page_no int, x0 int, y0 int, x1 int, y1 int, text string, score double")
    found = recognised_paragraphs(df)
    assert found.count() == 2 and recognised_paragraphs(df.limit(0)).count() == 0
    pages = spark.createDataFrame([("s", 1, None, 0, "text_layer", None, True), ("s", 2, "own", 3, "text_layer", None, False)], "source_file string, page_no int, text string, char_count int, text_source string, ocr_confidence double, is_scan boolean")
    got = {r["page_no"]: (r["text"], r["text_source"], r["is_scan"]) for r in overlay(pages, found).collect()}
    assert got == {1: ("The gate holds\n\n烟气层", "ocr", True), 2: ("own", "text_layer", False)}


def test_answers(spark):
    whole = {"segments": [{"text": "the gate holds", "source_id": "a"}, {"text": "so 2+2 is 4", "basis": "calculation", "support_quote": "the gate"}, {"text": "Next", "basis": "transition"}, {"text": "invented", "source_id": "a"}, {"text": "then 3", "basis": "calculation", "support_quote": "the gate"}]}
    raw = "```json\n" + json.dumps(whole) + "\n```"
    assert len(recovered(raw)) == 5 and len(recovered(raw[:100])) == 1 and recovered(None) == [] and recovered("no json") == []
    answers = spark.createDataFrame([(1, raw), (2, None)], "answer_id int, raw string")
    sources = spark.createDataFrame([(1, "a", "Here  the gate holds."), (9, "a", "other")], "answer_id int, id string, original string")
    got = [r["status"] for r in answer_segments(answers, sources).orderBy("segment_no").collect()]
    assert got == ["cited", "cited", "normal", "unsupported", "unsupported"]


def test_names_and_selections(spark):
    got = values(spark, ["2026-03-27 09.08 lesson.m4a", "录音 2026年04月08日 02点35分.wav", "x 20250513_110825.aac", "rec 2026.3.9.mp3", "voice02539", "2026-02-31", None], name_time)
    assert [(g["day"], g["minute"]) for g in got] == [(dt.date(2026, 3, 27), 548), (dt.date(2026, 4, 8), 155), (dt.date(2025, 5, 13), 668), (dt.date(2026, 3, 9), None), (None, None), (None, None), (None, None)]
    assert values(spark, ["5,20,1-3", "x,2", "9-1", "", "1-2，2"], page_selection) == [[1, 2, 3, 5, 20], [2], [], [], [1, 2]]


def test_packages(spark, tmp_path):
    tables = {
        "kp": spark.createDataFrame([("k1", "C"), ("k2", "D")], "kp_id string, course string"),
        "evidence": spark.createDataFrame([("e1", "k1", "s", 1), ("e2", "k2", "s", 2)], "evidence_id string, kp_id string, source_file string, page_no int"),
        "pages": spark.createDataFrame([("s", 1, "text x"), ("s", 2, "other"), ("s", 2, "other")], "source_file string, page_no int, text string"),
    }
    write_package(scoped(tables, "C"), str(tmp_path / "p.zip"))
    data = (tmp_path / "p.zip").read_bytes()
    back = read_package(spark, data)
    assert [r["kp_id"] for r in back["kp"].collect()] == ["k1"] and back["pages"].first()["text"] == "text x"
    assert additions(back["kp"], tables["kp"], "kp_id").count() == 0 and page_conflicts(back["pages"], tables["pages"]).count() == 0
    write_package({"kp": tables["kp"].union(tables["kp"])}, str(tmp_path / "q.zip"))
    with pytest.raises(ValueError):
        read_package(spark, (tmp_path / "q.zip").read_bytes())


def test_package_names():
    from tracebook.sources.package import unsafe

    assert all(unsafe(n) for n in ("/a", "a/../b", "C:a", "con.jsonl", "a/LPT1", "x.", "a\\..\\b", "q?")) and not any(unsafe(n) for n in ("kp.jsonl", "a/b.txt", "console.txt"))


def test_framing_does_not_end_what_calculations_take():
    from tracebook.operators.answers import judged

    parts = [{"text": "smoke layer", "source_id": "s"}, {"text": "补充说明：\n"}, {"text": "5 + 5 = 10", "basis": "calculation", "support_quote": "layer is"}, {"text": "odd"}, {"text": "6", "basis": "calculation"}]
    assert [x[3] for x in judged(parts, {"s": "the smoke layer is"}, lambda t: t)] == ["cited", "normal", "cited", "unsupported", "unsupported"]


def test_courses_by_containment(spark):
    from tracebook.operators.courses import match_course

    courses = spark.createDataFrame([("C1", "消防给水", ["WS"]), ("C2", "消防给水工程", None), ("C3", "Fire", [])], "course_id string, name string, aliases array<string>")
    df = spark.createDataFrame([(1, "消防给水排水工程", None), (2, "消防 给水工程学", None), (3, "ws", None), (4, "none", "Fire Dynamics"), (5, "xy", None), (6, None, None)], "i int, a string, b string")
    assert {r["i"]: r["matched_course"] for r in match_course(df, courses, ["a", "b"]).collect()} == {1: "C1", 2: "C2", 3: "C1", 4: "C3", 5: None, 6: None}
