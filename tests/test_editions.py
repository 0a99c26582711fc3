"""Answers, cards, worksheets, extraction results, recordings' times, runs and displays."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracebook.functions import display as D
from tracebook.functions.text import plain_form
from tracebook.operators import editions as E
from tracebook.operators import recordings as M
from tracebook.operators import retrieval as Q
from tracebook.operators import worklist as W
from tracebook.sources import runs as L


def values(spark, xs, make, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_question_parts_and_follow_ups(spark):
    got = values(spark, ["1. what is a smoke layer\n2、why does it descend\n3) no part", "only one question", "1. short\n2. a question long enough", None, "第1题：what is a layer\n第 2 题 what is a hose"], Q.question_parts)
    assert got == [["what is a smoke layer", "why does it descend"], ["only one question"], ["1. short\n2. a question long enough"], None, ["what is a layer", "what is a hose"]]
    assert len(values(spark, ["\n".join(f"{i}. question number {i}" for i in range(1, 20))], Q.question_parts)[0]) == 12
    turns = spark.createDataFrame([("为什么？", "烟气层"), ("继续", None), ("那么" + "x" * 60, "p"), ("new", "p")], "c string, p string").select(Q.with_context(F.col("c"), F.col("p")).alias("y"))
    assert [r["y"] for r in turns.collect()] == ["烟气层\n为什么？", "继续", "那么" + "x" * 60, "new"]


def test_round_robin_skips_what_is_taken():
    assert Q.round_robin([[("a", 3.0), ("b", 2.0), ("c", 1.0)], [("a", 9.0), ("b", 8.0)], []], 8) == [("a", 3.0), ("b", 8.0), ("c", 1.0)]
    assert len(Q.round_robin([[(str(i), 1.0) for i in range(50)]], 8)) == 8 and Q.round_robin([], 8) == []


def test_retrieved_needs_an_accepted_quote(spark):
    items = spark.createDataFrame([("k1", "smoke layer", "descends"), ("k2", "smoke vent", "opens"), ("k3", "smoke curtain", "hangs"), ("k4", "hose", "smoke"), ("k1", "smoke layer", "descends")], "kp_id string, name string, definition string")
    evidence = spark.createDataFrame([("k1", True, "q"), ("k2", False, "q"), ("k3", True, " "), ("k4", True, "q"), ("k4", True, "q")], "kp_id string, accepted boolean, quote string")
    asked = spark.createDataFrame([(1, "1. what does smoke do here\n2. what does a hose do here"), (2, "nothing known"), (3, None)], "q int, t string")
    got = Q.retrieved(asked, items, evidence, query_id="q", query="t", item_id="kp_id", fields=["name", "definition"], title="name").collect()
    assert {(r["q"], r["place"], r["kp_id"]) for r in got} == {(1, 1, "k1"), (1, 2, "k4")}
    pages = spark.createDataFrame([("f", 1, "smoke q here")], "source_file string, page_no int, text string")
    cited = spark.createDataFrame([("k1", "e2", "f", 1, "q here"), ("k1", "e1", "f", 1, "smoke"), ("k1", "e3", "f", 1, "absent"), (None, "e4", "f", 1, "q")], "kp_id string, evidence_id string, source_file string, page_no int, quote string")
    assert [tuple(r) for r in Q.quotes_shown(cited, pages).collect()] == [("k1", "smoke\nq here")]


def test_cards_outline_and_order(spark):
    rng = random.Random(2)
    rows = [(f"k{i:02d}", rng.choice(["A", "B", None]), f"n{i}", f"d{i}", rng.choice(["原理", "概念"]), rng.choice([1, 2, 3, 5, None]), rng.choice([None, [], ["1"]]), rng.choice(["x", "y", None]), rng.choice(["p. 3", "第 12 页", None])) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "kp_id string, course string, name string, definition string, type string, importance int, numbers array<string>, chapter string, page_label_start string")
    want = {}
    for course in ("A", "B", None):
        page = lambda r: int("".join(c for c in r[8] if c.isdigit())) if r[8] else 10**9
        mine = sorted((r for r in rows if r[1] == course and (r[5] or 3) >= 2), key=lambda r: (-(r[5] or 3), r[7] or "", page(r), r[0]))
        want |= {r[0]: (course, i) for i, r in enumerate(mine, 1)}
    got = E.cards(df, 2).collect()
    assert {r["kp_id"]: (r["course"], r["card_no"]) for r in got} == want and len(got) == len(want)
    assert sum(r["claims"] for r in E.outline(df).collect()) == 60
    skeleton = spark.createDataFrame([("f", "x", 4), ("f", "x", 2), ("f", "y", 3)], "source_file string, title string, ord int")
    placed = E.in_skeleton_order(spark.createDataFrame([("k", "f", "x", "p. 7"), ("m", "f", "z", None)], "kp_id string, source_file string, chapter string, page_label_start string"), skeleton)
    assert {r["kp_id"]: (r["chapter_order"], r["page"]) for r in placed.collect()} == {"k": (2, 7), "m": (9999, 10**9)}
    kept = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "kp_id string, keep string")
    told = E.alternates(kept, spark.createDataFrame([("b", "f", "p. 1", ["1", "2", "3", "4", "5"]), ("c", "g", None, None)], "kp_id string, source_file string, page_label_start string, numbers array<string>"))
    assert [tuple(r) for r in told.collect()] == [("a", "f p. 1 · b（1、2、3、4）；g  · c")]
    a, b = (spark.createDataFrame([(x,) for x in xs], "kp_id string") for xs in ("ab", "bc"))
    assert {tuple(r) for r in E.same_claims(a, b).collect()} == {("a", "before"), ("c", "after")} and E.same_claims(a, a).count() == 0


def test_worksheet_and_cascade(spark):
    evidence = spark.createDataFrame([("e1", "k", "one", True), ("e2", "k", "two", False), ("e3", "k", "three", False), ("e9", "m", "nine", True), ("e9", "m", "nine", True)], "evidence_id string, kp_id string, quote string, quote_verified boolean")
    findings = spark.createDataFrame([("a1", "k", "e3"), ("a2", "k", "gone"), ("a3", "m", None), ("a4", "none", "e1")], "audit_id string, kp_id string, target string")
    shown = W.finding_evidence(findings, evidence)
    assert {r["audit_id"]: (r["evidence_id"], r["quote"]) for r in shown.collect()} == {"a1": ("e3", "three"), "a2": ("e2", "two"), "a3": ("e9", "nine"), "a4": (None, None)}
    sheet = W.worksheet(findings, spark.createDataFrame([("a1", "ok"), ("a2", " "), ("zz", "bad")], "audit_id string, verdict string"))
    assert {r["audit_id"]: r["verdict"] for r in sheet.collect()} == {"a1": "ok", "a2": None, "a3": None, "a4": None}
    left = W.cascade({"e": evidence, "f": findings}, spark.createDataFrame([("k",)], "kp_id string"), {"e": "kp_id"})
    assert left["e"].count() == 2 and left["f"].count() == 4
    claims = spark.createDataFrame([("k", "r1"), ("m", "r2")], "kp_id string, revision string")
    assert [tuple(r) for r in W.quality_findings(claims, spark.createDataFrame([("k", "r1", "bad"), ("m", "r1", "bad"), ("m", "r2", "pass")], "kp_id string, revision string, verdict string")).collect()] == [("k", "bad")]


def test_anchors_tiers_and_windows(spark):
    rows = [("abcdefghijklmnopqrstuvwxyz", "xx abcdefghijklmnop yy"), ("abcdefghijklmnopqrstuvwxyz", "opqrstuvwxyz"), ("short", "short"), (None, "x")]
    df = spark.createDataFrame(rows, "q string, b string")
    assert [r["y"] for r in df.select(W.longest_anchor(F.col("q"), F.col("b")).alias("y")).collect()] == ["abcdefghijklmnop", "opqrstuvwxyz", None, None]
    stored = spark.createDataFrame([("partial", "exact", True), (None, "exact", False), (None, "legacy", True), (None, None, None)], "t string, m string, v boolean")
    assert [r["y"] for r in stored.select(W.tier_on_record(F.col("t"), F.col("m"), F.col("v")).alias("y")).collect()] == ["partial", "exact", "exact", "not_found"]
    body = "a " * 2000 + "needle in the hay" + " b" * 2000
    part = spark.createDataFrame([(body, "Needle  in the"), (body, "absent")], "b string, q string").select(W.window_around(F.col("b"), F.col("q")).alias("y")).collect()
    assert "needle" in part[0]["y"] and len(part[0]["y"]) == 900 and part[1]["y"].startswith("a a")


def test_extracted_claims(spark):
    item = "struct<name:string,definition:string,aliases:array<string>,type:string,importance:string,numbers:array<string>,note:string,evidence:array<struct<quote:string,page_label:string,evidence_type:string>>>"
    long = "the smoke layer is deep and hot"
    items = [(" Layer。", long, ["a", " "], None, "5", ["1"] * 12, None, [("smoke layer", "p1", None), ("absent", None, "x")] + [("hot", "p", None)] * 4), ("", long, None, None, None, None, None, None), ("Short", "too", None, None, None, None, None, None), ("Bare", long, None, "原理", "high", None, "n", None)]
    answers = spark.createDataFrame([("c1", "C", 7, long, items), ("c2", "C", 1, None, None)], f"chunk_id string, course_id string, start_index int, text string, items array<{item}>")
    claims, evidence = W.extracted_claims(answers, plain_form)
    got = {r["kp_id"]: r for r in claims.collect()}
    assert got.keys() == {"C-KP-0007", "C-KP-0008"} and got["C-KP-0007"]["name"] == "Layer" and got["C-KP-0007"]["aliases"] == ["a"] and len(got["C-KP-0007"]["numbers"]) == 10 and got["C-KP-0007"]["importance"] == 5
    assert got["C-KP-0007"]["confidence"] == "B" and got["C-KP-0008"]["confidence"] == "C" and got["C-KP-0008"]["importance"] == 3 and got["C-KP-0007"]["evidence_ids"] == [f"C-KP-0007-E{i}" for i in (1, 2, 3, 4)]
    assert {r["evidence_id"]: r["verify_method"] for r in evidence.collect()} == {"C-KP-0007-E1": "exact", "C-KP-0007-E2": "not_found", "C-KP-0007-E3": "exact", "C-KP-0007-E4": "exact"}


def test_new_files(spark):
    schema = "name string, size long, sha256 string"
    offered = spark.createDataFrame([("a.m4a", 1, "h" * 64), ("b.m4a", 1, "h" * 64), ("c.m4a", 2, "k" * 64), ("old.m4a", 3, "m" * 64), ("d", 9, "z" * 64)], schema)
    got = {r["name"]: (r["outcome"], r["stored_as"]) for r in W.new_files(offered, spark.createDataFrame([("x", 2, "k" * 64), ("old.m4a", 8, "q" * 64), ("y", 9, "other")], schema)).collect()}
    assert got == {"a.m4a": ("add", "a.m4a"), "b.m4a": ("known", None), "c.m4a": ("known", None), "old.m4a": ("add", "old-mmmmmmmm.m4a"), "d": ("add", "d")}


def test_recording_times(spark):
    stamp = dt.datetime(2026, 3, 20, 23, 30)
    names = {
        "2026-03-05 14.30 lesson": ("2026-03-05 06:30", True, "name"), "20260305_1430": ("2026-03-05 06:30", True, "name"), "2026年3月5日 下午2点30": ("2026-03-05 06:30", True, "name"), "2026-03-05": ("2026-03-05 04:00", False, "name_date"), "3月5日 9点05": ("2026-03-05 01:05", True, "name"),
        "8月5日": (None, False, "ambiguous"), "2026-02-30": (None, False, "invalid"), "2026-03-05 99点00": (None, False, "invalid"), "lesson 8点15": ("2026-03-21 00:15", True, "name_time"), "lesson": ("2026-03-20 23:30", True, "modified"),
    }
    df = spark.createDataFrame([(n, stamp, dt.date(2026, 3, 2), 17, "Asia/Shanghai") for n in names], "n string, m timestamp, s date, w int, z string")
    rows = df.select("n", M.recording_time(F.col("n"), F.col("m"), F.col("s"), F.col("w"), F.col("z")).alias("r")).select("n", F.date_format("r.at", "yyyy-MM-dd HH:mm").alias("at"), "r.timed", "r.basis").collect()
    assert {r["n"]: (r["at"], r["timed"], r["basis"]) for r in rows} == names
    none = df.limit(1).select(M.recording_time(F.lit("lesson"), F.lit(None).cast("timestamp"), F.col("s"), F.col("w"), F.col("z")).alias("r")).first()["r"]
    assert tuple(none) == (None, False, "none")
    cases = [(["A"], ["A"], "name", "matched"), ([], ["A"], "name", "matched"), ([], ["A"], "modified", "review"), (["A"], ["B"], "name", "conflict"), ([], ["A", "B"], "name", "conflict"), (None, [], "none", "unmatched"), (["A"], [], "modified", "review"), (["A"], [], "none", "matched")]
    got = spark.createDataFrame([c[:3] for c in cases], "n array<string>, t array<string>, b string").select(M.recording_verdict(F.col("n"), F.col("t"), F.col("b")).alias("y"))
    assert [r["y"] for r in got.collect()] == [c[3] for c in cases]
    assert values(spark, ["1-20001", "5, 3，2-1、x"], M.page_selection)[0][-1] == 20001 and values(spark, ["1-99999999"], lambda c: M.page_selection(c, 3)) == [[1, 2, 3]]


def test_displays(spark):
    assert values(spark, [None, 0, 1, 9, 4], D.stars, "int") == ["★★★☆☆", "★★★☆☆", "★☆☆☆☆", "★★★★★", "★★★★☆"]
    assert values(spark, [None, -0.35, -0.5, -0.76], D.transcript_grade, "double") == ["B", "A", "B", "C"]
    assert values(spark, ["a/b/c.pdf", "c.pdf", None], D.course_of_path) == ["b", "未分类", "未分类"] and values(spark, ["x/Smoke (2nd ed).pdf"], D.source_name) == ["Smoke"]
    layouts = {"Q=K·S/U": r"Q=\frac{KS}{U}", "1.3Q=K·S/U": "long"}
    text = "so Q=K·S/U holds, v2 = 3×10^3 too; $x=1$ stays"
    once = D.with_formulas(text, layouts)
    assert once == r"so $Q=\frac{KS}{U}$ holds, $v_{2} = 3\times 10^{3} too$; $x=1$ stays" and D.with_formulas(once, layouts) == once
    assert D.with_formulas("1.3Q=K·S/U", layouts) == "$long$" and D.with_formulas("", {}) == "" and values(spark, ["a=1", None], D.formula_text({})) == ["$a=1$", None]
    assert D.formula_html("a<b $x<y$") == 'a&lt;b <span class="math-tex">x&lt;y</span>'


def test_runs(spark, tmp_path):
    first, second = L.new_run_id("extract", dt.datetime(2026, 1, 2)), L.new_run_id("extract", dt.datetime(2026, 1, 3))
    assert first < second and first.startswith("extract-20260102-")
    log = f"{tmp_path}/log"
    with L.recorded(spark, log, "parse", first, {"a": "1"}) as told:
        told["pages"] = "7"
    with pytest.raises(KeyError), L.recorded(spark, log, "parse", second):
        raise KeyError("x")
    rows = spark.read.parquet(log)
    runs = {r["run_id"]: r for r in L.finished_runs(rows).collect()}
    assert runs[first]["exit_code"] == 0 and runs[second]["exit_code"] == 1 and "KeyError" in runs[second]["error"] and runs[first]["seconds"] >= 0
    assert rows.filter("event = 'end'").filter(F.col("run_id") == first).first()["details"] == {"a": "1", "pages": "7"}
    (tmp_path / "d.json").write_text('﻿{"a": [1]}')
    (tmp_path / "bad.json").write_text("{")
    assert L.read_document(spark, f"{tmp_path}/d.json") == {"a": [1]} and L.read_document(spark, f"{tmp_path}/bad.json", 5) == 5 and L.read_document(spark, f"{tmp_path}/none.json", []) == []
    assert L.settings_of(spark, {"zone": "spark.sql.session.timeZone"})["zone"] == "UTC"
    with pytest.raises(ValueError):
        L.settings_of(spark, {"x": "spark.some.password"})


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 2001)), encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("one two\r\n\nlast".encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = [(r["file"][-5:], r["line_no"], r["line"]) for r in L.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(n for f, n, _ in rows if f == "a.txt") == list(range(1, 2001)) and all(line == f"line {n}" for f, n, line in rows if f == "a.txt")
    assert sorted((n, line) for f, n, line in rows if f == "b.txt") == [(1, "one two\r"), (2, ""), (3, "last")]


def test_edits_under_a_token(spark):
    claims = spark.createDataFrame([("k1", "n1", "d1", ["1"], 3, "verified"), ("k2", "n2", "d2", None, 3, "verified"), ("k3", "n3", "d3", None, 3, "verified"), ("k4", "n4", None, None, 3, "verified")], "kp_id string, name string, definition string, numbers array<string>, importance int, status string")
    token = {r["kp_id"]: r["t"] for r in claims.select("kp_id", W.row_token(claims).alias("t")).collect()}
    assert len(set(token.values())) == 4
    edits = spark.createDataFrame([("k1", token["k1"], "new", None), ("k2", token["k2"], None, 5), ("k3", "stale", "x", None), ("k4", token["k4"], "a", None), ("k4", token["k4"], "b", None), ("k9", "t", "x", None)], "kp_id string, token string, name string, importance int")
    findings = spark.createDataFrame([("a1", "k1", "quote", "P1", "pending", False), ("a2", "k2", "quote", "P1", "pending", False)], "audit_id string, kp_id string, type string, priority string, status string, superseded boolean")
    after, audits, refused = W.edited_claims(claims, edits, findings)
    assert {r["kp_id"]: (r["name"], r["importance"], r["status"]) for r in after.collect()} == {"k1": ("new", 3, "pending"), "k2": ("n2", 5, "verified"), "k3": ("n3", 3, "verified"), "k4": ("n4", 3, "verified")}
    assert {(r["kp_id"], r["type"], r["status"], r["superseded"]) for r in audits.collect()} == {("k1", "quote", "ignored", True), ("k2", "quote", "pending", False), ("k1", "edited_content", "pending", False)}
    assert sorted((r["kp_id"], r["reason"]) for r in refused.collect()) == [("k3", "stale"), ("k4", "repeated"), ("k4", "repeated"), ("k9", "unknown")] and after.columns == claims.columns


def test_declared_duplicates_go_only_if_unused(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "source_file string, page_no int")
    declared = spark.createDataFrame([("b", "a")], "drop string, keep string")
    used = spark.createDataFrame([("a",), ("c",)], "source_file string")
    assert sorted(r["source_file"] for r in W.without_duplicates(rows, declared, used).collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="still used"):
        W.without_duplicates(rows, declared, spark.createDataFrame([("b",)], "source_file string"))
    with pytest.raises(ValueError, match="not there"):
        W.without_duplicates(rows, spark.createDataFrame([("b", "z")], "drop string, keep string"), used)
