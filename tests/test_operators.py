from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tracebook.operators import merging as M
from tracebook.operators import pages as P
from tracebook.operators.courses import resolve_course
from tracebook.operators.names import similar_names
from tracebook.operators.quality_gates import contract_report, ledger, manifest_diff, subset_proof
from tracebook.operators.quotes import best_body, confidence, quote_tier, transitions
from tracebook.operators.search import search
from tracebook.operators.timetable import expand_sessions, week_numbers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quote_tiers(spark):
    body = "thecurtainobscuresthecloggedscreenallowanceandthecladdingcurvefallsto67.92"
    cases = [
        (body[3:40], body, "exact"), (body[:24] + "xx" + body[-24:], body, "partial"), (body[:24] + "somethingelseentirely", body, "fabricated"), (body[:30] + "99", body, "fabricated"),
        ("entirelyinventedtextwithoutanchor", body, "not_found"), ("short", "other", "not_found"), ("", body, "not_found"), (None, body, "not_found"), ("abc", None, "not_found"), (body[:20] + "zz", body, "not_found"),
    ]
    df = spark.createDataFrame([(i, q, b) for i, (q, b, _) in enumerate(cases)], "i int, q string, b string")
    assert [r[1] for r in rows(df.select("i", quote_tier(F.col("q"), F.col("b"))))] == [t for *_, t in cases]
    best = best_body(spark.createDataFrame([(1, "abcdefghijkl", "xx", 1), (1, "abcdefghijkl", "abcdefghijklm", 2), (1, "abcdefghijkl", "abcdefghijkl", 3)], "k int, q string, b string, o int"), "k", "q", "b", "o")
    assert rows(best) == [(1, "exact", 2)]


def test_confidence_and_transitions(spark):
    df = spark.createDataFrame([("a", "exact", "exact"), ("a", "exact", "partial"), ("b", "exact", "exact"), ("c", None, "not_found")], "k string, before string, tier string")
    assert rows(df.groupBy("k").agg(confidence(F.col("tier")))) == [("a", "B"), ("b", "A"), ("c", "C")]
    got = {(r["before"], r["tier"]): (r["n"], r["change"]) for r in transitions(df).collect()}
    assert got == {("exact", "exact"): (2, "same"), ("exact", "partial"): (1, "lowered"), (None, "not_found"): (1, "new")}


def test_weeks_and_exceptions(spark):
    w = lambda text, total: spark.createDataFrame([(text, total)], "w string, t int").select(week_numbers(F.col("w"), F.col("t"))).first()[0]
    assert w("1-8,10", 12) == [1, 2, 3, 4, 5, 6, 7, 8, 10] and w("1—5单", 9) == [1, 3, 5] and w("2~6(双)", 9) == [2, 4, 6]
    assert w(None, 3) == [1, 2, 3] and w("", 2) == [1, 2] and w("3、5，7周", 6) == [3, 5] and w("x", 3) == [] and w(None, 0) == []
    slot = "array<struct<course_id:string,weekday:int,start:string,end:string,weeks:string>>"
    exc = "array<struct<course_id:string,date:date,start:string,end:string,action:string>>"
    import datetime as dt

    day = dt.date(2026, 3, 2)
    t = spark.createDataFrame(
        [("T", day, 2, "Asia/Shanghai", 15, [("C", 1, "8:00", "09：00", None), ("C", 1, "08:00", "9:00", None)], [("C", day, "08:00", "09:00", "cancel"), ("C", day, "10:00", "11:00", "add"), ("C", day, "12:00", "13:00", "add"), ("C", day, "12:00", "13:00", "cancel"), ("C", day, "08:00", "08:50", None)]), ("N", None, None, None, None, None, None)],
        f"timetable_id string, semester_start date, total_weeks int, timezone string, tolerance_minutes int, slots {slot}, exceptions {exc}",
    )
    got = [(str(r["session_date"]), r["start_minute"], r["end_minute"], str(r["start_at"])) for r in expand_sessions(t).orderBy("session_date", "start_minute").collect()]
    assert got == [("2026-03-02", 480, 530, "2026-03-02 00:00:00"), ("2026-03-02", 600, 660, "2026-03-02 02:00:00"), ("2026-03-09", 480, 540, "2026-03-09 00:00:00")]


def test_course_resolution(spark):
    courses = spark.createDataFrame([("EC01", "Smoke Movement", ["SmoMov"]), ("ZC01", "烟气", None)], "course_id string, name string, aliases array<string>")
    df = spark.createDataFrame([(" smoke  movement",), ("SMOMOV",), ("zc01",), ("nobody",), (None,)], "course string")
    assert sorted(r["resolved_course"] or "-" for r in resolve_course(df, courses, ["course"]).collect()) == ["-", "-", "EC01", "EC01", "ZC01"]


def windows(sizes, limit):
    out, held = [], 0
    for n in sizes:
        if out and held + n > limit:
            out.append([])
            held = 0
        if not out:
            out.append([])
        out[-1].append(n)
        held += n
    return out


def test_greedy_windows_against_plain_packing(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = [rng.randint(1, 60) for _ in range(40)] + [500] + [rng.randint(1, 60) for _ in range(10)]
        df = spark.createDataFrame([("f", i, n) for i, n in enumerate(sizes)], "file_id string, page_no int, size int")
        got = [r["weight"] for r in P.page_windows(df, ["file_id"], 150, overhead=0).orderBy("window").collect()]
        assert got == [sum(w) for w in windows(sizes, 150)]


def test_runs_intervals_and_interpolation(spark):
    keys = spark.createDataFrame([("f", "s1", "c", n, 10) for n in (1, 2, 3, 7, 8)] + [("g", "s2", "c", 1, 0)], "file_id string, source_file string, course string, page_no int, size int")
    assert rows(P.page_runs(keys)) == [("f", 1, 3, 3), ("f", 7, 8, 2), ("g", 1, 1, 1)]
    assert rows(P.page_intervals(keys)) == [("s1", 5, 1, 5), ("s2", 1, 6, 6)]
    anchors = spark.createDataFrame([("f", 2, 10), ("f", 6, 12), ("f", 8, 14), ("g", 1, 1)], "file_id string, index int, printed int")
    got = {r["page_no"]: (r["printed"], r["extrapolated"]) for r in P.interpolate(keys, anchors).collect()}
    assert got == {1: (10, True), 2: (10, False), 3: (10, False), 7: (13, False), 8: (14, False)}


def test_interpolation_of_long_files_and_long_numbers(spark):
    keys = spark.createDataFrame([("f", n) for n in (1, 25_000, 60_000, 60_001)] + [("g", n) for n in (1, 5, 9, 30)], "file_id string, page_no int")
    anchors = spark.createDataFrame([("f", 1, 11), ("f", 60_000, 60_010), ("g", 1, 1), ("g", 9, 999_999_993)], "file_id string, index int, printed int")
    got = {(r["file_id"], r["page_no"]): (r["printed"], r["extrapolated"]) for r in P.interpolate(keys, anchors).collect()}
    assert got == {("f", 1): (11, False), ("f", 25_000): (25_010, False), ("f", 60_000): (60_010, False), ("f", 60_001): (60_011, True)} | {("g", 1): (1, False), ("g", 5): (499_999_997, False), ("g", 9): (999_999_993, False), ("g", 30): (None, True)}


def test_chunks_own_pages_once(spark):
    pages = spark.createDataFrame([("f", "s", "C", n, f"p{n}", "x" * 300) for n in range(1, 9)], "file_id string, source_file string, course string, page_no int, page_label string, text string")
    section = "array<struct<ord:int,no:string,title:string,page_start:int,page_end:int,node_id:string>>"
    skeleton = spark.createDataFrame([("ch1", "s", 1, 1, "A", "body", 1, 4, [(1, "1", "a", 1, 2, "s1"), (2, "2", "b", 2, 1, "bad"), (3, "3", "c", 3, 9, "s3")]), ("ch2", "s", 2, 2, "B", "body", 4, 7, None), ("m", "s", 3, 3, "M", "matter", 8, 8, None)], f"node_id string, source_file string, ord int, num int, title string, kind string, page_start int, page_end int, sections {section}")
    got = {(r["node_id"], r["section_id"], r["page_start"], r["page_end"]) for r in P.chapter_chunks(skeleton, pages, limit=700).collect()}
    assert got == {("ch1", "s1", 1, 2), ("ch1", "s3", 3, 4), ("ch2", None, 5, 6), ("ch2", None, 7, 7)}
    whole = P.chapter_chunks(skeleton, pages, limit=5000).collect()
    assert {(r["node_id"], r["page_start"], r["page_end"]) for r in whole} == {("ch1", 1, 4), ("ch2", 5, 7)} and len({r["chunk_id"] for r in whole}) == 2


def test_merging(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert rows(M.last_by_key(df, ["k"], [F.col("t")])) == [("a", 2, "y"), ("b", None, "z")]
    new = spark.createDataFrame([("a", 9, "n")], "k string, t int, v string")
    assert rows(M.upsert(df, new, ["k"])) == [("a", 9, "n"), ("b", None, "z")]
    old = spark.createDataFrame([("k", None, "r1", "done"), ("k", "t", "r1", "done")], "k string, target string, revision string, status string")
    now = spark.createDataFrame([("k", None, "r1", "open"), ("k", "t", "r2", "open")], "k string, target string, revision string, status string")
    got = rows(M.merge_history(old, now, ["k", "target"], "revision", ["status"]).select("revision", "status", "superseded"))
    assert got == [("r1", "done", False), ("r1", "done", True), ("r2", "open", False)]
    dup = spark.createDataFrame([(1, "t"), (2, "t"), (3, None), (4, "u")], "id int, t string")
    assert rows(M.declared_duplicates(dup, "id", F.col("t"))) == [(2, 1)]
    runs = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 3, None), ("g", 4, None), ("g", 5, "a")], "g string, n int, l string")
    assert sorted((r["first"], r["last"], r["rows"]) for r in M.segments(runs, "g", "n", "l").collect()) == [(1, 2, 2), (3, 4, 2), (5, 5, 1)]


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["smoke layer height", "exit width", "烟气控制", "duct", "fan curve of the upper hall"]
    names = {"".join(c for c in b if rng.random() > 0.06) + rng.choice(["", "s", " 2", "x"]) for b in base for _ in range(12)} | {"ab", "abc", "a", "烟", "烟气"}
    df = spark.createDataFrame([("c", n) for n in names] + [("c", None), (None, "duct")], "g string, n string")
    got = {(r["name_a"], r["name_b"]) for r in similar_names(df, group="g", name="n").collect()}
    clean = sorted({n.strip().lower() for n in names if n.strip()})
    want = {(a, b) for i, a in enumerate(clean) for b in clean[i + 1 :] if a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.82}
    assert got == want


def test_gates(spark):
    df = spark.createDataFrame([("a", "x", None), ("", "y", 1), (None, None, 2)], "k string, e string, n int")
    got = {(r["check"], r["column"]): r["n"] for r in contract_report(df, "t", required=["k", "n", "gone"], enums={"e": ["x"]}).collect()}
    assert got == {("missing", "k"): 2, ("missing", "n"): 1, ("missing", "gone"): None, ("enum", "e"): 1}
    a, b = spark.createDataFrame([("f", 1), ("g", 2)], "k string, d int"), spark.createDataFrame([("f", 1), ("g", 3), ("h", 1)], "k string, d int")
    assert rows(manifest_diff(a, b, "k", "d")) == [("f", "same"), ("g", "changed"), ("h", "right_only")]
    assert tuple(subset_proof(a, b, "k").first()) == (2, 3, 0, 1, True)
    assert rows(ledger({"a": a, "b": b}, "k")) == [("f", 1, 1, ""), ("g", 1, 1, ""), ("h", 0, 1, "a")]
    assert contract_report(df.limit(0), "t", required=["k"]).first()["n"] == 0


def test_search(spark):
    df = spark.createDataFrame([("s", 1, "The Smoke\nand   fire"), ("s", 2, "smoke only"), ("s", 3, None)], "source_file string, page_no int, text string")
    assert [r["page_no"] for r in search(df, ["SMOKE", "fire"]).collect()] == [1]
    assert sorted(r["page_no"] for r in search(df, ["fire", "only"], match_any=True).collect()) == [1, 2]
    assert "【Smoke】 and 【fire】" in search(df, ["smoke", "fire"]).first()["snippet"]


def test_name_similarity_of_all_points_of_a_course(spark, tmp_path):
    from tracebook.plans.evidence import name_similarity

    spark.createDataFrame([("EC10", "Fire Dynamics", ["fire dyn"])], "course_id string, name string, aliases array<string>").write.parquet(str(tmp_path / "courses.parquet"))
    kp = [
        ("EC10", None, "plume rise"), (None, "fire  Dynamics", "plume rise 2"), ("ec 10", "x", "plume rises"),
        (None, None, "duct leak"), (None, " ", "duct leaks"), (None, "other", "duct leakage"), (None, "other", "a duct leakage"), ("EC99", None, "riser"), ("EC99", "other", "risers"),
    ]
    spark.createDataFrame(kp, "course_id string, course string, name string").write.parquet(str(tmp_path / "kp.parquet"))
    got = {(r["course_id"], r["name_a"], r["name_b"]) for r in name_similarity(spark, str(tmp_path)).collect()}
    assert got == {("EC10", "plume rise", "plume rise 2"), ("EC10", "plume rise", "plume rises"), ("EC10", "plume rise 2", "plume rises"), ("未分类", "duct leak", "duct leaks"), ("other", "a duct leakage", "duct leakage"), ("EC99", "riser", "risers")}


def test_numbers_of_claims_whose_quotes_cite_no_page(spark, tmp_path):
    from tracebook.plans.evidence import number_check_units

    kp = [("cited", "f", "1", "1"), ("lost", "f", "p. 2", "3"), ("label", "f", None, None), ("bare", "f", "2", None), ("none", "g", "1", "2"), ("wide", "f", "1", "900000000")]
    spark.createDataFrame([(k, ["7 m", "8 m"], f, a, b) for k, f, a, b in kp], "kp_id string, numbers array<string>, source_file string, page_label_start string, page_label_end string").write.parquet(str(tmp_path / "kp.parquet"))
    spark.createDataFrame([("cited", "f", 1, "1"), ("cited", "f", 99, "99"), ("lost", "f", 99, None), ("label", "f", None, "3"), ("none", "g", 1, "1")], "kp_id string, source_file string, page_no int, page_label string").write.parquet(str(tmp_path / "evidence.parquet"))
    spark.createDataFrame([("f", 1, "8 m"), ("f", 2, "none"), ("f", 3, "7 m")], "source_file string, page_no int, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["kp_id"], r["number"]): r["ok"] for r in number_check_units(spark, str(tmp_path)).collect()}
    right = {("cited", "8 m"), ("lost", "7 m"), ("label", "7 m"), ("wide", "7 m"), ("wide", "8 m")}
    assert got == {(k, n): (k, n) in right for k, *_ in kp for n in ("7 m", "8 m")}


def test_claim_sources_of_wide_ranges(spark, tmp_path):
    from tracebook.plans.evidence import claim_sources

    kp = [("narrow", "f", "2", "3"), ("wide", "f", "1", "p. 2500"), ("beyond", "f", "3", "999999999"), ("back", "f", "3", "2"), ("open", "f", "3", None)]
    spark.createDataFrame(kp, "kp_id string, source_file string, page_label_start string, page_label_end string").write.parquet(str(tmp_path / "kp.parquet"))
    spark.createDataFrame([("f", 1, "a"), ("f", 2, "bb"), ("f", 3, None), ("f", 2500, "cccc"), ("f", 2501, "d"), ("g", 2, "e")], "source_file string, page_no int, text string").write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(claim_sources(spark, str(tmp_path)).select("kp_id", "pages", "chars")) == [("beyond", 3, 5), ("narrow", 2, 2), ("wide", 4, 7)]


def test_similar_names_with_repeated_bigrams(spark):
    rng = random.Random(5)
    names = {"ab" * 10, "ab" * 9 + "ac"} | {"".join(rng.choice(["ab", "ab", "ab", "b", "cd"]) for _ in range(rng.randint(5, 16))) for _ in range(70)}
    whole = ["".join(rng.choice("abcdefgh") for _ in range(220)) for _ in range(4)]
    for w in whole:  # one name within the other but for one character in fifty-five
        names |= {w, "".join(c for i, c in enumerate(w) if i % 55), "".join(c + "." * (i % 55 == 0) for i, c in enumerate(w))}
    df = spark.createDataFrame([("c", n) for n in sorted(names)], "g string, n string")
    for t in (0.82, 0.9):
        got = {(r["name_a"], r["name_b"]) for r in similar_names(df, group="g", name="n", threshold=t).collect()}
        clean = sorted(names)
        assert got == {(a, b) for i, a in enumerate(clean) for b in clean[i + 1 :] if a in b or b in a or SequenceMatcher(None, a, b).ratio() >= t}


def test_similar_names_in_blocks(spark, monkeypatch):
    from tracebook.operators import names as N

    monkeypatch.setattr(N, "BLOCK", 40)
    rng = random.Random(11)
    pick = lambda *x: rng.choice(x)
    names = {f"{pick('absorption', 'activation', 'actuation')} in {pick('sealed', 'unsealed', 'steel')} {pick('stage', 'storage', 'wall')} systems {pick('a', 'b', 'k')}{pick('.', '-')}{rng.randint(100, 140)}" for _ in range(150)}
    names |= {pick("屋顶", "天窗", "风管", "𠀋管") + "对" + pick("油池", "泡沫板") + pick("分布", "趋势", "强度") + pick("的作用", "要点", "") for _ in range(40)} | {"a", "对", "𠀋", "wall", "stage systems", "systems a"}
    long = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in (63, 64, 65, 90, 210)]
    names |= {v.strip() for n in long for v in (n, "x" + n[:-3], n[:40] + "yy" + n[45:], n[10:])}
    df = spark.createDataFrame([(g, n) for g in "cd" for n in sorted(names)] + [("e", "wall"), (None, "wall"), ("e", " ")], "g string, n string")
    found = similar_names(df, group="g", name="n")
    got = {(r["g"], r["name_a"], r["name_b"]): r["ratio"] for r in found.collect()}
    clean = sorted(names)
    ratios = {(a, b): 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio() for i, a in enumerate(clean) for b in clean[i + 1 :]}
    assert got == {(g, *p): round(r, 6) for g in "cd" for p, r in ratios.items() if r >= 0.82}
    # pairs are met within units: the one join deals names to blocks, none makes rows of pairs
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
