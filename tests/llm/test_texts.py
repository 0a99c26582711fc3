"""Look-alikes, splitting, quality, mixing and noise of scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracebook.llm import scan_noise as N
from tracebook.llm.mixing import plan_shares, position, prefix_sums
from tracebook.llm.splitting import split_oversized


def test_splitting(spark):
    text = ("A sentence of some words here. " * 12 + "\n\n") * 30
    rows = [("a", text), ("b", "x" * 5000), ("c", "short"), ("d", ""), ("e", None), ("f", "𝒳" * 700), ("g", "\n" * 900)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k string, t string, piece int")
    out = {}
    for r in split_oversized(df, keys=["k"], text="t", limit=600, overlap=60).orderBy("k", "piece_no").collect():
        out.setdefault(r["k"], []).append(r)
    assert set(out) == {"a", "b", "c", "f", "g"} and len(out["c"]) == 1
    for k, t in rows:
        for i, r in enumerate(out.get(k, [])):
            assert len(r["piece"]) <= 600 and r["piece_no"] == i + 1
            if i:
                assert out[k][i - 1]["piece"].endswith(r["piece"][: r["overlap"]]) and r["overlap"] <= 60
        if k in out:
            assert "".join(r["piece"][r["overlap"] :] for r in out[k]) == t
    assert all(r["piece"].endswith("\n\n") for r in out["a"][:-1])
    with pytest.raises(ValueError):
        split_oversized(df, keys=["k"], text="t", limit=600, overlap=300)
    assert split_oversized(df.limit(0), keys=["k"], text="t").count() == 0


def test_plan_and_positions(spark):
    shares = {x.source: x for x in plan_shares([("a", 0.5, 2), ("b", 0.3, 1), ("none", 0.2, 3), (None, 0.1, 1), ("z", 0.0, 1)], {"a": 1000, "b": 600}, {"a": 1.0, "b": -1.0}, None)}
    assert abs(shares["a"].demand / shares["b"].demand - 5 / 3) < 1e-9 and abs(shares["b"].demand - 600) < 1e-6 and shares["none"].demand == 0
    assert abs(0.5 * shares["a"].tilt + 0.3 * shares["b"].tilt) < 1e-9
    df = spark.createDataFrame([(float(u), t) for t in (-1.0, -0.4, 0.0, 0.7, 1.0) for u in (0, 1, 25, 50, 99, 100)], "u double, t double")
    for r in df.select("u", "t", position(F.col("u"), F.lit(100.0), F.col("t")).alias("p")).collect():
        assert 0 <= r["p"] <= 1 and abs(100 * (r["p"] + r["t"] * (r["p"] ** 2 - r["p"])) - r["u"]) < 1e-6


def test_prefix_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), F.xxhash64("id").alias("h"), F.col("id").alias("_key"), (F.col("id") % 7 + 1).alias("v"))
    got = prefix_sums(df, "g", "h", "v", "at").collect()
    for g in "012":
        mine = sorted((r["at"], r["v"]) for r in got if r["g"] == g)
        assert [a for a, _ in mine] == [sum(v for _, v in mine[:i]) for i in range(len(mine))]


def test_mixture(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    del tiktoken
    import base64

    from tracebook.llm.mixing import curriculum_mixture

    (tmp_path / "bytes.tiktoken").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    docs = [(i, "x" * (10 + i % 5), "big" if i % 4 else "small") for i in range(400)] + [(1000, None, "big"), (1001, "", "big"), (1002, "y", None), (1003, "y", "other"), (None, "y", "big")]
    docs += docs[:3]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, position int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, weight double, max_repeats int")
    kw = {"key": "doc_id", "text": "text", "source": "source", "vocabulary": str(tmp_path / "bytes.tiktoken"), "pattern": r"[\s\S]", "tilts": {"small": 0.5}}
    mixture, shares = curriculum_mixture(df, targets, **kw)
    rows = mixture.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows) and max(r["copy_no"] for r in rows if r["source"] == "big") == 1 and max(r["copy_no"] for r in rows) <= 3
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["small"]["actual_share"] - 0.4 / 0.9) < 0.01 and got["gone"]["n_tokens"] == 0 and sum(r["n_tokens"] for r in rows) == sum(r["n_tokens"] for r in got.values())
    assert curriculum_mixture(df.limit(0), targets, **kw)[0].count() == 0


@pytest.mark.parametrize("label,number,wrong", [("P.I9", "19", True), ("第9O页", "90", True), ("Page l", "1", True), ("S", "5", True), ("iv", "iv", False), ("第 iii 页", "iii", False), ("p. 12", "12", False), ("Slide 3", "3", False), (None, None, False), ("Cover", "Cover", False)])
def test_labels(label, number, wrong):
    assert N.label_number(label) == (number, wrong)


def test_page_faults(spark):
    body = "The curtain masks the corridor.\nThe curtain fills the plenum.\nThe corridor holds the curtain.\n"
    clean = [("f", "s", n, str(n), f"Layer in hose systems    {n}\n" + body * 3 + f"— {n} —", "text_layer") for n in range(1, 9)]
    scan = ("f", "s", 9, "l0", "Layer in h.se systems\nThe curfain masks the corri-\ndor. The low-\npressure rnasks hold 5\n479\n— 10 —", "ocr")
    other = [("g", "t", 1, None, None, "ocr"), ("g", "t", 2, "2", "", None), ("g", "t", 3, "3", "low-pressure hose and low-pressure masks", "text_layer"), (None, "t", 4, "I4", "x", None)]
    cols = "file_id string, source_file string, page_no int, page_label string, text string, text_source string"
    pages = spark.createDataFrame([*clean, clean[0], scan, *other], cols)
    skeleton = spark.createDataFrame([("s", 1, "Unused")], "source_file string, num int, title string")
    got = {(r["file_id"], r["page_no"], r["line_no"], r["issue"]) for r in N.page_faults(pages, skeleton).collect()}
    want = {("f", n, 1, "header") for n in range(1, 9)} | {("f", n, 11, "page_number") for n in range(1, 9)}
    want |= {("f", 9, 1, "header"), ("f", 9, 2, "misread"), ("f", 9, 2, "hyphen"), ("f", 9, 4, "misread"), ("f", 9, 6, "page_number"), ("f", 9, 0, "label")}
    assert got == want
    assert N.page_faults(pages.limit(0), skeleton).count() == 0


def counts(spark, rows):
    return spark.createDataFrame(rows, "a string, n long, m long")


def test_corrections_by_shape_and_by_neighbours(spark):
    # 密度 is the commoner word, but 侬 has the shape of 浓; 徊 has no known reading
    bigrams = counts(spark, [("密度", 900, 90), ("浓度", 300, 30), ("侬度", 0, 9), ("的浓", 50, 5), ("的密", 90, 9), ("的侬", 0, 3), ("徊烟", 0, 6), ("排烟", 50, 5), ("挡烟", 40, 5), ("的徊", 0, 6), ("的排", 30, 5), ("的挡", 30, 5)])
    chars = counts(spark, [("密", 990, 99), ("浓", 350, 35), ("度", 1200, 129), ("侬", 0, 12), ("徊", 0, 12), ("烟", 90, 16), ("的", 200, 33)])
    words = counts(spark, [("smoke", 40, 4), ("srnoke", 0, 1), ("smokc", 0, 1), ("valve", 30, 3), ("vaive", 0, 2), ("hood", 9, 0), ("hxod", 0, 1), ("srno-ke", 0, 1)])
    got = {r["word"]: (r["fixed"], r["place"]) for r in N.word_corrections(words, bigrams).collect()}
    assert got == {"srnoke": ("smoke", 2), "smokc": ("smoke", 5), "vaive": ("valve", 3), "侬度": ("浓度", 0), "的侬": ("的浓", 0)}
    known = spark.createDataFrame([(w, f) for w, (f, p) in got.items() if p == 0], "word string, fixed string")
    assert {r["word"]: r["fixed"] for r in N.ideograph_corrections(chars, bigrams, known).collect()} == {"侬": "浓", "徊": None}
    none = bigrams.limit(0)
    assert N.word_corrections(none, none).count() == 0 and N.ideograph_corrections(none, none, known).count() == 0


def test_learnt_confusions_need_a_share_of_the_words(spark):
    right = ["cable", "table", "plate", "slate", "later", "relay"]
    rows = [(w, 40, 4) for w in right] + [(w.replace("l", "j"), 0, 1) for w in right] + [("roof", 40, 1), ("rxof", 0, 1)]
    got = {r["word"]: r["fixed"] for r in N.word_corrections(counts(spark, rows), counts(spark, [])).collect()}
    assert got == {w.replace("l", "j"): w for w in right}


def test_long_edge_lines_are_titles_if_equal(spark):
    title = "A running title of many words " * 9
    pages = spark.createDataFrame([("f", "s", i, str(i), f"{title}\nBody of the page number {i} with words.\nThe end is here.", None) for i in range(1, 4)], "file_id string, source_file string, page_no int, page_label string, text string, text_source string")
    skeleton = spark.createDataFrame([], "source_file string, num int, title string")
    assert {(r["page_no"], r["line_no"]) for r in N.page_faults(pages, skeleton).filter("issue = 'header'").collect()} == {(1, 1), (2, 1), (3, 1)}


def test_accuracy_on_pages_misread_on_purpose(spark):
    import os
    import random
    import re

    import pandas as pd

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    rng, likes, truth = random.Random(5), {x[0]: x[1] for x in N.LIKE_SHAPES}, {}
    pages = pd.read_parquet(f"{d}/pages.parquet").drop_duplicates(["file_id", "page_no"])
    pages = pages[pages.text.notna() & (pages.text_source != "ocr")]

    def spoil(key, text):
        out = []
        for n, line in enumerate(text.split("\n"), 1):

            def word(m, n=n):
                w, ways = m[0].lower(), [(x[0], x[1]) for x in N.CONFUSED if x[0] in m[0].lower()]
                if len(w) < 5 or not ways or rng.random() > 0.03:
                    return m[0]
                right, wrong = rng.choice(ways)
                bad = w.replace(right, wrong, 1)
                truth[*key, n, bad] = w
                return bad

            line = re.sub("[A-Za-z]+", word, line)
            for i, c in enumerate(line):
                if c in likes and rng.random() < 0.03:
                    truth[*key, n, likes[c]] = c
                    line = line[:i] + likes[c] + line[i + 1 :]
            out.append(line)
        return "\n".join(out)

    half = pages.index % 2 == 0
    read = pages[half].assign(text=[spoil(k, t) for k, t in zip(zip(pages[half].file_id, pages[half].page_no), pages[half].text)], text_source="ocr")
    columns = ["file_id", "source_file", "page_no", "page_label", "text", "text_source"]
    skeleton = spark.createDataFrame([], "source_file string, num int, title string")
    found = N.page_faults(spark.createDataFrame(pd.concat([pages[~half], read])[columns].astype({"page_no": "int32"})).withColumn("page_no", F.col("page_no").cast("int")), skeleton).filter("issue = 'misread'").collect()
    fixed: dict = {}
    for r in found:
        for a, b in zip(r["wrong"], r["fixed"] or "") if not r["wrong"].isascii() else [(r["wrong"], r["fixed"])]:
            if a != b:
                fixed[r["file_id"], r["page_no"], r["line_no"], a] = b
    right = [fixed.get(k) == v for k, v in truth.items()]
    wrong = [k in fixed and fixed[k] != v for k, v in truth.items()]
    assert len(truth) > 300 and sum(right) >= 0.9 * len(truth) and sum(wrong) <= 0.01 * len(truth)
