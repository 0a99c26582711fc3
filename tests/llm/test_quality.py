"""Quality figures, fitted profiles and the kinds they give."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from tracebook.llm import quality as Q

PROSE = "The pump was measured at the gate, while the hall is near the exit. It is assumed that the door of the duct is open."
WORDS = "the of and a to in is it that for as with was at by on from this while near 的 在 与 如果".split()
VOCAB = Q.Vocabulary(WORDS)
LABELLED = [
    (PROSE, "prose"), (PROSE.replace("pump", "valve") + " " + PROSE, "prose"), ("\n".join(f"{i}. pump gate" for i in range(1, 12)), "list"), ("\n".join(["pump rate", "hall width", "duct", "exit door", "smoke vent"]), "list"),
    ("a\tb\tc\n" + "\n".join(f"x{i}\t{i}\tn/a" for i in range(9)), "table"), ("| a | b |\n" + "\n".join(f"| r{i} | {i} |" for i in range(9)), "table"), ("same line of text\n" * 20, "junk"), ("S p a c e d " * 30, "junk"),
]


def fitted():
    d = Q.described([t for t, _ in LABELLED], VOCAB)
    return Q.fit_profiles(d.distributions(), [k for _, k in LABELLED], d.chinese())


@pytest.mark.parametrize("text,kind", [
    (PROSE + " " + PROSE.replace("gate", "wall"), "prose"), ("\n".join(f"{i}. hall exit" for i in range(1, 30)), "list"), ("m\tn\to\n" + "\n".join(f"z{i}\t{i * 7}\tn/a" for i in range(20)), "table"),
    ("| k | v |\n" + "\n".join(f"| s{i} | {i * 3} |" for i in range(20)), "table"), ("another line again\n" * 30, "junk"), ("/$<|<=@<<@#</~^^/#|=+\n#^\\%=_+_&<>@*" * 9, "junk"), ("", "junk"), (" \n ", "junk"),
])
def test_kinds_by_nearest_profile(text, kind):
    assert Q.measured([text], VOCAB, fitted()).kind[0] == kind


def test_divergence_alone_decides():
    profiles = fitted()
    texts = [t for t, _ in LABELLED]
    swapped = Q.Profiles(profiles.rows, profiles.kinds[::-1], profiles.chinese)
    assert (Q.measured(texts, VOCAB, profiles).kind == [k for _, k in LABELLED]).all() and (Q.measured(texts, VOCAB, swapped).kind != [k for _, k in LABELLED]).mean() > 0.5
    a, b = np.zeros((1, Q.WIDTH), "f4"), np.zeros((1, Q.WIDTH), "f4")
    at = np.cumsum([0, *Q.PARTS.values()])[:-1]
    a[0, at], b[0, at + 1] = 1, 1
    assert abs(Q.divergences(a, b)[0, 0] - 1) < 1e-4 and Q.divergences(a, a)[0, 0] < 1e-5


def test_figures():
    f = Q.measured(["The pump is on.\n12 | x\n", "如果在的门。", "𝒳𠀀"], VOCAB, fitted()).to_dict("records")
    assert (f[0]["n_words"], f[0]["n_lines"], f[0]["stop_line_share"], f[0]["language"]) == (5, 2, 0.5, "en") and abs(f[0]["common_word_share"] - 3 / 5) < 1e-9
    assert abs(f[0]["mean_word_length"] - 12 / 5) < 1e-9 and abs(f[0]["digit_ratio"] - 2 / 23) < 1e-9
    assert (f[1]["n_words"], f[1]["language"], f[1]["stop_line_share"]) == (5, "zh", 1.0) and abs(f[1]["common_word_share"] - 4 / 5) < 1e-9 and f[2]["n_words"] == 1


def test_counts_do_not_depend_on_batches(monkeypatch):
    texts = [PROSE * 3, "", "x\ty\n" * 40, "\n\n", "如果在的门。\n" * 9]
    whole = Q.described(texts, VOCAB)
    monkeypatch.setattr(Q, "CHUNK", 50)
    parts = Q.described(texts, VOCAB)
    assert (whole.parts["words"] == parts.parts["words"]).all() and (whole.parts["repeats"][2:] == parts.parts["repeats"][2:]).all() and (whole.classes == parts.classes).all() and (whole.letters == parts.letters).all()


def test_quality_frame(spark):
    docs = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (4, PROSE * 2000, "x"), (1, PROSE, "x"), (5, "\n".join(["hall width", "duct"] * 4), "x")], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(1, "prose"), (9, "list"), (5, "list"), (5, "list"), (None, "junk"), (1, "other")], "doc_id long, label string")
    words = spark.createDataFrame([("the",), ("of",), (None,)], "word string")
    rows = Q.text_quality(docs, labels, words, key="doc_id", text="text").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and got[1]["kind"] == "prose" and got[5]["kind"] == "list" and got[2]["kind"] == got[3]["kind"] == "junk" and got[2]["n_words"] == 0 and got[4]["n_chars"] == len(PROSE) * 2000
    none = {r["doc_id"]: r["kind"] for r in Q.text_quality(docs, labels.limit(0), words.limit(0), key="doc_id", text="text").collect()}
    assert none == {1: None, 2: "junk", 3: "junk", 4: None, 5: None}
    assert Q.text_quality(docs.limit(0), labels, words, key="doc_id", text="text").count() == 0


def test_held_out_accuracy():
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    docs, labels = pd.read_parquet(f"{d}/documents.parquet").drop_duplicates("doc_id"), pd.read_parquet(f"{d}/doc_labels.parquet")
    vocab = Q.Vocabulary(pd.read_parquet(f"{d}/common_words.parquet").word.tolist())
    both = labels.merge(docs, on="doc_id")
    both = both[both.text.notna()]
    even, odd = both[both.doc_id % 2 == 0], both[both.doc_id % 2 == 1]
    seen = Q.described(even.text.tolist(), vocab)
    profiles = Q.fit_profiles(seen.distributions(), even.label.tolist(), seen.chinese())
    right = Q.measured(odd.text.tolist(), vocab, profiles).kind.to_numpy() == odd.label.to_numpy()
    assert right.mean() >= 0.97 and right[odd.label.to_numpy() != "prose"].mean() >= 0.9
