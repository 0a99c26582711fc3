"""Near duplicates, shared spans and string tiling against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tracebook.llm.minmax_hash import band_keys, char_shingles, expand_pairs, met_in_bands, near_duplicate_pairs, overlaps, signatures, word_shingles
from tracebook.llm.shared_spans import powers, shared_span_pairs, stripped, winnow
from tracebook.llm.string_tiling import letters_and_digits, seed_size, tiled_items, tiles

WORDS = "smoke layer exit door width fire vent hall pump riser foam mist gate roof duct".split()


def grams(t):
    return {t[i : i + 4] for i in range(len(t) - 3)}


def pairs_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, c string, t string, rid string, text string")
    pairs, members = near_duplicate_pairs(df, key="id", text=F.col("t"), block=F.col("c"), unit="char", size=4, threshold=0.6, **kw)
    return {(r["key_a"], r["key_b"]) for r in expand_pairs(pairs, members).collect()}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice(WORDS) for _ in range(14)) for _ in range(12)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        rows.append((f"k{i:03d}", rng.choice("xy"), "".join(t), "clash", "clash"))
    rows += [rows[0], ("n1", "x", None, "", ""), ("n2", None, base[0], "", ""), ("e1", "x", "abc", "", ""), ("e2", "x", "abc", "", ""), (None, "x", base[0], "", "")]
    seen = {r[0]: r for r in rows if r[0]}
    want = set()
    for a in seen.values():
        for b in seen.values():
            if a[0] < b[0] and a[1] and a[1] == b[1] and a[2] and b[2] and (u := grams(a[2]) | grams(b[2])) and len(grams(a[2]) & grams(b[2])) >= 0.6 * len(u):
                want.add((a[0], b[0]))
    assert len(want) > 30 and pairs_of(spark, rows) == want and pairs_of(spark, rows, hot=3) == want


def test_copies_cost_one_text(spark):
    rows = [(f"c{i:02d}", "x", "the same long text again", "", "") for i in range(30)]
    assert len(pairs_of(spark, rows)) == 30 * 29 // 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string")
    pairs, members = near_duplicate_pairs(df, key="id", text=F.col("t"))
    assert expand_pairs(pairs, members).count() == 0


def test_both_ends_of_a_permutation_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 300, "u8"), rng.integers(0, 2**63, 100, "u8")
    x, y = signatures(np.concatenate([a, a[:200], b]), np.array([0, 300, 600]), 512)
    assert abs((x == y).mean() - 0.5) < 0.05 and len(x) == 1024
    assert abs((x == y)[:512].mean() - (x == y)[512:].mean()) < 0.1
    assert len(set(band_keys(x[None], 4)[0])) == 256


def test_shingles_of_a_batch():
    texts = ["abcde", "", "abc", "aaaaaa", "abcde" * 3]
    h, starts = char_shingles(texts, 4)
    assert np.diff(starts).tolist() == [len(grams(t)) for t in texts] and set(h[: starts[1]]) < set(h[starts[4] :])
    h, starts = word_shingles(["one two", " ", "a b c d e f", "a b c d e", "two one"], 5)
    assert np.diff(starts).tolist() == [1, 0, 2, 1, 1] and h[starts[3]] in h[starts[2] : starts[3]] and h[0] != h[-1]
    common, every = overlaps(["abcde", "abc", "xyzw"], ["bcdef", "abc", "xyzw"], "char", 4)
    assert common.tolist() == [1, 0, 1] and every.tolist() == [3, 0, 1]


def test_signatures_in_blocks(monkeypatch):
    from tracebook.llm import minmax_hash as M

    rng = np.random.default_rng(3)
    h, starts = rng.integers(0, 2**63, 100, "u8"), np.array([0, 7, 8, 60, 100])
    whole = signatures(h, starts, 16)
    monkeypatch.setattr(M, "BLOCK", 9)
    assert (signatures(h, starts, 16) == whole).all()


def test_hot_bands_are_split_and_equal_ones_met_once(spark):
    rng = random.Random(8)
    rows = [(r, b) for b in range(4) for r in range(40)] + [(rng.randint(0, 99), 10 + rng.randint(0, 9)) for _ in range(150)]
    bands = spark.createDataFrame(sorted(set(rows)), "rid long, band long")
    want = {(a, b) for a, x in set(rows) for b, y in set(rows) if x == y and a < b}
    for hot in (1000, 7):
        got = [(r["rid_a"], r["rid_b"]) for r in met_in_bands(bands, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def brute_spans(rows, length):
    out = set()
    for a in rows:
        for b in rows:
            if None not in a and None not in b and a[0] < b[0] and a[1] != b[1]:
                s, t = stripped(a[2]), stripped(b[2])
                if any(s[i : i + length] in t for i in range(len(s) - length + 1)):
                    out.add((a[0], b[0]))
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop 烟气\n") for _ in range(n))
    passages = [text(n) for n in (40, 70, 98, 130, 300)]
    rows = [(f"k{i}", f"f{rng.randint(0, 6)}", text(rng.randint(0, 150)) + rng.choice(passages) + text(rng.randint(0, 90))) for i in range(60)]
    rows += [rows[0], ("n", None, passages[4]), ("m", "f1", None), (None, "f2", passages[4]), ("e", "f3", ""), ("w", "f4", "x" * 2000), ("v", "f5", "x" * 300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "key string, grp string, text string, fp string")
    want = brute_spans(rows, 100)
    assert len(want) > 100 and ("v", "w") in want
    for hot in (10_000, 3):
        got = {(r["key_a"], r["key_b"]) for r in shared_span_pairs(df, length=100, phrases_per_shard=20, hot=hot).collect()}
        assert got == want
    assert shared_span_pairs(df.limit(0)).count() == 0


def test_texts_longer_than_a_chunk(monkeypatch):
    from tracebook.llm import shared_spans as S

    monkeypatch.setattr(S, "CHUNK", 400)
    import pandas as pd

    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(1500))
    frame = pd.DataFrame({"grp": [1, 2], "rid": [7, 8], "text": [t, "short"]})
    fps = {h for f in S._phrases(40, 100)(iter([frame])) for h in f["fp"]}
    given = next(S._phrase_texts(40, 100)(iter([pd.DataFrame({"text": [t], "fps": [sorted(fps)]})])))
    whole = set(given["phrase"])
    assert set(given["fp"]) == fps and all(any(t[i + j : i + j + 40] in whole for j in range(61)) for i in range(len(t) - 99))


def test_records_go_only_to_shards_they_can_meet(spark, monkeypatch):
    from tracebook.llm import shared_spans as S

    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefghijklmnop") for _ in range(220)) for _ in range(40)]
    rows = [(f"k{i}", f"f{i % 7}", "".join(rng.choice("qrstuv") for _ in range(150)) + passages[i % 40]) for i in range(120)] + [(f"n{i}", "f9", "".join(rng.choice("qrstuvwxyz") for _ in range(400))) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, grp string, text string")
    sent = []
    plain = S._occurrences
    monkeypatch.setattr(S, "_occurrences", lambda path, k, length: sent.append(path) or plain(path, k, length))
    got = {(r["key_a"], r["key_b"]) for r in S.shared_span_pairs(df, length=100, phrases_per_shard=5).collect()}
    assert got == brute_spans(rows, 100) and len(sent) == 1
    shards = spark.read.parquet(sent[0])
    assert shards.select("shard").distinct().count() >= 20 and shards.count() == shards.select("fp").distinct().count()


def test_every_window_keeps_a_phrase():
    rng = random.Random(9)
    t = "".join(rng.choice("ab") for _ in range(700))
    _, at, _ = winnow([t], 40, 100, powers(1000))
    assert all(any(i <= p <= i + 60 for p in at) for i in range(len(t) - 99))


def greedy(doc, item, least):
    """Greedy tiling by comparing all places."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_i[i : i + best]) and all(free_d[j : j + best]):
                free_i[i : i + best] = free_d[j : j + best] = [False] * best
                out.append((i, j, best))


def test_running_karp_rabin_tiles_as_greedily(monkeypatch):
    rng = random.Random(3)
    for n in range(60):
        item = "".join(rng.choice("ab" if n % 2 else "abcdefgh") for _ in range(rng.randint(1, 40)))
        parts = [item[i : i + rng.randint(2, 15)] for i in range(0, len(item), 5)]
        doc = "".join(rng.choice([*parts, "xy", "a"]) for _ in range(rng.randint(0, 12)))
        least = rng.randint(2, 6)
        assert tiles(doc, item, least) == greedy(doc, item, least)
        size = rng.randint(1, 4)
        if min(len(doc), len(item)) >= size:
            from tracebook.llm import string_tiling as T

            pows = powers(100)
            sides = [T._unmarked_hashes(T.prefix_hashes(T.codes_of(t), pows[0]), pows[1], np.zeros(len(t), bool), size) for t in (item, doc)]
            assert T.longest_matches(*sides[0], *sides[1], size) == T.longest_matches(*sides[0], *sides[1], size, at_once=0)


def test_items_cut_in_many_shuffled_parts(spark):
    rng = random.Random(12)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    docs = []
    for n in (2, 4, 5, 8, 10):
        parts = [item[i : i + 200 // n] for i in range(0, 200, 200 // n)]
        rng.shuffle(parts)
        docs.append((n, "".join(x + "".join(rng.choice("0123456789") for _ in range(9)) for x in parts)))
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r["doc_key"]: r["covered"] for r in tiled_items(a, b, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect()}
    assert got.keys() == {"2", "4", "5", "8", "10"} and min(got.values()) >= 190


def test_tiling_catches_reordered_passages():
    item = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert tiles("zz" + item[18:] + "--" + item[:18], item, 6) == [(0, 22, 18), (18, 2, 18)]
    assert tiles("nothing", item, 6) == []
    assert sum(n for *_, n in tiles(item[:12] * 3, item, 6)) == 12


def test_items_against_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijk .,") for _ in range(n))
    items = [(i, text(rng.randint(12, 200))) for i in range(30)] + [(90, None), (91, ""), (92, "?!"), (93, "ab")]
    docs = []
    for d in range(120):
        n = letters_and_digits(items[rng.randrange(30)][1])
        part = n[(a := rng.randint(0, len(n) // 2)) : a + rng.randint(len(n) // 3, len(n))]
        docs.append((d, text(rng.randint(0, 300)) + " ".join(part).upper() + text(rng.randint(0, 50))))
    docs += [docs[0], (500, None), (501, ""), (None, items[0][1])]
    a = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id int, text string, item_key string")
    b = spark.createDataFrame(items, "item_id int, text string")
    want = set()
    for d, t in docs:
        for i, s in items:
            if d is not None and t and s and (n := letters_and_digits(s)):
                half, whole = -(-len(n) // 2), letters_and_digits(t)
                if any(n[j : j + half] in whole for j in range(len(n) - half + 1)):
                    want.add((str(d), str(i)))
    for block in (10_000, 7):
        found = tiled_items(a, b, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text", block=block).filter("2 * longest >= item_length")
        assert {(r["doc_key"], r["item_key"]) for r in found.collect()} == want
    assert tiled_items(a, b.limit(0), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").count() == 0
    assert all(2 * seed_size(r) - 1 <= max(r, 1) + (r < 9) for r in range(1, 400))


def test_items_in_pieces_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijk .,") for _ in range(n))
    items = [(i, text(rng.randint(60, 300))) for i in range(30)] + [(90, "ab"), (91, text(20))]
    docs = [(d, text(rng.randint(0, 200))) for d in range(20)]
    for d in range(20, 120):
        n = letters_and_digits(items[d % 30][1])
        size = rng.randint(6, max(7, len(n) // 4 - 1))
        pieces = [n[i : i + size] for i in range(0, len(n), size)]
        docs.append((d, "".join(text(rng.randint(0, 40)) + "!" + x + "z" for x in rng.sample(pieces, rng.randint(1, len(pieces))))))
    want = {}
    for d, t in docs:
        for i, s in items:
            n = letters_and_digits(s)
            half = -(-len(n) // 2)
            laid = [x[2] for x in tiles(letters_and_digits(t), n, max(1, min(12, (half + 1) // 2)))]  # equal to the greedy tiling by the test above
            if laid and (sum(laid) >= half or 2 * max(laid) >= half):
                want[str(d), str(i)] = (max(laid), sum(laid), len(laid))
    short = [k for k, v in want.items() if 4 * v[0] < len(letters_and_digits(dict(items)[int(k[1])]))]
    assert len(short) > 15
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for block, chars in ((10_000, 10**6), (7, 10**6), (10_000, 900)):
        found = tiled_items(a, b, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text", block=block, block_chars=chars)
        assert {(r["doc_key"], r["item_key"]): (r["longest"], r["covered"], r["tiles"]) for r in found.collect()} == want
