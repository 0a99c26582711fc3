"""Long exact spans shared between records, by repeated-phrase automata.

1. Every record is winnowed: of each window of consecutive phrases of K
   characters the one with the least hash is kept, so any two records that
   share LENGTH characters keep at least one phrase of that span in common.
   Only hashes are staged.
2. A phrase kept in two or more groups (files) is confirmed as recurring; its
   text is taken from one record that holds it.
3. The recurring phrases are compiled to Aho-Corasick automata, in shards of a
   bounded number of phrases. The hashes tell which shards a record can meet:
   it streams through the automata of those, which locate every occurrence.
4. Occurrences of one phrase are extended to both sides; the pair counts if
   the equal text around it is LENGTH characters or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracebook.llm.minmax_hash import mix
from tracebook.sources.tables import stage, staging_path, without_broadcast

PRIME = 0x9E3779B97F4A7C15
PLACE = 20
CHUNK = 500_000
#: Tasks that may hold the automaton of one shard.
SPREAD = 16

#: The automaton a Python worker holds: one shard at a time.
_HELD: dict = {}


def stripped(text: str) -> str:
    return text.replace(" ", "").replace("\n", "").replace("\t", "").replace("\r", "")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(PRIME, -1, 2**64)
    return tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(n, p, "u8"), dtype="u8")]) for p in (PRIME, inverse))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values."""
    n = len(v)
    padded = np.full(-(-n // w) * w, ~np.uint64(0))
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def winnow(texts: list[str], k: int, length: int, pows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept phrases of joined texts of `length` or more characters each: their
    hashes, starts in the joined text, and texts' numbers."""
    w = length - k + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    sizes = np.fromiter(map(len, texts), "int64", len(texts))
    ends = np.cumsum(sizes)
    n = len(codes)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((codes + np.uint64(1)) * pows[0][:n], dtype="u8")])
    h = mix((total[k:] - total[:-k]) * pows[1][: n - k + 1])
    order = (h & ~np.uint64(2**PLACE - 1)) | np.arange(len(h), dtype="u8")
    least = sliding_min(order, w) & np.uint64(2**PLACE - 1)
    inside = np.ones(len(least), bool)  # windows that lie in one text
    for e in ends[:-1]:
        inside[max(0, e - length + 1) : e] = False
    at = np.unique(least[inside]).astype("int64")
    return h[at].view("i8"), at, np.searchsorted(ends, at, side="right")


def _phrases(k: int, length: int):
    """fp, grp, rid of the kept phrases of each record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pows = powers(CHUNK)
        for f in frames:
            texts, groups, rids, held = [], [], [], 0
            every = [(t, g, r) for t, g, r in zip(map(stripped, f["text"]), f["grp"], f["rid"]) if len(t) >= length]
            for i, (t, g, r) in enumerate(every):
                texts.append(t)
                groups.append(g)
                rids.append(r)
                held += len(t)
                if i + 1 == len(every) or held + len(every[i + 1][0]) > CHUNK:
                    if held > CHUNK:  # one text longer than that, in overlapping parts
                        parts = [([t[j : j + CHUNK]], [g], [r]) for j in range(0, len(t) - length + 1, CHUNK - length + 1)]
                    else:
                        parts = [(texts, groups, rids)]
                    for some, of, ids in parts:
                        h, _, which = winnow(some, k, length, pows)
                        yield pd.DataFrame({"fp": h, "grp": np.array(of, "int64")[which], "rid": np.array(ids, "int64")[which]})
                    texts, groups, rids, held = [], [], [], 0

    return run


def _phrase_texts(k: int, length: int):
    """fp, phrase: the texts of the phrases that each record is to give (`fps`)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps, phrases = [], []
            for text, wanted in zip(f["text"], f["fps"]):
                t, wanted = stripped(text), set(wanted)
                pows = powers(min(len(t), CHUNK))
                for j in range(0, len(t) - length + 1, CHUNK - length + 1):
                    h, at, _ = winnow([t[j : j + CHUNK]], k, length, pows)
                    for fp, p in zip(h.tolist(), at.tolist()):
                        if fp in wanted:
                            fps.append(fp)
                            phrases.append(t[j + p : j + p + k])
            yield pd.DataFrame({"fp": np.array(fps, "int64"), "phrase": pd.Series(phrases, dtype=object)})

    return run


def _automaton(path: str, shard: int):
    import ahocorasick

    if _HELD.get("is") != (path, shard):
        _HELD.clear()
        where, base = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        found = ds.dataset(f"{base}/shard={shard}", filesystem=where, format="parquet").to_table(columns=["fp", "phrase"])
        a = ahocorasick.Automaton()
        for fp, phrase in zip(found["fp"].to_pylist(), found["phrase"].to_pylist()):
            a.add_word(phrase, fp)
        if len(a):
            a.make_automaton()
        _HELD.update({"is": (path, shard), "a": a})
    return _HELD["a"]


def _occurrences(path: str, k: int, length: int):
    side = length - k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for shard, key, grp, text in zip(f["shard"], f["key"], f["grp"], f["text"]):
                a = _automaton(path, shard)
                t = stripped(text)
                if len(a):
                    for end, fp in a.iter(t):
                        s = end - k + 1
                        out.append((fp, key, grp, len(t), s, t[max(0, s - side) : s], t[end + 1 : end + 1 + side]))
            yield pd.DataFrame(out, columns=["fp", "key", "grp", "n", "at", "before", "after"])

    return run


def common_start(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def extends(k: int, length: int):
    """Whether the equal text around two occurrences has `length` characters."""

    @F.pandas_udf(BooleanType())
    def test(ab: pd.Series, bb: pd.Series, aa: pd.Series, ba: pd.Series) -> pd.Series:
        return pd.Series([k + common_start(c, d) + common_start(a[::-1], b[::-1]) >= length for a, b, c, d in zip(ab, bb, aa, ba)], dtype=bool)

    return test


def _windows(k: int, length: int):
    """Of each text of `length` characters around an occurrence two hashes (h, m),
    where it begins and how far left of the phrase."""
    side = length - k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pows = powers(2 * side + 1)
        for f in frames:
            hashes: list[list[np.ndarray]] = [[], []]
            row, left, size = [], [], []
            for i, (before, after) in enumerate(zip(f["before"], f["after"])):
                most, least = len(before), max(0, side - len(after))
                if most < least:
                    continue
                codes = np.frombuffer((before + after).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
                lefts = np.arange(least, most + 1)
                for j in (0, 1):
                    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(codes + np.uint64(7 * j + 1)) * pows[0][: len(codes)], dtype="u8")])
                    begin = most - lefts
                    hashes[j].append(mix((total[begin + side] - total[begin]) * pows[1][begin] ^ lefts.astype("u8")))
                row.append(np.full(len(lefts), i))
                left.append(lefts)
                size.append(len(lefts))
            if not row:
                continue
            which, lefts = np.concatenate(row), np.concatenate(left)
            out = {"fp": f["fp"].to_numpy()[which], "key": f["key"].to_numpy()[which], "grp": f["grp"].to_numpy()[which], "left": lefts.astype("int32")}
            yield pd.DataFrame(out | {"start": (f["at"].to_numpy()[which] - lefts).astype("int32"), "h": np.concatenate(hashes[0]).view("i8"), "m": np.concatenate(hashes[1]).view("i8")})

    return run


WINDOW = "fp long, key string, grp long, left int, start int, h long, m long"


def phrase_occurrences(records: DataFrame, length: int, k: int, phrases_per_shard: int) -> DataFrame:
    """fp, key, grp, n, at, before, after: every occurrence of every recurring
    phrase in the records that can share it, staged; n is the stripped length
    of the record and at the place in it. `records` as in
    `shared_span_pairs`.

    The phrases of one record stay in one shard, so that records that share a
    passage meet in few. Of one shard, up to SPREAD tasks read the records."""
    spark = records.sparkSession
    rows = records.filter(F.col("key").isNotNull() & F.col("grp").isNotNull() & (F.length("text") >= length)).select("key", F.xxhash64("grp").alias("grp"), "text")
    # a clash of rids only sends one record more through an automaton
    rows = rows.withColumn("rid", F.xxhash64("key", "text"))
    kept = stage(rows.select("grp", "rid", "text").mapInPandas(_phrases(k, length), "fp long, grp long, rid long").distinct(), "phrases")
    recurring = kept.groupBy("fp").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min("rid").alias("giver")).filter("low <> high").select("fp", "giver")
    confirmed = stage(recurring, "confirmed")
    shards = max(1, -(-confirmed.count() // phrases_per_shard))
    shard = F.pmod(F.xxhash64("giver"), F.lit(shards)).cast("int").alias("shard")

    givers = confirmed.groupBy(F.col("giver").alias("rid")).agg(F.collect_list("fp").alias("fps"))
    texts = without_broadcast(rows.select("rid", "text")).join(givers, "rid").mapInPandas(_phrase_texts(k, length), "fp long, phrase string").distinct()
    path = staging_path(spark, "shards")
    without_broadcast(texts).join(confirmed.select("fp", shard), "fp").repartition("shard").write.partitionBy("shard").parquet(path)

    route = without_broadcast(kept.select("fp", "rid")).join(confirmed.select("fp", shard), "fp").select("rid", "shard").distinct()
    routed = without_broadcast(rows).join(route, "rid").select("shard", "key", "grp", "text")
    by_shard = routed.repartition("shard", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("shard")
    found = by_shard.mapInPandas(_occurrences(path, k, length), "fp long, key string, grp long, n int, at int, before string, after string")
    return stage(found, "occurrences")


def _paired(df: DataFrame, on: list[str]) -> DataFrame:
    a, b = df.alias("a"), df.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & (F.col("a.grp") != F.col("b.grp")) & (F.col("a.key") < F.col("b.key")))


def shared_span_pairs(records: DataFrame, *, length: int = 100, k: int = 40, phrases_per_shard: int = 50_000, hot: int = 200) -> DataFrame:
    """key_a, key_b (key_a < key_b): the records of different groups that share
    `length` or more consecutive characters, whitespace (space, tab, CR, LF)
    left out.

    `records`: key STRING, grp STRING, text STRING; others are not read. Rows
    with a null are left out, texts shorter than `length` are in no pair, rows
    repeated in full count once. A phrase with more than `hot` occurrences is
    not paired occurrence by occurrence but by its equal surroundings of
    `length` characters, so that only true pairs are ever made of it.
    """
    met = phrase_occurrences(records, length, k, phrases_per_shard).drop("n")
    often = met.groupBy("fp").count().filter(F.col("count") > hot).select("fp")
    few, many = met.drop("at").join(often, "fp", "left_anti").distinct(), met.join(often, "fp", "left_semi").distinct()
    keys = F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")
    of_few = _paired(few, ["fp"]).filter(extends(k, length)("a.before", "b.before", "a.after", "b.after")).select(*keys)
    around = many.mapInPandas(_windows(k, length), WINDOW).drop("start").distinct()
    return of_few.union(_paired(around, ["fp", "left", "h", "m"]).select(*keys)).distinct()


def shared_portions(records: DataFrame, *, length: int = 100, k: int = 40, phrases_per_shard: int = 50_000) -> DataFrame:
    """key, n, spans, shared, share: of each record that shares something, its
    length without whitespace, the number of spans of it that stand in records
    of other groups as well, their characters, and their part of the record.

    All texts of `length` characters around an occurrence are compared by
    equality across groups, so a phrase that stands in a third of all records
    costs rows in proportion, not pairs. Takes records as `shared_span_pairs`.
    """
    met = phrase_occurrences(records, length, k, phrases_per_shard)
    window = met.distinct().mapInPandas(_windows(k, length), WINDOW).select("key", "grp", "start", F.xxhash64("fp", "left", "h").alias("h"), F.xxhash64("fp", "left", "m", F.lit(1)).alias("m")).distinct()
    elsewhere = window.groupBy("h", "m").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("h", "m")
    starts = window.join(elsewhere, ["h", "m"], "left_semi").select("key", "start").distinct()
    w = Window.partitionBy("key").orderBy("start")
    gap = F.col("start") - F.lag("start").over(w)
    cut = starts.withColumns({"new": F.coalesce((gap > length).cast("int"), F.lit(1)), "fresh": F.least(F.coalesce(gap, F.lit(length)), F.lit(length))})
    size = met.select("key", "n").groupBy("key").agg(F.max("n").alias("n"))
    return cut.groupBy("key").agg(F.sum("new").alias("spans"), F.sum("fresh").cast("long").alias("shared")).join(size, "key").select("key", "n", "spans", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("share"))
