"""Near-duplicate pairs by min-max hashing.

Each permutation of the shingle hashes gives two values of the signature, its
minimum and its maximum, so half as many hash evaluations make a signature of
a given length; both collide with a probability equal to the Jaccard
similarity and the estimate stays unbiased, with less variance. The values are
banded; texts that agree in a whole band are candidates, and every candidate
is then measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracebook.sources.tables import stage

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters hashed at once, and shingles permuted at once.
CHARS, BLOCK = 1_000_000, 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads near values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, ascending, and where each owner begins."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n + 1))


def _windows(units: np.ndarray, sizes: np.ndarray, size: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each run of `size` units within one text; of a text
    with fewer, all of them as one run, if wanted."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    left = np.repeat(sizes, sizes) - (np.arange(len(units)) - np.repeat(first, sizes))  # units from here to the text's end
    padded = np.concatenate([units, np.zeros(size, "u8")])
    h = np.zeros(len(units), "u8")
    for i in range(size):
        h = np.where(left > i, mix(h ^ padded[i : i + len(units)] + np.uint64(i + 1)), h)
    begins = left >= size
    if whole_if_short:
        begins |= (np.repeat(sizes, sizes) < size) & (left == np.repeat(sizes, sizes))
    return owner[begins], h[begins]


def char_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct substrings of `size` code points of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    owner, h = _windows(codes, np.fromiter(map(len, texts), "i8", len(texts)), size, False)
    return _distinct(owner, h, len(texts))


def word_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of `size` blank-separated words of each text
    (all words as one, if there are fewer)."""
    words = [t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.empty(0, "u8")
    owner, h = _windows(hashes, np.fromiter(map(len, words), "i8", len(texts)), size, True)
    return _distinct(owner, h, len(texts))


SHINGLES = {"char": char_shingles, "word": word_shingles}


def in_parts(texts: list[str]) -> Iterator[slice]:
    """Slices of the texts of about CHARS characters; a longer text is one of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > CHARS:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def signatures(h: np.ndarray, starts: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """Minimum and maximum of each permutation, for each owner of the hashes
    (every owner must have some): 2 * permutations values a row."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, permutations, "u8") * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, permutations, "u8")
    n = len(starts) - 1
    low, high = np.full((permutations, n), ~np.uint64(0)), np.zeros((permutations, n), "u8")
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        one = np.searchsorted(starts, at, side="right") - 1
        last = np.searchsorted(starts, at + len(part), side="left")
        cuts = np.maximum(starts[one:last], at) - at
        for k in range(permutations):
            p = part * a[k] + b[k]
            low[k, one:last] = np.minimum(low[k, one:last], np.minimum.reduceat(p, cuts))
            high[k, one:last] = np.maximum(high[k, one:last], np.maximum.reduceat(p, cuts))
    return np.concatenate([low, high]).T


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of `rows` values of each signature; the band's place is part of it."""
    bands = sigs.reshape(len(sigs), -1, rows)
    h = np.tile(np.arange(1, bands.shape[1] + 1, dtype="u8"), (len(sigs), 1))
    for i in range(rows):
        h = mix(h * MIX2 ^ bands[:, :, i])
    return h


def _banded(unit: str, size: int, permutations: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, rid = f["text"].tolist(), f["rid"].to_numpy("i8")
            salt = pd.util.hash_array(f["block"].to_numpy(object))
            for part in in_parts(texts):
                h, starts = SHINGLES[unit](texts[part], size)
                held = np.flatnonzero(np.diff(starts))
                if len(held):
                    keys = mix(band_keys(signatures(h, np.append(starts[held], len(h)), permutations), rows) ^ salt[part][held][:, None]).view("i8")
                    yield pd.DataFrame({"rid": rid[part][held], "keys": pd.Series(list(keys), dtype=object)})

    return run


def overlaps(first: list[str], second: list[str], unit: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts how many shingles both have, and how many either
    has. Each distinct text is cut once."""
    codes, distinct = pd.factorize(np.array(first + second, dtype=object))
    h, starts = SHINGLES[unit](distinct.tolist(), size)
    many = np.diff(starts)
    a, b = codes[: len(first)], codes[len(first) :]
    # the shingles of all texts as ascending keys; those of one side are looked up among the other's
    names, place = np.unique(h, return_inverse=True)
    keys = np.repeat(np.arange(len(distinct)), many) * max(1, len(names)) + place
    few, other = np.where(many[a] <= many[b], a, b), np.where(many[a] <= many[b], b, a)
    sizes = many[few]
    pair = np.repeat(np.arange(len(a)), sizes)
    at = starts[few][pair] - (np.cumsum(sizes) - sizes)[pair] + np.arange(len(pair))
    wanted = other[pair] * max(1, len(names)) + place[at]
    held = keys[np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))] == wanted if len(keys) else np.zeros(0, bool)
    common = np.bincount(pair[held], minlength=len(a))
    return common, many[a] + many[b] - common


def similar(unit: str, size: int, threshold: float):
    """A vectorised test of pairs of texts: |common| >= threshold * |all|."""

    @F.pandas_udf(BooleanType())
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        first, second = a.tolist(), b.tolist()
        out = np.zeros(len(first), bool)
        for part in in_parts([x + y for x, y in zip(first, second)]):
            common, every = overlaps(first[part], second[part], unit, size)
            out[part] = (common >= threshold * every) & (every > 0)
        return pd.Series(out)

    return test


def met_in_bands(bands: DataFrame, hot: int) -> DataFrame:
    """rid_a, rid_b, rid_a < rid_b: the rids that share a band, once each.
    `bands`: rid, band.

    Bands with the very same rids (a family of near copies agrees in most) are
    joined once, told by two hashes of the set of rids. A band of more than
    `hot` rids is salted: its rids are spread over salts, and every two salts
    meet in a task of their own."""
    h = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *h).filter("n > 1")
    once = shared.groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    met = bands.join(once, "band").withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("salts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")
    spread = met.select("band", "rid", "salt", other).select("band", "rid", F.least("salt", "other").alias("s"), F.greatest("salt", "other").alias("t"), "salt")
    a, b = spread.alias("a"), spread.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.t") == F.col("b.t"))
    # of two salts the first meets the second; within one salt all meet
    ordered = ((F.col("a.s") == F.col("a.t")) & (F.col("a.rid") < F.col("b.rid"))) | ((F.col("a.s") < F.col("a.t")) & (F.col("a.salt") < F.col("b.salt")))
    pairs = a.join(b, same & ordered)
    return pairs.select(F.least("a.rid", "b.rid").alias("rid_a"), F.greatest("a.rid", "b.rid").alias("rid_b")).distinct()


def near_duplicate_pairs(df: DataFrame, *, key: str, text: Column, block: Column | None = None, unit: str = "word", size: int = 5, threshold: float = 0.8, permutations: int = 128, rows: int = 4, hot: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Pairs between distinct texts, and who holds each text.

    Returns `pairs`(rid_a, rid_b), rid_a < rid_b, of the texts of one block
    whose sets of shingles share at least `threshold` of their union, and
    `members`(key, rid). Equal texts of one block are one rid, so copies cost
    one row however many there are. A row with a null key or block, or with
    too little text for a shingle, is in no pair; a null text counts as empty;
    rows repeated in full count once. Only the key, text and block are read.

    A pair at similarity s is a candidate with probability
    1 - (1 - s^rows)^(2 * permutations / rows): 0.99986 at 0.6 with the
    defaults, 0.9999999 at 0.75. No bucket is capped; a bucket of one band is
    joined, not collected, and split beyond `hot` texts.
    """
    block = F.lit("") if block is None else block
    plain = df.select(F.col(key).alias("key"), block.alias("block"), F.coalesce(text, F.lit("")).alias("text")).filter(F.col("key").isNotNull() & F.col("block").isNotNull())
    # what has no shingle is like nothing, not even its copies
    plain = plain.filter(F.length("text") >= size if unit == "char" else F.col("text").rlike(r"\S"))
    texts = stage(plain.select("block", "text").distinct().withColumn("rid", F.monotonically_increasing_id()), "texts")
    banded = texts.mapInPandas(_banded(unit, size, permutations, rows), "rid long, keys array<long>")
    bands = stage(banded.select("rid", F.explode("keys").alias("band")), "bands")
    near = met_in_bands(bands, hot)
    sides = [texts.select(F.col("rid").alias(f"rid_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"]
    pairs = near.join(sides[0], "rid_a").join(sides[1], "rid_b").filter(similar(unit, size, threshold)("text_a", "text_b")).select("rid_a", "rid_b")
    members = plain.join(texts, ["block", "text"]).select("key", "rid").distinct()
    return pairs, members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """key_a, key_b (key_a < key_b): the pairs between the holders of similar
    texts and between the holders of one text."""
    between = pairs.join(members.select(F.col("key").alias("x"), F.col("rid").alias("rid_a")), "rid_a").join(members.select(F.col("key").alias("y"), F.col("rid").alias("rid_b")), "rid_b").select("x", "y")
    within = members.select("rid", F.col("key").alias("x")).join(members.select("rid", F.col("key").alias("y")), "rid").filter("x < y").select("x", "y")
    return between.union(within).filter("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
