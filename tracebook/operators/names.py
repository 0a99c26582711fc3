"""Similar names within a group, by the ratio of matching blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebook.sources.tables import without_broadcast

#: 64-bit words of a signature, and names in a block.
WORDS, BLOCK = 4, 4096


class Block:
    """Names in the order of their lengths, their characters in one array, and
    a signature of each: a bit for every character and how often it came before.
    A bit of one name that another has not is a character that it can't match."""

    def __init__(self, names: list[str]) -> None:
        self.names = sorted(names, key=lambda n: (len(n), n))
        self.size = np.array([len(n) for n in self.names], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.chars = np.frombuffer("".join(self.names).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        self.of = np.repeat(np.arange(len(self.names)), self.size)
        keys = np.sort(self.of << 32 | self.chars)
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        again = np.arange(len(keys)) - np.repeat(new, np.diff(new, append=len(keys)))
        h = ((keys & 0xFFFFFFFF) * 0x9E3779B1 + again * 0x85EBCA77) & 0xFFFFFFFF
        h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
        bit = (h ^ h >> 13) % (64 * WORDS)
        self.signature = np.zeros((WORDS, len(self.names)), dtype=np.uint64)
        np.bitwise_or.at(self.signature, (bit >> 6, keys >> 32), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.folded = np.bitwise_or.reduce(self.signature, axis=0)

    def places(self) -> np.ndarray:
        """For each name and each character, hashed to a byte, the places among
        the first 64 where it stands, as bits."""
        at = np.arange(len(self.chars)) - np.repeat(self.begin, self.size)
        held, out = at < 64, np.zeros((len(self.names), 256), dtype=np.uint64)
        np.bitwise_or.at(out, (self.of[held], self.chars[held] & 255), np.uint64(1) << at[held].astype(np.uint64))
        return out


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """The least characters that must match where two names have `size` together."""
    return np.ceil(threshold * size / 2 - 1e-9).astype(np.int64)


def alike_by_folded(a: Block, b: Block, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of each name of `a` those of `b` that their signatures, folded to a word,
    rule out neither as alike nor as one the part of the other; of a block with
    itself those further back."""
    own, other, size = a.folded, b.folded, None
    lacks = ~other
    for i in range(len(a.names)):
        start = i + 1 if a is b else 0
        if size != a.size[i]:
            size = a.size[i]
            need = needed(size + b.size, threshold)
            fits = np.flatnonzero((need <= size) & (need <= b.size))
            middle = np.searchsorted(b.size, size)
            first, last = (fits[0], fits[-1] + 1) if len(fits) else (middle, middle)
            spare, spare_b = (np.minimum(x - need, 255).clip(0).astype(np.uint8) for x in (size, b.size))
        lo, mid, hi = max(first, start), max(middle, start), max(last, start)
        only = np.bitwise_count(lacks[lo:] & own[i])
        only_b = np.bitwise_count(other[start:hi] & ~own[i])
        kept = np.concatenate([only_b[: mid - start], only[mid - lo :]]) == 0
        kept[lo - start : hi - start] |= (only[: hi - lo] <= spare[lo:hi]) & (only_b[lo - start :] <= spare_b[lo:hi])
        yield i, np.flatnonzero(kept) + start


def alike_by_signature(a: Block, i: np.ndarray, b: Block, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of names i of `a` and j of `b` whole signatures don't rule out."""
    only, only_b = np.zeros((2, len(i)), dtype=np.int64)
    for own, other in zip(a.signature, b.signature):
        x, y = own[i], other[j]
        only += np.bitwise_count(x & ~y)
        only_b += np.bitwise_count(y & ~x)
    n, m = a.size[i], b.size[j]
    need = needed(n + m, threshold)
    return ((only <= n - need) & (only_b <= m - need)) | ((only == 0) & (n <= m)) | ((only_b == 0) & (m <= n))


def most_matching(a: Block, places: np.ndarray, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """An upper bound of the characters that names i of `a` and j of `b` match:
    their longest common subsequence, by bits, of the first 64 characters of the
    former; those beyond count as matched."""
    order = np.argsort(-b.size[j], kind="stable")
    i, j = i[order], j[order]
    left, begin = -b.size[j], b.begin[j]
    state = np.full(len(i), ~np.uint64(0))
    for k in range(-left[0] if len(left) else 0):
        n = np.searchsorted(left, -k)
        now = state[:n]
        hit = now & places[i[:n], b.chars[begin[:n] + k] & 255]
        state[:n] = (now + hit) | (now - hit)
    out = np.empty(len(i), dtype=np.int64)
    out[order] = np.bitwise_count(~state) + np.maximum(a.size[i] - 64, 0)
    return out


def alike(a: Block, b: Block, threshold: float, at_once: int = 200_000) -> Iterator[tuple[str, str, float]]:
    """name_a, name_b (the greater) and ratio of the pairs of a name of `a` and
    one of `b` that match; of a block with itself each pair once."""
    places, matcher = a.places(), SequenceMatcher()

    def settled(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[str, str, float]]:
        i, j = np.repeat([i for i, _ in held], [len(j) for _, j in held]), np.concatenate([j for _, j in held])
        near = alike_by_signature(a, i, b, j, threshold)
        i, j = i[near], j[near]
        least = np.minimum(a.size[i], b.size[j])  # that many where one holds the other
        near = most_matching(a, places, i, b, j) >= np.minimum(needed(a.size[i] + b.size[j], threshold), least)
        pairs = [(a.names[p], b.names[q]) for p, q in zip(i[near], j[near])]
        for y, x in sorted((max(p), min(p)) for p in pairs):
            if x in y or y in x:
                yield x, y, 1.0
                continue
            if matcher.b != y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            if (ratio := matcher.ratio()) >= threshold:
                yield x, y, ratio

    held: list[tuple[int, np.ndarray]] = []
    count = 0
    for i, j in alike_by_folded(a, b, threshold):
        held.append((i, j))
        count += len(j)
        if count >= at_once:
            yield from settled(held)
            held, count = [], 0
    if count:
        yield from settled(held)


def similar_names(items: DataFrame, *, group: str, name: str, threshold: float = 0.82) -> DataFrame:
    """group, name_a, name_b, ratio: pairs of different names of a group, in lower
    case and trimmed, the smaller first, whose matching blocks make at least `threshold` of both,
    or of which one holds the other (ratio 1).

    Names of a group are dealt to blocks of about BLOCK by their hashes, and
    each pair of blocks is one unit of work, so no task has all names of a group.
    In it every pair is met, but only bits are compared: signatures first, then
    bounds of the longest common subsequence for what these leave; both rule out
    only what can't match. The rest is compared in full, and only what matches
    leaves the unit. Memory stays as it is, time grows with the square of a
    group's names, and so does what is shuffled beyond BLOCK of them, as every
    name goes to each unit of its block.
    """
    names = items.select(F.col(group).alias("g"), F.lower(F.trim(name)).alias("name")).filter("g is not null and name <> ''").distinct()
    parts = names.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = names.join(without_broadcast(parts), "g").withColumn("p", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    met = dealt.select("g", "name", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    units = met.select("g", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("first"), "name")
    tasks = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(unit: pd.DataFrame) -> pd.DataFrame:
        a = Block(unit["name"][unit["first"]].tolist())
        b = a if unit["i"].iloc[0] == unit["j"].iloc[0] else Block(unit["name"][~unit["first"]].tolist())
        out = pd.DataFrame(alike(a, b, threshold), columns=["x", "y", "ratio"])
        return out.assign(g=unit["g"].iloc[0])[["g", "x", "y", "ratio"]]

    # a number of tasks of its own: few bytes are much work here, and tasks must not be merged by bytes
    pairs = units.repartition(tasks, "g", "i", "j").groupBy("g", "i", "j").applyInPandas(compared, "g string, x string, y string, ratio double")
    return pairs.select(F.col("g").alias(group), F.col("x").alias("name_a"), F.col("y").alias("name_b"), F.round("ratio", 6).alias("ratio"))
