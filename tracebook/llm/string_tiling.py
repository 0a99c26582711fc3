"""Held-out items inside documents, by greedy string tiling.

Documents and items are reduced to their letters and digits. The seeds of an
item are all its substrings as long as the shortest tile; a document offers its
own at every place. Where the seeds that a document holds cover enough of an
item together, or half of that without a break, the pair is tiled: the longest
matches between unmarked characters are found by running Karp-Rabin over
substrings, marked, and the search repeated, so passages that were moved about
or cut up still add up in the coverage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracebook.llm.minmax_hash import mix
from tracebook.llm.shared_spans import CHUNK, powers
from tracebook.sources.tables import stage

NO_LETTER = re.compile(r"[\W_]+")


def letters_and_digits(text: str) -> str:
    """Compatibility folding and lower case, then only letters and digits."""
    return NO_LETTER.sub("", unicodedata.normalize("NFKC", text).lower())


def seed_size(run: int) -> int:
    """The largest of 5, 10, 20, ... such that any `run` characters hold an
    aligned block of it; for shorter runs whatever does."""
    k = 5
    if run < 2 * k - 1:
        return max(1, (run + 1) // 2)
    while 4 * k - 1 <= run:
        k *= 2
    return k


def shortest_tile(run: int, least: int) -> int:
    """`least` characters, and never more than half the run that matters."""
    return max(1, min(least, (run + 1) // 2))


def prefix_hashes(codes: np.ndarray, pows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, "u8"), np.cumsum((codes + np.uint64(1)) * pows[: len(codes)], dtype="u8")])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")


def _unmarked_hashes(total: np.ndarray, inverse: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the substrings of `size` that hold no marked character."""
    n = len(marked) - size + 1
    if n < 1:
        return np.empty(0, "i8"), np.empty(0, "u8")
    taken = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, mix((total[at + size] - total[at]) * inverse[at])


def longest_matches(i_at: np.ndarray, i_hash: np.ndarray, d_at: np.ndarray, d_hash: np.ndarray, size: int, at_once: int = 4_000_000) -> tuple[int, list[tuple[int, int]]]:
    """Length and places (item, doc), ascending, of the longest equal stretches
    that the equal substrings of `size` make up; (0, []) if none is equal."""
    order = np.argsort(d_hash, kind="stable")
    sorted_hash = d_hash[order]
    low, high = np.searchsorted(sorted_hash, i_hash, "left"), np.searchsorted(sorted_hash, i_hash, "right")
    many = high - low
    if not many.any():
        return 0, []
    if many.sum() > at_once:  # much repeated text: one place of the item at a time
        run, best, found, before = np.zeros(d_at.max() + 2, "i8"), 0, [], -2
        for i, a, z in zip(i_at.tolist(), low.tolist(), high.tolist()):
            here, j = np.zeros_like(run), d_at[order[a:z]]
            here[j + 1] = 1 + (run[j] if before == i - 1 else 0)
            run, before = here, i
            if (most := int(here.max())) >= max(best, 1):
                ends = np.flatnonzero(here == most) - 1
                found = (found if most == best else []) + [(i - most + 1, int(j) - most + 1) for j in ends]
                best = most
        return best + size - 1, sorted(found)
    i = np.repeat(i_at, many)
    j = d_at[order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]]
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    runs = np.diff(breaks, append=len(i))
    first = breaks[runs == runs.max()]
    return int(runs.max()) + size - 1, sorted(zip(i[first].tolist(), j[first].tolist()))


def tiles(doc: str, item: str, least: int, pows: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in doc, length), longest first, of
    matches of `least` or more characters that share no character.

    Running Karp-Rabin: the hashes of all unmarked substrings of the search
    length are compared, equal ones put together to the longest matches, and
    these marked; when no more are found the search length falls by half.
    pows: powers as long as either text, where they are at hand.
    """
    if min(len(doc), len(item)) < least:
        return []
    pows = pows if pows is not None and len(pows[0]) > max(len(doc), len(item)) else powers(max(len(doc), len(item)))
    total_d, total_i = prefix_hashes(codes_of(doc), pows[0]), prefix_hashes(codes_of(item), pows[0])
    marked_d, marked_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(doc), len(item)))
    while True:
        best, found = longest_matches(*_unmarked_hashes(total_i, pows[1], marked_i, size), *_unmarked_hashes(total_d, pows[1], marked_d, size), size)
        for i, j in found:
            if item[i : i + best] == doc[j : j + best] and not marked_i[i : i + best].any() and not marked_d[j : j + best].any():
                marked_i[i : i + best] = marked_d[j : j + best] = True
                out.append((i, j, best))
        if not found:
            if size == least:
                return out
            size = max(least, size // 2)


class Grams:
    """The substrings of one size of several items: distinct hashes, ascending,
    and where each is. Places are counted through all the items in turn."""

    def __init__(self, size: int, items: list[tuple[str, int]]):
        self.size = size
        pows = powers(max(len(t) for t, _ in items))
        found, places, owner, first = [], [], [], 0
        for t, n in items:
            total = prefix_hashes(codes_of(t), pows[0])
            found.append(mix((total[size:] - total[:-size]) * pows[1][: len(t) - size + 1]))
            places.append(np.arange(first, first + len(found[-1])))
            owner.append(np.full(len(t), n, "i4"))
            first += len(t)
        h, self.owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        self.places = np.concatenate(places)[order]
        self.hashes, begins = np.unique(h[order], return_index=True)
        self.begins = np.append(begins, len(h))

    def table(self) -> tuple[np.uint64, np.ndarray]:
        """By the upper bits of a hash whether it can be among the hashes."""
        bits = min(26, max(10, (16 * len(self.hashes)).bit_length()))
        shift = np.uint64(64 - bits)
        may = np.zeros(1 << bits, bool)
        may[(self.hashes >> shift).astype("i8")] = True
        return shift, may


class Seeds:
    """The seeds of one block of items: all substrings as long as the shortest
    tile, by that length."""

    def __init__(self, items: list[tuple[str, str]], share: float, least: int):
        self.items = [(k, t, -(-int(len(t) * share * 1e6) // 1_000_000)) for k, t in items if t]
        self.runs = np.array([run for *_, run in self.items], "i8")
        by_size: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for n, (_, t, run) in enumerate(self.items):
            by_size[shortest_tile(run, least)].append((t, n))
        self.of = [Grams(size, found) for size, found in by_size.items()]


def meetings(texts: list[str], seeds: Seeds, tables: list[tuple[np.uint64, np.ndarray]], pows: tuple[np.ndarray, np.ndarray], at_once: int = 2_000_000) -> set[tuple[int, int]]:
    """(text number, item number) of the pairs that can be kept: the seeds that
    a text holds cover the run that matters of the item, or half of it without
    a break. No tiling covers more than all the seeds do."""
    whole = "".join(texts)
    starts = np.cumsum([0, *map(len, texts)])
    total = prefix_hashes(codes_of(whole), pows[0])
    out: set[tuple[int, int]] = set()
    for g, (shift, may) in zip(seeds.of, tables):
        k = g.size
        if len(whole) < k:
            continue
        h = mix((total[k:] - total[:-k]) * pows[1][: len(whole) - k + 1])
        p = np.flatnonzero(may[(h >> shift).astype("i8")])
        slot = np.minimum(np.searchsorted(g.hashes, h[p]), len(g.hashes) - 1)
        t = np.searchsorted(starts, p, side="right") - 1
        real = (g.hashes[slot] == h[p]) & (p + k <= starts[t + 1])
        held = np.unique(t[real] * len(g.hashes) + slot[real])
        if not len(held):
            continue
        t, slot = held // len(g.hashes), held % len(g.hashes)
        many = g.begins[slot + 1] - g.begins[slot]
        before = np.concatenate([[0], np.cumsum(many)])
        edges = np.append(np.flatnonzero(np.diff(t, prepend=-1)), len(t))
        low = 0
        while low < len(edges) - 1:  # whole texts, about `at_once` places of items together
            high = max(low + 1, int(np.searchsorted(before[edges], before[edges[low]] + at_once, side="right")) - 1)
            part = slice(edges[low], edges[high])
            n = many[part]
            of = np.repeat(g.begins[slot[part]] - (before[part] - before[part.start]), n) + np.arange(n.sum())
            place = np.sort(np.repeat(t[part], n) * len(g.owner) + g.places[of])
            pair = place // len(g.owner) * len(seeds.items) + g.owner[place % len(g.owner)]
            step = np.diff(place, append=place[-1] + k)
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            covered = np.add.reduceat(np.minimum(step, k), new)
            breaks = np.flatnonzero(np.concatenate([[True], (step[:-1] != 1) | (pair[1:] != pair[:-1])]))
            unbroken = np.diff(breaks, append=len(place)) + k - 1
            enough = np.concatenate([pair[new][covered >= seeds.runs[pair[new] % len(seeds.items)]], pair[breaks][2 * unbroken >= seeds.runs[pair[breaks] % len(seeds.items)]]])
            out.update((int(x) // len(seeds.items), int(x) % len(seeds.items)) for x in np.unique(enough))
            low = high
    return out


def _tiled(shared, least: int, fold: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = shared.value
        tables, pows = [g.table() for g in seeds.of], powers(CHUNK)
        for f in frames:
            keys = f["key"].tolist()
            texts = [letters_and_digits(t) for t in f["text"]] if fold else f["text"].tolist()
            out = []
            first = 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (last == first or held + len(texts[last]) <= CHUNK):
                    held += len(texts[last])
                    last += 1
                some = pows if held <= CHUNK else powers(held)
                for t, n in sorted(meetings(texts[first:last], seeds, tables, some)):
                    key, item, run_length = seeds.items[n]
                    laid = tiles(texts[first + t], item, shortest_tile(run_length, least), some)
                    longest, covered = max((x[2] for x in laid), default=0), sum(x[2] for x in laid)
                    if covered >= run_length or 2 * longest >= run_length:
                        out.append((keys[first + t], key, len(item), longest, covered, len(laid)))
                first = last
            yield pd.DataFrame(out, columns=["doc_key", "item_key", "item_length", "longest", "covered", "tiles"])

    return run


def _blocks(items: Iterator[tuple[str, str]], most: int, chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most `most` items and (but for a longer item) `chars` characters."""
    part, held = [], 0
    for key, text in items:
        if part and (len(part) == most or held + len(text) > chars):
            yield part
            part, held = [], 0
        part.append((key, text))
        held += len(text)
    if part:
        yield part


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else letters_and_digits(t) for t in text], dtype=object)


def tiled_items(documents: DataFrame, items: DataFrame, *, doc_key: str, doc_text: str, item_key: str, item_text: str, share: float = 0.5, least: int = 12, block: int = 20_000, block_chars: int = 8_000_000) -> DataFrame:
    """doc_key, item_key, item_length, longest, covered, tiles: the pairs of a
    document and an item of which tiles cover at least `share` of its letters
    and digits, in whatever order, or one tile `share` / 2; with the longest
    tile, the characters of the item covered by tiles of `least` or more (half
    of `share` in shorter items), and their number.

    No such pair is lost. Items are the stated query set: they go to the
    workers in blocks of at most `block` items and `block_chars` characters,
    one scan of the documents each, so nothing unbounded is broadcast;
    documents are not shuffled, and folded only once if there are more blocks
    than one. Null keys and texts are left out, as are items without a letter
    or digit; keys come out as strings. Other columns are not read.
    """
    spark = documents.sparkSession
    columns = "doc_key string, item_key string, item_length int, longest int, covered int, tiles int"
    docs = documents.select(F.col(doc_key).cast("string").alias("key"), F.col(doc_text).alias("text")).filter("key is not null and text is not null")
    wanted = items.select(F.col(item_key).cast("string").alias("key"), folded(F.col(item_text)).alias("text")).filter("key is not null and text <> ''").distinct()
    blocks = _blocks(((r["key"], r["text"]) for r in wanted.toLocalIterator()), block, block_chars)
    out, ahead = None, next(blocks, None)
    if ahead is None:
        return spark.createDataFrame([], columns)
    part, ahead = ahead, next(blocks, None)
    docs = docs if ahead is None else stage(docs.select("key", folded("text").alias("text")), "folded")
    fold = ahead is None
    while part is not None:
        one = docs.mapInPandas(_tiled(spark.sparkContext.broadcast(Seeds(part, share, least)), least, fold), columns)
        out = one if out is None else out.union(one)
        part, ahead = ahead, next(blocks, None)
    return out.distinct()
