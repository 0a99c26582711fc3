"""Text quality figures of documents, and the structural profile nearest to each.

A document is described by distributions: of neighbouring character classes, of
words over function words and shapes of other words, and of its lines over
length, first characters, last character and repetition. Profiles are
distributions of the same kind, fitted to labelled documents: those of one
language and label fall into as many profiles as they differ in structure. A
document takes the kind of the profile from which its mean Jensen-Shannon
divergence is least; what is far from every profile is junk.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebook.llm.minmax_hash import MIX1
from tracebook.llm.shared_spans import powers

KINDS = ["prose", "list", "table", "junk"]
CLASSES = ["vowel", "consonant", "upper", "han", "digit", "stop", "comma", "bracket", "bar", "symbol", "odd", "space", "line"]
VOWEL, CONSONANT, UPPER, IDEOGRAPH, DIGIT, STOP, COMMA, BRACKET, BAR, SYMBOL, ODD, SPACE, LINE = range(len(CLASSES))
N = len(CLASSES)
#: The distributions that describe a document, and how many values each has.
PARTS = {"pairs": N * N, "words": 10, "lengths": 10, "starts": N * N, "ends": N, "repeats": 4}
WIDTH = sum(PARTS.values())
#: Weight of each value, so that every distribution counts alike.
WEIGHT = np.full(WIDTH, 1 / len(PARTS), "f4")
#: A document further than this from every profile is like nothing that was labelled.
REACH = 0.35
#: Labelled documents within this of a profile belong to it.
RADIUS = 0.15
CHUNK = 1_000_000
HAN = re.compile("[㐀-鿿]")


def char_class(code: int) -> int:
    c = chr(code)
    if c == "\n":
        return LINE
    if c == "\t" or c in "|¦│":
        return BAR
    if c.isspace():
        return SPACE
    if c in ".!?。！？…":
        return STOP
    if c in ",;:，；：、":
        return COMMA
    if c in "()[]{}\"'“”‘’「」『』（）《》-–—·•":
        return BRACKET
    kind = unicodedata.category(c)
    if kind[0] == "C" or kind in ("So", "Sk") or (0x80 <= code < 0xC0 and c not in "°²³·µ"):
        return ODD
    if kind == "Nd":
        return DIGIT
    if "㐀" <= c <= "鿿":
        return IDEOGRAPH
    if kind[0] == "L":
        plain = unicodedata.normalize("NFD", c)[0].lower()
        return UPPER if kind == "Lu" else VOWEL if plain in "aeiou" else CONSONANT
    return SYMBOL


#: The class of each character of the basic plane; others count as odd, ideographs as such.
TABLE = np.array([ODD if 0xD800 <= i < 0xE000 else char_class(i) for i in range(65536)], "u1")
TABLE[[ord(c) for c in "℃℉№"]] = SYMBOL
TABLE[[ord(c) for c in "☐☑☒✓✔■▪●○◦➤"]] = BRACKET
#: Lower case of each character of the basic plane.
LOWER = np.array([i if 0xD800 <= i < 0xE000 or len(chr(i).lower()) > 1 else ord(chr(i).lower()) for i in range(65536)], "u4")
IS_VOWEL = TABLE[np.minimum(LOWER, 65535)] == VOWEL


def codes_in(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Vocabulary:
    """Function words as hashes: Latin ones, and ideographic ones by length."""

    def __init__(self, words: list[str]):
        pows = powers(max([1, *map(len, words)]))
        of: dict[int, list[int]] = {}
        for w in set(words):
            codes = LOWER[np.minimum(codes_in(w), 65535)].astype("u8") + np.uint64(1)
            of.setdefault(len(w) if HAN.search(w) else 0, []).append(int((codes * pows[0][: len(codes)]).sum(dtype="u8")))
        self.latin = np.sort(np.array(of.pop(0, []), "u8"))
        self.han = {size: np.sort(np.array(hashes, "u8")) for size, hashes in of.items() if size}


@dataclass
class Described:
    """Counts of several documents, one row each."""

    classes: np.ndarray
    parts: dict[str, np.ndarray]
    words: np.ndarray
    letters: np.ndarray
    stops: np.ndarray

    def distributions(self) -> np.ndarray:
        rows = []
        for name in PARTS:
            total = self.parts[name].sum(axis=1, keepdims=True)
            rows.append(self.parts[name] / np.where(total > 0, total, 1))
        return np.hstack(rows).astype("f4")

    def chinese(self) -> np.ndarray:
        return self.classes[:, IDEOGRAPH] > self.classes[:, :IDEOGRAPH].sum(axis=1)


def _parts_of(text: str) -> Iterator[str]:
    """The text in parts of at most CHUNK characters, cut after a line's end,
    else after a blank, else anywhere."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind("\n", at, at + CHUNK) + 1 or text.rfind(" ", at, at + CHUNK) + 1
        end = end if end > at else at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def described(texts: list[str], vocabulary: Vocabulary) -> Described:
    """Counts of each text, about CHUNK characters of them at a time. A line or
    word longer than CHUNK counts as several."""
    n = len(texts)
    out = Described(np.zeros((n, N)), {k: np.zeros((n, size)) for k, size in PARTS.items()}, np.zeros(n), np.zeros(n), np.zeros(n))
    lines: list[tuple[np.ndarray, np.ndarray]] = []
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for p in _parts_of(text):
            if parts and held + len(p) > CHUNK:
                lines.append(_count(parts, np.array(owners), vocabulary, out))
                parts, owners, held = [], [], 0
            parts.append(p)
            owners.append(i)
            held += len(p)
    if parts:
        lines.append(_count(parts, np.array(owners), vocabulary, out))
        owner, hashes = (np.concatenate(x) for x in zip(*lines))
        _, which, times = np.unique(hashes ^ owner.astype("u8") * MIX1, return_inverse=True, return_counts=True)
        _tally(out.parts["repeats"], owner, np.minimum(times[which], 4) - 1)
    return out


def _tally(counts: np.ndarray, row: np.ndarray, column: np.ndarray) -> None:
    size = counts.shape[1]
    counts += np.bincount(row * size + column, minlength=counts.size).reshape(counts.shape)


def _count(texts: list[str], owners: np.ndarray, vocabulary: Vocabulary, out: Described) -> tuple[np.ndarray, np.ndarray]:
    """Add the texts, joined by line ends, to the counts of their owners;
    return owner and hash of each line."""
    raw = codes_in("\n\n".join(texts) + "\n\n")
    sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 2
    ends = np.cumsum(sizes)
    doc = np.repeat(owners, sizes)
    plane = np.minimum(raw, 65535)
    kind = np.where(raw > 65535, np.where(raw >= 0x20000, IDEOGRAPH, ODD), TABLE[plane]).astype("i8")
    own = np.ones(len(raw), bool)
    own[ends - 1] = own[ends - 2] = False
    _tally(out.classes, doc[own], kind[own])
    _tally(out.parts["pairs"], doc[own], (kind * N + np.append(kind[1:], LINE))[own])
    pows = powers(len(raw))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((LOWER[plane].astype("u8") + np.uint64(1)) * pows[0][: len(raw)], dtype="u8")])

    edge = np.diff(np.concatenate([[0], (kind <= UPPER).astype("i1"), [0]]))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = z - a
    vowels = np.concatenate([[0], np.cumsum(IS_VOWEL[plane])])
    mute = (vowels[z] == vowels[a]) & (size >= 3)
    shape = np.where(size == 1, 1, np.where(mute, 2, 3 + (size > 4) + (size > 8) + (size > 14)))
    _tally(out.parts["words"], doc[a], np.where(among((total[z] - total[a]) * pows[1][a], vocabulary.latin), 0, shape))
    han = kind == IDEOGRAPH
    function = np.zeros(len(raw), bool)
    for k, hashes in vocabulary.han.items():
        at = np.flatnonzero(han[: len(raw) - k + 1] & han[k - 1 :])
        at = at[among((total[at + k] - total[at]) * pows[1][at], hashes)]
        for j in range(k):
            function[at + j] = True
    first_digit = np.flatnonzero(np.diff(np.concatenate([[0], (kind == DIGIT).astype("i1")])) == 1)
    for where, column in ((doc[function], 7), (doc[han & ~function], 8), (doc[first_digit], 9)):
        out.parts["words"][:, column] += np.bincount(where, minlength=len(out.words))
    out.words += np.bincount(doc[a], minlength=len(out.words)) + np.bincount(doc[han], minlength=len(out.words))
    out.letters += np.bincount(doc[a], weights=size, minlength=len(out.words))

    text = np.flatnonzero((kind < SPACE) & (raw != 9))
    begins = np.flatnonzero(np.diff(np.cumsum(raw == 10)[text], prepend=-1))
    first, last = text[begins], text[np.append(begins[1:], len(text))[: len(begins)] - 1]
    of = doc[first]
    _tally(out.parts["lengths"], of, np.minimum(np.log2(last - first + 1).astype("i8"), 9))
    _tally(out.parts["starts"], of, kind[first] * N + kind[first + 1])
    _tally(out.parts["ends"], of, kind[last])
    stopped = (kind[last] == STOP) | (kind[last] == BRACKET) & (last > first) & (kind[last - 1] == STOP)
    out.stops += np.bincount(of[stopped], minlength=len(out.stops))
    return of, (total[last + 1] - total[first]) * pows[1][first]


def _information(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted sum of x log2 x along the last axis."""
    x = x + np.float32(1e-12)
    return (x * np.log2(x)) @ weight


def divergences(rows: np.ndarray, profiles: np.ndarray, weight: np.ndarray = WEIGHT) -> np.ndarray:
    """Mean Jensen-Shannon divergence of each row from each profile, 0 to 1."""
    of_rows = _information(rows, weight)
    out = np.empty((len(rows), len(profiles)), "f4")
    for k, p in enumerate(profiles):
        out[:, k] = (of_rows + _information(p, weight)) / 2 - _information((rows + p) / 2, weight)
    return np.maximum(out, 0)


@dataclass
class Profiles:
    """Fitted profiles with the kind and the language of each."""

    rows: np.ndarray
    kinds: list[str]
    chinese: np.ndarray

    def nearest(self, rows: np.ndarray, reach: float = REACH) -> tuple[list[str | None], np.ndarray]:
        """Kind and divergence of the nearest profile; junk beyond the reach of
        all, None without any profile."""
        if not self.kinds:
            return [None] * len(rows), np.full(len(rows), np.nan)
        apart = divergences(rows, self.rows)
        best = apart.argmin(axis=1)
        least = apart[np.arange(len(rows)), best]
        return ["junk" if d > reach else self.kinds[k] for k, d in zip(best.tolist(), least.tolist())], least

    def from_prose(self, rows: np.ndarray, chinese: np.ndarray) -> np.ndarray:
        """Divergence of character classes and words from the nearest prose
        profile of the text's language (of any, where it has none)."""
        out = np.full(len(rows), np.nan)
        prose = np.array([k == "prose" for k in self.kinds], bool)
        size = PARTS["pairs"] + PARTS["words"]
        weight = np.full(size, 0.5, "f4")
        for language in (False, True):
            mine = prose & (self.chinese == language)
            mine = mine if mine.any() else prose
            if mine.any() and (chinese == language).any():
                out[chinese == language] = divergences(rows[chinese == language, :size], self.rows[mine][:, :size], weight).min(axis=1)
        return out


def fit_profiles(rows: np.ndarray, labels: list[str], chinese: np.ndarray, radius: float = RADIUS) -> Profiles:
    """Profiles of the labelled documents of each language and kind: a document
    within `radius` of a profile joins it, another begins one; two rounds of
    means and nearest profiles follow."""
    found, kinds, languages = [], [], []
    for kind in KINDS:
        for language in (False, True):
            mine = rows[(np.array(labels, dtype=object) == kind) & (chinese == language)]
            if not len(mine):
                continue
            heads = mine[:1]
            for x in mine[1:]:
                if divergences(x[None], heads).min() > radius:
                    heads = np.vstack([heads, x])
            for _ in range(2):
                of = divergences(mine, heads).argmin(axis=1)
                heads = np.vstack([mine[of == k].mean(axis=0) for k in np.unique(of)])
            found.append(heads)
            kinds += [kind] * len(heads)
            languages += [language] * len(heads)
    return Profiles(np.vstack(found) if found else np.zeros((0, WIDTH), "f4"), kinds, np.array(languages, bool))


FIGURES = "n_chars int, n_words int, mean_word_length double, n_lines int, symbol_ratio double, digit_ratio double, alpha_ratio double, stop_line_share double, common_word_share double, language string, prose_divergence double, divergence double, kind string"


def measured(texts: list[str], vocabulary: Vocabulary, profiles: Profiles) -> pd.DataFrame:
    """FIGURES of each text."""
    d = described(texts, vocabulary)
    rows, chinese = d.distributions(), d.chinese()
    size = np.maximum(1, d.classes.sum(axis=1))
    lines = d.parts["lengths"].sum(axis=1)
    kinds, least = profiles.nearest(rows)
    spaced = np.maximum(1, d.words - d.classes[:, IDEOGRAPH])
    blank = lines == 0
    return pd.DataFrame({
        "n_chars": [len(t) for t in texts], "n_words": d.words.astype(int), "mean_word_length": d.letters / spaced, "n_lines": lines.astype(int),
        "symbol_ratio": d.classes[:, BAR : ODD + 1].sum(axis=1) / size, "digit_ratio": d.classes[:, DIGIT] / size, "alpha_ratio": d.classes[:, : IDEOGRAPH + 1].sum(axis=1) / size,
        "stop_line_share": d.stops / np.maximum(1, lines), "common_word_share": (d.parts["words"][:, 0] + d.parts["words"][:, 7]) / np.maximum(1, d.words),
        "language": np.where(chinese, "zh", "en"), "prose_divergence": profiles.from_prose(rows, chinese), "divergence": least.astype(float),
        "kind": pd.Series(["junk" if b else k for k, b in zip(kinds, blank)], dtype=object),
    })


def labelled_profiles(documents: DataFrame, labels: DataFrame, vocabulary: Vocabulary, *, key: str, text: str, label: str = "label", per_kind: int = 1_000) -> Profiles:
    """Profiles of at most `per_kind` labelled documents of each kind, chosen by
    a hash of the key. The documents are described where they lie; only their
    distributions (WIDTH numbers each) come to the driver."""
    wanted = labels.filter(F.col(key).isNotNull() & F.col(label).isin(KINDS)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_key"), "_key")
    wanted = wanted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_kind).drop("_n")
    chosen = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0).join(F.broadcast(wanted), "_key").drop("_key").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = described(f["_text"].tolist(), vocabulary)
            rows = pd.Series(list(d.distributions().astype(float)), dtype=object)
            yield pd.DataFrame({"label": f["_label"].to_numpy(), "chinese": d.chinese(), "row": rows})

    got = chosen.mapInPandas(run, "label string, chinese boolean, row array<float>").collect()
    got.sort(key=lambda r: (r["label"], r["chinese"], r["row"]))
    return fit_profiles(np.array([r["row"] for r in got], "f4").reshape(len(got), WIDTH), [r["label"] for r in got], np.array([r["chinese"] for r in got], bool))


def text_quality(documents: DataFrame, labels: DataFrame, common_words: DataFrame, *, key: str, text: str, label: str = "label", per_kind: int = 1_000, max_words: int = 100_000) -> DataFrame:
    """key and FIGURES of every document, in one pass without a shuffle.

    The profiles are fitted to a bounded sample of labelled documents
    (`per_kind`); everything else covers all rows. `common_words` (column
    `word`) must have at most `max_words` rows. A null text counts as empty; an
    empty or blank text is junk of no words; without any labelled document the
    kind of the others is null. Rows repeated in the frame come out repeated;
    other columns are not read.
    """
    words = [r["word"] for r in common_words.select("word").filter("word <> ''").distinct().limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError("too many common words to hold in each worker")
    vocabulary = Vocabulary(words)
    profiles = labelled_profiles(documents, labels, vocabulary, key=key, text=text, label=label, per_kind=per_kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = measured([t or "" for t in f[text]], vocabulary, profiles)
            out.insert(0, key, f[key].to_numpy())
            yield out

    return documents.select(key, text).mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, {FIGURES}")
