"""One form for text that looks the same: composition, width, ligatures,
invisible characters, hyphens, and look-alike letters by script-aware repair.

The scripts of each token's letters are counted. A token that mixes scripts is
spelled in its dominant one, or else in the next that has look-alikes for all
its other letters, if that spelling is a word of the corpus. A token of one
script stays as it is, with one exception: if all its letters are look-alikes,
no other word of its line is in its script, and the other spelling is at least
OFTEN times as frequent in the corpus, it was typed in the wrong script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tracebook.sources.tables import stage

# Letters of other scripts that look like Latin ones.
CYRILLIC_UPPER = "АВЕЗІЈКМНОРЅТУХԚԜҮ"
CYRILLIC_UPPER_AS = "ABE3IJKMHOPSTYXQWY"
CYRILLIC_LOWER = "аеоісјрѕухһԁԛԝӏү"
CYRILLIC_LOWER_AS = "aeoicjpsyxhdqwly"
GREEK_UPPER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_UPPER_AS = "ABEZHIKMNOPTYXCJ"
GREEK_LOWER = "οϲϳνα"
GREEK_LOWER_AS = "ocjva"
OTHER = "օոսհցզɑɡıΙ"
OTHER_AS = "onuhgqagiI"
# Radicals that have no compatibility mapping and the ideographs they look like.
RADICALS = "⺠⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰"
RADICALS_AS = "民西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙"

LATIN_OF = {a: b for a, b in zip(CYRILLIC_UPPER + CYRILLIC_LOWER + GREEK_UPPER + GREEK_LOWER + OTHER, CYRILLIC_UPPER_AS + CYRILLIC_LOWER_AS + GREEK_UPPER_AS + GREEK_LOWER_AS + OTHER_AS) if not b.isdigit()}
FOLD = str.maketrans(LATIN_OF)
#: Put in place before compatibility folding, which would take it for a final sigma.
EARLY = str.maketrans("ϲϹ" + RADICALS, "cC" + RADICALS_AS)
EARLY_ONES = re.compile(f"[ϲϹ{RADICALS}]")
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = re.compile(rf"(?:[^\W\d_{HAN}][̀-ͯ]*)+")
INVISIBLE = re.compile("[­͏ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
HYPHENS = re.compile("[‐‑﹣－]")
#: Superscripts, subscripts and fractions look unlike plain digits and stay.
KEPT = re.compile("([ªº²³¹¼-¾⁰-ₜ⅐-↉])")
BLANK = re.compile(r"\s+")
IN_LINE = re.compile(r"[^\S\n]+")
VOCABULARY_TOKEN = re.compile(rf"[^\W\d_{HAN}]+")
#: Letters of other scripts than Latin (and Latin ones that only look like others).
FOREIGN = re.compile("[" + "".join(c for c in OTHER if c < "Ͱ") + "Ͱ-ϿЀ-ԯ԰-֏ἀ-῿]")
#: How much more frequent a word must be for a token of one script to be it.
OFTEN = 20
#: Marks of tokens that may be cut: the first and the last one of a quote.
FIRST, LAST = "^", "$"


def composed(text: str) -> str:
    """Everything of the one form but blanks and look-alike letters."""
    if text.isascii():
        return text
    text = INVISIBLE.sub("", text)
    if EARLY_ONES.search(text):
        text = text.translate(EARLY)
    if KEPT.search(text):
        folded = "".join(p if KEPT.match(p) else unicodedata.normalize("NFKC", p) for p in KEPT.split(text))
    else:
        folded = unicodedata.normalize("NFKC", text)
    return HYPHENS.sub("-", folded if folded == text else INVISIBLE.sub("", folded))


def base_form(text: str) -> str:
    """Everything but the look-alike letters; blanks within a line become
    single spaces."""
    return IN_LINE.sub(" ", composed(text))


@lru_cache(maxsize=100_000)
def script_of(c: str) -> str:
    """The script of a letter by its name; marks have none."""
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    return "VARIANT" if c in LATIN_OF and c < "Ͱ" else unicodedata.name(c, "?").split(" ")[0]


def _letters_by_script() -> dict[str, dict[str, str]]:
    """By script, the letter that looks like a Latin one."""
    out: dict[str, dict[str, str]] = {"LATIN": {b: b for b in LATIN_OF.values()}}
    for other, latin in LATIN_OF.items():
        if script_of(other) != "VARIANT":
            out.setdefault(script_of(other), {}).setdefault(latin, other)
    return out


SPELLED = _letters_by_script()


def spelled_in(token: str, script: str) -> str | None:
    """The token with all letters in one script; None if one has no look-alike."""
    out = []
    for c in token:
        own = script_of(c)
        if own and own != script:
            c = SPELLED[script].get(LATIN_OF.get(c, c), "")
            if not c:
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=100_000)
def scripts_in(token: str) -> tuple[str, ...]:
    """The scripts of the letters of a token, the dominant one first."""
    counted = Counter(filter(None, map(script_of, unicodedata.normalize("NFD", token))))
    return tuple(sorted(counted, key=lambda x: (-counted[x], x)))


@lru_cache(maxsize=100_000)
def spellings(token: str, whole: bool = False) -> tuple[str, ...]:
    """Spellings of a token in one script, dominant scripts first: of a token
    that mixes scripts, or (whole) of one that may be in the wrong one."""
    of = scripts_in(token)
    if not of or (len(of) < 2) != whole:
        return ()
    able = [x for x in of if x in SPELLED] + [x for x in SPELLED if x not in of and (whole or x == "LATIN")]
    found = dict.fromkeys(x for x in (spelled_in(token, script) for script in able) if x is not None)
    found.pop(unicodedata.normalize("NFC", token), None)
    return tuple(found)


def letters_not_in(token: str, spelling: str) -> int:
    """How many letters a spelling changes: the fewer, the more dominant its script."""
    return sum(a != b for a, b in zip(unicodedata.normalize("NFC", token), spelling))


@lru_cache(maxsize=100_000)
def all_alike(token: str) -> bool:
    """Whether a token is of one script and every letter looks like one of another."""
    return bool(spellings(token, True))


def repairable(text: str) -> list[str]:
    """The tokens of a base form that a repair may change: those that mix
    scripts, and those wholly of look-alikes that are alone of their script in
    their line."""
    out: set[str] = set()
    for line in text.split("\n") if FOREIGN.search(text) else ():
        if not FOREIGN.search(line):
            continue
        tokens = [t for t in TOKEN.findall(line) if scripts_in(t)]
        own = {scripts_in(t)[0] for t in tokens if len(scripts_in(t)) == 1 and not all_alike(t)}
        out.update(t for t in tokens if spellings(t) or all_alike(t) and scripts_in(t)[0] not in own)
    return sorted(out)


def substituted(text: str, accepted: dict[str, str]) -> str:
    """The text with the accepted tokens in their places; those marked FIRST or
    LAST only at its begin or end."""
    found = list(TOKEN.finditer(text))
    out, at = [], 0
    for i, m in enumerate(found):
        fix = accepted.get(m[0])
        if not fix and i == 0:
            fix = accepted.get(FIRST + m[0])
        if not fix and i == len(found) - 1:
            fix = accepted.get(LAST + m[0])
        if fix:
            out += [text[at : m.start()], fix]
            at = m.end()
    return "".join([*out, text[at:]])


def apply_repairs(text: str, accepted: dict[str, str]) -> str:
    """The base form with accepted tokens substituted and blanks taken out."""
    return unicodedata.normalize("NFC", "".join((substituted(text, accepted) if accepted else text).split()))


def widest(text: str) -> str:
    """Every look-alike folded, without blanks. What is alike in the one form
    is alike here."""
    text = "".join(composed(text).split())
    return unicodedata.normalize("NFC", text.translate(FOLD)) if FOREIGN.search(text) else text


FORMED = StructType().add("base", StringType()).add("tokens", ArrayType(StringType()))


@F.pandas_udf(FORMED)
def base_and_tokens(text: pd.Series) -> pd.DataFrame:
    """The base form, and its tokens that a repair may change."""
    bases = [None if t is None else base_form(t) for t in text]
    return pd.DataFrame({"base": pd.Series(bases, dtype=object), "tokens": pd.Series([[] if b is None else repairable(b) for b in bases], dtype=object)})


@F.pandas_udf(FORMED)
def quote_and_tokens(text: pd.Series) -> pd.DataFrame:
    """As base_and_tokens for texts that may begin and end within a word: their
    first and last token also come marked as such."""
    bases, tokens = [], []
    for t in text:
        b = None if t is None else base_form(t)
        found = [] if b is None else repairable(b)
        if found:
            edge = TOKEN.findall(b)
            found += [mark + x for mark, x in ((FIRST, edge[0]), (LAST, edge[-1])) if x in found]
        bases.append(b)
        tokens.append(found)
    return pd.DataFrame({"base": pd.Series(bases, dtype=object), "tokens": pd.Series(tokens, dtype=object)})


@F.pandas_udf(StringType())
def widest_form(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else widest(t) for t in text], dtype=object)


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        words: Counter = Counter()
        for text in f["text"]:
            if text:
                words.update(VOCABULARY_TOKEN.findall(text))
        kept = [(w, n) for w, n in words.items() if w.isascii() or len(scripts_in(w)) == 1]
        yield pd.DataFrame(kept, columns=["word", "n"])


def vocabulary(texts: list[DataFrame]) -> DataFrame:
    """word, n: the words of one script in all texts (frames of one column
    `text`) and how often they occur; batches hand on each word once."""
    found = [t.mapInPandas(_words, "word string, n long") for t in texts]
    for f in found[1:]:
        found[0] = found[0].union(f)
    return found[0].groupBy("word").agg(F.sum("n").alias("n"))


@F.pandas_udf(ArrayType(StructType().add("rank", IntegerType()).add("fixed", StringType()).add("way", StringType())))
def candidates_of(token: pd.Series) -> pd.Series:
    out = []
    for t in token:
        mark, plain = (t[0], t[1:]) if t[:1] in (FIRST, LAST) else ("", t)
        mixed = spellings(plain)
        whole = () if mixed or mark else spellings(plain, True)
        out.append([{"rank": letters_not_in(plain, x), "fixed": x, "way": mark or ("mixed" if mixed else "whole")} for x in mixed or whole])
    return pd.Series(out, dtype=object)


def accepted_repairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, fixed: of each token (column `token`) the spelling in the most
    dominant script that the vocabulary `words` (word, n) has; where scripts
    are even the more frequent word. A spelling OFTEN times rarer than another
    of the same token is no word but the same mistake. A token cut at the begin
    or end of a quote is taken for the end or begin of a word."""
    each = stage(tokens.select("token").distinct().select("token", F.explode(candidates_of("token")).alias("c")).select("token", "c.*"), "spellings")
    as_is = words.select(F.col("word").alias("token"), F.col("n").alias("own"))
    known = each.filter(F.col("way").isin("mixed", "whole")).join(words.withColumnRenamed("word", "fixed"), "fixed").join(as_is, "token", "left")
    known = known.filter((F.col("way") == "mixed") | (F.col("n") >= OFTEN * F.coalesce("own", F.lit(1)))).select("token", "rank", "fixed", "n")
    cut = words.filter("length(word) > 1").select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    ends = cut.select(F.lit(FIRST).alias("way"), F.expr("substring(word, i + 1)").alias("fixed"), "n").union(cut.select(F.lit(LAST), F.expr("left(word, i)"), "n"))
    at_edge = each.filter(F.col("way").isin(FIRST, LAST)).join(ends, ["way", "fixed"]).groupBy("token", "rank", "fixed").agg(F.sum("n").alias("n"))
    both = known.union(at_edge)
    best = both.groupBy("token").agg(F.max("n").alias("most"))
    likely = both.join(best, "token").filter(F.col("n") * OFTEN > F.col("most"))
    return likely.groupBy("token").agg(F.min_by("fixed", F.struct("rank", -F.col("n"), "fixed")).alias("fixed"))


def with_repairs(df: DataFrame, key: list[str], tokens: Column, accepted: DataFrame) -> DataFrame:
    """key, repairs: the accepted repairs of each row's tokens, for the rows that have any."""
    each = df.select(*key, F.explode(tokens).alias("token")).join(accepted, "token")
    return each.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("token", "fixed"))).alias("repairs"))


@F.pandas_udf(StringType())
def one_form(base: pd.Series, repairs: pd.Series) -> pd.Series:
    """The one form of base forms, without blanks; letter case, accents,
    digits and points stay as they are."""
    return pd.Series([None if b is None else apply_repairs(b, dict(r) if r is not None else {}) for b, r in zip(base, repairs)], dtype=object)


def readable_forms(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, form: every text in the one form, its words kept apart by single
    spaces. `texts`: the key columns and `text`, all of which is the corpus
    whose words repairs must be. Null texts stay null; rows repeated in full
    count once; other columns are not read."""
    rows = texts.select(*key, "text")
    foreign = rows.filter(F.col("text").rlike(FOREIGN.pattern))
    tokens = stage(foreign.select(*key, base_and_tokens("text").alias("b")).filter(F.size("b.tokens") > 0).select(*key, F.col("b.tokens").alias("tokens")).distinct(), "tokens")
    words = stage(vocabulary([rows.select("text")]), "vocabulary")
    accepted = stage(accepted_repairs(tokens.select(F.explode("tokens").alias("token")), words), "repairs")
    return rows.distinct().join(with_repairs(tokens, key, F.col("tokens"), accepted), key, "left").select(*key, spaced_form("text", "repairs").alias("form"))


@F.pandas_udf(StringType())
def spaced_form(text: pd.Series, repairs: pd.Series) -> pd.Series:
    out = []
    for t, r in zip(text, repairs):
        if t is not None:
            t = base_form(t)
            t = unicodedata.normalize("NFC", BLANK.sub(" ", substituted(t, dict(r)) if r is not None else t)).strip()
        out.append(t)
    return pd.Series(out, dtype=object)
