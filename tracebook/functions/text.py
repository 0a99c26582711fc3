"""Text expressions. All but `match_form` stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, written out so that every regex engine takes the same.
BLANKS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Punctuation that quotations and pages write differently.
MARKS = "“”‘’—–−．，；：（）"
MARKS_AS = "\"\"''---.,;:()"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
JOINING_HYPHEN = r"(?<=[a-z0-9])-(?=[a-z0-9])"


def without_whitespace(text: Column) -> Column:
    """Without space, tab, CR and LF; other blanks stay."""
    return F.regexp_replace(text, r"[ \t\r\n]+", "")


def flattened(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANKS}+", " "))


def tidied(text: Column) -> Column:
    """Lines trimmed, no-break and ideographic spaces plain, line ends LF, runs
    of empty lines as one, none at the ends."""
    plain = F.regexp_replace(F.translate(text, " 　", "  "), "\r\n?", "\n")
    trimmed = F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def plain_form(text: Column) -> Column:
    """The form in which quotations are compared, as far as SQL functions go:
    lower case, no blanks, no private characters, no hyphen between letters or
    digits, plain punctuation. Hyphens go before dashes become hyphens, so a
    range written with a dash keeps it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), BLANKS, ""), PRIVATE, "")
    return F.translate(F.regexp_replace(bare, JOINING_HYPHEN, ""), MARKS, MARKS_AS)


_BLANK, _PRIVATE, _HYPHEN, _MARK = re.compile(r"\s+"), re.compile("[-]"), re.compile(JOINING_HYPHEN), str.maketrans(MARKS, MARKS_AS)


def full_match_form(text: str | None) -> str:
    """`plain_form` after compatibility folding and without combining marks."""
    if not text:
        return ""
    if not text.isascii():
        split = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
        text = "".join(c for c in split if unicodedata.category(c) != "Mn")
    return _HYPHEN.sub("", _PRIVATE.sub("", _BLANK.sub("", text.lower()))).translate(_MARK)


@F.pandas_udf(StringType())
def match_form(text: pd.Series) -> pd.Series:
    """`full_match_form`, by Arrow batches; null becomes empty."""
    return pd.Series([full_match_form(t) for t in text], dtype=object)


@F.pandas_udf(StringType())
def citation_form(text: pd.Series) -> pd.Series:
    """Compatibility folding and single spaces; case, marks and numbers stay."""
    return pd.Series(["" if not t else " ".join(unicodedata.normalize("NFKC", t).split()) for t in text], dtype=object)


def search_tokens(text: Column) -> Column:
    """The distinct tokens: runs of a-z and 0-9, and the bigrams of runs of
    ideographs (a run of one is a token itself)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0))

    def bigrams(run: Column) -> Column:
        last = F.greatest(F.length(run) - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(2)))

    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(F.transform(runs, bigrams))))


def first_number(label: Column) -> Column:
    """The first run of digits of a label as a number; null for none and for 0."""
    digits = F.regexp_extract(label, r"(\d{1,9})", 1)
    return F.when(digits != "", F.nullif(digits.cast("int"), F.lit(0)))


def safe_name(text: Column) -> Column:
    """Letters, digits, _ and -; runs of others as one _."""
    return F.regexp_replace(text, r"(?U)[^\w\-]+", "_")


CHINESE_DIGITS = "零一二三四五六七八九"


def chinese_number(text: Column) -> Column:
    """Digits, or Chinese numerals under 100; null for anything else."""
    digits = F.translate(text, CHINESE_DIGITS, "0123456789")
    tens = F.regexp_extract(digits, r"^(\d?)十(\d?)$", 1)
    ones = F.regexp_extract(digits, r"^(\d?)十(\d?)$", 2)
    ten = F.when(digits.rlike(r"^\d?十\d?$"), F.when(tens == "", F.lit(1)).otherwise(F.try_to_number(tens, F.lit("9")).cast("int")) * 10 + F.when(ones == "", F.lit(0)).otherwise(F.try_to_number(ones, F.lit("9")).cast("int")))
    return F.when(digits.rlike(r"^\d{1,9}$") & (text.rlike(r"^\d+$") | (F.length(text) == 1)), digits.try_cast("int")).otherwise(ten)


def file_id_of(path: Column) -> Column:
    """The file's stem, safe and cut to 40 characters, and a hash of its path."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.left(safe_name(stem), F.lit(40)), F.lit("__"), F.left(F.sha1(path), F.lit(8)))


def file_tag_of(file_id: Column) -> Column:
    """A short ASCII name of a file: slug of 28 characters and a hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(file_id), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.left(slug, F.lit(28)), F.lit("-"), F.left(F.md5(file_id), F.lit(8)))


def short_fingerprint(text: Column, start: Column, end: Column) -> Column:
    """Range, length and a hash of the first 32 characters without blanks."""
    bare = F.regexp_replace(text, f"{BLANKS}+", "")
    return F.concat_ws("|", F.concat_ws("-", start.cast("string"), end.cast("string")), F.length(text).cast("string"), F.left(F.md5(F.left(bare, F.lit(32))), F.lit(8)))
