"""Pages put in continuous paragraphs by the faults found on them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN_EDGE = re.compile("[㐀-鿿，。；：、！？（）]")
OWN_LINE = re.compile(r"^\s*(?:[•·\-*☐☑]\s|\d+(?:\.\d+)*[.、)]?\s|[（(]?\w{1,2}[)）]\s)|\S {2,}\S|\t|\|")
COMPOUND_END = re.compile(r"[^\W\d_][-‐‑]$")


def _replace(text: str, wrong: str, fixed: str) -> str:
    """The word in its place, with the capital that the wrong one began with."""

    def put(m: re.Match) -> str:
        return fixed[:1].upper() + fixed[1:] if m[0][:1].isupper() else fixed

    if wrong.isascii() or wrong[0].isalnum() and not HAN_EDGE.search(wrong):
        return re.sub(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", put, text, flags=re.IGNORECASE)
    return text.replace(wrong, fixed)


def reflowed(text: str, faults: list[tuple[int, str, str | None, str | None]]) -> str:
    """The text without its running titles and page numbers, cut words joined,
    misread words put right, and the lines of each paragraph as one. Lines
    that are items, headings with numbers or rows of a table stay apart, as do
    lines after one that is much shorter than the others of its block."""
    gone = {n for n, issue, *_ in faults if issue in ("header", "page_number")}
    cut = {n: (w, f) for n, issue, w, f in faults if issue == "hyphen"}
    wrong: dict[int, list[tuple[str, str]]] = {}
    for n, issue, w, f in faults:
        if issue == "misread" and w and f:
            wrong.setdefault(n, []).append((w, f))
    lines = text.split("\n")
    width, block = [0] * len(lines), []
    for i, x in enumerate([*lines, ""]):  # of each line the width of its block
        if i < len(lines) and x.strip():
            if i + 1 not in gone:
                block.append(i)
            continue
        most = max((len(lines[j].strip()) for j in block), default=0)
        for j in block:
            width[j] = most
        block = []
    out = ""
    held, pending, joined, own, last_own = "", False, None, False, False

    def close() -> None:
        nonlocal out, held, pending, last_own
        if held:
            out += ("" if not out else "\n" if own and last_own else "\n\n") + held
            last_own = own
        held, pending = "", False

    for i, line in enumerate(lines, 1):
        if i in gone:
            continue
        x = line.strip()
        if not x:
            close()
            last_own = False
            continue
        for w, f in wrong.get(i, ()):
            x = _replace(x, w, f)
        if not held or not pending or OWN_LINE.search(line.rstrip()):
            close()
            held, own = x, bool(OWN_LINE.search(line.rstrip()))
        elif joined is not None:
            held = re.sub(r"[-‐‑­]$", "", held) + x
            for n in (i - 1, i):
                for w, f in wrong.get(n, ()):
                    held = _replace(held, w, f)
        elif COMPOUND_END.search(held) or (HAN_EDGE.match(held[-1]) or HAN_EDGE.match(x[0])):
            held += x
        else:
            held += " " + x
        joined = cut.get(i)
        pending = not OWN_LINE.search(line.rstrip()) and (joined is not None or bool(COMPOUND_END.search(x)) or len(x) >= 0.6 * width[i - 1])
    close()
    return out


@F.pandas_udf(StringType())
def _reflow(text: pd.Series, faults: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else reflowed(t, [(f["line_no"], f["issue"], f["wrong"], f["fixed"]) for f in (fs if fs is not None else ())]) for t, fs in zip(text, faults)], dtype=object)


def repaired_pages(pages: DataFrame, faults: DataFrame) -> DataFrame:
    """file_id, page_no, page_label, text of every page that has a key: the
    label with its digits put right, the text in continuous paragraphs. A null
    text stays null; rows repeated in full count once. `faults` as from
    `page_faults`; those of one page are what one task collects."""
    by_page = faults.groupBy("file_id", "page_no").agg(F.collect_list(F.struct("line_no", "issue", "wrong", "fixed")).alias("faults"))
    label = F.element_at(F.filter("faults", lambda f: f["issue"] == "label"), 1)
    rows = pages.select("file_id", "page_no", "page_label", "text").filter("file_id is not null and page_no is not null").distinct().join(by_page, ["file_id", "page_no"], "left")
    fixed = F.when(F.exists("faults", lambda f: f["issue"] == "label"), F.regexp_replace("page_label", r"[0-9lIiOoZzSsBbgq|]+(?=\D*$)", label["fixed"])).otherwise(F.col("page_label"))
    return rows.select("file_id", "page_no", fixed.alias("page_label"), _reflow("text", "faults").alias("text"))
