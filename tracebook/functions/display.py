"""How claims, sources and formulas are shown."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A simple equation or comparison, and signs as they are set.
EQUATION = re.compile(r"(?<![A-Za-z])[A-Za-z]\w*\s*[=≥≤]\s*[A-Za-z0-9_.+*/()^~×·²³⁻\s-]+", re.ASCII)
SET_AS = {"≥": r"\geq ", "≤": r"\leq ", "×": r"\times ", "·": r"\cdot ", "²": "^{2}", "³": "^{3}", "~": r"\sim "}
FORMULA = re.compile(r"\$[^$]+\$")


def stars(importance: Column) -> Column:
    """One to five stars, three where the importance is not known."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.nullif(importance.cast("int"), F.lit(0)), F.lit(3))))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def card_type(numbers: Column, kind: Column) -> Column:
    """data for claims with numbers, method for methods and principles, else concept."""
    return F.when(F.size(F.coalesce(numbers, F.array().cast("array<string>"))) > 0, "data").when(kind.isin("方法", "原理"), "method").otherwise("concept")


def source_place(source_file: Column, label: Column, reference: Column) -> Column:
    """Where in a source: a slide's number, a paragraph's label, else the page reference."""
    number = F.regexp_extract(label, r"\d+", 0)
    name = F.lower(source_file)
    return F.when(F.endswith(name, F.lit(".pptx")) & (number != ""), F.concat(F.lit("幻灯片 "), number)).when(F.endswith(name, F.lit(".pptx")) | F.endswith(name, F.lit(".docx")) | (number == ""), label).otherwise(F.coalesce(reference, label))


def source_name(source_file: Column, most: int = 34) -> Column:
    """The file's name without what is in brackets behind it."""
    return F.left(F.trim(F.split(F.element_at(F.split(source_file, "/"), -1), r"\(")[0]), F.lit(most))


def transcript_grade(mean_log_probability: Column) -> Column:
    """A, B or C by the recogniser's confidence; B where it is not known."""
    p = mean_log_probability
    return F.when(p.isNull(), "B").when(p >= -0.35, "A").when(p >= -0.75, "B").otherwise("C")


def source_type(source_file: Column, prefixes: Mapping[str, str]) -> Column:
    """What kind of material a file is by the begin of its path; else other."""
    found = F.lit("other")
    for prefix, kind in sorted(prefixes.items()):
        found = F.when(F.startswith(source_file, F.lit(prefix)), kind).otherwise(found)
    return found


def course_of_path(path: Column) -> Column:
    """The folder that a file lies in, if it lies at least two folders deep."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise("未分类")


def _equation(m: re.Match) -> str:
    body = m[0].rstrip()
    made = re.sub(r"\^(\d+(?:\.\d+)?)", r"^{\1}", re.sub(r"([A-Za-z])(\d+)", r"\1_{\2}", body))
    for sign, as_set in SET_AS.items():
        made = made.replace(sign, as_set)
    return f"${made}${m[0][len(body):]}"


def with_formulas(text: str, layouts: Mapping[str, str]) -> str:
    """Equations between dollar signs: those of `layouts` (as written to as
    set) first, the longest before the shorter, then simple ones. What is
    between dollar signs stays, so a second pass changes nothing."""
    known = re.compile("|".join(map(re.escape, sorted(layouts, key=len, reverse=True)))) if layouts else None

    def plain(part: str) -> str:
        if known is None:
            return EQUATION.sub(_equation, part)
        out, at = [], 0
        for m in known.finditer(part):
            out += [EQUATION.sub(_equation, part[at : m.start()]), f"${layouts[m[0]]}$"]
            at = m.end()
        return "".join([*out, EQUATION.sub(_equation, part[at:])])

    out, at = [], 0
    for m in FORMULA.finditer(text):
        out += [plain(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, plain(text[at:])])


def formula_text(layouts: Mapping[str, str]):
    """`with_formulas` by Arrow batches; null stays null."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else with_formulas(t, layouts) for t in text], dtype=object)

    return run


def formula_html(text: str) -> str:
    """Text for a page, formulas in elements of their own."""
    out, at = [], 0
    for m in FORMULA.finditer(text):
        out += [html.escape(text[at : m.start()]), f'<span class="math-tex">{html.escape(m[0][1:-1])}</span>']
        at = m.end()
    return "".join([*out, html.escape(text[at:])])
