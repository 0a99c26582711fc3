"""Recognised boxes put in lines and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = re.compile(r"[　-鿿＀-￯]")


def lines_of(boxes: list[tuple[float, float, float, float, str, float]]) -> list[dict]:
    """Boxes (left, top, right, bottom, text, score) in lines: a box joins the
    line whose centre is nearer than 0.6 of its height, or 8 points."""
    lines: list[dict] = []
    for left, top, right, bottom, text, score in sorted(boxes, key=lambda b: ((b[1] + b[3]) / 2, b[0])):
        centre, height = (top + bottom) / 2, bottom - top
        last = lines[-1] if lines else None
        if last and abs(centre - last["centre"]) < max(8.0, 0.6 * max(height, last["height"])):
            last["parts"].append((left, text, score))
            last["bottom"], last["height"] = max(last["bottom"], bottom), max(last["height"], height)
        else:
            lines.append({"top": top, "bottom": bottom, "centre": centre, "height": height, "parts": [(left, text, score)]})
    return lines


def glued(a: str, b: str) -> str:
    """Two texts as one: no blank between wide characters."""
    return a + b if not a or not b or WIDE.match(a[-1]) or WIDE.match(b[0]) else f"{a} {b}"


def paragraphs_of(boxes: list[tuple]) -> list[tuple[str, float, int]]:
    """(text, mean score, lines) of the paragraphs: a gap of 0.75 of the line's
    height begins a new one."""
    out: list[tuple[str, list[float], int]] = []
    before = None
    for line in lines_of(boxes):
        text = ""
        for _, t, _ in sorted(line["parts"]):
            text = glued(text, t.strip())
        scores = [s for *_, s in line["parts"]]
        if before is not None and line["top"] - before["bottom"] < 0.75 * line["height"]:
            out[-1] = (glued(out[-1][0], text), out[-1][1] + scores, out[-1][2] + 1)
        else:
            out.append((text, scores, 1))
        before = line
    return [(t, sum(s) / len(s), n) for t, s, n in out]


def recognised_paragraphs(boxes: DataFrame) -> DataFrame:
    """source_file, page_no, paragraph_no, text, confidence, lines. `boxes`:
    source_file, page_no, x0, y0, x1, y1, text, score; boxes without text are
    left out. A page's boxes are collected in a list first, so the Python step
    needs no grouping."""
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text", F.col("score").cast("double").alias("score"))
    pages = boxes.filter("trim(text) <> ''").groupBy("source_file", "page_no").agg(F.collect_list(box).alias("boxes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, page, held in zip(f["source_file"], f["page_no"], f["boxes"]):
                found = paragraphs_of([(b["x0"], b["y0"], b["x1"], b["y1"], b["text"], b["score"]) for b in held])
                out += [(file, page, i, t, round(s, 4), n) for i, (t, s, n) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["source_file", "page_no", "paragraph_no", "text", "confidence", "lines"])

    return pages.mapInPandas(run, "source_file string, page_no int, paragraph_no int, text string, confidence double, lines int")


def overlay(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with the recognised text in place of their own where there is any;
    is_scan stays as it is."""
    text = recognised.groupBy("source_file", "page_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("paragraph_no", "text")))["text"], "\n\n").alias("_text"), F.round(F.avg("confidence"), 4).alias("_score"))
    met = pages.join(text, ["source_file", "page_no"], "left")
    new = F.col("_text").isNotNull()
    return met.withColumns({"text": F.coalesce("_text", "text"), "char_count": F.length(F.coalesce("_text", "text")), "text_source": F.when(new, "ocr").otherwise(F.col("text_source")), "ocr_confidence": F.coalesce("_score", "ocr_confidence")}).drop("_text", "_score")
