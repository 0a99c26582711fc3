"""Answers checked against their sources, segment by segment."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "segment_no int, text string, source_id string, status string"
SHORTEST = 4
# What only frames an answer.
FRAMING = {"根据知识库：\n", "补充说明：\n", "\n", "\n\n"}


def recovered(raw: str | None) -> list[dict]:
    """The segments of an answer in JSON. Fences and control characters are
    taken out; of a truncated list the complete leading segments are kept."""
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", raw or "")
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    text = fenced[1] if fenced else text
    start = text.find("[", text.find('"segments"') if '"segments"' in text else 0)
    if start < 0:
        return []
    decoder, at, out = json.JSONDecoder(strict=False), start + 1, []
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        if isinstance(value, dict):
            out.append(value)


def judged(segments: list[dict], sources: dict[str, str], form) -> list[tuple[int, str, str | None, str]]:
    """(number, text, source, status): cited where the source holds the segment
    or, for knowledge and calculations, the quote that supports it; a
    calculation without a source takes the last cited one; a transition needs
    none, nor does what only frames the answer; all else is unsupported, and
    ends what calculations may take."""
    out, last = [], None
    for i, s in enumerate(segments, 1):
        text, source, basis = str(s.get("text") or ""), s.get("source_id") or None, s.get("basis")
        quote = str(s.get("support_quote") or "")
        if source is None and basis == "calculation":
            source = last
        body = form(sources.get(source, "")) if source else ""
        own = len(text.strip()) >= SHORTEST and form(text) in body
        backed = basis in ("knowledge", "calculation") and len(quote.strip()) >= SHORTEST and form(quote) in body
        if source and body and (own or backed):
            status, last = "cited", source
        elif text in FRAMING or basis == "transition" and not s.get("source_id"):
            status, source = "normal", None
        else:
            status, last = "unsupported", None
        out.append((i, text, source, status))
    return out


def answer_segments(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, segment_no, text, source_id, status. answers: answer_id, raw
    (JSON); sources: answer_id, id, original - those an answer was given, which
    one task holds, not all sources."""
    import unicodedata

    def form(t: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", t).split())

    given = sources.groupBy("answer_id").agg(F.map_from_entries(F.collect_set(F.struct("id", "original"))).alias("given"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for answer, raw, held in zip(f["answer_id"], f["raw"], f["given"]):
                out += [(answer, *x) for x in judged(recovered(raw), dict(held) if held is not None else {}, form)]
            yield pd.DataFrame(out, columns=["answer_id", "segment_no", "text", "source_id", "status"])

    return answers.select("answer_id", "raw").join(given, "answer_id", "left").mapInPandas(run, f"answer_id {answers.schema['answer_id'].dataType.simpleString()}, {SEGMENTS}")
