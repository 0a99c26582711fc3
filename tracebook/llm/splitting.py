"""Cutting oversized items at natural boundaries, with overlap, in SQL functions.

One bounded-quantifier pattern per call: its alternatives, ordered by the
strength of the boundary, each consume as much as the limit allows and back
off to the last boundary of their kind; single characters are the fallback.
`regexp_extract_all` yields the consecutive cuts, array functions prefix each
with the end of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundaries from strong to weak, each with the greatest number of characters it takes.
BOUNDARIES = [
    (r"\n[ \t\r]?\n", 3),
    (r"[。！？!?][”’」』）)]?\n", 3),
    (r"(?:[。！？!?][”’」』）)]?|[.][”’)]?[ \t\n])", 3),
    (r"\n", 1),
    (r"[；;：:，,、][ \t]?", 2),
    (r"[ \t　]", 1),
]


def cut_pattern(limit: int, least: int) -> str:
    """Consume up to `limit` characters: the whole rest; else to the last
    boundary after `least` characters, the strongest kind first; else `limit`
    characters, not before a combining mark if that can be."""
    any_char = r"[\s\S]"
    ways = [rf"{any_char}{{1,{limit}}}\z"]
    ways += [rf"{any_char}{{{least},{limit - most}}}{b}" for b, most in BOUNDARIES]
    ways += [rf"{any_char}{{{least},{limit}}}(?!\p{{M}})", rf"{any_char}{{1,{limit}}}"]
    return "|".join(ways)


def split_oversized(df: DataFrame, *, keys: list[str], text: str, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """keys, piece_no (from 1), overlap, piece: each text in pieces of at most
    `limit` characters (code points), in order.

    A text within the limit is one piece; null and empty texts have none. Each
    later piece begins with the last `overlap` characters of the one before;
    without those, the pieces of a text are the text. Rows repeated in the
    frame come out repeated; columns other than those named are not read.
    """
    if not 0 <= overlap < limit // 4 or limit < 40:
        raise ValueError("overlap must be under a quarter of the limit, and the limit at least 40")
    core = limit - overlap
    pattern = cut_pattern(core, max(core // 2, overlap))
    t = F.col(text)
    cuts = F.when(F.length(t) <= limit, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

    def piece(cut, i):
        before = F.when(i == 0, F.lit("")).otherwise(F.right(F.element_at("_cuts", F.greatest(i, F.lit(1))), F.lit(overlap)))
        return F.struct((i + 1).alias("piece_no"), F.length(before).alias("overlap"), F.concat(before, cut).alias("piece"))

    cut = df.select(*keys, text).filter(F.length(t) > 0).withColumn("_cuts", cuts)
    return cut.select(*keys, F.explode(F.transform("_cuts", piece)).alias("_p")).select(*keys, "_p.piece_no", "_p.overlap", "_p.piece")
