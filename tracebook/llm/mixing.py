"""Mixing sources to target weights along a time-varying curriculum.

The weight of a source may change over the training run; its schedule is
integrated to a cumulative demand of tokens, and that is inverted to give each
document (and each repeat of it) the position at which the demand reaches it.
Sorting by position interleaves the sources as the schedule asks.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tracebook.sources.tables import stage

#: Bits of the shuffling key by which prefix sums are taken in parallel.
BUCKET_BITS = 12


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str, pattern: str):
    """Tokens of a text under the vocabulary file `path`; null texts have none."""

    @F.pandas_udf(IntegerType())
    def count(text: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in text], dtype="int32")

    return count


@dataclass
class Share:
    """One source of the plan. tilt: how its weight changes from the begin
    (weight * (1 - tilt)) to the end (weight * (1 + tilt)) of the run."""

    source: str
    weight: float
    max_repeats: int
    tokens: int = 0
    tilt: float = 0.0
    demand: float = 0.0


def plan_shares(targets: list[tuple[str, float, int]], tokens: dict[str, int], tilts: dict[str, float], total: int | None) -> list[Share]:
    """The demand of tokens of each source that has a target.

    Sources without documents can have no share; the weights of the others are
    scaled to make up for them. Without a `total` it is the largest at which
    every source reaches its weight without exceeding its repeats; with one, a
    source that is too small gives what it has. Tilts are shifted so that at
    every moment the weights sum to one.
    """
    shares = [Share(s, float(w), max(1, int(r or 1)), tokens.get(s, 0), float(tilts.get(s, 0))) for s, w, r in targets if s is not None and w and w > 0]
    there = [x for x in shares if x.tokens > 0]
    scale = sum(x.weight for x in there)
    if not there:
        return shares
    mean = sum(x.weight * x.tilt for x in there) / scale
    widest = max([1.0, *(abs(x.tilt - mean) for x in there)])
    size = total if total is not None else min(x.tokens * x.max_repeats * scale / x.weight for x in there)
    for x in there:
        x.tilt = (x.tilt - mean) / widest
        x.demand = min(x.weight / scale * size, float(x.tokens * x.max_repeats))
    return shares


def position(offset: Column, demand: Column, tilt: Column) -> Column:
    """The moment in 0..1 at which the cumulative demand
    demand * (t + tilt * (t * t - t)) reaches `offset`."""
    y = F.least(F.lit(1.0), offset / demand)
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)
    return F.when(F.abs(tilt) < 1e-9, y).otherwise(F.when(y == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * y / ((1 - tilt) + root))))


def prefix_sums(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of `value` within `group` by the 64-bit key
    `order`, in buckets of its leading bits: sums of buckets first (at most
    2 ** BUCKET_BITS rows a group), then within each bucket, so no task sorts
    a whole group. The frame is read twice and should be a staged table."""
    from pyspark.sql import Window

    cut = df.withColumn("_b", F.shiftrightunsigned(F.col(order), 64 - BUCKET_BITS))
    sums = cut.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    before = sums.select(group, "_b", (F.sum("_s").over(Window.partitionBy(group).orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, "_b").orderBy(F.shiftleft(F.col(order), BUCKET_BITS), "_key")) - F.col(value)
    return cut.join(before, [group, "_b"]).withColumn(out, F.col("_before") + inside).drop("_b", "_before")


def curriculum_mixture(documents: DataFrame, targets: DataFrame, *, key: str, text: str, source: str, vocabulary: str, pattern: str, tilts: dict[str, float] | None = None, total: int | None = None, seed: int = 7, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, copy_no, n_tokens, position; in the order of
    position) and the report on it (source, weight, planned_share, max_repeats,
    n_documents, n_tokens, most_copies, actual_share).

    Documents of a source come in an order given by a hash of key and seed, the
    whole source again for each repeat, until the source's demand is met to the
    nearest document. Documents without source, target, key or tokens are in
    no mixture; a source without documents is reported with a share of 0; rows
    of one key count once. `targets`: source, weight, max_repeats, at most
    `max_sources` rows. Only the columns named are read.
    """
    spark = documents.sparkSession
    counted = documents.filter(F.col(key).isNotNull() & F.col(source).isNotNull()).select(F.col(key).alias("_key"), F.col(source).alias("_source"), token_counter(vocabulary, pattern)(F.col(text)).alias("_n"))
    sized = stage(counted.filter("_n > 0").groupBy("_key").agg(F.min("_source").alias("_source"), F.max("_n").alias("_n")).withColumn("_h", F.xxhash64("_key", F.lit(seed))), "tokens")
    rows = targets.select("source", "weight", "max_repeats").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError("too many target sources")
    known = [r["source"] for r in rows if r["source"] is not None]
    tokens = {r["_source"]: r["n"] for r in sized.filter(F.col("_source").isin(known)).groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    shares = plan_shares([(r["source"], r["weight"], r["max_repeats"]) for r in rows], tokens, tilts or {}, total)
    plan = spark.createDataFrame([(x.source, x.weight, x.max_repeats, x.tokens, x.tilt, x.demand) for x in shares], "_source string, _weight double, _repeats int, _tokens long, _tilt double, _demand double")

    taken = sized.join(F.broadcast(plan.filter("_demand > 0")), "_source")
    offset = prefix_sums(taken, "_source", "_h", "_n", "_at")
    # copies 1, 2, ... whose middle lies within the demand
    copies = F.least(F.col("_repeats"), F.ceil((F.col("_demand") - F.col("_at") - F.col("_n") / 2) / F.col("_tokens")).cast("int"))
    each = offset.withColumn("_copies", copies).filter("_copies >= 1").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    at = F.col("_at") + (F.col("copy_no") - 1) * F.col("_tokens")
    mixed = each.select(F.col("_key").alias(key), F.col("_source").alias("source"), "copy_no", F.col("_n").alias("n_tokens"), position(at.cast("double"), F.col("_demand"), F.col("_tilt")).alias("position"))
    mixture = mixed.orderBy("position", key, "copy_no")

    used = mixed.groupBy("source").agg(F.count_distinct(key).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("most_copies"))
    size = sum(x.demand for x in shares) or 1.0
    report = plan.withColumnRenamed("_source", "source").join(used, "source", "left")
    whole = stage(report.select("source", F.col("_weight").alias("weight"), (F.col("_demand") / size).alias("planned_share"), F.col("_repeats").alias("max_repeats"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")), "shares")
    got = whole.agg(F.sum("n_tokens")).first()[0] or 1
    return mixture, whole.withColumn("actual_share", F.col("n_tokens") / F.lit(got))
