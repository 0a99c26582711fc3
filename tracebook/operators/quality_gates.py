"""Contracts and ledgers: keys, nulls, enumerations, references, set proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(c: str, kind: str) -> Column:
    """Null, or for strings empty: both count as not given."""
    return F.col(c).isNull() | (F.col(c) == "") if kind == "string" else F.col(c).isNull()


def contract_report(df: DataFrame, table: str, *, required: list[str] = (), enums: dict[str, list[str]] | None = None) -> DataFrame:
    """check, table, column, n: violations of a contract in one pass. A column
    that is not there at all is a finding of its own (n is null)."""
    kinds = dict(df.dtypes)
    checks: list[tuple[str, str, Column]] = []
    for c in required:
        checks.append(("missing", c, F.count_if(missing(c, kinds[c])) if c in kinds else F.lit(None).cast("long")))
    for c, allowed in (enums or {}).items():
        checks.append(("enum", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(allowed)) if c in kinds else F.lit(None).cast("long")))
    row = df.agg(*(x.alias(f"c{i}") for i, (_, _, x) in enumerate(checks)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(table).alias("table"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, (k, c, _) in enumerate(checks))))
    return row.select(each.alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that stand on more than one row, and on how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The distinct values of a column that the parent's key does not have."""
    return child.select(F.col(column).alias("value")).filter("value is not null").distinct().join(parent.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def ledger(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several tables by a key, fully outer joined: key, n_<name>
    (0 where a table has none) and missing_in (the names without rows). Tables
    are counted before they are joined."""
    parts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")) for name, df in sources.items()]
    met = reduce(lambda a, b: a.join(b, key, "full"), (p.filter(F.col(key).isNotNull()) for p in parts))
    filled = met.fillna(0, [f"n_{n}" for n in sources])
    absent = F.array_join(F.filter(F.array(*(F.when(F.col(f"n_{n}") == 0, F.lit(n)) for n in sources)), lambda x: x.isNotNull()), ",")
    return filled.withColumn("missing_in", absent)


def manifest_diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: left_only, right_only, changed or same."""
    a, b = left.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def subset_proof(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: n_before, n_after, n_lost, n_added, is_subset. Both sides are
    reduced to their distinct keys and compared in one shuffle."""
    side = before.select(key).distinct().withColumn("_b", F.lit(1)).join(after.select(key).distinct().withColumn("_a", F.lit(1)), key, "full")
    return side.agg(F.count("_b").alias("n_before"), F.count("_a").alias("n_after"), F.count_if(F.col("_a").isNull()).alias("n_lost"), F.count_if(F.col("_b").isNull()).alias("n_added"), (F.count_if(F.col("_a").isNull()) == 0).alias("is_subset"))


def summary_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n for each dimension, and the total: one pass by grouping sets."""
    each = F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("value")) for d in dimensions)))
    return df.select(each.alias("e")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))
