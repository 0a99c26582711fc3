"""Choosing, merging and replacing rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; an aggregate, so copies of
    a hot key are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and of `old` those whose key `new` does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_history(old: DataFrame, new: DataFrame, issue: list[str], revision: str, carried: list[str]) -> DataFrame:
    """History-preserving merge: a new row takes the carried columns of the old
    row of the same issue and revision; old issues that are gone stay, marked
    superseded. Nulls in the issue are equal."""
    a, b = new.alias("a"), old.alias("b")
    same = F.lit(True)
    for c in [*issue, revision]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kept = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in carried else F.col(f"a.{c}") for c in new.columns]
    now = a.join(b, same, "left").select(*kept, F.lit(False).alias("superseded"))
    gone = b.join(a, same, "left_anti").select(*(F.col(c) for c in new.columns), F.lit(True).alias("superseded"))
    return now.unionByName(gone)


def declared_duplicates(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key, keep: the rows whose content another row with a smaller key has."""
    same = df.select(key, F.md5(content).alias("_d"), F.length(content).alias("_n")).filter("_d is not null")
    first = same.groupBy("_d", "_n").agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return same.join(first, ["_d", "_n"]).filter(F.col(key) != F.col("keep")).select(key, "keep").distinct()


def representatives(items: DataFrame, support: DataFrame) -> DataFrame:
    """kp_id, keep, n_members: of the items of one course and one name (trimmed,
    letter case aside) the one that stands for all: most supporting rows, then
    the longest definition, the lowest page, the smallest id. A group whose
    members state different numbers keeps all of them.

    items: kp_id, course, name, definition, numbers, page; support: kp_id, n.
    """
    group = ["course", "_name"]
    rows = items.dropDuplicates(["kp_id"]).join(support, "kp_id", "left").withColumns({"_name": F.lower(F.trim("name")), "_num": F.array_join(F.array_sort(F.coalesce("numbers", F.array().cast("array<string>"))), "\x1f")}).filter("_name <> '' and course is not null")
    best = rows.groupBy(*group).agg(
        F.count_distinct("_num").alias("kinds"), F.count(F.lit(1)).alias("n_members"),
        F.min_by("kp_id", F.struct(-F.coalesce("n", F.lit(0)), -F.length(F.coalesce("definition", F.lit(""))), F.coalesce("page", F.lit(10**9)), F.col("kp_id"))).alias("best"),
    )
    return rows.join(best, group).select("kp_id", F.when(F.col("kinds") == 1, F.col("best")).otherwise(F.col("kp_id")).alias("keep"), "n_members")


def differing_numbers(items: DataFrame) -> DataFrame:
    """course, name, n_variants: names (without blanks, case kept) whose items
    state different sets of numbers; items without numbers don't count."""
    name = F.regexp_replace("name", r"\s+", "")
    num = F.array_join(F.array_sort("numbers"), "\x1f")
    return items.filter("size(numbers) > 0 and course is not null and name is not null").select("course", name.alias("name"), num.alias("num")).groupBy("course", "name").agg(F.count_distinct("num").alias("n_variants")).filter("n_variants > 1")


def stratified(items: DataFrame, strata: list[str], order: list[Column], key: str, size: int) -> DataFrame:
    """key, strata, rank, place: one item of each stratum per round, strata in
    their order, items in theirs, until `size` are chosen. Only the first
    `size` items of a stratum are ranked on."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*order, key))
    ranked = items.dropDuplicates([key]).withColumn("rank", rank).filter(F.col("rank") <= size)
    chosen = ranked.orderBy("rank", *strata, key).limit(size)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("rank", *strata, key))).select(key, *strata, "rank", "place")


def next_index(df: DataFrame, group: str, key: str) -> DataFrame:
    """group, next_index: one more than the greatest number that ends a key."""
    tail = F.regexp_extract(key, r"(\d{1,18})$", 1)
    return df.filter(tail != "").groupBy(group).agg((F.max(tail.cast("long")) + 1).alias("next_index"))


def longest_match(df: DataFrame, text: str, dimension: DataFrame, match: str, name: str, max_rows: int = 10_000) -> DataFrame:
    """df with `name`: of the dimension's rows whose `match` is part of the text
    the one with the longest match (then the smallest name); null without.
    The dimension is collected once, up to `max_rows`, and tested in one pass."""
    rows = dimension.select(match, name).filter(F.length(match) > 0).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("the dimension is too large to test each row against it")
    ordered = sorted(rows, key=lambda r: (-len(r[match]), r[name]))
    found = F.coalesce(*(F.when(F.contains(F.col(text), F.lit(r[match])), F.lit(r[name])) for r in ordered)) if ordered else F.lit(None).cast("string")
    return df.withColumn(name, found)


def segments(df: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """group, label, first, last, rows: runs of equal labels in order; a null
    label is a value of its own."""
    w = Window.partitionBy(group).orderBy(order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    runs = df.withColumn("_run", F.sum(change.cast("int")).over(w))
    return runs.groupBy(group, "_run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows")).drop("_run")
