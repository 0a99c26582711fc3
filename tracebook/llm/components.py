"""Connected groups of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebook.sources.tables import stage


def components(links: DataFrame) -> DataFrame:
    """node, label: of every node of the links (a, b) the least node that it is
    connected with. Each round takes the least label of the neighbours and then
    the label of that label, so rounds grow with the logarithm of the longest
    chain; labels are staged each round, and only counts come to the driver."""
    both = stage(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jumped = low.join(labels.select(F.col("node").alias("low"), F.col("label").alias("far")), "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("label"))
        now = stage(jumped, "labels")
        if not now.filter("label < old").limit(1).count():
            return now.select("node", "label")
        labels = now.select("node", "label")


def grouped(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """key, group_key, n_links: one row per holder of a text, the least key of
    its group, and to how many other texts its text is linked. Copies share a
    text and so a group; what is linked with nothing is a group of its own."""
    links = pairs.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    labels = components(links).select(F.col("node").alias("rid"), "label")
    of = members.join(labels, "rid", "left").join(degree, "rid", "left").select("key", F.coalesce("label", "rid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = of.groupBy("label").agg(F.min("key").alias("group_key"))
    return of.join(least, "label").select("key", "group_key", "n_links")
