from __future__ import annotations

import random

from tracebook.llm.components import components, grouped


def test_against_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links for x in pair}


def test_groups(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "rid_a long, rid_b long")
    members = spark.createDataFrame([("d", 1), ("b", 1), ("c", 2), ("e", 3), ("z", 9)], "key string, rid long")
    assert sorted(tuple(r) for r in grouped(pairs, members).collect()) == [("b", "b", 1), ("c", "b", 2), ("d", "b", 1), ("e", "b", 1), ("z", "z", 0)]
    assert sorted(tuple(r) for r in grouped(pairs.limit(0), members).collect())[0] == ("b", "b", 0)
