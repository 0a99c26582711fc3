from __future__ import annotations

import datetime as dt
import random

import numpy as np

from tracebook.llm import nearest_time as T

BASE = dt.datetime(2026, 1, 1)
LEFT = "id long, e string, f string, at timestamp, tol_us string"
RIGHT = "e string, f string, at timestamp, row string, tol_us long"
COLUMNS = {"entity": ["e", "f"], "left_id": "id", "left_time": "at", "right_time": "at", "right_row": "row", "right_tolerance_us": "tol_us"}


def joined(spark, left, right, minutes, **kw):
    got, progress = T.nearest_time_at_rest(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), **COLUMNS, horizon_minutes=minutes, **kw)
    return sorted((int(r["id"]), r["row"], r["distance_us"]) for r in got.distinct().collect()), progress


def brute(left, right):
    out = set()
    for i, e, f, at, _ in left:
        near = min(((abs((at - t).total_seconds()), t, row, tol) for x, y, t, row, tol in right if (x, y) == (e, f) and t is not None), default=None) if None not in (e, f, at) else None
        hit = near is not None and near[0] * 1e6 <= near[3]
        out.add((i, near[2], round(near[0] * 1e6)) if hit else (i, None, None))
    return sorted(out, key=lambda x: x[0])


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    when = lambda: BASE + dt.timedelta(seconds=rng.randint(0, 400_000))
    left = [(i, rng.choice("aaab"), rng.choice("xy"), when(), "clash") for i in range(60)] + [(100, None, "x", BASE, ""), (101, "a", "x", None, ""), (102, "z", "x", BASE, "")]
    left += left[:5]
    right = [(rng.choice("ab"), rng.choice("xy"), when(), f"r{j:03d}", 1_800_000_000) for j in range(80)] + [(None, "x", BASE, "n", 1), ("a", "x", None, "n", 1)]
    for waves, rows_per_task in ((1, 4), (4, 1000), (3, 4)):
        assert joined(spark, left, right, 30, slice_hours=5, rows_per_task=rows_per_task, waves=waves)[0] == brute(left, right)
    hot = T.hot_slices(spark.createDataFrame(left, LEFT), ["e", "f"], "at", 5, 1, 4)
    assert hot.count() > 0


def test_ties_and_bounds(spark):
    m = lambda x: BASE + dt.timedelta(minutes=x)
    left = [(1, "a", "x", m(10), ""), (2, "a", "x", m(40), ""), (3, "a", "x", m(51), "")]
    right = [("a", "x", m(5), "before", 300_000_000), ("a", "x", m(15), "after", 300_000_000), ("a", "x", m(45), "s2", 300_000_000), ("a", "x", m(45), "s1", 300_000_000), ("b", "x", m(10), None, 9), ("a", "x", m(90), "", 1)]
    assert joined(spark, left, right, 5)[0] == [(1, "before", 300_000_000), (2, "s1", 300_000_000), (3, None, None)]


def test_empty_sides(spark):
    assert joined(spark, [(1, "a", "x", BASE, "")], [], 5)[0] == [(1, None, None)]
    assert joined(spark, [], [("a", "x", BASE, "r", 1)], 5)[0] == []
    assert joined(spark, [], [], 5)[0] == []


def test_state_is_evicted_as_the_watermark_moves(spark):
    rng = random.Random(4)
    left = [(i, "a", "x", BASE + dt.timedelta(hours=rng.randint(0, 2000)), "") for i in range(400)]
    right = [("a", "x", BASE + dt.timedelta(hours=h, minutes=7), f"r{h}", 600_000_000) for h in range(2000)]
    got, progress = joined(spark, left, right, 10, slice_hours=24, waves=8)
    assert got == brute(left, right)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    rows = [p["numInputRows"] for p in progress]
    assert sum(n > 0 for n in rows) == 9 and max(held) * 4 < 2000 / 24 * 8 and held[-1] <= 1  # never all slices at once, none but the marker's at the end
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 0


def test_a_moving_stream_drops_late_rows(spark, tmp_path):
    m = lambda x: BASE + dt.timedelta(minutes=x)
    steps = [
        ([(1, "a", "x", m(0), "")], [("a", "x", m(1), "r1", 300_000_000)]),
        ([(2, "a", "x", m(100), "")], [("a", "x", m(101), "r2", 300_000_000)]),
        ([(3, "a", "x", m(2), ""), (5, None, "x", m(1), "")], [("a", "x", m(99), "r0", 300_000_000)]),  # left row 3 is late, the right one in time
        ([(4, "a", "x", m(300), "")], []),
    ]
    for name, schema in (("l", LEFT), ("r", RIGHT)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    sides = [spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("l", LEFT), ("r", RIGHT))]
    stream = T.nearest_time_stream(*sides, **COLUMNS, horizon_minutes=5, lateness="10 minutes", slice_hours=1, buckets=2)
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.append({(r["id"], r["row"]) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/log").start()
    try:
        for left, right in steps:
            for name, schema, rows in (("l", LEFT, left), ("r", RIGHT, right)):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            query.processAllAvailable()
        dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
    finally:
        query.stop()
    out = set().union(*seen)
    assert ("1", "r1") in out and ("2", "r0") in out and ("5", None) in out and not any(i == "3" for i, _ in out) and not any(i == "4" for i, _ in out) and dropped >= 1


def test_nearest_prefers_the_earlier():
    got = T.nearest(np.array([0, 0, 1]), np.array([10, 99, 10]), np.array([0, 0]), np.array([5, 15]))
    assert got.tolist() == [0, 1, -1]
