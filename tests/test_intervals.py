"""Points in intervals against plain loops."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terravote.operators import intervals, places

DAY = datetime(2024, 3, 1)
POINTS, HISTORY = "request_id long, catalogue_id string, ts timestamp, name_of string", "catalogue_id string, name string, valid_from timestamp, valid_to timestamp"


def _tables(seed: int, n: int, m: int, span: int):
    r = random.Random(seed)
    at = lambda: DAY + timedelta(seconds=r.randrange(span))
    key = lambda: "hot" if r.random() < 0.6 else r.choice(["a", "b", None])
    points = [(i, key(), at() if r.random() > 0.05 else None, "x") for i in range(n)]
    history = []
    for i in range(m):
        a = at()
        history.append((key(), f"n{i}", a, None if r.random() < 0.2 else a + timedelta(seconds=r.choice([0, 1, 5, span // 50, span, -3]))))
    return points, history


@pytest.mark.parametrize("seed, n, m, span", [(1, 300, 200, 100_000), (2, 300, 5, 50), (3, 200, 400, 1), (4, 5, 100, 3_000_000), (5, 0, 10, 10), (6, 10, 0, 10)])
def test_intervals_match_plain_loops(spark, seed, n, m, span):
    points, history = _tables(seed, n, m, span)
    p, h = spark.createDataFrame(points, POINTS), spark.createDataFrame(history, HISTORY)
    holds = lambda x, y: x[1] is not None and x[1] == y[0] and x[2] is not None and y[2] <= x[2] and (y[3] is None or x[2] < y[3])
    want = Counter((x[0], y[1]) for x in points for y in history if holds(x, y))
    got = places.as_of(p, h)
    assert Counter((r.request_id, r.name) for r in got.collect()) == want
    assert got.columns == [*p.columns, "name", "valid_from", "valid_to"]
    counts = {r.request_id: r.n for r in places.sizes_as_of(p, h).collect()}
    assert counts == {x[0]: sum(holds(x, y) for y in history) for x in points if x[1] is not None and x[2] is not None}


def test_a_hot_key_is_spread_and_pairs_meet_once(spark):
    """The join is an equality on key and block: a hot catalogue's rows go to many partitions, and nothing is crossed."""
    p = spark.range(4000).select(F.col("id").alias("request_id"), F.lit("hot").alias("catalogue_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    h = spark.range(4000).select(F.lit("hot").alias("catalogue_id"), F.col("id").cast("string").alias("name"), F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.timestamp_seconds(F.col("id") * 60 + 300).alias("valid_to"))
    out = intervals.interval_join(p, h, "catalogue_id", "ts", "valid_from", "valid_to")
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.count() == sum(min(i, 4) + 1 for i in range(4000))
