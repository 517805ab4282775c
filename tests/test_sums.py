"""Sums that don't depend on the order of rows."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from terravote.functions.exact import exact_avg, exact_sum
from terravote.operators import evaluate


def test_exact_sums_equal_fsum_in_any_partitions(spark):
    r, rows = random.Random(1), []
    for g in range(40):
        for _ in range(r.choice([1, 2, 3, 200])):
            rows.append((g, r.choice([1, -1]) * r.random() * 10 ** r.randint(-9, 12) if g % 2 else r.choice([0.1, -0.1, 1e-9, -3.3, 1e10, -1e10])))
    rows += [(100, 1e16), (100, 1.0), (100, -1e16), (101, 0.0), (103, 2.0**53), (103, 1.0), (103, 2.0**-60), (104, -(2.0**53)), (104, -1.0), (105, 2.0**103), (105, 1.0), (106, 2.0**53), (106, 1.0), (107, 2.0**-40), (107, 2.0**-93), (107, None)]
    want: dict = {}
    for g, x in rows:
        want.setdefault(g, []).extend([x] if x is not None else [])
    for parts in (1, 4, 17):
        t = spark.createDataFrame(rows, "g int, x double").orderBy(F.rand(parts)).repartition(parts)
        got = {a.g: (a.s, a.m) for a in t.groupBy("g").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).collect()}
        assert {g: s for g, (s, _) in got.items()} == {g: math.fsum(v) for g, v in want.items()}
        assert all(m == math.fsum(want[g]) / len(want[g]) for g, (_, m) in got.items())


def test_exact_sums_of_odd_values(spark):
    t = spark.createDataFrame([(1, None), (2, float("inf")), (2, 1.0), (3, float("nan")), (4, 1e300), (4, 1e300)], "g int, x double")
    got = {a.g: a.s for a in t.groupBy("g").agg(exact_sum("x").alias("s")).collect()}
    assert got[1] is None and got[2] == math.inf and math.isnan(got[3]) and got[4] == 2e300
    assert t.limit(0).agg(exact_sum("x").alias("s")).first().s is None


def test_costs_are_the_same_in_any_partitions(spark):
    """Ten calls of 0.00146085 lie on half of the sixth place of the cost per thousand."""
    rows = [("a", 0.00146085 if i < 10 else 0.0) for i in range(1000)] + [("b", 0.0000146085)] * 1000 + [("free", 0.0)] * 5
    seen = set()
    for parts in (1, 4, 17):
        t = evaluate.cost_per_thousand(spark.createDataFrame(rows, "engine string, cost_usd double").orderBy(F.rand(parts)).repartition(parts))
        seen |= {(r.engine, r.n, float(r.t), float(r.p), r.ratio) for r in t.select("engine", "n", F.round("total_usd", 9).alias("t"), F.round("per_1000", 6).alias("p"), "ratio").collect()}
    assert seen == {("a", 1000, 0.0146085, 0.014609, 1.0), ("b", 1000, 0.0146085, 0.014609, 1.0), ("free", 5, 0.0, 0.0, 0.0)}
