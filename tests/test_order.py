"""Exact medians against plain sorting."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from terravote.operators.order import exact_median


@pytest.mark.parametrize("most, parts", [(1 << 16, 4096), (3, 4), (20, 16)])
def test_medians_match_sorting(spark, most, parts):
    r, rows = random.Random(7), []
    kinds = [lambda: r.random(), lambda: r.choice([1.0, 2.0, 2.0]), lambda: r.gauss(0, 1e150) * 1e150, lambda: 1 + r.randrange(40) * 2**-52, lambda: -r.expovariate(1) ** 9]
    for g in [*range(20), None]:
        for _ in range(r.choice([1, 2, 3, 50, 301])):
            rows.append((g, kinds[(g or 0) % len(kinds)]()))
    rows += [(50, None), (51, float("nan")), (51, 4.0), (52, 1.0), (52, 2.0)]
    want: dict = {}
    for g, x in rows:
        if x is not None and x == x:
            want.setdefault(g, []).append(x)
    t = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = {a.g: a.m for a in exact_median(t, ["g"], F.col("x"), "m", most, parts).collect()}
    middle = lambda v: sorted(v)[(len(v) - 1) // 2] * 0.5 + sorted(v)[len(v) // 2] * 0.5
    assert got == {g: middle(v) for g, v in want.items()}
    assert all(abs(got[g] - statistics.median(v)) <= 1e-12 * abs(got[g]) for g, v in want.items() if abs(got[g]) < 1e300)
    whole = exact_median(t, [], F.col("x"), "m", most, parts).first().m
    assert whole == middle([x for v in want.values() for x in v])
    assert exact_median(t.limit(0), ["g"], F.col("x"), "m").count() == 0
