"""Functions against literal expectations."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terravote.functions import geo, stats, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_distances(spark):
    r = one(spark, a=geo.haversine_km(1.3521, 103.8198, 35.6762, 139.6503), b=geo.haversine_km(1.3521, 103.8198, 1.3496, 103.9568), c=geo.haversine_km(3.1390, 101.6869, 3.1073, 101.6067), d=geo.haversine_km(0.0, 0.0, 0.0, 180.0))
    assert r.a == pytest.approx(5311.231194878497) and r.b == pytest.approx(15.23202911859967) and r.c == pytest.approx(9.576884067351477)
    assert r.d == pytest.approx(math.pi * geo.RADIUS_KM)


def test_arcs_rings_and_wrapping(spark):
    r = one(spark, arc=geo.great_circle(0.0, 0.0, 0.0, 90.0), dot=geo.great_circle(1.0, 2.0, 1.0, 2.0), ring=geo.geodesic_circle(10.0, 20.0, 500.0), w=F.array(*(geo.wrap_longitude(F.lit(float(x)), 170.0) for x in (-170, 170, -10, -11, 350, 351))))
    assert len(r.arc) == 65 and r.arc[32].lon == pytest.approx(45) and len(r.dot) == 2 and len(r.ring) == 73
    assert r.ring[0].lat == pytest.approx(r.ring[72].lat)
    assert r.w == [190, 170, -10, 349, 350, -9]


def test_a_key_is_one_function_and_the_catalogue_none(spark):
    """Each Python function of a row of steps has a worker process of its own in every task."""
    from terravote.sources.catalogue import builtin_places

    plan = lambda t: t._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([(" \tSão\x07  PAULO\n",), ("Straße",), ("ﬁn",), (None,)], "n string")
    for key, want in ((text.name_key, ["são paulo", "strasse", "fin", None]), (text.place_name_key, ["são paulo", "strasse", "fin", None])):
        t = names.select(key("n").alias("k"))
        assert plan(t).count("ArrowEvalPython") == 1 and [r.k for r in t.collect()] == want
    built = builtin_places(spark)
    assert "Python" not in plan(built)
    assert built.filter((F.col("name_key") != text.name_key("name")) | (F.col("place_id") != text.place_id(text.name_key("name")))).count() == 0


def test_an_arc_measures_its_length_once(spark):
    """The distance is no part of what is made for each point, and points are those of the formula."""
    ends = (10.0, 20.0, -35.0, 170.0)
    t = spark.createDataFrame([ends], "a double, b double, c double, d double").select(geo.great_circle("a", "b", "c", "d").alias("arc"))
    plan = t._jdf.queryExecution().analyzed().toString()
    assert plan.count("ASIN(") == 1 and plan.count("ATAN2(") == 2
    p, l, q, m = map(math.radians, ends)  # noqa: E741
    d = math.acos(math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(m - l))
    for i, at in enumerate(t.first().arc):
        u, v = math.sin((1 - i / 64) * d), math.sin(i / 64 * d)
        x, y, z = u * math.cos(p) * math.cos(l) + v * math.cos(q) * math.cos(m), u * math.cos(p) * math.sin(l) + v * math.cos(q) * math.sin(m), u * math.sin(p) + v * math.sin(q)
        assert (at.lat, at.lon) == pytest.approx((math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))))


def test_coordinates(spark):
    f = lambda a, b: geo.coordinate_faults(F.lit(a).cast("double"), F.lit(b).cast("double"))
    r = one(spark, a=f(90.0, -180.0), b=f(91.0, 181.0), c=f(float("nan"), float("inf")), d=f(None, None))
    assert r.a == [] and r.d == [] and len(r.b) == 2 and r.c == ["latitude not finite", "longitude not finite"]


def test_intervals_and_tests(spark):
    w = lambda h, n: stats.wilson(F.lit(h), F.lit(n))
    r = one(spark, a=w(45, 48), b=w(48, 48), c=w(0, 48), d=w(0, 0), m=stats.mcnemar_statistic(F.lit(13), F.lit(19)), z=stats.mcnemar_statistic(F.lit(0), F.lit(0)), p=stats.adjusted_precision(F.lit(0.775), F.lit(0.595), 0.05))
    assert (r.a.lo, r.a.hi) == (pytest.approx(0.831646, abs=1e-6), pytest.approx(0.978517, abs=1e-6))
    assert (r.b.lo, r.b.hi) == (pytest.approx(0.9259, abs=1e-6), 1.0) and (r.c.lo, r.c.hi) == (0.0, pytest.approx(0.0741, abs=1e-6)) and (r.d.lo, r.d.hi) == (0, 0)
    assert r.m == pytest.approx(0.78125) and r.z == 0 and r.p == pytest.approx(0.064156, abs=1e-6)
    t = spark.createDataFrame([(0.78125,), (0.0,)], "s double").select(stats.mcnemar_p("s").alias("p")).collect()
    assert t[0].p == pytest.approx(0.376759, abs=1e-6) and t[1].p == 1.0


def test_match_counts(spark):
    cases = [("snowed in london, london-bound", "london", 2), ("new yorker in new york", "new york", 2), ("xlondon", "london", 0), ("aaaa", "aa", 0), ("st. louis st. louis", "st. louis", 2), ("été", "ét", 1), ("a b a b a", "a b a", 1), ("x", "", 0)]
    t = spark.createDataFrame(cases, "t string, k string, n int").select("n", text.match_count("t", "k").alias("m"))
    assert all(r.n == r.m for r in t.collect())


def test_texts_and_slugs(spark):
    t = spark.createDataFrame([("Hello &amp; bye | done http://t.co/abc  end", "los angeles-ca037-us"), (None, "rio de janeiro-21-br")], "t string, s string")
    r = t.select(text.clean_text("t").alias("t"), text.slug_to_name("s").alias("s")).collect()
    assert r[0].t == "Hello & bye done end" and r[1].t is None and [x.s for x in r] == ["Los Angeles", "Rio De Janeiro"]


def test_names(spark):
    t = spark.createDataFrame([("  São\tPaulo ",), ("Tοkyo",), ("Straße\x00",), (None,)], "n string")
    r = t.select(text.name_key("n").alias("k"), text.place_name_key("n").alias("p"), text.mixed_script_words("n").alias("m"), text.disallowed_characters("n").alias("d")).collect()
    assert [x.k for x in r] == ["são paulo", "tοkyo", "strasse", None] and r[1].p == "tokyo" and r[1].m == ["Tοkyo"] and r[0].m == []
    assert len(text.LOOKALIKES[0]) == len(text.LOOKALIKES[1]) == 53


@pytest.mark.parametrize("reply, found", [('{"a": 1}', True), ('x ```json\n{"a": {"b": "}"}}\n``` y', True), ('so: {"a": "\\"}{"} done', True), ("no object", False), ("[1, 2]", False), ("{broken", False), (None, False)])
def test_reply_objects(reply, found):
    assert (text.json_object(reply) is not None) == found


def test_cells_and_confidence(spark):
    t = spark.createDataFrame([(" YES ", "0.7"), ("", "nan"), ("f", "7"), (None, "x"), ("t", "-1"), ("0", "true")], "b string, c string")
    r = t.select(text.boolean_cell("b").alias("b"), text.confidence("c").alias("c")).collect()
    assert [x.b for x in r] == [True, None, False, None, True, False] and [x.c for x in r] == [0.7, None, 1.0, None, 0.0, 1.0]
