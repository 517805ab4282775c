"""Operators on tiny tables with literal expectations."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravote.functions import rounding
from terravote.functions.geo import haversine_km
from terravote.functions.text import match_count
from terravote.operators import automaton, benchmark, celltree, evaluate, exports, fusion, places, reports, rules, scoring, state, toponyms
from terravote.sources import readers
from terravote.sources.catalogue import builtin_places, country_boxes, country_names, roster

NAMES = {"Singapore": (1.3521, 103.8198), "Tampines": (1.3496, 103.9568), "Tokyo": (35.6762, 139.6503), "Kuala Lumpur": (3.1390, 101.6869), "Petaling Jaya": (3.1073, 101.6067)}


def texts(spark, *items):
    return spark.createDataFrame([(str(i), "post", t) for i, t in enumerate(items)], "row_id string, level string, text string")


def predictions(spark, rows):
    """rows: (row_id, engine, ord, level, [(place, score)], state)."""
    full = [(r, e, o, v, l[0][0] if l else None, l[0][1] if l else 0.0, l, 10.0 * o, 0.0, s == "abstain", s == "failed", s == "skipped", None, "") for r, e, o, v, l, s in rows]
    return spark.createDataFrame(full, scoring.PREDICTION)


def test_gazetteer_scores_and_abstains(spark):
    got = toponyms.gazetteer(texts(spark, "Snowed in again here in London", "London and London and Tokyo", "nothing here names a place", "Flew Singapore to Tokyo, Singapore was hot"), builtin_places(spark))
    r = {x.row_id: x for x in got.collect()}
    assert r["0"].city == "London" and not r["0"].abstain
    assert [(x.place, round(x.score, 6)) for x in r["1"].top_k] == [("London", 0.666667), ("Tokyo", 0.333333)]
    assert r["2"].city is None and r["2"].abstain and r["2"].top_k == []
    assert "the text also names Tokyo" in r["3"].evidence


def test_landmarks_weigh_a_quarter(spark):
    p = spark.createDataFrame([(0, "Cieunteung"), (1, "Sintang")], "ord int, name string")
    prof = spark.createDataFrame([("Cieunteung", [], ["Citarum"])], "name string, aliases array<string>, landmarks array<string>")
    r = toponyms.gazetteer(texts(spark, "From Citarum to Sintang"), p, prof).first()
    assert r.city == "Sintang" and r.top_k[1].score == pytest.approx(0.25 / 1.25)


def test_row_and_join_forms_agree(spark):
    names = [r["name"] for r in builtin_places(spark).orderBy("ord").collect()]
    rng = random.Random(4)
    t = texts(spark, *(" ".join(rng.choice([*names, "Londoner", "new yorker", "xx"]) for _ in range(6)) for _ in range(60)))
    a = {r.row_id: r.top_k for r in toponyms.gazetteer(t, builtin_places(spark)).collect()}
    b = {r.row_id: r.top_k for r in toponyms.gazetteer_in_row(t, names).collect()}
    assert a == b


def test_fusion_by_sums_and_by_ranks(spark):
    rows = [("r", "a", 0, "post", [("Tokyo", 9.0), ("Singapore", 0.1)], ""), ("r", "b", 1, "post", [("Singapore", 0.3), ("Tokyo", 0.1)], ""), ("r", "c", 2, "post", [("Singapore", 0.2), ("Tokyo", 0.1)], ""), ("r", "d", 3, "post", [], "abstain"), ("r", "e", 4, "post", [], "failed")]
    w, r = (fusion.fuse(predictions(spark, rows), m).first() for m in ("weighted", "rrf"))
    assert (w.consensus_city, round(w.consensus_confidence, 6), w.engines) == ("Tokyo", 0.938776, ["a", "b", "c"])
    assert (r.consensus_city, round(r.consensus_confidence, 6)) == ("Singapore", 0.501355)
    scaled = [(a, b, c, d, [(p, s / 7) for p, s in l], x) for a, b, c, d, l, x in rows]
    assert fusion.fuse(predictions(spark, scaled), "rrf").first().top_k == r.top_k


def test_ties_go_to_the_roster(spark):
    rows = [("r", "b", 1, "post", [("Tokyo", 0.5)], ""), ("r", "a", 0, "post", [("Singapore", 0.5)], "")]
    p = predictions(spark, rows)
    assert fusion.fuse(p).first().consensus_city == "Singapore"
    assert fusion.best_single(p).first().best_engine == "a"
    assert fusion.vote(p, ["row_id"]).first().consensus == "Singapore"


@pytest.mark.parametrize("post, user, flag, score, km", [("Singapore", "Tokyo", True, 1.0, 5311), ("Singapore", "Tampines", False, 0.0076, 15), ("Tokyo", "Tokyo", False, 0.0, None), ("Singapore", "Nowhere", True, 0.5, None)])
def test_flag(spark, post, user, flag, score, km):
    rows = [("r", "p", 0, "post", [(post, 0.9)], ""), ("r", "u", 1, "user", [(user, 0.8)], ""), ("r", "x", 2, "user", [], "failed"), ("s", "p", 0, "post", [], "failed")]
    got = {r.row_id: r for r in fusion.verification_flag(predictions(spark, rows), builtin_places(spark)).collect()}
    r = got["r"]
    assert r.flag == flag and r.score == pytest.approx(score, abs=1e-3) and (r.km is None if km is None else int(r.km) == km)
    assert got["s"].note == "no engine returned a prediction" and not got["s"].flag
    if km == 5311:
        assert "5,311 km" in r.note


def test_metrics_of_distance_rank_and_silence(spark):
    rows = spark.createDataFrame([("1", "ok", "Kuala Lumpur", None, None), ("2", "ok", "Kuala Lumpur", None, None)], "row_id string, status string, truth_post string, truth_user string, bucket string")
    def m(*preds):
        return evaluate.engine_metrics(evaluate.scored(predictions(spark, list(preds)), rows, builtin_places(spark))).first()
    a = m(("1", "e", 0, "post", [("Petaling Jaya", 1.0)], ""), ("2", "e", 0, "post", [("Tokyo", 1.0)], ""))
    assert (a.acc_at_1, a.acc_161, a.n_geo) == (0, 0.5, 2) and (a.acc_at_5, a.acc_at_5_compat) == (0, 1)
    b = m(("1", "e", 0, "post", [("Nowhere", 1.0)], ""))
    assert (b.acc_161, b.n_geo) == (0, 1)
    c = m(("1", "e", 0, "post", [], "abstain"), ("2", "e", 0, "post", [], "abstain"))
    assert (c.n, c.n_abstained, c.n_geo, c.n_rank_found) == (2, 2, 0, 0) and c.mean_rank > 1000
    d = m(("1", "e", 0, "post", [("kuala lumpur", 1.0)], ""), ("2", "e", 0, "post", [], "failed"))
    assert (d.n, d.acc_at_1) == (1, 1.0)


def test_confusion_table(spark):
    flags = spark.createDataFrame([("1", True, "x"), ("2", False, "x"), ("3", True, None), ("4", False, "x")], "row_id string, flag boolean, user_city string")
    rows = spark.createDataFrame([(str(i), "ok", "Tokyo", None, i <= 2) for i in (1, 2, 3, 4)], "row_id string, status string, truth_post string, truth_user string, should_disagree boolean")
    r = evaluate.flag_confusion(flags, rows).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.n_with_timeline) == (1, 1, 1, 1, 0.5, 0.5, 3)


def test_buckets(spark):
    t = spark.createDataFrame([("hard-sem-3", None), ("sg-explicit-1", ""), ("x", "given"), ("12", None), ("", None)], "row_id string, bucket string")
    assert [r[0] for r in t.select(evaluate.bucket()).collect()] == ["hard-sem", "sg-explicit", "given", "12", "other"]


def test_replies(spark):
    t = spark.createDataFrame([("1", '{"top_k": [["LONDON", "0.4"], ["Nowhere", 0.9], ["Tokyo", 7], ["Paris"], ["Seoul", 0.1], ["Dublin", 0.1]]}'), ("2", "sorry"), ("3", '{"top_k": [["Nowhere", 1]]}'), ("4", "{}")], "row_id string, reply string")
    r = {x.row_id: x for x in scoring.reply_predictions(t, builtin_places(spark)).collect()}
    assert [(x.place, x.score) for x in r["1"].top_k] == [("London", 0.4), ("Tokyo", 1.0), ("Seoul", 0.1)]
    assert (r["2"].error_class, r["3"].outcome, r["4"].outcome) == ("ValueError", "no_catalogue_place", "no_catalogue_place")


def test_dispatch_and_status(spark):
    rows = spark.createDataFrame([("1", "p", None, "tokyo", None, None), ("2", None, ["a"], "Atlantis", None, None), ("3", None, None, None, "Tokyo", "bad")], "row_id string, post string, user_posts array<string>, truth_post string, truth_user string, error string")
    e = spark.createDataFrame([(0, "g", "post", False, 1.0), (1, "u", "user", True, 1.0)], "ord int, engine string, level string, third_party boolean, weight double")
    got = {(r.row_id, r.engine): r.skip_reason for r in scoring.dispatch(rows, e, ["g", "u"]).collect()}
    assert got == {("1", "g"): None, ("1", "u"): "no timeline", ("2", "g"): "no post", ("2", "u"): None, ("3", "g"): "no post", ("3", "u"): "no timeline"}
    assert {r.row_id: r.status for r in scoring.row_status(rows, builtin_places(spark)).collect()} == {"1": "ok", "2": "ooc", "3": "error"}


def test_near_places(spark):
    t = spark.createDataFrame([("a", 64.1466, -21.9426), ("b", 1.35, 103.8), ("c", 89.9, 10.0), ("d", 0.0, 180.0), ("e", 0.0, -179.9)], "row_id string, lat double, lon double")
    a = {r.row_id: (r.place, round(r.km, 6)) for r in places.nearest_place(t, builtin_places(spark)).collect()}
    b = {r.row_id: (r.place, round(r.km, 6)) for r in places.nearest_in_cells(t, builtin_places(spark)).collect()}
    assert a == b and a["a"][1] > 50 and a["b"][0] == "Singapore"


def test_nearest_matches_all_pairs(spark):
    """Poles, the date line, dense spots, copies of a place, and a name to leave out; the tree and the blocks."""
    rng = random.Random(9)
    spot = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.choice([-90.0, 89.999, 90.0]), rng.uniform(-180, 180)), (rng.uniform(-5, 5), rng.choice([-180.0, 180.0, 179.9999])), (48.1 + rng.uniform(0, 0.01), 11.5 + rng.uniform(0, 0.01))])
    table = [(i, f"p{i % 180}", *spot()) for i in range(400)] + [(500 + i, "copy", 48.1, 11.5) for i in range(20)] + [(900, "none", None, 1.0)]
    asked = [(f"r{i}", *spot(), f"p{rng.randrange(200)}") for i in range(150)] + [("at", 48.1, 11.5, "copy"), ("null", None, 0.0, "p1")]
    p = spark.createDataFrame(table, "ord int, name string, lat double, lon double").repartition(3)
    q = spark.createDataFrame(asked, "row_id string, lat double, lon double, own string").repartition(4)
    km = {(r.row_id, r.ord): (r.km, r.ord, r.name, r.own) for r in q.join(p.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})).select("row_id", "own", "ord", "name", haversine_km("lat", "lon", "p_lat", "p_lon").alias("km")).filter("km is not null").collect()}
    for exclude in (None, "own"):
        want: dict = {}
        for (row_id, _), (d, o, name, own) in km.items():
            if exclude is None or name != own:
                want[row_id] = min(want.get(row_id, (1e9, 0, "")), (d, o, name))
        for got in (places.nearest_place(q, p, exclude=exclude), places.nearest_in_cells(q, p, exclude=exclude, size=16), places.nearest_in_cells(q, p, exclude=exclude, blocks=8, size=4)):
            assert {r.row_id: (r.km, r.place) for r in got.collect() if r.place} == {k: (d, n) for k, (d, _, n) in want.items()}
            assert got.count() == len(asked) and got.columns == [*q.columns, "place", "km"]
    assert places.nearest_place(q, p.limit(0)).filter("place is not null").count() == 0 == places.nearest_in_cells(q, p.limit(0)).filter("place is not null").count()


def test_a_crowded_spot_is_several_blocks(spark):
    """Places of one lowest cell are dealt to lists of bounded length, copies of a place count once, and points aren't multiplied."""
    rng = random.Random(3)
    spot = lambda: (48.1 + rng.uniform(0, 0.004), 11.5 + rng.uniform(0, 0.004))
    table = [(i, f"p{i}", *spot()) for i in range(600)] + [(1000 + i, f"same{i}", 48.1, 11.5) for i in range(300)] + [(2000, "far", -20.0, 100.0)]
    p = spark.createDataFrame(table, "ord int, name string, lat double, lon double").repartition(3)
    q = spark.createDataFrame([(f"r{i}", *spot()) for i in range(60)] + [("at", 48.1, 11.5), ("off", -21.0, 99.0), ("none", None, 1.0)], "row_id string, lat double, lon double")
    want = {r.row_id: (r.place, r.km) for r in places.nearest_place(q, p).collect()}
    assert {r.row_id: (r.place, r.km) for r in places.nearest_in_cells(q, p, size=16).collect()} == want and want["at"] == ("same0", 0.0) and want["off"][0] == "far"
    sizes = [r["count"] for r in places._blocks(places._located(p.filter("ord < 1000")), 16).groupBy("block").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 40 and len(sizes) >= 30


def test_the_tree_tries_few_places(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (20_000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    who, item = celltree.CellTree(v).nearest(v[:500])
    assert sorted(zip(who.tolist(), item.tolist())) == [(i, i) for i in range(500)]


def test_pairs_by_cells_match_all_pairs(spark):
    rng = random.Random(8)
    pts = [(i, f"p{i}", rng.uniform(-90, 90), rng.choice([-180, 180, 0]) + rng.uniform(-1, 1)) for i in range(300)]
    pts = [(i, n, lat, (lon + 180) % 360 - 180) for i, n, lat, lon in pts]
    t = spark.createDataFrame(pts, "ord int, name string, lat double, lon double")
    from terravote.functions.geo import haversine_km

    every = t.alias("a").join(t.alias("b"), F.col("a.ord") < F.col("b.ord")).withColumn("km", haversine_km("a.lat", "a.lon", "b.lat", "b.lon")).filter("km <= 161")
    want = {(r[0], r[1]) for r in every.select("a.ord", "b.ord").collect()}
    assert {(r.a_ord, r.b_ord) for r in places.pairs_within(t, 161.0).collect()} == want and len(want) > 20


def test_copies_of_a_point_are_not_paired_with_each_other(spark):
    rng = random.Random(5)
    spots = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(30)] + [(0.0, 180.0), (0.0, -180.0), (None, 1.0)]
    t = spark.createDataFrame([(i, f"p{i}", *spots[i * 7 % 33]) for i in range(330)], "ord int, name string, lat double, lon double").repartition(3)
    got = [(r.a_ord, r.a, r.b_ord, r.b, r.km, r.same_point) for r in places.linked_points(t, 161.0).collect()]
    assert sum(r[5] for r in got) == 320 - 32 and len(got) == len(set(got)) < 320 * 3 and all(r[1] == f"p{r[0]}" and r[3] == f"p{r[2]}" for r in got)
    # All pairs of places follow: members of two classes that are linked, and two members of one class.
    members = {a: {a} for a in range(33) if spots[a * 7 % 33][0] is not None}
    for a, _, b, _, _, same in got:
        if same:
            members[a].add(b)
    whole = {(min(x, y), max(x, y)) for a, _, b, _, _, same in got if not same for x in members[a] for y in members[b]}
    whole |= {(x, y) for m in members.values() for x in m for y in m if x < y}
    assert whole == {(r.a_ord, r.b_ord) for r in places.pairs_within(t, 161.0).collect()}


def test_all_members_of_blocks_are_paired(spark, monkeypatch):
    monkeypatch.setattr(places, "MEMBERS", 4)
    rng = random.Random(6)
    spots = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(8)] + [(0.0, 180.0), (0.0, -180.0), (-0.0, 180.0), (89.9, 10.0), (89.9, -170.0), (None, 1.0), (float("nan"), 1.0)]
    rows = [(i, f"p{i}", *(spots[0] if i % 3 == 0 else spots[i % 15])) for i in range(150)] + [(7, "again", *spots[0])]
    t = spark.createDataFrame(rows, "ord int, name string, lat double, lon double").repartition(3)
    km = haversine_km("a.lat", "a.lon", "b.lat", "b.lon")
    every = t.alias("a").join(t.alias("b"), F.col("a.ord") < F.col("b.ord")).withColumn("km", km).filter("km <= 161")
    want = sorted(tuple(r) for r in every.select("a.ord", "a.name", "b.ord", "b.name", F.round("km", 3)).collect())
    got = places.pairs_within(t, 161.0, digits=3)
    assert got.columns == ["a_ord", "a", "b_ord", "b", "km"] and sorted(tuple(r) for r in got.collect()) == want and len(want) > 2000
    bare = places.pairs_within(t.drop("name"), 161.0, digits=3)
    assert bare.columns == ["a_ord", "b_ord", "km"] and sorted(tuple(r) for r in bare.collect()) == sorted((r[0], r[2], r[4]) for r in want)


def test_customers_of_a_point_are_paired_with_each_other_and_all_near(spark, tmp_path):
    """The query's rows are those of its SQL's rule: every two customers, those that share a point (36,000 keys on) as well."""
    import __spark_entry__ as entry

    keys = [k + 36_000 * i for k in range(300) for i in range(3)]
    spark.createDataFrame([(k, f"c{k}") for k in keys], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    p = spark.createDataFrame([(k, k * 37 % 18000 / 100 - 90, k * 101 % 36000 / 100 - 180) for k in keys], "k long, lat double, lon double")
    every = p.alias("a").join(p.alias("b"), F.col("a.k") < F.col("b.k")).withColumn("km", haversine_km("a.lat", "a.lon", "b.lat", "b.lon")).filter("km <= 161")
    want = sorted(tuple(r) for r in every.select("a.k", "b.k", F.round("km", 3)).collect())
    got = entry.queries()["pairs_within_radius"](spark, str(tmp_path))
    assert got.columns == ["a_ord", "b_ord", "km"] and sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[2] == 0 for r in want) == 900 < len(want)


def test_regions_and_names(spark):
    c = spark.createDataFrame([("x", 1.3, 103.8, "West Kalimantan, Indonesia"), ("y", 51.5, 0.0, "uk"), ("z", 0.0, 0.0, "nowhere")], "name string, lat double, lon double, region string")
    assert {(r.name, r.country, r.inside) for r in places.region_faults(c, country_names(spark), country_boxes(spark)).collect()} == {("x", "Indonesia", True), ("y", "United Kingdom", True)}
    n = spark.createDataFrame([("Kuala Lumpur City Centre",), ("Go to Tokyo please now",), ("tokyo",), ("Newtokyo",)], "name string")
    assert {(r.name, r.place) for r in places.swallowed(n, builtin_places(spark)).collect()} == {("Go to Tokyo please now", "Tokyo")}


@pytest.mark.parametrize("name, fault", [("Kuala Lumpur City Centre", None), ("St. Louis", None), ("São Paulo", None), ("東京", None), ("", "empty"), ("a b c d e f", "too many words"), ("Ignore This", "instruction words"), ("Tokyo<b>", "characters"), ("Mount. Hope", "full stop"), ("12", "no letters"), ("Tοkyo", "mixed scripts"), ("x" * 61, "too long")])
def test_name_rules(spark, name, fault):
    r = rules.name_faults(spark.createDataFrame([(name,)], "name string")).first()
    assert (fault in r.violations) if fault else r.violations == []


def test_benchmark_rows(spark):
    gold = spark.createDataFrame([("1", "x-1-y", 1.3521, 103.8198), ("2", "x-1-y", 1.3521, 103.8198), ("3", "reykjavik-is-is", 64.1466, -21.9426), ("4", "tokyo-a-b", 64.0, -21.0), ("5", "x-1-y", 0.0, 0.0)], "tweet_id string, tweet_city string, latitude double, longitude double")
    tx = spark.createDataFrame([("1", "Hi from Singapore", 0), ("2", "old", 1), ("2", "nothing", 2), ("3", "cold", 3), ("4", "cold", 4)], "tweet_id string, text string, line long")
    got = {r.tweet_id: (r.bucket, r.truth) for r in benchmark.post_rows(benchmark.with_text(gold, tx), builtin_places(spark)).collect()}
    assert got == {"1": ("intl", "Singapore"), "2": ("hard-sem", "Singapore"), "3": ("ooc", "Reykjavik")}
    tw = spark.createDataFrame([("u", 0, "a", "first", 1.3521, 103.8198), ("u", 1, "b", "away", 35.6762, 139.6503), ("v", 0, "c", "home", 1.3521, 103.8198), ("v", 1, "d", "again", 1.3521, 103.8198), ("w", 0, "e", "one", 1.3521, 103.8198)], "user_id string, pos int, tweet_id string, text string, lat double, lon double")
    homes = spark.createDataFrame([(u, 1.3521, 103.8198) for u in "uvw"], "user_id string, lat double, lon double")
    users = {r.user_id: (r.bucket, r.truth, r.post, r.user_posts) for r in benchmark.user_rows(tw, homes, builtin_places(spark)).collect()}
    assert users == {"u": ("disagree", "Tokyo", "away", ["first"]), "v": ("userhome", "Singapore", "home", ["again"])}


def test_posts_take_one_python_stage_at_a_time(spark):
    """Cleaning, the nearest place and the matching of terms each read a table, and none runs twice."""
    gold = spark.createDataFrame([("1", "x-1-y", 1.3521, 103.8198)], "tweet_id string, tweet_city string, latitude double, longitude double")
    t = benchmark.post_rows(benchmark.with_text(gold, spark.createDataFrame([("1", "Hi &amp; bye from Singapore", 0)], "tweet_id string, text string, line long")), builtin_places(spark))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "unescape_html" not in plan
    assert [(r.post, r.truth, r.bucket) for r in t.collect()] == [("Hi & bye from Singapore", "Singapore", "intl")]


def test_encoders_get_bounded_batches(spark):
    sizes = [5] * 2500 + [3_000_000, 7] + [100_000] * 60
    t = spark.createDataFrame([(i, None if i % 50 == 9 else "é" + "x" * (n - 2)) for i, n in enumerate(sizes)], "k int, text string").coalesce(1)
    told = lambda batch: [[len(batch), sum(len(x.encode()) for x in batch), len(x)] for x in batch]
    got = {r.k: r.vector for r in scoring.embed(t, told).select("k", "vector").collect()}
    assert len(got) == len(sizes) and all((v is None) == (k % 50 == 9) for k, v in got.items())
    some = [v for v in got.values() if v]
    assert max(v[0] for v in some) <= 1024 and all(v[1] <= 2**21 or v[0] == 1 for v in some) and len({tuple(v[:2]) for v in some}) > 5
    assert all(v is None or v[2] == sizes[k] - 1 for k, v in got.items())
    assert scoring.embed(t.limit(9), told, keep=["k"]).columns == ["k", "vector"] and scoring.embed(t.limit(0), told).columns == ["k", "text", "vector"]


def test_the_pool_takes_one_python_stage_at_a_time(spark, tmp_path):
    from terravote.plans import reporting

    spark.range(20).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    turns = [(c, i, "user", f"turn {i}") for c in range(6) for i in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    t = reporting.benchmark_pool(spark, str(tmp_path))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    # Of the posts the nearest place and the terms, each over a written table; of the accounts their homes and tweets are written.
    assert plan.count("MapInArrow") <= 3 and "unescape_html" not in plan and "_name_key" not in plan and "_nfc" not in plan
    assert sum(r.n for r in t.collect()) == 26


def test_fixed_rows_are_part_of_the_plan(spark):
    """Neither the catalogue nor the tables beside it are made by Python workers: those would stay beside a query's own."""
    from terravote.sources.catalogue import PLACES, prices

    p = builtin_places(spark)
    for t in (p, country_boxes(spark), country_names(spark), prices(spark), roster(spark, [("a", "post", False, 1.0)]), roster(spark, [])):
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("LocalRelation") and all(f.nullable for f in t.schema)
    assert [(r.ord, r.name, r.lat, r.lon, r.feature_type) for r in p.orderBy("ord").collect()] == [(i, *x) for i, x in enumerate(PLACES)]
    assert [tuple(r) for r in roster(spark, [("a", "post", False, 1.0), ("b", "user", True, 0.5)]).orderBy("ord").collect()] == [(0, "a", "post", False, 1.0), (1, "b", "user", True, 0.5)]
    assert roster(spark, []).count() == 0 and dict(p.dtypes)["ord"] == "int"


def test_csv_and_json_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,post ,user_posts,ground_truth_city\r\n x1 ,\"two\nlines \"\"q\"\"\",a| |b, Bedok \r\n,p,,\r\n".encode())
    r = rules.clean_inputs(readers.evaluation_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert (r[0].row_id, r[0].post, r[0].user_posts, r[0].truth_post, r[0].error) == ("x1", 'two\nlines "q"', ["a", "b"], "Bedok", None)
    assert r[1].error == "id is missing"
    assert rules.clean_inputs(readers.evaluation_csv(spark, str(tmp_path / "a.csv")), "row_number").collect()[1].row_id == "2"
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "post": "x", "user_posts": ["a", "b"]}]))
    assert readers.batch_json(spark, str(tmp_path / "b.json")).first().user_posts == "a|b"
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "odd": 1}]))
    with pytest.raises(ValueError, match="odd"):
        readers.batch_json(spark, str(tmp_path / "c.json"))
    bad = rules.refuse(rules.clean_inputs(readers.evaluation_csv(spark, str(tmp_path / "a.csv"))), "fail")
    with pytest.raises(Exception, match="id is missing"):
        bad.collect()


def test_exports(spark, tmp_path):
    p = predictions(spark, [("r", "a", 0, "post", [("Tokyo", 0.5)], ""), ("r", "u", 1, "user", [], "skipped")])
    truths = spark.createDataFrame([("r", "tokyo", None)], "row_id string, truth_post string, truth_user string")
    w = exports.wide_export(p, truths, ["a", "u"]).first()
    assert (w.a_place, w.a_scored, w.u_mode, w.u_scored) == ("Tokyo", 1, "skipped", None)
    a, b = (exports.input_fingerprint(truths.unionByName(truths.withColumn("row_id", F.lit("s"))).orderBy(c), ["row_id"]).first()[0] for c in ("row_id", F.desc("row_id")))
    assert a == b


def test_ledgers_and_catalogues():
    led = state.Ledger(2.0, 10.0)
    assert led.offer(0, 2.5, True) == (True, 0, 0) and led.offer(60, 1, True) == (False, 2.5, 2.5) and led.offer(7200, 1, True) == (True, 0, 2.5)
    q = state.Quota(1)
    assert [q.offer(t)[0] for t in (0, 10, 3600)] == [True, False, True]
    c = state.Catalogue(60, 2, frozenset({"B"}))
    assert c.apply("register", "x", 0)[0] == "added" and c.apply("register", "y", 1)[0] == "added"
    assert c.apply("register", "z", 2) == ("added", ["x"]) and c.apply("register", "B", 3)[1] == []
    assert c.apply("register", "y", 4)[0] == "already_present" and c.apply("reset", "B", 5)[0] == "built_in_restored" and c.apply("reset", "q", 6)[0] == "not_present"
    assert [n for n, _ in c.expire(63)] == ["z"] and list(c.added) == ["y"]


def test_rolling_windows_include_their_end(spark):
    t = spark.sql("select * from values (1, 'k', timestamp'2024-01-01 00:00:00', 1.0D), (2, 'k', timestamp'2024-01-01 01:00:00', 1.0D), (3, 'k', timestamp'2024-01-01 01:00:01', -5.0D) as t(call_id, key, ts, usd)")
    r = {x.call_id: (x.hour, x.day, x.reached) for x in state.rolling_spend(t, 2.0, 0).collect()}
    assert r == {1: (1.0, 1.0, None), 2: (2.0, 2.0, "hour"), 3: (1.0, 2.0, None)}


def test_engines_are_known_or_registered(spark):
    r = roster(spark, [("a", "post", False, 1.0), ("b", "user", True, 2.0)])
    assert scoring.known_engines(["b"], r) == ["b"]
    with pytest.raises(ValueError, match="unknown engines: x, y"):
        scoring.known_engines(["a", "x", "y"], r)
    more = scoring.register(r, "c", "post", weight=0.5)
    assert [tuple(x) for x in more.orderBy("ord").collect()][-1] == (2, "c", "post", False, 0.5)
    assert {(d.engine, d.skip_reason) for d in scoring.dispatch(spark.createDataFrame([("r", "text", None)], "row_id string, post string, user_posts array<string>"), more).collect()} >= {("a", None), ("c", None)}
    for name, level in (("a", "post"), ("d", "city")):
        with pytest.raises(ValueError):
            scoring.register(r, name, level)


def test_empty_batches_are_refused(spark):
    t = spark.createDataFrame([("r",)], "row_id string")
    assert rules.not_empty(t).count() == 1
    with pytest.raises(ValueError):
        rules.not_empty(t.limit(0))


def test_rounding_is_half_up_on_what_is_written(spark):
    t = spark.createDataFrame([(0.175,), (0.615,), (0.6139,), (1.0,), (0.0,), (1e-5,), (2.675,)], "x double")
    got = [tuple(r) for r in t.select(rounding.share_text("x"), rounding.half_up("x", 2), rounding.half_up("x", 1), rounding.is_tie("x")).collect()]
    assert got == [(".18", "0.18", "0.2", True), (".62", "0.62", "0.6", True), (".61", "0.61", "0.6", False), ("1.00", "1.00", "1.0", False), (".00", "0.00", "0.0", False), (".00", "0.00", "0.0", False), ("2.68", "2.68", "2.7", True)]


def test_softmax_over_blocks_matches_the_whole_catalogue(spark):
    rng = np.random.default_rng(3)
    q, p = rng.normal(0, 1, (40, 6)), rng.normal(0, 1, (200, 6))
    p[7], p[150], q[3] = p[20], p[20], 0.0  # ties go by catalogue order
    queries = spark.createDataFrame([(f"r{i % 39}", list(map(float, v))) for i, v in enumerate(q)] + [("none", None)], "row_id string, vector array<double>").repartition(3)
    table = spark.createDataFrame([(i, f"p{i}", list(map(float, v))) for i, v in enumerate(p)] + [(999, "none", None)], "place_ord int, place string, vector array<double>").repartition(5)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    logits = 10 * unit(q) @ unit(p).T
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    want = Counter((f"r{i % 39}", tuple((f"p{j}", round(e[i, j], 9)) for j in sorted(range(200), key=lambda j: (-round(logits[i, j], 12), j))[:5])) for i in range(40))
    for block, at_once in ((4096, 512), (50, 7), (10, 3)):
        got = scoring.encoder_topk(queries, table, 5, block, at_once)
        assert Counter((r.row_id, tuple((x.place, round(x.score, 9)) for x in r.top_k)) for r in got.collect()) == want
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_slices_of_terms_find_what_one_automaton_finds(spark):
    p = spark.createDataFrame([(0, "Kuala Lumpur"), (1, "St. Ives"), (2, "New York"), (3, "a-b"), (4, "York"), (5, "York")], "ord int, name string")
    t = texts(spark, "kuala lumpur and St. Ives, st. ives", "NEW YORK a-b xa-by a-b", "nothing", "", None)
    few, many = ({tuple(r) for r in toponyms.matches(t, toponyms.terms(p), n).select("row_id", "level", "place_ord", "term", "hits").collect()} for n in (100, 1))
    assert few == many and len(few) == 6


def test_counts_of_terms_match_a_count_term_by_term(spark):
    """Words at their edges (hyphens, marks and digits beside them), phrases anywhere, none of a term overlapping itself."""
    rng = random.Random(6)
    terms = ["a", "ab", "aa", "a-a", "o'er", "-a", "a-", "aa aa", "a.", "é", "éa", "b é", "straße", "ı", "'"]
    pieces = [*terms, " ", " ", ".", "_", "1", "²", "\u0301", "-", "'", "É", "A", "\u200d", "x", "😀"]
    rows = [(str(i), "post", "".join(rng.choice(pieces) for _ in range(30))) for i in range(300)]
    t, names = spark.createDataFrame(rows, "row_id string, level string, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(r.row_id, r.term): r.n for r in t.join(names).select("row_id", "term", match_count(F.lower("text"), "term").alias("n")).filter("n > 0").collect()}
    for at_once in (3, 1000):
        assert {(r.row_id, r.term): r.hits for r in automaton.term_counts(t, names, at_once).collect()} == want
    inside = automaton.with_counts(t.withColumn("hits", F.lit(1)), sorted(terms)).collect()
    assert {(r.row_id, sorted(terms)[x.i]): x.n for r in inside for x in r.found} == want
    plan = toponyms.matches(t, toponyms.terms(spark.range(20_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("place "), F.col("id").cast("string")).alias("name"))))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_documents_of_a_flag_scored_anew(spark):
    flags = spark.createDataFrame([("a", "X", "Y", True), ("b", "X", None, False), ("c", "X", "X", False)], "row_id string, post_city string, user_city string, flag boolean")
    rows = spark.createDataFrame([("a", "intl", "ok", "X", None, True), ("b", "intl", "ok", "X", None, True), ("c", "ooc", "ok", "X", None, False)], "row_id string, bucket string, status string, truth_post string, truth_user string, should_disagree boolean")
    t = reports.flag_rescore(flags, rows, {"one": ["intl"], "all": ["intl", "ooc"]})
    doc = json.loads(reports.rescore_document(t, "note").first().document)
    assert doc["note"] == "note" and [(x["row_set"], x["n_rows"], x["tp"], x["fn"], x["tn"]) for x in doc["row_sets"]] == [("all", 3, 1, 1, 1), ("one", 2, 1, 1, 0)]


def test_masked_tokens_take_no_part(spark):
    t = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<float>>, m array<int>")
    assert [r.p for r in t.select(scoring.mean_pool("t", "m").alias("p")).collect()] == [[2.0, 3.0], None]


def test_unknown_languages_are_und(spark):
    t = spark.createDataFrame([("der Hund", " "), ("x", None), ("y", "fr")], "text string, lang string")
    tag = lambda c: F.when(F.contains(c, F.lit("der")), "de")
    assert [r.tag for r in reports.language_tag(t, detect=tag, known="lang").collect()] == ["de", "und", "fr"]
    assert {r.tag for r in reports.language_tag(t).collect()} == {"und"}
