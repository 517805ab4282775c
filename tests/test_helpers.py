"""Helpers called from SQL, and the store of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravote.functions import geo, stats, text
from terravote.functions import sql as functions_sql
from terravote.operators import benchmark, scoring


def test_sql_helpers_equal_the_column_functions(spark):
    functions_sql.register(spark)
    functions_sql.register(spark)
    t = spark.createDataFrame([(1, 10.0, 20.0, -30.0, 179.0, 3.0, 7.0, " Köln\t Süd "), (2, 90.0, 0.0, -90.0, 0.0, 0.0, 0.0, "Pаris"), (3, 0.0, 180.0, 0.0, -180.0, 5.0, 5.0, None)], "id int, a double, b double, c double, d double, h double, n double, name string")
    t.createOrReplaceTempView("helper_rows")
    got = spark.sql("SELECT id, haversine_km(a, b, c, d) AS km, wilson_interval(h, n) AS w, name_key(name) AS k, place_name_key(name) AS pk, place_id(name_key(name)) AS p, latency_text(a * 100) AS l, recall_ratio(h, n) AS r FROM helper_rows")
    want = t.select("id", geo.haversine_km("a", "b", "c", "d").alias("km"), stats.wilson("h", "n").alias("w"), text.name_key("name").alias("k"), text.place_name_key("name").alias("pk"), text.place_id(text.name_key("name")).alias("p"), text.latency_text(F.col("a") * 100).alias("l"), stats.ratio("h", "n").alias("r"))
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


def test_filters_pass_the_helpers(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 1.0).alias("lat"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    functions_sql.register(spark)
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("helper_points")
    out = spark.sql("SELECT * FROM (SELECT id, haversine_km(lat, 0, 0, 0) AS km FROM helper_points) WHERE id > 3")
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "unused" not in plan.split("Physical Plan")[1]
    assert out.count() == 6


def test_a_second_run_embeds_nothing(spark, tmp_path):
    path, said = str(tmp_path / "store"), str(tmp_path / "said")

    def encode(batch):
        with open(said, "a") as f:
            f.writelines(f"{t}\n" for t in batch)
        return [[float(len(t)), 1.0] for t in batch]

    t = spark.createDataFrame([(1, "one", 5), (2, "three", 6), (3, "one", 7), (4, None, 8), (5, "", 9)], "id int, text string, vector_of int")
    run = lambda t, *a: {(r.id, None if r.vector is None else tuple(r.vector)) for r in scoring.stored_vectors(t, encode, path, *a).collect()}
    want = {(1, (3.0, 1.0)), (2, (5.0, 1.0)), (3, (3.0, 1.0)), (4, None), (5, (0.0, 1.0))}
    assert run(t, "m") == want and sorted(open(said)) == ["\n", "one\n", "three\n"]
    assert run(t, "m") == want and len(list(open(said))) == 3
    more = t.unionByName(spark.createDataFrame([(6, "new", 1)], t.schema))
    assert run(more, "m") == want | {(6, (3.0, 1.0))} and len(list(open(said))) == 4
    assert run(t, "m", "passage") == want and len(list(open(said))) == 7  # another template is another key
    assert scoring.stored_vectors(t.filter("id = 4"), encode, str(tmp_path / "none"), "m").first().vector is None


def test_a_long_timeline_is_two_bounded_aggregates(spark):
    from terravote.sources.catalogue import builtin_places

    tweets = [("u", i, f"t{i}", f"text {i}", 1.35, 103.8) for i in range(3000)] + [("u", 2500 + 5000, "far", "far away", 35.68, 139.65)] + [("one", 0, "x", "x", 1.35, 103.8)]
    t = spark.createDataFrame(tweets, "user_id string, pos int, tweet_id string, text string, lat double, lon double").repartition(5)
    homes = spark.createDataFrame([("u", 1.35, 103.8), ("one", 1.35, 103.8)], "user_id string, lat double, lon double")
    out = benchmark.user_rows(t, homes, builtin_places(spark))
    r = out.collect()
    assert [(x.user_id, x.post, x.bucket, x.user_posts) for x in r] == [("u", "far away", "disagree", [f"text {i}" for i in range(10)])]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
