"""Features on a map, and one document made of many tasks' rows."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from terravote.operators import fusion, mapping
from terravote.sources import documents
from terravote.sources.catalogue import builtin_places, roster
from tests.test_operators import predictions


def test_features_have_every_key_and_say_why(spark):
    p = predictions(spark, [("r", "a", 0, "post", [("Tokyo", 0.5)], ""), ("r", "gazetteer_post", 1, "post", [], "abstain"), ("r", "u", 2, "user", [], "skipped"), ("r", "v", 3, "user", [], "failed"), ("s", "a", 0, "post", [("Nowhere", 0.5)], "")])
    rows = spark.createDataFrame([("r", "ok", "intl", "tokyo", None, None), ("s", "ok", "intl", "Tokyo", None, None), ("o", "ooc", "intl", "Atlantis", None, None), ("e", "error", None, None, None, "id is missing"), ("n", "ok", "x", None, None, None)], "row_id string, status string, bucket string, truth_post string, truth_user string, error string")
    engines = roster(spark, [("a", "post", False, 1.0), ("gazetteer_post", "post", False, 1.0), ("u", "user", False, 1.0), ("v", "user", True, 1.0)]).withColumn("label", F.upper("engine"))
    t = mapping.map_features(rows, fusion.fuse(p), p, fusion.verification_flag(p, builtin_places(spark)), builtin_places(spark), engines)
    f = {r.feature_id: json.loads(r.feature) for r in t.collect()}
    assert set(f) == {"r:post:a", "r:post:gazetteer_post", "r:post:fused", "r:user:u", "r:user:v", "s:post:a", "s:post:gazetteer_post", "s:post:fused", "o:row:none", "e:row:none", "n:row:none"}
    assert all(list(x["properties"]) == mapping.PROPERTY_KEYS and len(mapping.PROPERTY_KEYS) == 26 and x["type"] == "Feature" and x["id"] == k for k, x in f.items())
    why = {k: x["properties"]["no_coordinate_reason"] for k, x in f.items()}
    assert f["r:post:a"]["geometry"] == {"type": "Point", "coordinates": [139.6503, 35.6762]} and why["r:post:a"] is None
    assert why["r:post:gazetteer_post"] == mapping.NO_PLACE and why["r:user:u"] == mapping.NOT_RUN + mapping.NOTHING_TO_READ and why["r:user:v"] == mapping.CALL_FAILED + mapping.UNKNOWN_ERROR
    assert why["s:post:a"] == "Nowhere" + mapping.NO_COORDINATE and why["s:post:gazetteer_post"] == mapping.NOT_THERE
    assert (why["o:row:none"], why["e:row:none"], why["n:row:none"]) == (mapping.OUT_OF_SCOPE, "id is missing", mapping.NO_PREDICTION)
    assert f["r:post:a"]["properties"]["engine_label"] == "A" and f["r:post:fused"]["properties"]["engine_mode"] == "fused" and f["r:post:a"]["properties"]["names_a_catalogue_place"] is False
    assert f["o:row:none"]["properties"]["level"] is None and f["o:row:none"]["properties"]["is_fused"] is False


def test_one_document_of_many_tasks(spark, tmp_path):
    documents.register(spark)
    path = str(tmp_path / "map.geojson")
    t = spark.range(1000).select(F.to_json(F.struct("id", F.lit("é\n\"x\"").alias("name"))).alias("feature")).repartition(7)
    t.write.format("feature_collection").mode("append").save(path)
    doc = json.load(open(path, encoding="utf-8"))
    assert doc["type"] == "FeatureCollection" and sorted(f["id"] for f in doc["features"]) == list(range(1000)) and doc["features"][0]["name"] == 'é\n"x"'
    assert os.listdir(tmp_path) == ["map.geojson"]
    for split in (1, 100, 5000, 1 << 25):
        back = spark.read.format("feature_collection").option("split", split if split > 1 else 37).load(path)
        assert sorted(json.loads(r.feature)["id"] for r in back.collect()) == list(range(1000))
    with pytest.raises(Exception, match="map.geojson"):
        t.write.format("feature_collection").mode("append").save(path)
    t.limit(0).write.format("feature_collection").mode("overwrite").save(path)
    assert json.load(open(path)) == {"type": "FeatureCollection", "features": []} and spark.read.format("feature_collection").load(path).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    documents.register(spark)
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit("{}")).alias("feature")).repartition(5)
    with pytest.raises(Exception):
        bad.write.format("feature_collection").mode("append").save(str(tmp_path / "bad.geojson"))
    assert os.listdir(tmp_path) == []


def test_a_runs_document(spark):
    manifest = spark.createDataFrame([("abc", 3)], "catalogue_hash string, total int")
    metrics = spark.createDataFrame([("b", 0.5), ("a", None)], "engine string, acc double")
    doc = json.loads(mapping.run_document(manifest, per_engine=metrics, per_level=metrics.limit(0)).first().document)
    assert doc == {"manifest": {"catalogue_hash": "abc", "total": 3}, "summary": {"per_engine": [{"engine": "a", "acc": None}, {"engine": "b", "acc": 0.5}], "per_level": []}}
