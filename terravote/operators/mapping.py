"""Results on a map: GeoJSON features, and the documents that hold a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravote.functions.geo import METRO_KM, haversine_km
from terravote.functions.text import name_key, place_id
from terravote.operators.exports import catalogue_hash
from terravote.operators.scoring import mode, usable
from terravote.sources.shared import checked

# The property keys of a feature, and why one has no coordinates.
PROPERTY_KEYS = """row_id level engine engine_label is_fused engine_mode
status bucket catalogue_sha
city place_id lat lon confidence
names_a_catalogue_place
ground_truth_city ground_truth_place_id error_km within_161km
post_consensus_city post_consensus_place_id
user_consensus_city user_consensus_place_id
disagreement_flag disagreement_km
no_coordinate_reason""".split()
NOT_THERE = "this engine is not in the response for this row"
NOT_SELECTED = "this engine was not selected for the run"
NOT_RUN, NOTHING_TO_READ = "this engine was not run: ", "nothing to read"
OFF_CATALOGUE = "the reply named no catalogue place"
CALL_FAILED, UNKNOWN_ERROR = "the call failed: ", "unknown error"
NO_PLACE = "the engine named no place in this text"
OUT_OF_SCOPE = "the row's ground truth is outside the catalogue, so no prediction was made"
NO_PREDICTION = "no prediction for this row"
NO_COORDINATE = " has no coordinate in the catalogue; onboard it with a latitude and longitude to place it"


def _placed(t: DataFrame, places: DataFrame, city: str, prefix: str) -> DataFrame:
    """Adds <prefix>_place_id, _lat and _lon of the catalogue's place of that name."""
    at = places.select(F.col("name").alias("__n"), place_id(name_key("name")).alias(f"{prefix}_place_id"), F.col("lat").alias(f"{prefix}_lat"), F.col("lon").alias(f"{prefix}_lon"))
    return t.join(checked(at), F.col(city) == F.col("__n"), "left").drop("__n")


def _reason(p: DataFrame) -> Column:
    """Why an engine gave no place; null if it gave one."""
    of = lambda c: F.col(c) if c in p.columns else F.lit(None).cast("string")
    skipped = F.when(F.col("reason") == "not selected", NOT_SELECTED).otherwise(F.concat(F.lit(NOT_RUN), F.coalesce("reason", F.lit(NOTHING_TO_READ))))
    return (
        F.when(F.col("failed").isNull(), NOT_THERE)
        .when(F.col("skipped"), skipped)
        .when(of("outcome") == "no_catalogue_place", OFF_CATALOGUE)
        .when(F.col("failed"), F.concat(F.lit(CALL_FAILED), F.coalesce(of("error_class"), F.lit(UNKNOWN_ERROR))))
        .when(F.col("abstain") | F.col("city").isNull(), NO_PLACE)
    )


def map_features(rows: DataFrame, fused: DataFrame, predictions: DataFrame, flags: DataFrame, places: DataFrame, engines: DataFrame) -> DataFrame:
    """(feature_id, feature, and the property keys as columns): one feature per row, level and engine, and the fused lists.

    rows: row_id, status, bucket, truth_post, truth_user, error.  engines: ord, engine, level, and label if there is one.  A
    level of a row has features if it has a fused list or any prediction: one for each engine of the level, and one for the
    fused list.  A row without any has one feature, <row>:row:none.  Every feature has all property keys, nulls written
    out; one that can't be put on the map has a null geometry and says why.
    """
    p = predictions.join(rows.select("row_id"), "row_id", "left_semi")
    there = fused.select("row_id", "level").unionByName(p.select("row_id", "level")).distinct()
    label = F.col("label") if "label" in engines.columns else F.col("engine")
    asked = there.join(checked(engines.select("level", "engine", label.alias("engine_label"))), "level")
    states = [c for c in ("outcome", "error_class") if c in p.columns]
    t = asked.join(p.select("row_id", "engine", "city", "confidence", "abstain", "failed", "skipped", "reason", "note", *states), ["row_id", "engine"], "left")
    reason = _reason(t)
    t = t.withColumn("engine_mode", F.when(F.col("failed").isNotNull(), mode())).withColumn("why", reason)
    t = t.select("row_id", "level", "engine", "engine_label", F.lit(False).alias("is_fused"), "engine_mode", F.when(F.col("why").isNull(), F.col("city")).alias("city"), F.when(F.col("why").isNull(), F.col("confidence")).alias("confidence"), "why")
    f = fused.select("row_id", "level", F.lit("fused").alias("engine"), F.concat("level", F.lit("-level fused prediction")).alias("engine_label"), F.lit(True).alias("is_fused"), F.lit("fused").alias("engine_mode"), F.col("consensus_city").alias("city"), F.col("consensus_confidence").alias("confidence"), F.lit(None).cast("string").alias("why"))
    none = rows.select("row_id").join(there, "row_id", "left_anti")
    each = t.unionByName(f.join(rows.select("row_id"), "row_id", "left_semi")).unionByName(none, allowMissingColumns=True)
    named = predictions.filter(F.col("engine") == F.concat(F.lit("gazetteer_"), F.col("level"))).select("row_id", "level", F.when(usable(), ~F.col("abstain")).alias("names_a_catalogue_place"))
    each = each.join(named, ["row_id", "level"], "left")
    shared = rows.select("row_id", "status", "bucket", "truth_post", "truth_user", "error").join(flags.select("row_id", F.col("post_city").alias("post_consensus_city"), F.col("user_city").alias("user_consensus_city"), F.col("flag").alias("disagreement_flag"), F.round("km", 1).alias("disagreement_km")), "row_id", "left")
    each = each.join(shared, "row_id")
    truth = F.when(F.col("level") == "user", F.coalesce("truth_user", "truth_post")).when(F.col("level") == "post", F.col("truth_post"))
    each = each.withColumn("ground_truth_city", truth)
    for city, prefix in (("city", "p"), ("ground_truth_city", "ground_truth"), ("post_consensus_city", "post_consensus"), ("user_consensus_city", "user_consensus")):
        each = _placed(each, places, city, prefix)
    sha = catalogue_hash(places).select(F.col("catalogue_hash").alias("catalogue_sha"))
    km = haversine_km("p_lat", "p_lon", "ground_truth_lat", "ground_truth_lon")
    gone = F.when(F.col("level").isNull(), F.when(F.col("status") == "ooc", OUT_OF_SCOPE).otherwise(F.coalesce("error", F.lit(NO_PREDICTION)))).when(F.col("p_lat").isNull(), F.coalesce("why", F.concat("city", F.lit(NO_COORDINATE))))
    each = each.join(F.broadcast(sha), F.lit(True)).withColumn("km", km).withColumns({
        "place_id": F.col("p_place_id"), "lat": F.round("p_lat", 4), "lon": F.round("p_lon", 4), "is_fused": F.coalesce("is_fused", F.lit(False)),
        "error_km": F.round("km", 1), "within_161km": F.col("km") <= METRO_KM, "no_coordinate_reason": gone,
    })
    key = F.concat_ws(":", "row_id", F.coalesce("level", F.lit("row")), F.coalesce("engine", F.lit("none")))
    point = F.when(F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), key.alias("id"), point.alias("geometry"), F.struct(*PROPERTY_KEYS).alias("properties")), {"ignoreNullFields": "false"})
    return each.select(key.alias("feature_id"), body.alias("feature"), *PROPERTY_KEYS)


def run_document(manifest: DataFrame, **summary: DataFrame) -> DataFrame:
    """One row (document): a JSON document with the run's manifest (a row's columns) and a list for each table of the summary.

    The tables are results a few rows long: metrics by engine, by level, counts.
    """
    one = manifest.select(F.struct(*manifest.columns).alias("manifest"))
    for name, table in summary.items():
        one = one.join(F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))), F.lit(True))
    return one.select(F.to_json(F.struct("manifest", F.struct(*summary).alias("summary")), {"ignoreNullFields": "false"}).alias("document"))
