"""Result tables to their exchange forms, and the manifest of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravote.functions.geo import METRO_KM, haversine_km
from terravote.functions.text import name_key, place_id
from terravote.operators.scoring import mode, usable
from terravote.sources.shared import checked

EVAL_COLUMNS = ["id", "post", "user_posts", "ground_truth_city", "bucket", "should_disagree", "source", "lang"]
MANIFEST_COLUMNS = ["id", "bucket", "ground_truth_city", "should_disagree", "lang", "post_tweet_id", "user_post_ids"]


def cell_text() -> Column:
    """What an export says for a prediction: its place, or why there is none."""
    return (
        F.when(F.col("skipped"), F.concat(F.lit("not run: "), F.coalesce("reason", F.lit(""))))
        .when(F.col("failed"), "call failed")
        .when(F.col("abstain") | F.col("city").isNull(), "no place named")
        .otherwise(F.col("city"))
    )


def long_export(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Adds cell, mode, and scored 1, 0 or null: first answer against the level's truth, whatever the case."""
    t = predictions.join(truths.select("row_id", "truth_post", "truth_user"), "row_id")
    wanted = F.when(F.col("level") == "user", F.coalesce("truth_user", "truth_post")).otherwise(F.col("truth_post"))
    right = F.when(usable() & wanted.isNotNull(), F.coalesce(F.lower("city") == F.lower(wanted), F.lit(False)).cast("int"))
    return t.withColumn("cell", cell_text()).withColumn("mode", mode()).withColumn("scored", right)


def wide_export(predictions: DataFrame, truths: DataFrame, engines: list[str]) -> DataFrame:
    """One row per row_id with the columns <engine>_place, _confidence, _mode and _scored of every engine, in roster order."""
    t = long_export(predictions, truths)
    fields = {"place": "cell", "confidence": "confidence", "mode": "mode", "scored": "scored"}
    each = [F.max(F.when(F.col("engine") == e, F.col(c))).alias(f"{e}_{n}") for e in engines for n, c in fields.items()]
    return t.groupBy("row_id").agg(*each)


# The columns of the row-by-row export, and what follows for each engine in roster order.
RESULT_COLUMNS = """id status bucket catalogue_sha
ground_truth_city ground_truth_place_id ground_truth_lat ground_truth_lon
ground_truth_user_city ground_truth_user_place_id ground_truth_user_lat ground_truth_user_lon
post_fused_city post_fused_conf post_fused_place_id post_fused_lat post_fused_lon post_fused_error_km post_fused_within_161km
user_fused_city user_fused_conf user_fused_place_id user_fused_lat user_fused_lon user_fused_error_km user_fused_within_161km
post_consensus_city user_consensus_city post_consensus_place_id user_consensus_place_id
disagreement_flag disagreement_km disagreement_score""".split()
ENGINE_COLUMNS = ["top1", "mode", "place_id", "lat", "lon", "error_km", "within_161km", "correct"]


def _with_place(t: DataFrame, places: DataFrame, city: str, prefix: str) -> DataFrame:
    """Adds <prefix>_place_id, _lat and _lon of the catalogue's place of that name, null if it has none."""
    at = places.select(F.col("name").alias("__n"), place_id(name_key("name")).alias(f"{prefix}_place_id"), F.col("lat").alias(f"{prefix}_lat"), F.col("lon").alias(f"{prefix}_lon"))
    return t.join(checked(at), F.col(city) == F.col("__n"), "left").drop("__n")


def result_rows(rows: DataFrame, fused: DataFrame, flags: DataFrame, predictions: DataFrame, places: DataFrame, engines: list[str]) -> DataFrame:
    """One row per row of ``rows`` (with status, bucket and truths): RESULT_COLUMNS, then ENGINE_COLUMNS for every engine.

    Errors are distances to the truth of the level, an account's own or else its post's.  What is unknown is null: an engine
    that did not run is neither right nor wrong.
    """
    t = rows.select("row_id", "status", "bucket", F.col("truth_post").alias("ground_truth_city"), F.col("truth_user").alias("ground_truth_user_city"))
    t = t.withColumn("user_truth", F.coalesce("ground_truth_user_city", "ground_truth_city"))
    for level in ("post", "user"):
        own = fused.filter(F.col("level") == level)
        t = t.join(own.select("row_id", F.col("consensus_city").alias(f"{level}_fused_city"), F.round("consensus_confidence", 4).alias(f"{level}_fused_conf")), "row_id", "left")
    said = flags.select("row_id", F.col("post_city").alias("post_consensus_city"), F.col("user_city").alias("user_consensus_city"), F.col("flag").cast("int").alias("disagreement_flag"), F.round("km", 1).alias("disagreement_km"), F.round("score", 3).alias("disagreement_score"))
    t = t.join(said, "row_id", "left")
    for city, prefix in (("ground_truth_city", "ground_truth"), ("ground_truth_user_city", "ground_truth_user"), ("user_truth", "aim"), ("post_fused_city", "post_fused"), ("user_fused_city", "user_fused"), ("post_consensus_city", "post_consensus"), ("user_consensus_city", "user_consensus")):
        t = _with_place(t, places, city, prefix)
    for level, aim in (("post", "ground_truth"), ("user", "aim")):
        km = haversine_km(f"{level}_fused_lat", f"{level}_fused_lon", f"{aim}_lat", f"{aim}_lon")
        t = t.withColumn(f"{level}_fused_error_km", F.round(km, 1)).withColumn(f"{level}_fused_within_161km", (km <= METRO_KM).cast("int"))
    e = long_export(predictions, rows).withColumn("place", F.when(usable() & ~F.col("abstain"), F.col("city")))
    e = e.withColumn("wanted", F.when(F.col("level") == "user", F.coalesce("truth_user", "truth_post")).otherwise(F.col("truth_post")))
    e = _with_place(_with_place(e, places, "place", "p"), places, "wanted", "t")
    km = haversine_km("p_lat", "p_lon", "t_lat", "t_lon")
    e = e.withColumn("km", km).withColumn("error", F.round("km", 1)).withColumn("within", (F.col("km") <= METRO_KM).cast("int"))
    fields = dict(zip(ENGINE_COLUMNS, ["cell", "mode", "p_place_id", "p_lat", "p_lon", "error", "within", "scored"]))
    each = e.groupBy("row_id").agg(*(F.max(F.when(F.col("engine") == n, F.col(c))).alias(f"{n}_{k}") for n in engines for k, c in fields.items()))
    sha = catalogue_hash(places).select(F.col("catalogue_hash").alias("catalogue_sha"))
    out = t.join(each, "row_id", "left").join(F.broadcast(sha), F.lit(True)).withColumnRenamed("row_id", "id")
    return out.select(*RESULT_COLUMNS, *(f"{n}_{k}" for n in engines for k in ENGINE_COLUMNS))


def catalogue_hash(places: DataFrame) -> DataFrame:
    """One row: twelve hex digits that depend on the set of names alone.  The digest is of all names, so they meet in one
    row: a catalogue of names, some tens of bytes each."""
    names = F.array_join(F.array_sort(F.collect_list(F.lower(F.trim("name")))), "\n")
    return places.agg(F.substring(F.sha2(names, 256), 1, 12).alias("catalogue_hash"), F.count("*").alias("n"))


def row_fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("row_id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256).alias("fingerprint"))


def input_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of all rows whatever their order: exclusive or and sum of 64-bit parts of the rows' digests."""
    part = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long")
    t = row_fingerprints(rows, columns).withColumn("part", part)
    return t.agg(F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor("part"), F.sum(F.col("part").cast("decimal(38,0)"))), 256).alias("input_fingerprint"))


def run_manifest(places: DataFrame, rows: DataFrame, predictions: DataFrame, prices: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row with the run's settings, counts, catalogue detail, hashes, call counts and prices, and the same as JSON."""
    from terravote.operators.evaluate import call_modes, status_counts

    sorted_list = lambda c: F.array_sort(F.collect_list(c))
    names = places.agg(sorted_list(F.when(F.col("source") == "built-in", F.col("name"))).alias("built_in"), sorted_list(F.when(F.col("source") != "built-in", F.col("name"))).alias("onboarded"))
    calls = call_modes(predictions).agg(sorted_list(F.struct("engine", "real", "stub", "failed", "skipped", "observed")).alias("calls"))
    table = prices.agg(sorted_list(F.struct("model", "usd_in", "usd_out", "checked")).alias("prices"))
    out = catalogue_hash(places).withColumn("settings", F.to_json(F.create_map(*(F.lit(x) for kv in sorted(settings.items()) for x in kv))))
    for one_row in (status_counts(rows), names, calls, table, input_fingerprint(rows, ["row_id", "post", "truth_post", "truth_user"])):
        out = out.join(F.broadcast(one_row), F.lit(True))
    return out.withColumn("manifest", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}))


def write_eval_csv(rows: DataFrame, path: str) -> None:
    rows.select(EVAL_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_id_manifest(rows: DataFrame, path: str) -> None:
    """Ids and labels only, no text."""
    rows.select(MANIFEST_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(path)
