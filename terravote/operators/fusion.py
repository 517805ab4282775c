"""Fusion of ranked lists, and votes over first answers.

Sums run in roster order and ties go to what came first in the roster, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.functions.geo import DISAGREEMENT_KM, METRO_KM, haversine_km
from terravote.operators.scoring import usable
from terravote.sources.shared import checked

DAMPING = 60


def _ordered_sum(order: list, value: Column) -> Column:
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x["v"])


def entries(predictions: DataFrame) -> DataFrame:
    """One row per usable list entry: row_id, level, engine, ord, pos, place, score."""
    return predictions.filter(usable() & (F.size("top_k") > 0)).select("row_id", "level", "engine", "ord", F.posexplode("top_k").alias("pos", "e")).select("*", "e.place", "e.score").drop("e")


def fused_scores(predictions: DataFrame, method: str = "weighted", weights: DataFrame | None = None) -> DataFrame:
    """(row_id, level, place, score, share, first_ord, first_pos): weighted sums of scores, or of reciprocal ranks."""
    e = entries(predictions)
    if weights is not None:
        e = e.join(checked(weights.select("engine", "weight")), "engine", "left")
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    value = w / (DAMPING + F.col("pos") + 1) if method == "rrf" else w * F.col("score")
    s = e.groupBy("row_id", "level", "place").agg(_ordered_sum(["ord", "pos"], value).alias("score"), F.min(F.struct("ord", "pos")).alias("at"))
    s = s.select("row_id", "level", "place", "score", F.col("at.ord").alias("first_ord"), F.col("at.pos").alias("first_pos"))
    everything = Window.partitionBy("row_id", "level").orderBy("first_ord", "first_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("score").over(everything)
    return s.withColumn("share", F.col("score") / F.when(total == 0, 1.0).otherwise(total))


def _singles(predictions: DataFrame) -> DataFrame:
    """Per row_id and level that has a list: the most confident engine, first in the roster on ties, and all engines."""
    p = predictions.filter(usable() & (F.size("top_k") > 0))
    best = F.min(F.struct((-F.col("confidence")).alias("low"), "ord", "engine", "city", "confidence")).alias("b")
    used = F.transform(F.array_sort(F.collect_list(F.struct("ord", "engine"))), lambda x: x["engine"]).alias("engines")
    t = p.groupBy("row_id", "level").agg(best, used)
    return t.select("row_id", "level", F.col("b.engine").alias("best_engine"), F.col("b.city").alias("best_city"), F.col("b.confidence").alias("best_confidence"), "engines")


def best_single(predictions: DataFrame) -> DataFrame:
    """(row_id, level, best_engine, best_city, best_confidence)."""
    return _singles(predictions).drop("engines")


def fuse(predictions: DataFrame, method: str = "weighted", weights: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row per row_id and level that has a list: consensus_city, consensus_confidence, top_k, engines, best single, delta, differs."""
    order = F.struct((-F.col("share")).alias("low"), "first_ord", "first_pos", "place", F.col("share").alias("score"))
    lists = fused_scores(predictions, method, weights).groupBy("row_id", "level").agg(F.slice(F.array_sort(F.collect_list(order)), 1, max(1, k)).alias("r"))
    lists = lists.select("row_id", "level", F.col("r")[0]["place"].alias("consensus_city"), F.col("r")[0]["score"].alias("consensus_confidence"), F.transform("r", lambda x: F.struct(x["place"].alias("place"), x["score"].alias("score"))).alias("top_k"))
    out = lists.join(_singles(predictions), ["row_id", "level"])
    return out.withColumn("method", F.lit(method)).withColumn("delta", F.col("consensus_confidence") - F.col("best_confidence")).withColumn("differs", F.col("consensus_city") != F.col("best_city"))


def vote(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, consensus, confidence, votes, answered): confidence-weighted vote of the engines that name a place."""
    named = predictions.filter(usable() & F.col("city").isNotNull())
    s = named.groupBy(*keys, "city").agg(_ordered_sum(["ord"], F.col("confidence")).alias("weight"), F.count("*").alias("votes"), F.min("ord").alias("first"))
    every = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("weight").over(every)
    s = s.withColumn("confidence", F.col("weight") / F.when(total == 0, 1.0).otherwise(total)).withColumn("answered", F.sum("votes").over(every)).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "first")))
    return s.filter("r = 1").select(*keys, F.col("city").alias("consensus"), "confidence", "votes", "answered")


def plurality(predictions: DataFrame) -> DataFrame:
    """(row_id, level, answered, share, low): share of the most frequent answer; low under 0.4 with two answers or more."""
    c = predictions.filter(usable() & F.col("city").isNotNull()).groupBy("row_id", "level", "city").count()
    s = c.groupBy("row_id", "level").agg(F.sum("count").alias("answered"), (F.max("count") / F.sum("count")).alias("share"))
    return s.withColumn("low", (F.col("answered") >= 2) & (F.col("share") < 0.4))


def verification_flag(predictions: DataFrame, coordinates: DataFrame, radius_km: float = METRO_KM) -> DataFrame:
    """One row per row_id: consensus, confidence, agreement, each level's consensus and votes, km, score, flag and note.

    coordinates has (name, lat, lon).  The flag is raised where the two levels' places differ and lie more than the radius
    apart, or where a coordinate is missing: then km is null and the score 0.5.
    """
    rows = predictions.groupBy("row_id").agg(F.bool_or(usable()).alias("any_usable"))
    overall = vote(predictions, ["row_id"]).select("row_id", "consensus", "confidence", (F.col("votes") / F.col("answered")).alias("agreement"))
    of = lambda level, c, name: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{level}_{name}")
    levels = vote(predictions, ["row_id", "level"]).groupBy("row_id").agg(*(of(v, c, n) for v in ("post", "user") for c, n in (("consensus", "city"), ("votes", "votes"), ("answered", "answered"))))
    out = rows.join(overall, "row_id", "left").join(levels, "row_id", "left")
    for level in ("post", "user"):
        at = coordinates.select(F.col("name").alias(f"{level}_city"), F.col("lat").alias(f"{level}_lat"), F.col("lon").alias(f"{level}_lon"))
        out = out.join(checked(at), f"{level}_city", "left")
    apart = F.col("post_city") != F.col("user_city")
    km = F.when(apart, haversine_km("post_lat", "post_lon", "user_lat", "user_lon"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pair = F.concat(F.lit("the post points to "), F.col("post_city"), F.lit(" and the account to "), F.col("user_city"))
    note = (
        F.when(~F.col("any_usable"), "no engine returned a prediction")
        .when(apart & F.col("km").isNull(), F.concat(pair, F.lit("; their distance is unknown")))
        .when(F.col("flag"), F.concat(pair, F.format_string(", %,.0f km apart", F.col("km"))))
        .when(apart, F.concat(pair, F.format_string(", only %,.0f km apart", F.col("km"))))
    )
    return (
        out.withColumn("km", km)
        .withColumn("flag", F.coalesce(apart & (F.col("km").isNull() | (F.col("km") > radius_km)), F.lit(False)))
        .withColumn("score", F.when(apart & F.col("km").isNull(), 0.5).when(apart, F.least(F.lit(1.0), F.col("km") / DISAGREEMENT_KM)).otherwise(0.0))
        .withColumn("note", note)
        .select("row_id", "consensus", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), "post_city", "user_city", *(zero(f"{v}_{w}").alias(f"{v}_{w}") for v in ("post", "user") for w in ("votes", "answered")), "km", "score", "flag", "note")
    )
