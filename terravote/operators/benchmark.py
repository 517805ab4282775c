"""From geotagged records to an evaluation set, and samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.functions.geo import METRO_KM, haversine_km
from terravote.functions.text import clean_text, slug_to_name
from terravote.operators.places import nearest_place
from terravote.operators.toponyms import matches, terms
from terravote.sources.shared import checked, written

INSIDE_KM, TIMELINE = 50.0, 10


def with_text(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """gold joined to its cleaned text by tweet_id; of a repeated id the last text counts; records without text go."""
    last = texts.groupBy("tweet_id").agg(F.max_by("text", "line").alias("text"))
    return gold.join(last, "tweet_id").withColumn("text", clean_text("text")).filter(F.col("text") != "")


def post_rows(records: DataFrame, places: DataFrame) -> DataFrame:
    """(tweet_id, post, truth, bucket, km): intl within 50 km of a place that the text names one of, hard-sem if it names
    none, else ooc with the city of the record's slug, unless that is blank or a catalogue place.

    Records are written first, so that what cleans, what places and what matches them are Python stages of their own: in
    one stage each would hold a worker process for every running task.
    """
    own = written(records.select(F.col("tweet_id").alias("row_id"), "text", "tweet_city", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    near = nearest_place(own, places)
    texts = own.select("row_id", F.lit("post").alias("level"), "text")
    named = matches(texts, terms(places)).select("row_id").distinct().withColumn("named", F.lit(True))
    t = near.join(named, "row_id", "left")
    inside = F.col("km") <= INSIDE_KM
    t = t.withColumn("bucket", F.when(inside & F.col("named"), "intl").when(inside, "hard-sem").otherwise("ooc"))
    t = t.withColumn("truth", F.when(inside, F.col("place")).otherwise(slug_to_name("tweet_city")))
    known = places.select(F.lower("name").alias("__known")).distinct()
    t = t.join(checked(known), F.lower("truth") == F.col("__known"), "left")
    return t.filter(inside | ((F.col("truth") != "") & F.col("__known").isNull())).select(F.col("row_id").alias("tweet_id"), F.col("text").alias("post"), "truth", "bucket", "km")


def user_rows(tweets: DataFrame, homes: DataFrame, places: DataFrame) -> DataFrame:
    """(user_id, post, user_posts, truth, bucket, should_disagree) of accounts with a catalogue home and two tweets.

    tweets: user_id, pos, tweet_id, text, lat, lon; homes: user_id, lat, lon.  The first tweet over 161 km from home and
    within 50 km of another place makes the account ``disagree`` with that place as truth; else ``userhome``.  The timeline
    is the first ten other tweets.
    """
    home = nearest_place(homes.select(F.col("user_id").alias("row_id"), "lat", "lon"), places).filter(F.col("km") <= INSIDE_KM)
    home = home.select(F.col("row_id").alias("user_id"), F.col("place").alias("home"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    t = nearest_place(tweets.withColumn("row_id", F.concat_ws("/", "user_id", F.col("pos").cast("string"))), places).join(home, "user_id")
    away = (haversine_km("lat", "lon", "h_lat", "h_lon") > METRO_KM) & (F.col("km") <= INSIDE_KM) & (F.col("place") != F.col("home"))
    item = F.struct("pos", "tweet_id", "text", "place")
    t = written(t.select("user_id", "home", item.alias("item"), F.coalesce(away, F.lit(False)).alias("away")))
    # An account is its first tweet away and its first eleven: a window that ends at a rank keeps no more of a task's rows.
    odd = t.filter("away").groupBy("user_id").agg(F.min("item").alias("odd"))
    by = Window.partitionBy("user_id").orderBy("item")
    first = t.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TIMELINE + 1)
    users = first.groupBy("user_id", "home").agg(F.array_sort(F.collect_list("item")).alias("tl")).filter(F.size("tl") >= 2).join(odd, "user_id", "left")
    users = users.withColumn("chosen", F.coalesce("odd", F.get("tl", F.lit(0))))
    rest = F.slice(F.filter("tl", lambda x: x["pos"] != F.col("chosen.pos")), 1, TIMELINE)
    differs = F.col("odd").isNotNull()
    return users.select(
        "user_id",
        F.col("chosen.text").alias("post"),
        F.transform(rest, lambda x: x["text"]).alias("user_posts"),
        F.when(differs, F.col("odd.place")).otherwise(F.col("home")).alias("truth"),
        F.when(differs, "disagree").otherwise("userhome").alias("bucket"),
        differs.alias("should_disagree"),
    )


def capped_sample(rows: DataFrame, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each bucket by a seeded hash, named bucket-0000 and on."""
    by = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), key), key)
    t = rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= cap)
    return t.withColumn("id", F.format_string("%s-%04d", "bucket", F.col("r") - 1)).drop("r")


def round_robin(rows: DataFrame, order: str, n: int = 50) -> DataFrame:
    """n rows, one of each bucket by turns.  No bucket gives more than its first n rows, so no task sorts one whole."""
    t = rows.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).filter(F.col("turn") <= n)
    return t.orderBy("turn", "bucket").limit(n)


def manifest_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """(bucket, missing, extra, first_missing, first_extra) of two tables of (bucket, id)."""
    t = want.select("bucket", "id", F.lit(True).alias("w")).join(got.select("bucket", "id", F.lit(True).alias("g")), ["bucket", "id"], "full_outer")
    t = t.withColumn("side", F.when(F.col("g").isNull(), "missing").when(F.col("w").isNull(), "extra"))
    n = t.groupBy("bucket").agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))
    by = Window.partitionBy("bucket", "side").orderBy("id")
    five = t.filter(F.col("side").isNotNull()).withColumn("r", F.row_number().over(by)).filter("r <= 5")
    said = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("id")))), ",").alias(f"first_{side}")
    first = five.groupBy("bucket").agg(said("missing"), said("extra"))
    return n.join(first, "bucket", "left").fillna("", ["first_missing", "first_extra"])


#: The benchmark's buckets in the order of its pool.
POOL = ["intl", "hard-sem", "ooc", "disagree", "userhome"]


def pool(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """The rows of all parts (each with a bucket and whatever of ``columns`` it has), with position, the bucket's place."""
    none = lambda t: {c: F.lit(None).cast("string") for c in columns if c not in t.columns}
    out = None
    for t in parts:
        t = t.withColumns(none(t)).select("bucket", *columns)
        out = t if out is None else out.unionByName(t)
    return out.filter(F.col("bucket").isin(POOL)).withColumn("position", F.array_position(F.array(*map(F.lit, POOL)), F.col("bucket")))
