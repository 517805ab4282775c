"""Declared readers: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT_COLUMNS = ["id", "post", "user_posts", "user_handle", "ground_truth_city", "ground_truth_user_city", "bucket", "tag", "should_disagree"]
PROFILE = "name string, aliases array<string>, landmarks array<string>, foods array<string>, slang array<string>, notes string, lat double, lon double, region string, source string"
TWEET_GOLD = "tweet_id string, tweet_city string, tweet_latitude double, tweet_longitude double"
USER_GOLD = TWEET_GOLD + ", user_id string, user_city string, user_city_latitude double, user_city_longitude double"


def evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as a string, under trimmed headers; a byte order mark, CRLF and quoted newlines are read; missing columns are null."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    t = t.toDF(*(c.replace("﻿", "").strip() for c in t.columns))
    return t.select(*((F.col(f"`{c}`") if c in t.columns else F.lit(None)).cast("string").alias(c) for c in INPUT_COLUMNS))


def batch_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of row objects; a field that is not known ends the read."""
    raw = spark.read.option("multiLine", True).json(path)
    extra = sorted(set(raw.columns) - set(INPUT_COLUMNS) - {"user_posts"})
    if extra:
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    posts = dict(raw.dtypes).get("user_posts", "")
    joined = F.array_join("user_posts", "|") if posts.startswith("array") else F.col("user_posts") if posts else F.lit(None)
    return raw.select(*((joined if c == "user_posts" else F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in INPUT_COLUMNS))


def gold_jsonl(spark: SparkSession, path: str, schema: str = TWEET_GOLD) -> DataFrame:
    """One object per line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def texts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(tweet_id, text, line), where line orders the rows as they are read."""
    return spark.read.schema("tweet_id string, text string").option("mode", "DROPMALFORMED").json(path).withColumn("line", F.monotonically_increasing_id())


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per place; files that don't hold a profile, or whose name is not their place's id, are left out."""
    from terravote.functions.text import name_key, place_id

    t = spark.read.schema(PROFILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("__file"))
    t = t.filter(F.col("name").isNotNull()).withColumn("name_key", name_key("name")).withColumn("place_id", place_id("name_key"))
    return t.filter(F.col("__file") == F.concat("place_id", F.lit(".json"))).drop("__file")


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, ids) of an id manifest."""
    t = spark.read.option("header", True).csv(path)
    return t.groupBy("bucket").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def committed_results(spark: SparkSession, path: str) -> DataFrame:
    """(engine, metric, value) of a results document {"per_engine": {engine: {metric: number}}}."""
    t = spark.read.schema("per_engine map<string,map<string,double>>").option("multiLine", True).json(path)
    return t.select(F.explode("per_engine").alias("engine", "m")).select("engine", F.explode("m").alias("metric", "value"))
