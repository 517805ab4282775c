"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.functions.exact import MONEY, exact_avg, money
from terravote.functions.geo import METRO_KM, haversine_km
from terravote.functions.stats import mcnemar_p, mcnemar_statistic, ratio, wilson
from terravote.operators.order import exact_median
from terravote.operators.scoring import mode, usable
from terravote.sources.shared import checked, written

ABSENT = 1_000_000
MODES = ["real", "stub", "failed", "skipped"]


def bucket(given: str = "bucket", key: str = "row_id") -> Column:
    """The given bucket, else the id before its last number, else the id, else other."""
    blank = F.lit("")
    return F.coalesce(F.nullif(given, blank), F.nullif(F.regexp_extract(key, r"^(.*?)-?\d+$", 1), blank), F.nullif(key, blank), F.lit("other"))


def truth(level: Column | str) -> Column:
    lvl = F.col(level) if isinstance(level, str) else level
    return F.when(lvl == "user", F.coalesce("truth_user", "truth_post")).otherwise(F.col("truth_post"))


def rank_in(top_k: str, wanted: str) -> Column:
    """1-based rank of a place in a list, whatever its case; one more than the list if absent; a million for no list."""
    at = F.array_position(F.transform(top_k, lambda x: F.lower(x["place"])), F.lower(wanted))
    return F.when(F.size(top_k) == 0, ABSENT).when(at > 0, at).otherwise(F.size(top_k) + 1).cast("long")


def _located(rows: DataFrame, coordinates: DataFrame, city: str) -> DataFrame:
    for side, c in (("p", city), ("t", "truth")):
        rows = rows.join(checked(coordinates.select(F.col("name").alias(f"__{side}"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))), F.col(c) == F.col(f"__{side}"), "left").drop(f"__{side}")
    return rows.withColumn("km", haversine_km("p_lat", "p_lon", "t_lat", "t_lon"))


def scored(predictions: DataFrame, rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Usable predictions of evaluated rows with truth, rank, found, km, geo (truth located, not abstained) and bucket.

    rows: row_id, status, truth_post, truth_user, bucket.  Engines that did not run or failed are not scored as misses.
    """
    keep = rows.filter((F.col("status") == "ok") & (F.col("truth_post").isNotNull() | F.col("truth_user").isNotNull()))
    p = predictions.filter(usable()).join(keep.select("row_id", "truth_post", "truth_user", bucket().alias("bucket")), "row_id")
    p = p.withColumn("truth", truth("level")).filter(F.col("truth").isNotNull())
    p = _located(p.withColumn("rank", rank_in("top_k", "truth")), coordinates, "city")
    silent = F.col("abstain") | F.col("city").isNull()
    return p.withColumn("found", F.col("rank") <= F.size("top_k")).withColumn("silent", silent).withColumn("geo", ~silent & F.col("t_lat").isNotNull())


def _metrics() -> list[Column]:
    geo = F.col("geo")
    within = F.coalesce(F.col("km") <= METRO_KM, F.lit(False))
    five, compat = F.count_if(F.col("found") & (F.col("rank") <= 5)), F.count_if(F.col("rank") <= 5)
    n = F.count("*")
    return [
        n.alias("n"),
        F.avg((F.col("rank") == 1).cast("double")).alias("acc_at_1"),
        (five / n).alias("acc_at_5"),
        (compat / n).alias("acc_at_5_compat"),
        wilson(F.count_if(F.col("rank") == 1), n).alias("ci_1"),
        wilson(five, n).alias("ci_5"),
        F.avg("rank").alias("mean_rank"),
        F.coalesce(F.avg(F.when(F.col("found"), F.col("rank"))), F.lit(0.0)).alias("mean_rank_found"),
        F.count_if("found").alias("n_rank_found"),
        F.coalesce(exact_avg(F.when(geo, F.col("km"))), F.lit(0.0)).alias("mean_km"),
        ratio(F.count_if(geo & within), F.count_if(geo)).alias("acc_161"),
        F.count_if(geo).alias("n_geo"),
        F.count_if("silent").alias("n_abstained"),
    ]


def engine_metrics(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, rank, distance, latency and cost of ``scored`` points, per engine or other keys.

    Sums don't depend on the order of the rows, and medians are exact without a group in one task (``order``).
    """
    by, points = by or ["engine"], written(points)
    t = points.groupBy(*by).agg(*_metrics(), F.sum(money("cost_usd")).cast("double").alias("total_cost_usd"))
    return _with_median(_with_median(t, points, by, _placed_km(), "median_km", 0.0), points, by, F.col("latency_ms"), "median_latency_ms")


def _placed_km() -> Column:
    return F.when(F.col("geo"), F.col("km"))


def _with_median(metrics: DataFrame, points: DataFrame, by: list[str], value: Column, name: str, none: float | None = None) -> DataFrame:
    found = exact_median(points, by, value, name).withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)})
    on = [metrics[c].eqNullSafe(found[f"__k{i}"]) for i, c in enumerate(by)]
    t = metrics.join(found, on, "left").drop(*(f"__k{i}" for i in range(len(by))))
    return t if none is None else t.withColumn(name, F.coalesce(name, F.lit(none)))


def fusion_points(fused: DataFrame, rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    as_prediction = fused.withColumns({"city": F.col("consensus_city"), "failed": F.lit(False), "skipped": F.lit(False), "abstain": F.lit(False)})
    return scored(as_prediction, rows, coordinates)


def fusion_metrics(points: DataFrame) -> DataFrame:
    """The same per level of fused results, with the share that differs from the best single engine."""
    points = written(points)
    t = points.groupBy("level").agg(*_metrics(), F.avg(F.col("differs").cast("double")).alias("differs_rate"))
    return _with_median(t, points, ["level"], _placed_km(), "median_km", 0.0)


def bucket_accuracy(points: DataFrame) -> DataFrame:
    return points.groupBy("bucket", "engine").agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("acc_at_1"))


def in_scope(points: DataFrame, scope: DataFrame) -> DataFrame:
    """Points whose (level, bucket) is in the scope table: the fair subset of each level."""
    return points.join(checked(scope.select("level", "bucket").distinct()), ["level", "bucket"], "left_semi")


def flag_confusion(flags: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: labelled rows, those with a timeline, the four counts, precision, recall, false alarms and intervals."""
    keep = rows.filter((F.col("status") == "ok") & (F.col("truth_post").isNotNull() | F.col("truth_user").isNotNull()) & F.col("should_disagree").isNotNull())
    t = flags.join(keep.select("row_id", "should_disagree"), "row_id")
    gold, fired = F.col("should_disagree"), F.col("flag")
    c = t.agg(F.count("*").alias("n_labelled"), F.count_if(F.col("user_city").isNotNull()).alias("n_with_timeline"), F.count_if(gold).alias("positives"), F.count_if(gold & fired).alias("tp"), F.count_if(~gold & fired).alias("fp"), F.count_if(gold & ~fired).alias("fn"), F.count_if(~gold & ~fired).alias("tn"))
    p, r = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return c.withColumns({"precision": ratio("tp", p), "recall": ratio("tp", r), "false_alarms": ratio("fp", F.col("fp") + F.col("tn")), "precision_ci": wilson("tp", p), "recall_ci": wilson("tp", r)})


def paired(points: DataFrame) -> DataFrame:
    """(level, engine_a, engine_b, both, a_only, b_only, n, statistic, p): engines of a level on the rows that both scored."""
    one = points.select("row_id", "level", "ord", "engine", (F.col("rank") == 1).alias("hit"))
    a, b = one.alias("a"), one.alias("b")
    t = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.ord") < F.col("b.ord")))
    x, y = F.col("a.hit"), F.col("b.hit")
    t = t.groupBy(F.col("a.level").alias("level"), F.col("a.engine").alias("engine_a"), F.col("b.engine").alias("engine_b")).agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"))
    return t.withColumn("statistic", mcnemar_statistic("a_only", "b_only")).withColumn("p", mcnemar_p("statistic"))


def named_a_place(predictions: DataFrame, gazetteers: list[str]) -> DataFrame:
    """(row_id, level, named): whether the level's gazetteer named a place; null where it did not run."""
    g = predictions.filter(F.col("engine").isin(gazetteers))
    return g.select("row_id", "level", F.when(usable(), ~F.col("abstain")).alias("named"))


def rollup(answers: DataFrame, named: DataFrame) -> DataFrame:
    """(city, post and user counts, each split by named, unnamed and unknown, total) of (row_id, level, city, seen), most first."""
    t = answers.filter(F.col("city").isNotNull()).join(named, ["row_id", "level"], "left")
    at = lambda level: F.col("level") == level
    part = lambda level: [F.count_if(at(level)).alias(f"{level}_count"), F.count_if(at(level) & F.col("named")).alias(f"{level}_named"), F.count_if(at(level) & ~F.col("named")).alias(f"{level}_unnamed"), F.count_if(at(level) & F.col("named").isNull()).alias(f"{level}_unknown")]
    return t.groupBy("city").agg(*part("post"), *part("user"), F.count("*").alias("total")).orderBy(F.desc("total"), "city")


def placeless(named: DataFrame) -> DataFrame:
    return named.groupBy("level").agg(F.count_if("named").alias("n_named"), F.count_if(~F.col("named")).alias("n_placeless"))


def call_modes(predictions: DataFrame) -> DataFrame:
    """Per engine the number of real, stub, failed and skipped calls, and its one mode, mixed or none."""
    t = predictions.withColumn("mode", mode())
    c = t.groupBy("engine").agg(*(F.count_if(F.col("mode") == m).alias(m) for m in MODES))
    ran = ["real", "stub", "failed"]
    kinds = sum(((F.col(m) > 0).cast("int") for m in ran), F.lit(0))
    single = F.coalesce(*(F.when(F.col(m) > 0, m) for m in ran))
    return c.withColumn("observed", F.when(kinds == 0, "none").when(kinds > 1, "mixed").otherwise(single))


def majority_baseline(rows: DataFrame) -> DataFrame:
    """(bucket, place, share): the most frequent truth of each bucket."""
    c = rows.groupBy("bucket", F.col("truth_post").alias("place")).count()
    by = Window.partitionBy("bucket")
    c = c.withColumn("share", F.col("count") / F.sum("count").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("count"), "place")))
    return c.filter("r = 1").select("bucket", "place", "share")


def cost_per_thousand(costs: DataFrame) -> DataFrame:
    """Per engine: n, total, cost per thousand rows; and its ratio to the cheapest engine that costs anything.

    Amounts are added up as decimal numbers, so no total and no rounding of one depends on the order of the rows.
    """
    t = costs.groupBy("engine").agg(F.count("*").alias("n"), F.coalesce(F.sum(money("cost_usd")), F.lit(0)).cast(MONEY).alias("total_usd"))
    t = t.withColumn("per_1000", (F.col("total_usd") * 1000 / F.col("n").cast("decimal(19,0)")).cast(MONEY))
    return t.withColumn("ratio", (F.col("per_1000") / F.min(F.when(F.col("per_1000") > 0, F.col("per_1000"))).over(Window.partitionBy())).cast("double"))


def status_counts(rows: DataFrame) -> DataFrame:
    at = lambda s: F.count_if(F.col("status") == s)
    some = F.col("truth_post").isNotNull() | F.col("truth_user").isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if((F.col("status") == "ok") & some).alias("evaluated"), at("ooc").alias("ooc"), at("error").alias("error"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison of two metric tables: OK, MISMATCH, or missing from one."""
    t = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    status = F.when(F.col("a").isNull(), "only in b").when(F.col("b").isNull(), "only in a").when(F.abs(F.col("a") - F.col("b")) <= tolerance, "OK").otherwise("MISMATCH")
    return t.withColumn("status", status)
