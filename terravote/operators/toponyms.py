"""Place names in texts: terms, matches, scores and ranked places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravote.operators.automaton import AT_ONCE, term_counts, with_counts
from terravote.sources.shared import checked

LANDMARK_WEIGHT = 0.25


def terms(places: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(place_ord, place, seq, kind, term, weight): names, then aliases other than the name, then landmarks.

    Not distinct: an alias given twice counts twice.
    """
    named = places.select(F.col("ord").alias("place_ord"), F.col("name").alias("place"), F.lit(0).alias("seq"), F.lit("name").alias("kind"), F.col("name").alias("raw"))
    if profiles is not None:
        own = places.select("ord", "name").join(profiles.select("name", "aliases", "landmarks"), "name")
        for kind, column, base in (("alias", "aliases", 1), ("landmark", "landmarks", 10_000)):
            each = own.select("ord", "name", F.posexplode(column).alias("at", "raw")).filter(F.trim("raw") != "")
            if kind == "alias":
                each = each.filter(F.col("raw") != F.col("name"))
            named = named.unionByName(each.select(F.col("ord").alias("place_ord"), F.col("name").alias("place"), (F.col("at") + base).alias("seq"), F.lit(kind).alias("kind"), "raw"))
    weight = F.when(F.col("kind") == "landmark", LANDMARK_WEIGHT).otherwise(1.0)
    return named.withColumn("term", F.trim(F.lower("raw"))).filter(F.col("term") != "").withColumn("weight", weight)


def matches(texts: DataFrame, terms: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """texts (row_id, level, text) and terms -> one row per text and matching term, with hits.

    One pass of an automaton of all terms over each text (``automaton``): texts meet no table of terms, however many there
    are; only hits meet it, by an equality join on the term.
    """
    hits = term_counts(texts, terms, at_once)
    return hits.withColumnRenamed("term", "__t").join(checked(terms), F.col("__t") == F.col("term")).drop("__t")


def score_places(matched: DataFrame) -> DataFrame:
    """(row_id, level, place_ord, place, score, share, names, landmarks): share of all places' scores of the text."""
    seen = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("seq", "raw")))), lambda x: x["raw"])
    marks = F.col("kind") == "landmark"
    s = matched.groupBy("row_id", "level", "place_ord", "place").agg(F.sum(F.col("weight") * F.col("hits")).alias("score"), seen(~marks).alias("names"), seen(marks).alias("landmarks"))
    return s.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("row_id", "level")))


def ranked(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best places of each text, ties in catalogue order."""
    by = Window.partitionBy("row_id", "level").orderBy(F.desc("share"), "place_ord")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def gazetteer(texts: DataFrame, places: DataFrame, profiles: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(row_id, level, city, confidence, top_k, abstain, evidence); a text that names no place abstains."""
    best = ranked(score_places(matches(texts, terms(places, profiles))), k)
    item = F.struct("rank", F.col("place"), F.col("share").alias("score"), "names", "landmarks")
    lists = best.groupBy("row_id", "level").agg(F.array_sort(F.collect_list(item)).alias("r"))
    first = F.col("r")[0]
    said = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(F.slice(items, 1, 3), ", ")))
    others = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["place"])
    evidence = F.concat_ws("; ", said("matched: ", first["names"]), said("matched landmark: ", first["landmarks"]), said("the text also names ", others))
    lists = lists.select("row_id", "level", first["place"].alias("city"), first["score"].alias("confidence"), F.transform("r", lambda x: F.struct(x["place"].alias("place"), x["score"].alias("score"))).alias("top_k"), evidence.alias("evidence"))
    out = texts.select("row_id", "level").join(lists, ["row_id", "level"], "left")
    none = F.array().cast("array<struct<place:string,score:double>>")
    return out.withColumn("abstain", F.col("city").isNull()).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("top_k", F.coalesce("top_k", none)).withColumn("evidence", F.coalesce("evidence", F.lit("")))


def gazetteer_in_row(texts: DataFrame, places: list[str], k: int = 5) -> DataFrame:
    """The same ranking inside each row, for streams, by the same matcher: nothing is grouped or joined."""
    low = [p.lower() for p in places]
    terms = sorted(set(low) - {""})
    owners = F.array(*(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("place")) for i, p in enumerate(places) if low[i] == t)) for t in terms))
    each = F.transform("__found", lambda x: F.transform(F.get(owners, x["i"]), lambda p: F.struct((-x["n"]).alias("neg"), p["ord"].alias("ord"), p["place"].alias("place"))))
    out = with_counts(texts, terms, "__found").withColumn("hits", F.array_sort(F.flatten(each)))
    out = out.withColumn("total", F.aggregate("hits", F.lit(0), lambda a, t: a - t["neg"]))
    top = F.transform(F.slice("hits", 1, k), lambda t: F.struct(t["place"].alias("place"), (-t["neg"] / F.col("total")).alias("score")))
    return out.withColumn("top_k", top).withColumn("city", F.get("top_k", F.lit(0))["place"]).withColumn("abstain", F.col("city").isNull()).drop("hits", "total", "__found")


__all__ = ["gazetteer", "gazetteer_in_row", "matches", "ranked", "score_places", "terms"]
