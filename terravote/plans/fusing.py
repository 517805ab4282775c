"""Queries on fusion, votes and the verification flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravote.operators import fusion
from terravote.plans import corpus as C
from terravote.plans.corpus import sql
from terravote.sources.catalogue import builtin_places

R = lambda c, a=None: F.round(c, 6).alias(a or c)


def _fused(method):
    def query(spark, sf_dir):
        f = C.fused(spark, sf_dir, method)
        return f.select("row_id", "level", F.posexplode("top_k").alias("pos", "e")).select("row_id", "level", (F.col("pos") + 1).alias("rank"), "e.place", R("e.score", "share"))

    return query


def fusion_result(spark, sf_dir):
    f = C.fused(spark, sf_dir)
    return f.select("row_id", "level", "consensus_city", R("consensus_confidence"), F.array_join("engines", ",").alias("engines"), "best_engine", "best_city", R("delta"), "differs")


def best_single(spark, sf_dir):
    return fusion.best_single(C.predictions(spark, sf_dir)).select("row_id", "level", "best_engine", "best_city", R("best_confidence"))


def consensus(spark, sf_dir):
    return fusion.vote(C.predictions(spark, sf_dir), ["row_id", "level"]).select("row_id", "level", "consensus", R("confidence"), "votes", "answered")


def agreement(spark, sf_dir):
    v = fusion.vote(C.predictions(spark, sf_dir), ["row_id"])
    return v.select("row_id", "consensus", R("confidence"), F.round(F.col("votes") / F.col("answered"), 6).alias("agreement"))


def low_agreement(spark, sf_dir):
    return fusion.plurality(C.predictions(spark, sf_dir)).select("row_id", "level", "answered", R("share"), "low")


def flags(spark, sf_dir):
    return fusion.verification_flag(C.predictions(spark, sf_dir), builtin_places(spark))


def verification_flag(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return flags(spark, sf_dir).select("row_id", blank("post_city"), blank("user_city"), F.round("km", 3).alias("km"), R("score"), "flag")


def flag_notes(spark, sf_dir):
    """The sentence of each row, and the votes behind it."""
    return flags(spark, sf_dir).select("row_id", "post_votes", "post_answered", "user_votes", "user_answered", F.coalesce("note", F.lit("")).alias("note"))


LIST = "SELECT row_id, level, rank::INT AS rank, place, round(share, 6) AS share FROM {} WHERE rank<=5"
QUERIES = {
    "fusion_weighted": (_fused("weighted"), sql(LIST.format("weighted"))),
    "fusion_rrf": (_fused("rrf"), sql(LIST.format("rrf"))),
    "fusion_result": (fusion_result, sql("""SELECT w.row_id, w.level, w.place AS consensus_city, round(w.share, 6) AS consensus_confidence, u.engines, b.engine AS best_engine, b.city AS best_city, round(w.share-b.confidence, 6) AS delta, w.place<>b.city AS differs
      FROM weighted w JOIN best b USING (row_id, level) JOIN (SELECT row_id, level, string_agg(engine, ',' ORDER BY eord) AS engines FROM preds WHERE size>0 GROUP BY ALL) u USING (row_id, level) WHERE w.rank=1""")),
    "best_single": (best_single, sql("SELECT row_id, level, engine AS best_engine, city AS best_city, round(confidence, 6) AS best_confidence FROM best")),
    "consensus_vote": (consensus, sql("SELECT row_id, level, city AS consensus, round(confidence, 6) AS confidence, n AS votes, answered::BIGINT AS answered FROM votes WHERE r=1")),
    "agreement": (agreement, sql("SELECT row_id, city AS consensus, round(confidence, 6) AS confidence, round(n/answered::DOUBLE, 6) AS agreement FROM overall WHERE r=1")),
    "low_agreement": (low_agreement, sql("SELECT row_id, level, sum(n)::BIGINT AS answered, round(max(n)/sum(n)::DOUBLE, 6) AS share, sum(n)>=2 AND max(n)/sum(n)::DOUBLE<0.4 AS low FROM votes GROUP BY ALL")),
    "verification_flag": (verification_flag, sql("SELECT row_id, coalesce(post_city, '') AS post_city, coalesce(user_city, '') AS user_city, round(km, 3) AS km, round(CASE WHEN post_city<>user_city THEN least(1, km/2000) ELSE 0 END, 6) AS score, coalesce(km>161, false) AS flag FROM flags")),
    "flag_notes": (flag_notes, sql("""SELECT f.row_id, coalesce(a.n, 0) AS post_votes, coalesce(a.answered, 0)::BIGINT AS post_answered, coalesce(b.n, 0) AS user_votes, coalesce(b.answered, 0)::BIGINT AS user_answered,
      CASE WHEN NOT EXISTS (SELECT 1 FROM preds p WHERE p.row_id=f.row_id AND NOT p.skipped AND NOT p.failed) THEN 'no engine returned a prediction' WHEN km>161 THEN 'the post points to '||post_city||' and the account to '||user_city||', '||format('{:,}', round_even(km, 0)::BIGINT)||' km apart'
      WHEN post_city<>user_city THEN 'the post points to '||post_city||' and the account to '||user_city||', only '||format('{:,}', round_even(km, 0)::BIGINT)||' km apart' ELSE '' END AS note
      FROM flags f LEFT JOIN votes a ON a.row_id=f.row_id AND a.level='post' AND a.r=1 LEFT JOIN votes b ON b.row_id=f.row_id AND b.level='user' AND b.r=1""")),
}
