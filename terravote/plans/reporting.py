"""Queries on report orders, rounding, the flag scored anew, the benchmark's pool and pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravote.functions import rounding
from terravote.operators import benchmark, exports, fusion, reports, scoring
from terravote.plans import cataloguing, evaluating
from terravote.plans import corpus as C
from terravote.plans.corpus import km_sql, read, sql, wilson_sql
from terravote.sources.catalogue import builtin_places

#: Sets of buckets that the flag is scored on.
ROW_SETS = {"all": ["intl", "hard-sem", "userhome"], "accounts": ["userhome"]}


def report_orders(spark, sf_dir):
    """Engines, buckets and places as the report lists them."""
    engines = reports.ordered(evaluating.engine_metrics(spark, sf_dir), "engines").select(F.lit("engines").alias("report"), "line", F.col("engine").alias("name"))
    buckets = reports.ordered(C.inputs(spark, sf_dir).groupBy("bucket").count(), "buckets").select(F.lit("buckets").alias("report"), "line", F.col("bucket").alias("name"))
    places = reports.ordered(evaluating.corpus_rollup(spark, sf_dir), "places").select(F.lit("places").alias("report"), "line", F.col("city").alias("name"))
    return engines.unionByName(buckets).unionByName(places)


ORDERS_SQL = f"""SELECT 'engines' AS report, row_number() OVER (ORDER BY acc_at_1 DESC, engine)::INT AS line, engine AS name FROM ({evaluating.QUERIES['engine_metrics'][1]})
UNION ALL SELECT 'buckets', row_number() OVER (ORDER BY bucket)::INT, bucket FROM (SELECT DISTINCT bucket FROM ({sql('SELECT bucket FROM inputs')}))
UNION ALL SELECT 'places', row_number() OVER (ORDER BY total DESC, city)::INT, city FROM ({evaluating.QUERIES['corpus_rollup'][1]})"""


def rounded_shares(spark, sf_dir):
    """Shares of two thousand, as a table prints them: many lie just between two hundredths."""
    share = (F.col("p_partkey") % 2001) / 2000
    return read(spark, sf_dir, "part").select("p_partkey", rounding.share_text(share).alias("acc2"), rounding.share_text(share, 3).alias("acc3"), rounding.half_up(share, 2).alias("rate2"), rounding.half_up((F.col("p_partkey") % 2001) / 20, 1).alias("ratio1"), rounding.is_tie(share).alias("tie"))


ROUNDED_SQL = """SELECT p_partkey, CASE WHEN h>=100 THEN '1.'||lpad((h-100)::VARCHAR, 2, '0') ELSE '.'||lpad(h::VARCHAR, 2, '0') END AS acc2, CASE WHEN m>=1000 THEN '1.000' ELSE '.'||lpad(m::VARCHAR, 3, '0') END AS acc3,
  (h//100)||'.'||lpad((h%100)::VARCHAR, 2, '0') AS rate2, (m//10)||'.'||(m%10) AS ratio1, k%20=10 AS tie FROM (SELECT p_partkey, k, (k+10)//20 AS h, (k+1)//2 AS m FROM (SELECT p_partkey, p_partkey%2001 AS k FROM part))"""


def flag_rescore(spark, sf_dir):
    t = reports.flag_rescore(evaluating.flags(spark, sf_dir), C.status(spark, sf_dir), ROW_SETS)
    R = lambda c: F.round(c, 6).alias(c)
    return t.select("row_set", F.array_join("buckets", "|").alias("buckets"), "n_rows", "n_labelled", "positives", "tp", "fp", "fn", "tn", *map(R, ("precision", "precision_lo", "precision_hi", "recall", "recall_lo", "recall_hi")))


_P, _R = wilson_sql("tp", "(tp+fp)"), wilson_sql("tp", "(tp+fn)")
RESCORE_SQL = sql(", sets(row_set, bucket) AS (VALUES " + ", ".join(f"('{n}', '{b}')" for n, bs in ROW_SETS.items() for b in bs) + f"""), c AS (SELECT z.row_set, s.status='ok' AND f.should_disagree IS NOT NULL AS l, f.should_disagree AS g, coalesce(f.km>161, false) AS x FROM sets z JOIN status s USING (bucket) JOIN flags f USING (row_id)),
k AS (SELECT row_set, count(*) AS n_rows, count(*) FILTER (l) AS n_labelled, count(*) FILTER (l AND g) AS positives, count(*) FILTER (l AND g AND x) AS tp, count(*) FILTER (l AND NOT g AND x) AS fp, count(*) FILTER (l AND g AND NOT x) AS fn, count(*) FILTER (l AND NOT g AND NOT x) AS tn FROM c GROUP BY row_set)
SELECT row_set, CASE row_set {' '.join(f"WHEN '{n}' THEN '{'|'.join(bs)}'" for n, bs in ROW_SETS.items())} END AS buckets, n_rows, n_labelled, positives, tp, fp, fn, tn, round(CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp)::DOUBLE END, 6) AS precision, round({_P[0]}, 6) AS precision_lo, round({_P[1]}, 6) AS precision_hi,
  round(CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn)::DOUBLE END, 6) AS recall, round({_R[0]}, 6) AS recall_lo, round({_R[1]}, 6) AS recall_hi FROM k""")


def benchmark_pool(spark, sf_dir):
    """Posts and accounts of all five buckets in one pool, counted."""
    posts, users = cataloguing.benchmark_posts(spark, sf_dir), cataloguing.benchmark_users(spark, sf_dir)
    t = benchmark.pool([posts.select("bucket", "truth", F.col("tweet_id").alias("key")), users.select("bucket", "truth", F.col("user_id").alias("key"))], ["key", "truth"])
    return t.groupBy("position", "bucket").agg(F.count("*").alias("n"), F.countDistinct("truth").alias("truths"), F.min("key").alias("first"))


POOL_SQL = f"""SELECT list_position(['intl','hard-sem','ooc','disagree','userhome'], bucket)::BIGINT AS position, bucket, count(*) AS n, count(DISTINCT truth) AS truths, min(key) AS first
FROM (SELECT bucket, truth, tweet_id AS key FROM ({cataloguing.POSTS_SQL}) UNION ALL SELECT bucket, truth, user_id FROM ({cataloguing.USERS_SQL})) GROUP BY bucket"""


def language_tags(spark, sf_dir):
    """Documents' own language, else a detector's: here one that knows a word of German."""
    d = read(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    t = reports.language_tag(d, detect=lambda c: F.when(F.contains(c, F.lit(" der ")), "de"), known="lang")
    return t.groupBy("tag").agg(F.count("*").alias("n"))


TAGS_SQL = "SELECT coalesce(CASE WHEN doc_id%3<>0 THEN lang END, CASE WHEN contains(text, ' der ') THEN 'de' END, 'und') AS tag, count(*) AS n FROM documents GROUP BY 1"


def pooled_vectors(spark, sf_dir):
    """Vectors of ten as one text's tokens, every third masked: the first and last component of their mean."""
    e = read(spark, sf_dir, "embeddings").withColumn("x", F.struct("vec_id", "embedding"))
    g = e.groupBy(F.expr("vec_id div 10").alias("chunk")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    mask = F.transform("x", lambda x: (x["vec_id"] % 3 != 0).cast("int"))
    g = g.withColumn("m", scoring.mean_pool(F.transform("x", lambda x: x["embedding"]), mask)).filter("m IS NOT NULL")
    return g.select("chunk", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", -1), 6).alias("last"))


POOLED_SQL = "SELECT vec_id//10 AS chunk, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[-1]::DOUBLE), 6) AS last FROM embeddings WHERE vec_id%3<>0 GROUP BY 1"

def result_rows(spark, sf_dir):
    p, places = C.predictions(spark, sf_dir), builtin_places(spark)
    return exports.result_rows(C.status(spark, sf_dir), fusion.fuse(p), fusion.verification_flag(p, places), p, places, [e[0] for e in C.ENGINES])


def _km(a: str, b: str) -> str:
    return km_sql(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


_CELL = {"top1": "cell", "mode": "mode", "place_id": "pid", "lat": "lat", "lon": "lon", "error_km": "round(km, 1)", "within_161km": "(km<=161)::INT", "correct": "scored"}
ROWS_SQL = sql(f""", pl AS (SELECT name, lat::DOUBLE AS lat, lon::DOUBLE AS lon, 'pl_'||substr(sha256(lower(name)), 1, 12) AS pid FROM places), w1 AS (SELECT * FROM weighted WHERE rank=1),
x AS (SELECT p.row_id, p.engine, a.pid, a.lat, a.lon, {_km('a', 't')} AS km, CASE WHEN p.skipped THEN 'not run: '||CASE WHEN p.level='user' THEN 'no timeline' ELSE 'no post' END WHEN p.failed THEN 'call failed' WHEN p.city IS NULL THEN 'no place named' ELSE p.city END AS cell,
  CASE WHEN p.skipped THEN 'skipped' WHEN p.failed THEN 'failed' ELSE 'real' END AS mode, CASE WHEN NOT p.skipped AND NOT p.failed THEN coalesce((lower(p.city)=lower(CASE WHEN p.level='user' THEN coalesce(i.truth_user, i.truth_post) ELSE i.truth_post END))::INT, 0) END AS scored
  FROM preds p JOIN inputs i USING (row_id) LEFT JOIN pl a ON a.name=p.city AND NOT p.skipped AND NOT p.failed LEFT JOIN pl t ON t.name=CASE WHEN p.level='user' THEN coalesce(i.truth_user, i.truth_post) ELSE i.truth_post END WHERE p.engine<>'similarity_post' OR p.skipped OR p.city IS NOT NULL),
e AS (SELECT row_id, {', '.join(f"max(CASE WHEN engine='{n}' THEN {c} END) AS {n}_{k}" for n, *_ in C.ENGINES for k, c in _CELL.items())} FROM x GROUP BY row_id)
SELECT s.row_id AS id, s.status, s.bucket, (SELECT substr(sha256(string_agg(lower(trim(name)), chr(10) ORDER BY lower(trim(name)))), 1, 12) FROM places) AS catalogue_sha,
  s.truth_post AS ground_truth_city, tp.pid AS ground_truth_place_id, tp.lat AS ground_truth_lat, tp.lon AS ground_truth_lon, s.truth_user AS ground_truth_user_city, tu.pid AS ground_truth_user_place_id, tu.lat AS ground_truth_user_lat, tu.lon AS ground_truth_user_lon,
  {', '.join(f"f{v[0]}.place AS {v}_fused_city, round(f{v[0]}.share, 4)::DOUBLE AS {v}_fused_conf, {v[0]}.pid AS {v}_fused_place_id, {v[0]}.lat AS {v}_fused_lat, {v[0]}.lon AS {v}_fused_lon, round({_km(v[0], t)}, 1) AS {v}_fused_error_km, ({_km(v[0], t)}<=161)::INT AS {v}_fused_within_161km" for v, t in (('post', 'tp'), ('user', 'te')))},
  g.post_city AS post_consensus_city, g.user_city AS user_consensus_city, cp.pid AS post_consensus_place_id, cu.pid AS user_consensus_place_id, coalesce(g.km>161, false)::INT AS disagreement_flag, round(g.km, 1) AS disagreement_km,
  round(CASE WHEN g.post_city<>g.user_city THEN least(1, g.km/2000) ELSE 0 END, 3) AS disagreement_score, e.* EXCLUDE (row_id)
FROM status s LEFT JOIN pl tp ON tp.name=s.truth_post LEFT JOIN pl tu ON tu.name=s.truth_user LEFT JOIN pl te ON te.name=coalesce(s.truth_user, s.truth_post)
  LEFT JOIN w1 fp ON fp.row_id=s.row_id AND fp.level='post' LEFT JOIN w1 fu ON fu.row_id=s.row_id AND fu.level='user' LEFT JOIN pl p ON p.name=fp.place LEFT JOIN pl u ON u.name=fu.place
  LEFT JOIN flags g ON g.row_id=s.row_id LEFT JOIN pl cp ON cp.name=g.post_city LEFT JOIN pl cu ON cu.name=g.user_city LEFT JOIN e ON e.row_id=s.row_id""")

QUERIES = {
    "result_rows": (result_rows, ROWS_SQL),
    "report_orders": (report_orders, ORDERS_SQL),
    "rounded_shares": (rounded_shares, ROUNDED_SQL),
    "flag_rescore": (flag_rescore, RESCORE_SQL),
    "benchmark_pool": (benchmark_pool, POOL_SQL),
    "language_tags": (language_tags, TAGS_SQL),
    "pooled_vectors": (pooled_vectors, POOLED_SQL),
}
