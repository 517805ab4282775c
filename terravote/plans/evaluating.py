"""Queries on metrics against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravote.functions.stats import adjusted_precision
from terravote.operators import evaluate, exports, fusion, mapping
from terravote.plans import corpus as C
from terravote.plans.corpus import km_sql, sql, wilson_sql
from terravote.plans.fusing import flags
from terravote.sources.catalogue import builtin_places, prices
from terravote.sources.shared import fixed_rows, written

R = lambda c, a=None: F.round(c, 6).alias(a or c)
GAZETTEERS = ["gazetteer_post", "gazetteer_user"]
SCOPE = [("post", "intl"), ("post", "hard-sem"), ("user", "userhome")]


def points(spark, sf_dir):
    return evaluate.scored(C.predictions(spark, sf_dir), C.status(spark, sf_dir), builtin_places(spark))


def _shown(m):
    whole = ["n", "n_rank_found", "n_geo", "n_abstained"]
    rest = ["acc_at_1", "acc_at_5", "acc_at_5_compat", "mean_rank", "mean_rank_found", "acc_161"]
    return [*whole, *(R(c) for c in rest), F.round("median_km", 3).alias("median_km"), F.round("mean_km", 3).alias("mean_km"), R("ci_1.lo", "lo_1"), R("ci_1.hi", "hi_1")]


LO, HI = wilson_sql("count(*) FILTER (rank=1)", "count(*)")
METRICS = f"""count(*) AS n, count(*) FILTER (found) AS n_rank_found, count(*) FILTER (geo) AS n_geo, count(*) FILTER (silent) AS n_abstained,
  round(avg((rank=1)::INT), 6) AS acc_at_1, round(avg((found AND rank<=5)::INT), 6) AS acc_at_5, round(avg((rank<=5)::INT), 6) AS acc_at_5_compat,
  round(avg(rank), 6) AS mean_rank, round(coalesce(avg(rank) FILTER (found), 0), 6) AS mean_rank_found,
  round(CASE WHEN count(*) FILTER (geo)=0 THEN 0 ELSE count(*) FILTER (geo AND km<=161)/(count(*) FILTER (geo))::DOUBLE END, 6) AS acc_161,
  round(coalesce(median(km) FILTER (geo), 0), 3) AS median_km, round(coalesce(avg(km) FILTER (geo), 0), 3) AS mean_km, round({LO}, 6) AS lo_1, round({HI}, 6) AS hi_1"""


def engine_metrics(spark, sf_dir):
    m = evaluate.engine_metrics(points(spark, sf_dir))
    return m.select("engine", *_shown(m))


def engine_costs(spark, sf_dir):
    m = evaluate.engine_metrics(points(spark, sf_dir))
    return m.select("engine", F.round("median_latency_ms", 3).alias("median_latency_ms"), F.round("total_cost_usd", 9).alias("total_cost_usd"))


def fusion_metrics(spark, sf_dir):
    m = evaluate.fusion_metrics(evaluate.fusion_points(C.fused(spark, sf_dir), C.status(spark, sf_dir), builtin_places(spark)))
    return m.select("level", *_shown(m), R("differs_rate"))


FUSED_SQL = f"""
, fl AS (SELECT row_id, level, place, rank-1 AS pos FROM weighted WHERE rank<=5),
fp AS (SELECT w.row_id, w.level, w.place AS city, n.size, CASE WHEN w.level='user' THEN coalesce(s.truth_user, s.truth_post) ELSE s.truth_post END AS truth, w.place<>b.city AS differs
  FROM weighted w JOIN status s USING (row_id) JOIN best b USING (row_id, level) JOIN (SELECT row_id, level, count(*) AS size FROM fl GROUP BY ALL) n USING (row_id, level) WHERE w.rank=1 AND s.status='ok'),
fr AS (SELECT f.*, h.pos AS hit FROM fp f LEFT JOIN fl h ON h.row_id=f.row_id AND h.level=f.level AND lower(h.place)=lower(f.truth)),
fq AS (SELECT r.*, coalesce(hit+1, size+1) AS rank, hit IS NOT NULL AS found, false AS silent, t.lat IS NOT NULL AS geo, {C.km_sql('c.lat', 'c.lon', 't.lat', 't.lon')} AS km FROM fr r LEFT JOIN places c ON c.name=r.city LEFT JOIN places t ON t.name=r.truth)
SELECT level, {METRICS}, round(avg(differs::INT), 6) AS differs_rate FROM fq GROUP BY level"""


def bucket_accuracy(spark, sf_dir):
    return evaluate.bucket_accuracy(points(spark, sf_dir)).select("bucket", "engine", "n", R("acc_at_1"))


def stratified(spark, sf_dir):
    m = evaluate.engine_metrics(evaluate.in_scope(points(spark, sf_dir), fixed_rows(spark, SCOPE, "level string, bucket string")))
    return m.select("engine", "n", R("acc_at_1"))


def flag_confusion(spark, sf_dir):
    c = evaluate.flag_confusion(flags(spark, sf_dir), C.status(spark, sf_dir))
    return c.select("n_labelled", "n_with_timeline", "positives", "tp", "fp", "fn", "tn", R("precision"), R("recall"), R("false_alarms"), R("recall_ci.lo", "recall_lo"), R("recall_ci.hi", "recall_hi"))


CONFUSION_SQL = """
, c AS (SELECT f.*, coalesce(f.km>161, false) AS fired FROM flags f JOIN status s USING (row_id) WHERE s.status='ok' AND f.should_disagree IS NOT NULL),
k AS (SELECT count(*) AS n_labelled, count(user_city) AS n_with_timeline, count(*) FILTER (should_disagree) AS positives, count(*) FILTER (should_disagree AND fired) AS tp, count(*) FILTER (NOT should_disagree AND fired) AS fp,
  count(*) FILTER (should_disagree AND NOT fired) AS fn, count(*) FILTER (NOT should_disagree AND NOT fired) AS tn FROM c)"""
RLO, RHI = wilson_sql("tp", "(tp+fn)")


def prevalence_precision(spark, sf_dir):
    c = evaluate.flag_confusion(flags(spark, sf_dir), C.status(spark, sf_dir))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("prevalence"), adjusted_precision("recall", "false_alarms", p).alias("precision")) for p in (0.01, 0.05, 0.5)))).alias("x")
    return c.select(each).select("x.prevalence", R("x.precision", "precision"))


def mcnemar(spark, sf_dir):
    return evaluate.paired(points(spark, sf_dir)).select("level", "engine_a", "engine_b", "n", "both", "a_only", "b_only", R("statistic"))


def mcnemar_p(spark, sf_dir):
    return evaluate.paired(points(spark, sf_dir)).select("engine_a", "engine_b", R("p"))


def _named(spark, sf_dir):
    return evaluate.named_a_place(C.predictions(spark, sf_dir), GAZETTEERS)


def corpus_rollup(spark, sf_dir):
    return evaluate.rollup(C.fused(spark, sf_dir).select("row_id", "level", F.col("consensus_city").alias("city")), _named(spark, sf_dir))


def engine_rollup(spark, sf_dir):
    p = C.predictions(spark, sf_dir).filter("engine = 'similarity_post'").select("row_id", "level", "city")
    return evaluate.rollup(p, _named(spark, sf_dir)).select("city", "post_count", "post_named", "post_unnamed", "total")


ROLLUP_SQL = """SELECT city, count(*) FILTER (level='post') AS post_count, count(*) FILTER (level='post' AND nm) AS post_named, count(*) FILTER (level='post' AND NOT nm) AS post_unnamed, count(*) FILTER (level='post' AND nm IS NULL) AS post_unknown,
  count(*) FILTER (level='user') AS user_count, count(*) FILTER (level='user' AND nm) AS user_named, count(*) FILTER (level='user' AND NOT nm) AS user_unnamed, count(*) FILTER (level='user' AND nm IS NULL) AS user_unknown, count(*) AS total
  FROM (SELECT w.place AS city, w.level, CASE WHEN NOT g.skipped THEN NOT g.abstain END AS nm FROM weighted w LEFT JOIN preds g ON g.row_id=w.row_id AND g.level=w.level AND g.engine LIKE 'gazetteer%' WHERE w.rank=1) GROUP BY city"""


def placeless(spark, sf_dir):
    return evaluate.placeless(_named(spark, sf_dir))


def call_modes(spark, sf_dir):
    return evaluate.call_modes(C.predictions(spark, sf_dir))


def majority(spark, sf_dir):
    return evaluate.majority_baseline(C.inputs(spark, sf_dir)).select("bucket", "place", R("share"))


def coverage(spark, sf_dir):
    """Rows of each bucket, those whose truth has coordinates, and of the first 40 rows by id."""
    t = C.inputs(spark, sf_dir).join(F.broadcast(builtin_places(spark).select("name", "lat")), F.col("truth_post") == F.col("name"), "left")
    first = C.inputs(spark, sf_dir).orderBy("conv_id").limit(40).select("row_id", F.lit(True).alias("early"))
    return t.join(first, "row_id", "left").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull()).alias("placed"), F.count_if(F.col("early")).alias("early"))


def status_counts(spark, sf_dir):
    return evaluate.status_counts(C.status(spark, sf_dir))


def cost_per_1000(spark, sf_dir):
    return evaluate.cost_per_thousand(C.predictions(spark, sf_dir)).select("engine", "n", F.round("total_usd", 9).cast("double").alias("total_usd"), F.round("per_1000", 6).cast("double").alias("per_1000"), F.round("ratio", 4).alias("ratio"))


def run_comparison(spark, sf_dir):
    """Weighted against reciprocal rank fusion of the same predictions: first places that agree."""
    p = C.predictions(spark, sf_dir)
    a = fusion.fuse(p, "weighted").select("row_id", "level", F.col("consensus_confidence").alias("v"))
    b = fusion.fuse(p, "rrf").filter("level = 'post'").select("row_id", "level", F.col("consensus_confidence").alias("v"))
    t = evaluate.compare_runs(a, b, ["row_id", "level"], "v", 1e-3)
    return t.groupBy("level", "status").agg(F.count("*").alias("n"))


def engine_reference(spark, sf_dir):
    """Predictions with their engine's measured accuracy, over all rows and over those that name a place or none."""
    p = points(spark, sf_dir).join(_named(spark, sf_dir), ["row_id", "level"], "left")
    hit = (F.col("rank") == 1).cast("double")
    ref = p.groupBy("engine").agg(F.avg(hit).alias("overall"), F.avg(F.when(F.col("named"), hit)).alias("named"), F.avg(F.when(~F.col("named"), hit)).alias("unnamed"))
    q = C.predictions(spark, sf_dir).filter(F.col("city").isNotNull()).select("row_id", "engine", "city")
    return q.join(F.broadcast(ref), "engine").select("row_id", "engine", "city", R("overall"), R("named"), R("unnamed"))


def wide_export(spark, sf_dir):
    names = [e[0] for e in C.ENGINES]
    t = exports.wide_export(C.predictions(spark, sf_dir), C.inputs(spark, sf_dir), names)
    return t.select("row_id", *(c if not c.endswith("confidence") else F.round(c, 6).alias(c) for c in t.columns if c != "row_id"))


WIDE_SQL = "SELECT p.row_id, " + ", ".join(
    f"max(CASE WHEN engine='{e}' THEN cell END) AS {e}_place, round(max(CASE WHEN engine='{e}' THEN confidence END), 6) AS {e}_confidence, max(CASE WHEN engine='{e}' THEN mode END) AS {e}_mode, max(CASE WHEN engine='{e}' THEN scored END)::INT AS {e}_scored" for e, *_ in C.ENGINES
) + """ FROM (SELECT p.row_id, p.engine, p.confidence, CASE WHEN p.skipped THEN 'not run: '||CASE WHEN p.level='user' THEN 'no timeline' ELSE 'no post' END WHEN p.failed THEN 'call failed' WHEN p.city IS NULL THEN 'no place named' ELSE p.city END AS cell,
  CASE WHEN p.skipped THEN 'skipped' WHEN p.failed THEN 'failed' ELSE 'real' END AS mode, CASE WHEN NOT p.skipped AND NOT p.failed THEN coalesce((lower(p.city)=lower(CASE WHEN p.level='user' THEN coalesce(i.truth_user, i.truth_post) ELSE i.truth_post END))::INT, 0) END AS scored
  FROM preds p JOIN inputs i USING (row_id) WHERE p.engine<>'similarity_post' OR p.skipped OR p.city IS NOT NULL) p GROUP BY p.row_id"""


def _features(spark, sf_dir):
    """Features of the rows that are in scope; the others have one that says why there is none."""
    p, rows = C.predictions(spark, sf_dir), C.status(spark, sf_dir)
    p = written(p.join(rows.filter("status = 'ok'").select("row_id"), "row_id", "left_semi"))
    return mapping.map_features(rows, fusion.fuse(p), p, fusion.verification_flag(p, builtin_places(spark)), builtin_places(spark), C.engines(spark))


def geojson(spark, sf_dir):
    return _features(spark, sf_dir).select("feature_id", "feature")


def geojson_properties(spark, sf_dir):
    """The features' properties as they are read back from the text, with the coordinates of the geometry."""
    t = _features(spark, sf_dir)
    kinds = dict(t.dtypes)
    props = ", ".join(f"{k}: {kinds[k]}" for k in mapping.PROPERTY_KEYS)
    j = F.from_json("feature", f"id string, geometry struct<coordinates: array<double>>, properties struct<{props}>").alias("j")
    shown = {"confidence": 6, "error_km": 1, "disagreement_km": 1}
    return t.select(j).select("j.id", *(F.round(f"j.properties.{k}", shown[k]).alias(k) if k in shown else f"j.properties.{k}" for k in mapping.PROPERTY_KEYS), F.get("j.geometry.coordinates", F.lit(0)).alias("x"), F.get("j.geometry.coordinates", F.lit(1)).alias("y"))


_ID = "'pl_'||substr(sha256(lower({0})), 1, 12)"
PROPERTIES_SQL = f""", okp AS (SELECT p.* FROM preds p JOIN status s USING (row_id) WHERE s.status='ok'),
e AS (SELECT p.row_id, p.level, p.engine, p.engine AS engine_label, false AS is_fused, CASE WHEN p.skipped THEN 'skipped' WHEN p.failed THEN 'failed' ELSE 'real' END AS engine_mode, CASE WHEN NOT p.skipped AND NOT p.failed THEN p.city END AS city,
    CASE WHEN NOT p.skipped AND NOT p.failed AND p.city IS NOT NULL THEN p.confidence END AS confidence,
    CASE WHEN p.skipped THEN '{mapping.NOT_RUN}'||CASE WHEN p.level='user' THEN 'no timeline' ELSE 'no post' END WHEN p.failed THEN '{mapping.CALL_FAILED}{mapping.UNKNOWN_ERROR}' WHEN p.city IS NULL THEN '{mapping.NO_PLACE}' END AS why FROM okp p
  UNION ALL SELECT w.row_id, w.level, 'fused', w.level||'-level fused prediction', true, 'fused', w.place, w.share, NULL FROM weighted w JOIN status s USING (row_id) WHERE w.rank=1 AND s.status='ok'
  UNION ALL SELECT row_id, NULL, NULL, NULL, false, NULL, NULL, NULL, CASE WHEN status='ooc' THEN '{mapping.OUT_OF_SCOPE.replace("'", "''")}' ELSE error END FROM status WHERE status<>'ok'),
sha AS (SELECT substr(sha256(string_agg(lower(trim(name)), chr(10) ORDER BY lower(trim(name)))), 1, 12) AS catalogue_sha FROM places),
f AS (SELECT e.row_id||':'||coalesce(e.level, 'row')||':'||coalesce(e.engine, 'none') AS id, e.*, s.status, s.bucket, sha.catalogue_sha, g.named AS names_a_catalogue_place, CASE WHEN e.level='user' THEN coalesce(s.truth_user, s.truth_post) WHEN e.level='post' THEN s.truth_post END AS ground_truth_city,
    CASE WHEN s.status='ok' THEN fl.post_city END AS post_consensus_city, CASE WHEN s.status='ok' THEN fl.user_city END AS user_consensus_city, CASE WHEN s.status='ok' THEN coalesce(fl.km>161, false) END AS disagreement_flag, CASE WHEN s.status='ok' THEN round(fl.km, 1) END AS disagreement_km
  FROM e JOIN status s USING (row_id) CROSS JOIN sha LEFT JOIN flags fl ON fl.row_id=e.row_id LEFT JOIN (SELECT row_id, level, CASE WHEN NOT skipped THEN NOT abstain END AS named FROM okp WHERE engine LIKE 'gazetteer%') g ON g.row_id=e.row_id AND g.level=e.level)
SELECT f.id, f.row_id, f.level, f.engine, f.engine_label, f.is_fused, f.engine_mode, f.status, f.bucket, f.catalogue_sha, f.city, CASE WHEN p.name IS NOT NULL THEN {_ID.format('p.name')} END AS place_id, round(p.lat, 4) AS lat, round(p.lon, 4) AS lon, round(f.confidence, 6) AS confidence, f.names_a_catalogue_place,
  f.ground_truth_city, CASE WHEN t.name IS NOT NULL THEN {_ID.format('t.name')} END AS ground_truth_place_id, round({km_sql('p.lat', 'p.lon', 't.lat', 't.lon')}, 1) AS error_km, {km_sql('p.lat', 'p.lon', 't.lat', 't.lon')}<=161 AS within_161km,
  f.post_consensus_city, CASE WHEN a.name IS NOT NULL THEN {_ID.format('a.name')} END AS post_consensus_place_id, f.user_consensus_city, CASE WHEN b.name IS NOT NULL THEN {_ID.format('b.name')} END AS user_consensus_place_id, f.disagreement_flag, f.disagreement_km,
  CASE WHEN p.lat IS NULL THEN coalesce(f.why, f.city||'{mapping.NO_COORDINATE}') END AS no_coordinate_reason, round(p.lon, 4) AS x, round(p.lat, 4) AS y
FROM f LEFT JOIN places p ON p.name=f.city LEFT JOIN places t ON t.name=f.ground_truth_city LEFT JOIN places a ON a.name=f.post_consensus_city LEFT JOIN places b ON b.name=f.user_consensus_city"""


def manifest(spark, sf_dir):
    return exports.run_manifest(builtin_places(spark), C.status(spark, sf_dir), C.predictions(spark, sf_dir), prices(spark), {"method": "weighted", "k": "5"}).select("catalogue_hash", "total", "evaluated", "ooc", "error", "manifest")


def manifest_counts(spark, sf_dir):
    """The manifest's columns that don't hold text: its catalogue, and the counts of rows and calls read back from the JSON."""
    m = exports.run_manifest(builtin_places(spark), C.status(spark, sf_dir), C.predictions(spark, sf_dir), prices(spark), {"method": "weighted", "k": "5"})
    calls = F.from_json("manifest", "calls array<struct<engine: string, `real`: bigint, failed: bigint, skipped: bigint>>")["calls"]
    t = m.select("catalogue_hash", "n", "total", "evaluated", "ooc", "error", F.explode(calls).alias("c"))
    return t.select("catalogue_hash", "n", "total", "evaluated", "ooc", "error", "c.engine", F.col("c.real").alias("calls"), "c.failed", "c.skipped")


MANIFEST_SQL = """SELECT (SELECT substr(sha256(string_agg(lower(trim(name)), chr(10) ORDER BY lower(trim(name)))), 1, 12) FROM places) AS catalogue_hash, (SELECT count(*) FROM places) AS n, s.*, c.* FROM
  (SELECT count(*) AS total, count(*) FILTER (status='ok') AS evaluated, count(*) FILTER (status='ooc') AS ooc, count(*) FILTER (status='error') AS error FROM status) s,
  (SELECT engine, count(*) FILTER (NOT skipped AND NOT failed) AS calls, count(*) FILTER (failed) AS failed, count(*) FILTER (skipped) AS skipped FROM preds GROUP BY engine) c"""


QUERIES = {
    "engine_metrics": (engine_metrics, sql(f"SELECT engine, {METRICS} FROM located GROUP BY engine")),
    "engine_costs": (engine_costs, sql("""SELECT l.engine, median(CASE WHEN l.engine LIKE 'model%' THEN 500.0+l.conv_id%13*100 ELSE 0 END)::DOUBLE AS median_latency_ms,
      round(coalesce(sum((100+l.conv_id%50)*p.usd_in+(20+l.conv_id%7)*p.usd_out), 0), 9)::DOUBLE AS total_cost_usd FROM located l LEFT JOIN prices p ON p.model=CASE l.engine WHEN 'model_post' THEN 'gpt-4o-mini' WHEN 'model_user' THEN 'claude-haiku-4-5-20251001' END GROUP BY l.engine""")),
    "fusion_metrics": (fusion_metrics, sql(FUSED_SQL)),
    "bucket_accuracy": (bucket_accuracy, sql("SELECT bucket, engine, count(*) AS n, round(avg((rank=1)::INT), 6) AS acc_at_1 FROM located GROUP BY ALL")),
    "stratified_metrics": (stratified, sql("SELECT engine, count(*) AS n, round(avg((rank=1)::INT), 6) AS acc_at_1 FROM located WHERE (level='post' AND bucket IN ('intl','hard-sem')) OR (level='user' AND bucket='userhome') GROUP BY ALL")),
    "flag_confusion": (flag_confusion, sql(CONFUSION_SQL + f""" SELECT n_labelled, n_with_timeline, positives, tp, fp, fn, tn, round(CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn)::DOUBLE END, 6) AS recall,
      round(CASE WHEN fp+tn=0 THEN 0 ELSE fp/(fp+tn)::DOUBLE END, 6) AS false_alarms, round({RLO}, 6) AS recall_lo, round({RHI}, 6) AS recall_hi FROM k""")),
    "prevalence_precision": (prevalence_precision, sql(CONFUSION_SQL + """ SELECT p::DOUBLE AS prevalence, round(CASE WHEN p*r+(1-p)*f=0 THEN 0 ELSE p*r/(p*r+(1-p)*f) END, 6)::DOUBLE AS precision FROM (SELECT CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn)::DOUBLE END AS r, CASE WHEN fp+tn=0 THEN 0 ELSE fp/(fp+tn)::DOUBLE END AS f FROM k), (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.5::DOUBLE)) v(p)""")),
    "mcnemar_pairs": (mcnemar, sql("""SELECT a.level, a.engine AS engine_a, b.engine AS engine_b, count(*) AS n, count(*) FILTER (a.rank=1 AND b.rank=1) AS both, count(*) FILTER (a.rank=1 AND b.rank<>1) AS a_only, count(*) FILTER (a.rank<>1 AND b.rank=1) AS b_only,
      round(CASE WHEN count(*) FILTER ((a.rank=1)<>(b.rank=1))=0 THEN 0 ELSE power(abs(count(*) FILTER (a.rank=1 AND b.rank<>1)-count(*) FILTER (a.rank<>1 AND b.rank=1))-1, 2)/count(*) FILTER ((a.rank=1)<>(b.rank=1))::DOUBLE END, 6) AS statistic
      FROM located a JOIN located b ON a.row_id=b.row_id AND a.level=b.level AND a.eord<b.eord GROUP BY ALL""")),
    "mcnemar_p": (mcnemar_p, None),
    "corpus_rollup": (corpus_rollup, sql(ROLLUP_SQL)),
    "engine_rollup": (engine_rollup, sql("SELECT s.name AS city, count(*) AS post_count, count(*) FILTER (NOT g.abstain) AS post_named, count(*) FILTER (g.abstain) AS post_unnamed, count(*) AS total FROM sims s JOIN preds g ON g.row_id=s.row_id AND g.engine='gazetteer_post' WHERE s.rank=1 AND s.post IS NOT NULL GROUP BY ALL")),
    "placeless_counts": (placeless, sql("SELECT level, count(*) FILTER (NOT skipped AND NOT abstain) AS n_named, count(*) FILTER (abstain) AS n_placeless FROM preds WHERE engine LIKE 'gazetteer%' GROUP BY level")),
    "call_modes": (call_modes, sql("""SELECT engine, count(*) FILTER (NOT skipped AND NOT failed) AS "real", 0::BIGINT AS stub, count(*) FILTER (failed) AS failed, count(*) FILTER (skipped) AS skipped, CASE WHEN count(*) FILTER (NOT skipped AND NOT failed)>0 AND count(*) FILTER (failed)>0 THEN 'mixed' WHEN count(*) FILTER (failed)>0 THEN 'failed' WHEN count(*) FILTER (NOT skipped AND NOT failed)>0 THEN 'real' ELSE 'none' END AS observed FROM preds GROUP BY engine""")),
    "majority_baseline": (majority, sql("SELECT bucket, place, round(share, 6) AS share FROM (SELECT bucket, truth_post AS place, count(*)/sum(count(*)) OVER (PARTITION BY bucket)::DOUBLE AS share, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, truth_post) AS r FROM inputs GROUP BY bucket, truth_post) WHERE r=1")),
    "coverage_counts": (coverage, sql("SELECT bucket, count(*) AS n, count(lat) AS placed, count(*) FILTER (n<=40) AS early FROM (SELECT i.bucket, p.lat, row_number() OVER (ORDER BY i.conv_id) AS n FROM inputs i LEFT JOIN places p ON p.name=i.truth_post) GROUP BY bucket")),
    "status_counts": (status_counts, sql("SELECT count(*) AS total, count(*) FILTER (status='ok') AS evaluated, count(*) FILTER (status='ooc') AS ooc, count(*) FILTER (status='error') AS error FROM status")),
    # Whole numbers of 10^-15 dollars, so that halves of the last place are rounded as they are.
    "cost_per_1000": (cost_per_1000, sql("""SELECT engine, n::BIGINT AS n, total::DOUBLE/1e15 AS total_usd, ((2*total*1000+n*1000000000)//(2*n*1000000000))::DOUBLE/1e6 AS per_1000, round((total/n::DOUBLE)/min(CASE WHEN total>0 THEN total/n::DOUBLE END) OVER (), 4)::DOUBLE AS ratio FROM
      (SELECT e.engine, count(*)::HUGEINT AS n, coalesce(sum(CASE WHEN NOT e.skipped AND NOT e.failed THEN (100+e.conv_id%50)*round(p.usd_in*1e15)::HUGEINT+(20+e.conv_id%7)*round(p.usd_out*1e15)::HUGEINT END), 0)::HUGEINT AS total FROM preds e LEFT JOIN prices p ON p.model=CASE e.engine WHEN 'model_post' THEN 'gpt-4o-mini' WHEN 'model_user' THEN 'claude-haiku-4-5-20251001' END GROUP BY e.engine)""")),
    "run_comparison": (run_comparison, sql("SELECT level, status, count(*) AS n FROM (SELECT coalesce(a.level, b.level) AS level, CASE WHEN a.row_id IS NULL THEN 'only in b' WHEN b.row_id IS NULL THEN 'only in a' WHEN abs(a.share-b.share)<=1e-3 THEN 'OK' ELSE 'MISMATCH' END AS status FROM (SELECT * FROM weighted WHERE rank=1) a FULL JOIN (SELECT * FROM rrf WHERE rank=1 AND level='post') b ON a.row_id=b.row_id AND a.level=b.level) GROUP BY ALL")),
    "engine_reference_join": (engine_reference, sql("""SELECT p.row_id, p.engine, p.city, round(r.overall, 6) AS overall, round(r.named, 6) AS named, round(r.unnamed, 6) AS unnamed FROM preds p JOIN (SELECT l.engine, avg((l.rank=1)::INT) AS overall, avg((l.rank=1)::INT) FILTER (NOT g.skipped AND NOT g.abstain) AS named, avg((l.rank=1)::INT) FILTER (NOT g.skipped AND g.abstain) AS unnamed
      FROM located l LEFT JOIN preds g ON g.row_id=l.row_id AND g.level=l.level AND g.engine LIKE 'gazetteer%' GROUP BY l.engine) r USING (engine) WHERE p.city IS NOT NULL""")),
    "wide_export": (wide_export, sql(WIDE_SQL)),
    "geojson_features": (geojson, None),
    "geojson_properties": (geojson_properties, sql(PROPERTIES_SQL)),
    "run_manifest": (manifest, None),
    "manifest_counts": (manifest_counts, sql(MANIFEST_SQL)),
}
