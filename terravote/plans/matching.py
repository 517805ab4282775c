"""Queries on matching, dispatch, vectors and replies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terravote.functions import sql as functions_sql
from terravote.functions import text as T
from terravote.operators import runner, scoring, toponyms
from terravote.plans import corpus as C
from terravote.plans.corpus import sql
from terravote.sources.catalogue import builtin_places, prices
from terravote.sources.shared import fixed_rows, shared_dir


def _lists(df, *keys):
    return df.select(*keys, F.posexplode("top_k").alias("pos", "e")).select(*keys, (F.col("pos") + 1).alias("rank"), "e.place", F.round("e.score", 6).alias("score"))


def _gazetteer(level):
    def query(spark, sf_dir):
        t = C.texts(C.inputs(spark, sf_dir)).filter(F.col("level") == level)
        return _lists(toponyms.gazetteer(t, builtin_places(spark)), "row_id")

    return query


def _hits(kind):
    def query(spark, sf_dir):
        t = C.texts(C.inputs(spark, sf_dir))
        return toponyms.matches(t, toponyms.terms(builtin_places(spark)).filter(F.col("term").rlike(kind))).select("row_id", "level", "place", "hits")

    return query


def _profiles(spark):
    rows = [("Singapore", ["Lion City", "Singapore", " "], ["Merlion", "the of"]), ("Tokyo", ["Edo"], ["and the"]), ("London", [], ["with"])]
    return fixed_rows(spark, rows, "name string, aliases array<string>, landmarks array<string>")


def landmarks(spark, sf_dir):
    t = C.texts(C.inputs(spark, sf_dir))
    m = toponyms.matches(t, toponyms.terms(builtin_places(spark), _profiles(spark)))
    return toponyms.score_places(m).select("row_id", "level", "place", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


LANDMARKS_SQL = r"""
, terms AS (SELECT ord, name, lower(name) AS term, 1.0::DOUBLE AS weight FROM places
  UNION ALL SELECT ord, name, t.term, t.weight FROM places JOIN (VALUES ('Singapore','lion city',1.0),('Singapore','merlion',0.25),('Singapore','the of',0.25),('Tokyo','edo',1.0),('Tokyo','and the',0.25),('London','with',0.25)) t(place,term,weight) ON t.place=name),
met AS (SELECT t.row_id, t.level, m.ord, m.name, m.weight, CASE WHEN regexp_full_match(m.term, '[a-z]+') THEN len(regexp_extract_all(lower(t.text), '(?:^|[^\pL\pN_])' || m.term || '(?:$|[^\pL\pN_])')) ELSE (length(lower(t.text))-length(replace(lower(t.text), m.term, '')))//length(m.term) END AS hits
  FROM texts t JOIN terms m ON contains(lower(t.text), m.term)),
s AS (SELECT row_id, level, ord, name AS place, sum(weight*hits)::DOUBLE AS score FROM met WHERE hits>0 GROUP BY ALL)
SELECT row_id, level, place, round(score, 6) AS score, round(score/sum(score) OVER (PARTITION BY row_id, level), 6) AS share FROM s"""


def evidence(spark, sf_dir):
    t = C.texts(C.inputs(spark, sf_dir))
    return toponyms.gazetteer(t, builtin_places(spark)).select("row_id", "level", F.coalesce("city", F.lit("")).alias("city"), "abstain", "evidence")


def dispatch_reasons(spark, sf_dir):
    d = scoring.dispatch(C.inputs(spark, sf_dir), C.engines(spark), ["gazetteer_post", "gazetteer_user", "model_user"])
    return d.select("row_id", "engine", F.coalesce("skip_reason", F.lit("run")).alias("decision"))


def local_engines(spark, sf_dir):
    """The preset without third parties, counted over the accounts."""
    local = [r["engine"] for r in C.engines(spark).filter(~F.col("third_party")).select("engine").collect()]
    d = scoring.dispatch(C.inputs(spark, sf_dir), C.engines(spark), local).filter("skip_reason IS NULL")
    return d.groupBy("engine").agg(F.count("*").alias("n"))


def row_status(spark, sf_dir):
    return C.status(spark, sf_dir).select("row_id", "status", "truth_post")


def encoder_topk(spark, sf_dir):
    """Every vector against the catalogue's."""
    e = C.read(spark, sf_dir, "embeddings")
    _, p = C.vectors(spark, sf_dir)
    return _lists(scoring.encoder_topk(e.select(F.col("vec_id").cast("string").alias("row_id"), F.col("embedding").alias("vector")), p), "row_id")


def reply_predictions(spark, sf_dir):
    t = scoring.reply_predictions(C.replies(spark, sf_dir), builtin_places(spark))
    return t.select("row_id", "engine", F.coalesce("city", F.lit("")).alias("city"), F.round("confidence", 6).alias("confidence"), F.size("top_k").alias("n"), "failed", F.coalesce("outcome", F.lit("")).alias("outcome"))


def prompt_rows(spark, sf_dir):
    t = C.inputs(spark, sf_dir).withColumn("text", scoring.level_text(F.lit("post"))).filter(F.col("text").isNotNull())
    return scoring.prompts(t, builtin_places(spark), 3).select("row_id", F.char_length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("digest"))


PROMPT_SQL = """SELECT row_id, length(p)::INT AS n_chars, sha256(p) AS digest FROM (SELECT i.row_id, 'Choose up to 3 places from this list: ' || n.names || '. Answer as JSON {"top_k": [[place, confidence], ...]}.' || chr(10) || 'Text: ' || i.text AS p
FROM (SELECT row_id, coalesce(post, split_part(line, chr(10), 1)) AS text, post, conv_id FROM inputs) i, (SELECT string_agg(name, ', ' ORDER BY ord) AS names FROM places) n WHERE i.post IS NOT NULL)
UNION ALL
SELECT row_id, length(p)::INT, sha256(p) FROM (SELECT i.row_id, 'Choose up to 3 places from this list: ' || n.names || '. Answer as JSON {"top_k": [[place, confidence], ...]}.' || chr(10) || 'Text: ' || i.text AS p
FROM (SELECT 'row-'||conv_id AS row_id, arg_min(text, turn) AS text FROM turns WHERE conv_id%11=0 AND conv_id%7<>0 GROUP BY conv_id) i, (SELECT string_agg(name, ', ' ORDER BY ord) AS names FROM places) n)"""


def closed_prompts(spark, sf_dir):
    """The same prompts for a model that is told to answer with JSON alone."""
    t = C.inputs(spark, sf_dir).withColumn("text", scoring.level_text(F.lit("post"))).filter(F.col("text").isNotNull())
    return scoring.prompts(t, builtin_places(spark), 3, scoring.ONLY_JSON).select("row_id", F.char_length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("digest"))


CLOSED_SQL = PROMPT_SQL.replace("i.text AS p", "i.text || chr(10) || '" + scoring.ONLY_JSON.strip() + "' AS p")


def _stand_in(batch):
    """What stands for an encoder here: counts of a text's letters."""
    return [[float(t.count(c)) for c in "etaoin"] for t in batch]


def embed_texts(spark, sf_dir):
    """Every document's vector from a store that begins empty: each different text is embedded once."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    t = scoring.stored_vectors(docs, _stand_in, path, "letters")
    return t.select("doc_id", F.size("vector").alias("width"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("vector", F.lit(0)).alias("first"))


EMBED_SQL = """SELECT doc_id, 6 AS width, (6*length(text)-length(replace(text,'e',''))-length(replace(text,'t',''))-length(replace(text,'a',''))-length(replace(text,'o',''))-length(replace(text,'i',''))-length(replace(text,'n','')))::DOUBLE AS total, (length(text)-length(replace(text,'e','')))::DOUBLE AS first FROM documents"""


def sql_helpers(spark, sf_dir):
    """The helpers called from SQL text, over customers."""
    functions_sql.register(spark)
    C.read(spark, sf_dir, "customer").createOrReplaceTempView("terravote_customer")
    return spark.sql("""SELECT c_custkey, round(haversine_km(c_custkey % 90, c_custkey % 180, c_nationkey, -c_nationkey), 3) AS km, within_km(0D, 0D, c_custkey % 3, 0D) AS near,
      round(wilson_interval(c_custkey % 5, 4).lo, 6) AS lo, round(wilson_interval(c_custkey % 5, 4).hi, 6) AS hi, recall_ratio(c_custkey % 3, c_custkey % 2) AS ratio, place_id(name_key(c_name)) AS place_id, latency_text(c_custkey * 10) AS latency FROM terravote_customer""")


_LO, _HI = C.wilson_sql("(c_custkey%5)", "4")
HELPERS_SQL = f"""SELECT c_custkey, round({C.km_sql('(c_custkey%90)', '(c_custkey%180)', 'c_nationkey', '(-c_nationkey)')}, 3) AS km, (c_custkey%3)*111.195<=161 AS near, round({_LO}, 6)::DOUBLE AS lo, round({_HI}, 6)::DOUBLE AS hi,
  CASE WHEN c_custkey%2=0 THEN 0.0 ELSE c_custkey%3 END::DOUBLE AS ratio, 'pl_'||substr(sha256(lower(c_name)), 1, 12) AS place_id, CASE WHEN c_custkey>=100 THEN printf('%.2f s', c_custkey/100.0) ELSE printf('%d ms', c_custkey*10) END AS latency FROM customer"""


def place_descriptions(spark, sf_dir):
    """The three templates over customers that stand for profiles."""
    c = C.read(spark, sf_dir, "customer")
    t = c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).alias("aliases"), F.array(F.lit("pier"), F.lit("gate")).alias("landmarks"), F.array().cast("array<string>").alias("foods"), F.lit(" ").alias("notes"))
    return t.select("c_custkey", scoring.describe("name").alias("plain"), scoring.describe("account").alias("account"), scoring.describe("passage").alias("passage"))


def call_cost(spark, sf_dir):
    t = scoring.call_costs(C.replies(spark, sf_dir), prices(spark))
    return t.select("row_id", "engine", F.round("cost_usd", 9).alias("cost_usd"), "cost_is_estimated", T.latency_text("latency_ms").alias("latency"))


def text_counts(spark, sf_dir):
    """F15 over documents: how often a few terms occur."""
    d = C.read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    terms = F.explode(F.array(*map(F.lit, ["the", "on the", "ing"]))).alias("term")
    return d.select("doc_id", "low", terms).select("doc_id", "term", T.match_count("low", "term").alias("hits"))


def custom_engine(spark, sf_dir):
    """A caller's engine, registered after the others, over vectors that a caller's encoder makes, through a batch run."""
    def encode(batch):
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in batch]

    p = scoring.embed(builtin_places(spark).select("ord", "name"), encode, "name").select(F.col("ord").alias("place_ord"), F.col("name").alias("place"), "vector")
    lengths = lambda rows: scoring.encoder_topk(scoring.embed(rows.select("row_id", "text"), encode).select("row_id", "vector"), p)
    roster = scoring.register(C.engines(spark), "lengths", "post")
    out = runner.run_batch(C.inputs(spark, sf_dir), builtin_places(spark), roster, {"lengths": lengths}).predictions
    return out.select("row_id", "engine", F.coalesce("city", F.lit("")).alias("city"), F.round("confidence", 6).alias("confidence"), "skipped", F.coalesce("reason", F.lit("")).alias("reason"))


CUSTOM_SQL = """, roster AS (SELECT engine, level FROM engines UNION ALL SELECT 'lengths', 'post'), ok AS (SELECT * FROM status WHERE status='ok'),
q AS (SELECT row_id, [length(post)::DOUBLE, (length(post)-length(replace(post, ' ', '')))::DOUBLE, 1.0::DOUBLE] AS v FROM ok WHERE post IS NOT NULL),
n AS (SELECT ord, name, [length(name)::DOUBLE, (length(name)-length(replace(name, ' ', '')))::DOUBLE, 1.0::DOUBLE] AS v FROM places),
x AS (SELECT row_id, ord, name, 10*list_cosine_similarity(q.v, n.v) AS l FROM q, n),
y AS (SELECT row_id, name, e/sum(e) OVER (PARTITION BY row_id) AS p, row_number() OVER (PARTITION BY row_id ORDER BY round(l, 12) DESC, ord) AS rank FROM (SELECT *, exp(l-max(l) OVER (PARTITION BY row_id)) AS e FROM x))
SELECT s.row_id, r.engine, coalesce(y.name, '') AS city, round(coalesce(y.p, 0), 6) AS confidence, y.name IS NULL AS skipped, CASE WHEN r.engine<>'lengths' THEN 'not selected' WHEN y.name IS NULL THEN 'no post' ELSE '' END AS reason
FROM ok s CROSS JOIN roster r LEFT JOIN y ON y.row_id=s.row_id AND y.rank=1 AND r.engine='lengths'"""

GAZ = "SELECT row_id, rank::INT AS rank, name AS place, round(share, 6) AS score FROM ranks WHERE level='{}'"
QUERIES = {
    "gazetteer_post_topk": (_gazetteer("post"), sql(GAZ.format("post"))),
    "gazetteer_user_topk": (_gazetteer("user"), sql(GAZ.format("user"))),
    "toponym_token_join": (_hits("^[a-z]+$"), sql("SELECT row_id, level, name AS place, hits::INT AS hits FROM hits WHERE regexp_full_match(lower(name), '[a-z]+')")),
    "toponym_substring_join": (_hits("^(?![a-z]+$)"), sql("SELECT row_id, level, name AS place, hits::INT AS hits FROM hits WHERE NOT regexp_full_match(lower(name), '[a-z]+')")),
    "gazetteer_landmarks": (landmarks, sql(LANDMARKS_SQL)),
    "gazetteer_evidence": (evidence, sql("""SELECT t.row_id, t.level, coalesce(a.name, '') AS city, a.name IS NULL AS abstain,
      CASE WHEN a.name IS NULL THEN '' ELSE 'matched: '||a.name||coalesce('; the text also names '||o.others, '') END AS evidence
      FROM texts t LEFT JOIN ranks a ON a.row_id=t.row_id AND a.level=t.level AND a.rank=1
      LEFT JOIN (SELECT row_id, level, string_agg(name, ', ' ORDER BY rank) AS others FROM ranks WHERE rank BETWEEN 2 AND 4 GROUP BY ALL) o ON o.row_id=t.row_id AND o.level=t.level""")),
    "dispatch_reasons": (dispatch_reasons, sql("""SELECT i.row_id, e.engine, CASE WHEN e.engine NOT IN ('gazetteer_post','gazetteer_user','model_user') THEN 'not selected' WHEN e.level='user' AND i.n_posts=0 THEN 'no timeline' WHEN e.level='post' AND i.post IS NULL THEN 'no post' ELSE 'run' END AS decision FROM inputs i, engines e""")),
    "local_engines": (local_engines, sql("SELECT e.engine, count(*) AS n FROM inputs i, engines e WHERE NOT e.third_party AND NOT (e.level='user' AND i.n_posts=0) AND NOT (e.level='post' AND i.post IS NULL) GROUP BY ALL")),
    "row_status": (row_status, sql("SELECT row_id, status, truth_post FROM status")),
    "encoder_topk": (encoder_topk, sql(""", every AS (SELECT e.vec_id::VARCHAR AS row_id, p.ord, p.name, 10*list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS l FROM embeddings e, pv p),
      x AS (SELECT row_id, name, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, ord) AS rank FROM (SELECT *, exp(l-max(l) OVER w)/sum(exp(l-10)) OVER w*exp(max(l) OVER w-10) AS p FROM every WINDOW w AS (PARTITION BY row_id)))
      SELECT row_id, rank::INT AS rank, name AS place, round(p, 6) AS score FROM x WHERE rank<=5""")),
    "llm_reply_predictions": (reply_predictions, sql("""SELECT i.row_id, m.engine, CASE WHEN i.conv_id%4<2 THEN p.name ELSE '' END AS city, CASE WHEN i.conv_id%4<2 THEN ('0.'||(5+i.conv_id%5))::DOUBLE ELSE 0.0 END AS confidence,
      CASE WHEN i.conv_id%4<2 THEN 2 ELSE 0 END AS n, i.conv_id%4>=2 AS failed, CASE WHEN i.conv_id%4=2 THEN 'no_catalogue_place' ELSE '' END AS outcome
      FROM inputs i, (VALUES ('model_post', 0), ('model_user', 17)) m(engine, shift) JOIN places p ON p.ord=(i.conv_id*11+m.shift)%50""")),
    "prompt_rows": (prompt_rows, sql(PROMPT_SQL)),
    "prompt_rows_closed": (closed_prompts, sql(CLOSED_SQL)),
    "embed_texts": (embed_texts, EMBED_SQL),
    "sql_helpers": (sql_helpers, HELPERS_SQL),
    "place_descriptions": (place_descriptions, "SELECT c_custkey, c_name AS plain, 'a social media user from '||c_name AS account, 'passage: '||c_name||CASE WHEN c_custkey%2=0 THEN '. also known as '||c_mktsegment ELSE '' END||'. landmarks include pier, gate' AS passage FROM customer"),
    "call_cost": (call_cost, sql("""SELECT i.row_id, m.engine, round((100+i.conv_id%50)*p.usd_in+(20+i.conv_id%7)*p.usd_out, 9) AS cost_usd, true AS cost_is_estimated,
      CASE WHEN 500+i.conv_id%13*100>=1000 THEN printf('%.2f s', (500+i.conv_id%13*100)/1000.0) ELSE printf('%.0f ms', (500+i.conv_id%13*100)::DOUBLE) END AS latency
      FROM inputs i, (VALUES ('model_post', 'gpt-4o-mini'), ('model_user', 'claude-haiku-4-5-20251001')) m(engine, model) JOIN prices p ON p.model=m.model""")),
    "text_counts": (text_counts, r"""SELECT doc_id, term, (CASE WHEN contains(term, ' ') THEN (length(low)-length(replace(low, term, '')))//length(term) ELSE len(list_filter(regexp_extract_all(low, '[\pL\pM\pN\p{Pc}]+'), lambda w: w=term)) END)::INT AS hits FROM (SELECT doc_id, lower(text) AS low FROM documents), (VALUES ('the'), ('on the'), ('ing')) t(term)"""),
    "custom_engine": (custom_engine, sql(CUSTOM_SQL)),
}
