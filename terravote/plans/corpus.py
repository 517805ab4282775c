"""Posts, accounts, engines and labels derived from the standard tables: once in Spark, once in SQL.

The tables name hardly any place, so each user turn gets one: place number (7 conv_id + turn) mod 75, none from 50 on.
Accounts are conversations, a post is the first user turn, the timeline all of them.  Vectors come from ``embeddings``,
replies of two models are built from the conversation's number.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravote.operators import fusion, scoring, toponyms
from terravote.sources.catalogue import COUNTRY_ALIASES, COUNTRY_BOXES, PLACES, PRICES, SEED_SOURCE, SEEDED, GOLD_SOURCE, builtin_places, prices, roster
from terravote.sources.shared import written

ENGINES = [("similarity_post", "post", False, 1.0), ("gazetteer_post", "post", False, 1.0), ("gazetteer_user", "user", False, 1.0), ("model_post", "post", True, 1.0), ("model_user", "user", True, 1.0)]
MODEL = {"model_post": ("gpt-4o-mini", 0), "model_user": ("claude-haiku-4-5-20251001", 17)}
BUCKETS = ["intl", "hard-sem", "userhome"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(places: DataFrame, number, alias: str):
    """A broadcast look-up of a place's name by number."""
    return F.broadcast(places.select(F.col("ord").alias(f"__{alias}"), F.col("name").alias(alias))), number == F.col(f"__{alias}")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    side, on = numbered(builtin_places(spark), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(75)), "mention")
    t = c.join(side, on, "left")
    return t.select("conv_id", "turn", F.concat("text", F.coalesce(F.concat(F.lit(" "), "mention"), F.lit(""))).alias("text"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = F.col("conv_id")
    for alias, number in (("a", F.pmod(c, F.lit(53))), ("b", F.pmod(c * 3, F.lit(53)))):
        side, on = numbered(builtin_places(spark), number, alias)
        t = t.join(side, on, "left")
    return t.select(
        "conv_id",
        F.concat(F.lit("row-"), c.cast("string")).alias("row_id"),
        F.when(c % 11 != 0, F.col("t")[0]["text"]).alias("post"),
        F.when(c % 7 != 0, F.transform("t", lambda x: x["text"])).alias("user_posts"),
        F.coalesce("a", F.lit("Atlantis")).alias("truth_post"),
        F.when(c % 5 != 0, F.coalesce("b", F.lit("Atlantis"))).alias("truth_user"),
        F.get(F.array(*map(F.lit, BUCKETS)), (c % 3).cast("int")).alias("bucket"),
        F.when(c % 4 == 0, True).when(c % 4 == 1, False).alias("should_disagree"),
        F.when(c % 29 == 28, "id is missing").alias("error"),
    )


def engines(spark: SparkSession) -> DataFrame:
    return roster(spark, ENGINES)


def texts(rows: DataFrame) -> DataFrame:
    """(row_id, level, text) of what the gazetteers read; no text, no row."""
    post = rows.select("row_id", F.lit("post").alias("level"), F.col("post").alias("text"))
    line = rows.select("row_id", F.lit("user").alias("level"), F.array_join("user_posts", "\n").alias("text"))
    return post.unionByName(line).filter(F.col("text").isNotNull())


def vectors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (row_id, vector), one per account, and places (place_ord, place, vector)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = e.agg((F.coalesce(F.max("vec_id"), F.lit(0)) + 1).alias("n"))
    rows = inputs(spark, sf_dir) if rows is None else rows
    q = rows.select("row_id", "conv_id").join(F.broadcast(n), F.lit(True)).select("row_id", F.pmod(F.col("conv_id") * 7 + 50, F.col("n")).alias("vec_id")).join(e, "vec_id").select("row_id", "vector")
    p = builtin_places(spark).join(e, F.col("ord") == F.col("vec_id")).select(F.col("ord").alias("place_ord"), F.col("name").alias("place"), "vector")
    return q, p


def replies(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, engine, model, reply, in_tokens, out_tokens, latency_ms): plain, fenced, off the catalogue or broken, by conv_id mod 4."""
    out, c = None, F.col("conv_id")
    rows = inputs(spark, sf_dir) if rows is None else rows
    for engine, (model, shift) in MODEL.items():
        t = rows.select("row_id", "conv_id")
        for alias, number in (("x", F.pmod(c * 11 + shift, F.lit(50))), ("y", F.pmod(c * 13 + 5 + shift, F.lit(50)))):
            side, on = numbered(builtin_places(spark), number, alias)
            t = t.join(side, on)
        body = F.format_string('{"top_k": [["%s", 0.%d], ["Nowhere", 0.15], ["%s", "0.2"]]}', F.upper("x"), 5 + c % 5, F.col("y"))
        reply = F.when(c % 4 == 0, body).when(c % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(c % 4 == 2, F.lit('{"top_k": [["Nowhere", 0.9]]}')).otherwise(F.lit("I can't tell {"))
        t = t.select("row_id", F.lit(engine).alias("engine"), F.lit(model).alias("model"), reply.alias("reply"), (100 + c % 50).alias("in_tokens"), (20 + c % 7).alias("out_tokens"), (500.0 + c % 13 * 100).alias("latency_ms"))
        out = t if out is None else out.unionByName(t)
    return out


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All engines' predictions, skips included, in the one long schema; written once for all that a query makes of them."""
    rows, places = written(inputs(spark, sf_dir)), builtin_places(spark)
    d = scoring.dispatch(rows.select("row_id", "post", "user_posts"), engines(spark)).select("row_id", "engine", "ord", "level", "skip_reason")
    run = d.filter(F.col("skip_reason").isNull())
    g = toponyms.gazetteer(texts(rows), places).join(run.filter(F.col("engine").startswith("gazetteer")), ["row_id", "level"])
    q, p = vectors(spark, sf_dir, rows)
    s = scoring.encoder_topk(q, p).join(run.filter("engine = 'similarity_post'"), "row_id")
    m = scoring.call_costs(scoring.reply_predictions(replies(spark, sf_dir, rows), places), prices(spark)).join(run, ["row_id", "engine"])
    cost = F.when(~F.col("failed"), F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)
    parts = [scoring.state(g), scoring.state(s), scoring.state(m.withColumn("cost_usd", cost)), scoring.skipped(d)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return written(out)


def fused(spark: SparkSession, sf_dir: str, method: str = "weighted") -> DataFrame:
    return fusion.fuse(predictions(spark, sf_dir), method)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.row_status(inputs(spark, sf_dir), builtin_places(spark))


def _q(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)})"


H = "(power(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*power(sin((radians({d})-radians({b}))/2),2))"
KM = f"2*6371.0088*asin(sqrt(CASE WHEN {H}>1 THEN 1 ELSE {H} END))"


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return KM.format(a=a, b=b, c=c, d=d)


def wilson_sql(h: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    mid = f"({h}/({n})::DOUBLE + {z}*{z}/(2*{n}))/(1+{z}*{z}/{n})"
    half = f"{z}*sqrt({h}/({n})::DOUBLE*(1-{h}/({n})::DOUBLE)/{n} + {z}*{z}/(4.0*{n}*{n}))/(1+{z}*{z}/{n})"
    return f"CASE WHEN {n}<=0 OR {h}<=0 THEN 0.0 ELSE greatest(0, {mid}-{half}) END", f"CASE WHEN {n}<=0 THEN 0.0 WHEN {h}>={n} THEN 1.0 ELSE least(1, {mid}+{half}) END"


def _model_sql(engine: str) -> str:
    shift = MODEL[engine][1]
    return f"""
      SELECT i.row_id, '{engine}' engine, u.pos, u.place, u.score FROM inputs i
      JOIN places x ON x.ord=(i.conv_id*11+{shift})%50 JOIN places y ON y.ord=(i.conv_id*13+5+{shift})%50,
      LATERAL (SELECT 0 pos, x.name place, ('0.'||(5+i.conv_id%5))::DOUBLE score UNION ALL SELECT 1, y.name, 0.2::DOUBLE) u
      WHERE i.conv_id%4 IN (0,1) AND {'i.post IS NOT NULL' if engine.endswith('post') else 'i.n_posts>0'}"""


@cache
def ctes() -> dict[str, str]:
    """The same tables as common table expressions, in an order in which each can be defined."""
    out = [
        values("places", "ord, name, lat, lon, feature_type, centroid_source", [(i, *p, SEED_SOURCE if i < SEEDED else GOLD_SOURCE) for i, p in enumerate(PLACES)]),
        values("boxes", "country, min_lat, max_lat, min_lon, max_lon", COUNTRY_BOXES),
        values("aliases", "alias, country", [(c[0].lower(), c[0]) for c in COUNTRY_BOXES] + list(COUNTRY_ALIASES.items())),
        values("prices", "model, usd_in, usd_out, checked", PRICES),
        values("engines", "ord, engine, level, third_party, weight", [(i, *e) for i, e in enumerate(ENGINES)]),
        "turns AS (SELECT c.conv_id, c.turn, c.text || coalesce(' '||p.name, '') AS text FROM conversations c LEFT JOIN places p ON p.ord=(c.conv_id*7+c.turn)%75 WHERE c.role='user')",
        f"""inputs AS (SELECT t.conv_id, 'row-'||t.conv_id AS row_id, CASE WHEN t.conv_id%11<>0 THEN arg_min(t.text, t.turn) END AS post,
          CASE WHEN t.conv_id%7<>0 THEN string_agg(t.text, chr(10) ORDER BY t.turn) END AS line, CASE WHEN t.conv_id%7<>0 THEN count(*) ELSE 0 END AS n_posts,
          coalesce(any_value(a.name), 'Atlantis') AS truth_post, CASE WHEN t.conv_id%5<>0 THEN coalesce(any_value(b.name), 'Atlantis') END AS truth_user,
          ['{BUCKETS[0]}','{BUCKETS[1]}','{BUCKETS[2]}'][1+t.conv_id%3] AS bucket, CASE WHEN t.conv_id%4=0 THEN true WHEN t.conv_id%4=1 THEN false END AS should_disagree,
          CASE WHEN t.conv_id%29=28 THEN 'id is missing' END AS error
          FROM turns t LEFT JOIN places a ON a.ord=t.conv_id%53 LEFT JOIN places b ON b.ord=(t.conv_id*3)%53 GROUP BY t.conv_id)""",
        "texts AS (SELECT row_id, 'post' AS level, post AS text FROM inputs WHERE post IS NOT NULL UNION ALL SELECT row_id, 'user', line FROM inputs WHERE line IS NOT NULL)",
        """hits AS (SELECT * FROM (SELECT t.row_id, t.level, p.ord, p.name, CASE WHEN regexp_full_match(lower(p.name), '[a-z]+') THEN len(regexp_extract_all(lower(t.text), '\\b'||lower(p.name)||'\\b'))
          ELSE (length(lower(t.text))-length(replace(lower(t.text), lower(p.name), '')))//length(p.name) END AS hits FROM texts t JOIN places p ON contains(lower(t.text), lower(p.name))) WHERE hits>0)""",
        "shares AS (SELECT *, hits::DOUBLE/sum(hits) OVER (PARTITION BY row_id, level) AS share FROM hits)",
        "ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, level ORDER BY share DESC, ord) AS rank FROM shares) WHERE rank<=5)",
        "qv AS (SELECT i.row_id, i.post, e.embedding::DOUBLE[] AS v FROM inputs i JOIN embeddings e ON e.vec_id=(50+i.conv_id*7)%(SELECT max(vec_id)+1 FROM embeddings))",
        "pv AS (SELECT p.ord, p.name, e.embedding::DOUBLE[] AS v FROM places p JOIN embeddings e ON e.vec_id=p.ord)",
        "cosines AS (SELECT q.row_id, q.post, p.ord, p.name, list_cosine_similarity(q.v, p.v) AS cosine FROM qv q, pv p)",
        "soft AS (SELECT *, exp(10*(cosine-max(cosine) OVER w)) AS e FROM cosines WINDOW w AS (PARTITION BY row_id))",
        "sims AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, ord) AS rank FROM (SELECT *, e/sum(e) OVER (PARTITION BY row_id) AS p FROM soft))",
        f"""lists AS (SELECT l.*, e.ord AS eord, e.level FROM (
          SELECT row_id, 'similarity_post' AS engine, rank-1 AS pos, name AS place, p AS score FROM sims WHERE rank<=5 AND post IS NOT NULL
          UNION ALL SELECT row_id, 'gazetteer_'||level, rank-1, name, share FROM ranks
          UNION ALL {_model_sql('model_post')} UNION ALL {_model_sql('model_user')}) l JOIN engines e USING (engine))""",
        """preds AS (SELECT i.conv_id, i.row_id, e.engine, e.ord AS eord, e.level, l.place AS city, coalesce(l.score, 0) AS confidence, coalesce(n.size, 0) AS size,
          (e.level='user' AND i.n_posts=0) OR (e.level='post' AND i.post IS NULL) AS skipped,
          e.engine LIKE 'model%' AND i.conv_id%4 IN (2,3) AND NOT ((e.level='user' AND i.n_posts=0) OR (e.level='post' AND i.post IS NULL)) AS failed,
          e.engine LIKE 'gazetteer%' AND l.place IS NULL AND NOT ((e.level='user' AND i.n_posts=0) OR (e.level='post' AND i.post IS NULL)) AS abstain
          FROM inputs i CROSS JOIN engines e LEFT JOIN (SELECT * FROM lists WHERE pos=0) l ON l.row_id=i.row_id AND l.engine=e.engine
          LEFT JOIN (SELECT row_id, engine, count(*) AS size FROM lists GROUP BY ALL) n ON n.row_id=i.row_id AND n.engine=e.engine)""",
        "sums AS (SELECT row_id, level, place, sum(score ORDER BY eord, pos) AS weighted, sum(1.0::DOUBLE/(60+pos+1) ORDER BY eord, pos) AS rrf, min(eord*1000+pos) AS first_at FROM lists GROUP BY ALL)",
        "weighted AS (SELECT *, row_number() OVER (PARTITION BY row_id, level ORDER BY share DESC, first_at) AS rank FROM (SELECT row_id, level, place, first_at, weighted/sum(weighted) OVER (PARTITION BY row_id, level) AS share FROM sums))",
        "rrf AS (SELECT *, row_number() OVER (PARTITION BY row_id, level ORDER BY share DESC, first_at) AS rank FROM (SELECT row_id, level, place, first_at, rrf/sum(rrf) OVER (PARTITION BY row_id, level) AS share FROM sums))",
        "best AS (SELECT * FROM (SELECT row_id, level, engine, city, confidence, row_number() OVER (PARTITION BY row_id, level ORDER BY confidence DESC, eord) AS r FROM preds WHERE size>0) WHERE r=1)",
        "named AS (SELECT * FROM preds WHERE city IS NOT NULL AND NOT skipped AND NOT failed)",
        "votes AS (SELECT *, row_number() OVER (PARTITION BY row_id, level ORDER BY w DESC, first) AS r, w/sum(w) OVER (PARTITION BY row_id, level) AS confidence, sum(n) OVER (PARTITION BY row_id, level) AS answered FROM (SELECT row_id, level, city, sum(confidence ORDER BY eord) AS w, count(*) AS n, min(eord) AS first FROM named GROUP BY ALL))",
        "overall AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, first) AS r, w/sum(w) OVER (PARTITION BY row_id) AS confidence, sum(n) OVER (PARTITION BY row_id) AS answered FROM (SELECT row_id, city, sum(confidence ORDER BY eord) AS w, count(*) AS n, min(eord) AS first FROM named GROUP BY ALL))",
        f"""flags AS (SELECT i.row_id, i.should_disagree, a.city AS post_city, b.city AS user_city, CASE WHEN a.city<>b.city THEN {km_sql('p.lat', 'p.lon', 'q.lat', 'q.lon')} END AS km
          FROM inputs i LEFT JOIN votes a ON a.row_id=i.row_id AND a.level='post' AND a.r=1 LEFT JOIN votes b ON b.row_id=i.row_id AND b.level='user' AND b.r=1 LEFT JOIN places p ON p.name=a.city LEFT JOIN places q ON q.name=b.city)""",
        "status AS (SELECT i.*, CASE WHEN i.error IS NOT NULL THEN 'error' WHEN i.truth_post='Atlantis' OR i.truth_user='Atlantis' THEN 'ooc' ELSE 'ok' END AS status FROM inputs i)",
        f"""points AS (SELECT *, CASE WHEN size=0 THEN 1000000 WHEN hit IS NOT NULL THEN hit+1 ELSE size+1 END AS rank, hit IS NOT NULL AS found FROM (
          SELECT p.*, s.bucket, CASE WHEN p.level='user' THEN coalesce(s.truth_user, s.truth_post) ELSE s.truth_post END AS truth,
          (SELECT min(l.pos) FROM lists l WHERE l.row_id=p.row_id AND l.engine=p.engine AND lower(l.place)=lower(CASE WHEN p.level='user' THEN coalesce(s.truth_user, s.truth_post) ELSE s.truth_post END)) AS hit
          FROM preds p JOIN status s USING (row_id) WHERE s.status='ok' AND NOT p.skipped AND NOT p.failed))""",
        f"located AS (SELECT p.*, t.lat AS t_lat, p.city IS NULL AS silent, p.city IS NOT NULL AND t.lat IS NOT NULL AS geo, {km_sql('c.lat', 'c.lon', 't.lat', 't.lon')} AS km FROM points p LEFT JOIN places c ON c.name=p.city LEFT JOIN places t ON t.name=p.truth)",
    ]
    return {x.split("(")[0].split(" ")[0]: x for x in out}


def sql(body: str) -> str:
    """body with the tables that it needs, and those that these need; a body that starts with a comma adds tables of its own."""
    import re

    known, need, look = ctes(), set(), body
    for name in reversed(known):
        if re.search(rf"\b{name}\b", look):
            need.add(name)
            look += known[name]
    tables = ", ".join(c for n, c in known.items() if n in need)
    if body.lstrip().startswith(","):
        return "WITH " + (tables + body if tables else body.lstrip()[1:])
    return f"WITH {tables}\n{body}" if tables else body
