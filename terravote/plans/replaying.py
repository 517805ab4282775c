"""Queries on rolling sums, replays of rules with memory, and streams."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from terravote.operators import places, state
from terravote.operators.toponyms import gazetteer
from terravote.plans import corpus as C
from terravote.plans.corpus import read, sql
from terravote.sources.catalogue import PLACES, builtin_places
from terravote.streaming import stateful


def calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"), F.lit("score").alias("kind"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1000).alias("usd"), (F.col("event_type") == "purchase").alias("paid"))


def log(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type IN ('signup', 'error')")
    op = F.when(F.col("event_type") == "signup", "register").otherwise("reset")
    return e.select(F.pmod("user_id", F.lit(10)).alias("catalogue_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("Place "), (F.col("value").cast("int") % 40).cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("ts"))


def rolling_spend(spark, sf_dir):
    t = state.rolling_spend(calls(spark, sf_dir), 0.2, 1.0)
    return t.select("call_id", F.round("hour", 6).alias("hour"), F.round("day", 6).alias("day"), F.coalesce("reached", F.lit("")).alias("reached"))


ROLLING = """SELECT call_id, round(h, 6) AS hour, round(d, 6) AS day, CASE WHEN h>=0.2 THEN 'hour' WHEN d>=1.0 THEN 'day' ELSE '' END AS reached FROM (SELECT event_id AS call_id,
  sum(greatest(value/1000, 0)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS h, sum(greatest(value/1000, 0)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS d FROM events)"""


def spend_gate(spark, sf_dir):
    t = state.spend_gate(calls(spark, sf_dir), 0.2, 1.0)
    return t.select("call_id", "key", "ran", F.round("hour", 6).alias("hour"), F.round("day", 6).alias("day"))


def quota_admission(spark, sf_dir):
    t = state.quota_admission(calls(spark, sf_dir), 2)
    return t.select("call_id", "key", "admitted", "remaining", F.round("retry_after", 3).alias("retry_after"))


TTL, CAP = 36 * 3600, 8


def changes(spark, sf_dir):
    """What happens to the catalogues up to the end of the events."""
    end = read(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("ts")).select(F.unix_micros("ts").alias("at")).first()["at"]
    until = None if end is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=end)
    return state.catalogue_changes(log(spark, sf_dir), ttl_s=TTL, cap=CAP, until=until)


def catalogue_history(spark, sf_dir):
    return state.catalogue_history(changes(spark, sf_dir))


def catalogue_changes(spark, sf_dir):
    t = changes(spark, sf_dir)
    return t.groupBy("catalogue_id", "status").agg(F.count("*").alias("n"), F.sum(F.size("evicted")).alias("evicted"), F.max("size").alias("largest"))


def views(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.pmod("user_id", F.lit(10)).alias("catalogue_id"), F.col("ts").cast("timestamp").alias("ts"))


def catalogue_asof(spark, sf_dir):
    """The places that each catalogue held at each view event: how many, and the first and last of them."""
    t = places.as_of(views(spark, sf_dir), catalogue_history(spark, sf_dir))
    return t.groupBy("request_id").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


def catalogue_sizes(spark, sf_dir):
    """How many places each catalogue held at each view event, none included."""
    return places.sizes_as_of(views(spark, sf_dir), catalogue_history(spark, sf_dir)).select("request_id", "n")


# One step for each event of a catalogue: what it held before, less what has expired, then the event.  ``alive`` and the
# rest tell what happened.
BOOKS = f"""WITH RECURSIVE log AS (SELECT user_id%10 AS cat, row_number() OVER (PARTITION BY user_id%10 ORDER BY ts, event_id) AS i, event_id AS seq, epoch_us(ts) AS tm, event_type='signup' AS reg, 'Place '||(trunc(value)::INT%40) AS name FROM events WHERE event_type IN ('signup','error')),
ends AS (SELECT max(epoch_us(ts)) AS until FROM events),
books AS (SELECT DISTINCT cat, 0::BIGINT AS i, NULL::BIGINT AS seq, 0::BIGINT AS tm, false AS reg, '' AS name, false AS had, []::VARCHAR[] AS evicted, []::STRUCT(name VARCHAR, t BIGINT)[] AS held FROM log
  UNION ALL SELECT cat, i, seq, tm, reg, name, had, CASE WHEN reg THEN list_transform(list_slice(others, 1, greatest(0, len(others)-{CAP - 1})), lambda x: x.name) ELSE [] END,
    CASE WHEN reg THEN list_append(list_slice(others, greatest(1, len(others)-{CAP - 2}), len(others)), {{'name': name, 't': tm}}) ELSE others END
  FROM (SELECT l.*, list_filter(b.held, lambda x: x.t>l.tm-{TTL}000000 AND x.name<>l.name) AS others, len(list_filter(b.held, lambda x: x.t>l.tm-{TTL}000000 AND x.name=l.name))>0 AS had FROM books b JOIN log l ON l.cat=b.cat AND l.i=b.i+1)),
steps AS (SELECT * FROM books WHERE i>0),
stops AS (SELECT cat, i, name FROM steps UNION ALL SELECT cat, i, unnest(evicted) FROM steps),
stays AS (SELECT s.cat, s.name, s.tm, min(n.tm) AS stopped FROM steps s LEFT JOIN (SELECT t.*, x.tm FROM stops t JOIN steps x USING (cat, i)) n ON n.cat=s.cat AND n.name=s.name AND n.i>s.i WHERE s.reg GROUP BY s.cat, s.name, s.i, s.tm),
history AS (SELECT cat AS catalogue_id, name, tm AS a, CASE WHEN stopped<tm+{TTL}000000 THEN stopped WHEN tm+{TTL}000000<=until THEN tm+{TTL}000000 END AS b, coalesce(stopped<tm+{TTL}000000, false) AS cut FROM stays, ends)
"""
HISTORY_SQL = BOOKS + "SELECT catalogue_id, name, make_timestamp(a) AS valid_from, make_timestamp(b) AS valid_to FROM history"
CHANGES_SQL = BOOKS + """SELECT catalogue_id, status, count(*) AS n, sum(e)::BIGINT AS evicted, max(size)::INT AS largest FROM (SELECT cat AS catalogue_id, CASE WHEN reg AND had THEN 'already_present' WHEN reg THEN 'added' WHEN had THEN 'removed' ELSE 'not_present' END AS status, len(evicted) AS e, len(held) AS size FROM steps
  UNION ALL SELECT h.catalogue_id, 'expired', 0, (SELECT count(*) FROM history o WHERE o.catalogue_id=h.catalogue_id AND o.a<=h.b AND (o.b IS NULL OR o.b>h.b)) FROM history h WHERE b IS NOT NULL AND NOT cut) GROUP BY ALL"""
VIEWS_SQL = "FROM (SELECT event_id AS request_id, user_id%10 AS cat, epoch_us(ts) AS tm FROM events WHERE event_type='view') v LEFT JOIN history h ON h.catalogue_id=v.cat AND h.a<=v.tm AND (h.b IS NULL OR v.tm<h.b) GROUP BY request_id"


def minutes_left(spark, sf_dir):
    """Minutes until a registration of the log expires, seen from the log's end, oldest first."""
    t = log(spark, sf_dir).filter("op = 'register'")
    end = t.agg(F.max("ts").alias("end"))
    left = F.greatest(F.lit(0.0), F.lit(36 * 60.0) - (F.unix_micros("end") - F.unix_micros("ts")) / 6e7)
    return t.join(F.broadcast(end), F.lit(True)).orderBy("ts", "seq").select("seq", "catalogue_id", F.round(left, 3).alias("minutes"))


MINUTES = "SELECT event_id AS seq, user_id%10 AS catalogue_id, round(greatest(0, 2160.0-(epoch_us((SELECT max(ts) FROM events WHERE event_type='signup'))-epoch_us(ts))/6e7), 3) AS minutes FROM events WHERE event_type='signup'"


def stale_profiles(spark, sf_dir):
    """Names ever registered that no catalogue holds at the end of the log."""
    h = catalogue_history(spark, sf_dir)
    every = h.select(F.concat_ws("/", "catalogue_id", "name").alias("place_id")).distinct()
    return places.stale_profiles(every, h.filter("valid_to IS NULL").select(F.concat_ws("/", "catalogue_id", "name").alias("place_id")))


def stream_scoring(spark, sf_dir):
    """Documents with a place added to their texts, read as a stream and scored within the row."""
    path = f"{sf_dir}/documents.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema)
    whole = spark.read.parquet(path)
    parent = d.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if len(whole.inputFiles()) == 1 and whole.inputFiles()[0].endswith("/documents.parquet") else d.parquet(path)
    names = [p[0] for p in PLACES]
    mention = F.get(F.array(*map(F.lit, names)), F.pmod(F.col("doc_id") * 7, F.lit(75)).cast("int"))
    posts = parent.select(F.col("doc_id").cast("string").alias("row_id"), F.concat_ws(" ", "text", mention).alias("text"))
    return stateful.drained(stateful.score_posts(posts, names).select("row_id", "city", "abstain", F.size("top_k").alias("n")))


STREAM_SQL = sql(r""", posts AS (SELECT doc_id::VARCHAR AS row_id, concat_ws(' ', text, p.name) AS text FROM documents d LEFT JOIN places p ON p.ord=(d.doc_id*7)%75),
h AS (SELECT t.row_id, p.ord, p.name, CASE WHEN regexp_full_match(lower(p.name), '[a-z]+') THEN len(list_filter(regexp_extract_all(lower(t.text), '[\pL\pM\pN\p{Pc}]+'), lambda w: w=lower(p.name))) ELSE (length(lower(t.text))-length(replace(lower(t.text), lower(p.name), '')))//length(p.name) END AS n FROM posts t JOIN places p ON contains(lower(t.text), lower(p.name)))
SELECT p.row_id, g.city, g.city IS NULL AS abstain, coalesce(g.n, 0)::INT AS n FROM posts p LEFT JOIN (SELECT row_id, arg_min(name, -n*1000+ord) AS city, least(5, count(*)) AS n FROM h WHERE n>0 GROUP BY row_id) g USING (row_id)""")


# The replays as recursions: a call at a time, with the entries of the window.  Amounts are whole numbers of 2^-60 dollars.
GATE_SQL = """WITH RECURSIVE log AS (SELECT event_id AS call_id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS tm, value/1000 AS usd, event_type='purchase' AS paid FROM events),
g AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS call_id, true AS ran, 0.0::DOUBLE AS hour, 0.0::DOUBLE AS day, []::STRUCT(t BIGINT, n HUGEINT)[] AS held FROM log
  UNION ALL SELECT key, i, call_id, NOT (paid AND (hour>=0.2 OR day>=1.0)), hour, day, CASE WHEN NOT (paid AND (hour>=0.2 OR day>=1.0)) AND usd>0 THEN list_append(kept, {'t': tm, 'n': floor(usd*1152921504606846976)::HUGEINT}) ELSE kept END
  FROM (SELECT *, coalesce(list_sum(list_transform(list_filter(kept, lambda x: x.t>=tm-3600000000), lambda x: x.n::DOUBLE)), 0)/1152921504606846976 AS hour, coalesce(list_sum(list_transform(kept, lambda x: x.n::DOUBLE)), 0)/1152921504606846976 AS day
    FROM (SELECT l.*, list_filter(g.held, lambda x: x.t>=l.tm-86400000000) AS kept FROM g JOIN log l ON l.key=g.key AND l.i=g.i+1)))
SELECT call_id, key, ran, round(hour, 6) AS hour, round(day, 6) AS day FROM g WHERE i>0"""
QUOTA_SQL = """WITH RECURSIVE log AS (SELECT event_id AS call_id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS tm FROM events),
g AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS call_id, true AS admitted, 0 AS remaining, 0.0::DOUBLE AS retry_after, []::BIGINT[] AS held FROM log
  UNION ALL SELECT key, i, call_id, len(kept)<2, greatest(0, 1-len(kept))::INT, CASE WHEN len(kept)<2 THEN 0 ELSE (kept[1]+3600000000-tm)/1e6 END::DOUBLE, CASE WHEN len(kept)<2 THEN list_append(kept, tm) ELSE kept END
  FROM (SELECT l.*, list_filter(g.held, lambda x: x>l.tm-3600000000) AS kept FROM g JOIN log l ON l.key=g.key AND l.i=g.i+1))
SELECT call_id, key, admitted, remaining, round(retry_after, 3) AS retry_after FROM g WHERE i>0"""


def hourly_spend(spark, sf_dir):
    """Spend in tumbling hours per key: the batch form of the watermarked stream."""
    t = calls(spark, sf_dir).filter("usd > 0")
    return t.groupBy(F.window("ts", "1 hour"), "key").agg(F.sum("usd").alias("usd"), F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "key", F.round("usd", 6).alias("usd"), "calls")


def gazetteer_documents(spark, sf_dir):
    """Every document scored against the catalogue: the join form over whole texts."""
    t = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("row_id"), F.lit("post").alias("level"), "text")
    g = gazetteer(t, builtin_places(spark))
    return g.select("row_id", F.coalesce("city", F.lit("")).alias("city"), F.round("confidence", 6).alias("confidence"))


GAZ_DOCS = sql(r""", h AS (SELECT d.doc_id::VARCHAR AS row_id, p.ord, p.name, CASE WHEN regexp_full_match(lower(p.name), '[a-z]+') THEN len(list_filter(regexp_extract_all(lower(d.text), '[\pL\pM\pN\p{Pc}]+'), lambda w: w=lower(p.name))) ELSE (length(lower(d.text))-length(replace(lower(d.text), lower(p.name), '')))//length(p.name) END AS n FROM documents d JOIN places p ON contains(lower(d.text), lower(p.name)))
SELECT d.doc_id::VARCHAR AS row_id, coalesce(g.city, '') AS city, round(coalesce(g.c, 0), 6)::DOUBLE AS confidence FROM documents d LEFT JOIN (SELECT row_id, arg_min(name, -n*1000+ord) AS city, max(n)/sum(n)::DOUBLE AS c FROM h WHERE n>0 GROUP BY row_id) g ON g.row_id=d.doc_id::VARCHAR""")

QUERIES = {
    "rolling_spend": (rolling_spend, ROLLING),
    "hourly_spend": (hourly_spend, "SELECT date_trunc('hour', ts) AS start, user_id AS key, round(sum(value/1000), 6) AS usd, count(*) AS calls FROM events WHERE value>0 GROUP BY ALL"),
    "spend_gate": (spend_gate, GATE_SQL),
    "quota_admission": (quota_admission, QUOTA_SQL),
    "catalogue_changes": (catalogue_changes, CHANGES_SQL),
    "catalogue_history": (catalogue_history, HISTORY_SQL),
    "catalogue_asof": (catalogue_asof, BOOKS + "SELECT request_id, count(*) AS n, min(name) AS first, max(name) AS last " + VIEWS_SQL.replace("LEFT JOIN", "JOIN")),
    "catalogue_sizes": (catalogue_sizes, BOOKS + "SELECT request_id, count(h.a) AS n " + VIEWS_SQL),
    "minutes_to_expiry": (minutes_left, MINUTES),
    "stale_profiles": (stale_profiles, BOOKS + "SELECT DISTINCT catalogue_id||'/'||name AS place_id FROM history h WHERE NOT EXISTS (SELECT 1 FROM history o WHERE o.catalogue_id=h.catalogue_id AND o.name=h.name AND o.b IS NULL)"),
    "stream_scoring": (stream_scoring, STREAM_SQL),
    "gazetteer_documents": (gazetteer_documents, GAZ_DOCS),
}
