"""Dispatch of rows to engines, and engines that score vectors or model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravote.functions.text import confidence, extract_json
from terravote.sources.shared import checked, written

SHARPNESS = 10.0
LIST = "array<struct<place:string,score:double>>"
PREDICTION = "row_id string, engine string, ord int, level string, city string, confidence double, top_k array<struct<place:string,score:double>>, latency_ms double, cost_usd double, abstain boolean, failed boolean, skipped boolean, reason string, note string"
FIELDS = [f.split(" ")[0] for f in PREDICTION.replace("struct<place:string,score:double>", "x").split(", ")]


def row_status(inputs: DataFrame, places: DataFrame) -> DataFrame:
    """Adds status: error if the row carries an error; ooc if a truth is outside the catalogue, whatever its case; else ok."""
    known = places.select(F.lower("name").alias("n")).distinct()
    out = inputs
    for side in ("truth_post", "truth_user"):
        out = out.join(checked(known.select(F.col("n").alias(f"__{side}"))), F.lower(side) == F.col(f"__{side}"), "left")
    outside = lambda side: F.col(side).isNotNull() & F.col(f"__{side}").isNull()
    status = F.when(F.col("error").isNotNull(), "error").when(outside("truth_post") | outside("truth_user"), "ooc").otherwise("ok")
    return out.withColumn("status", status).drop("__truth_post", "__truth_user")


def dispatch(inputs: DataFrame, engines: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Rows x engines with skip_reason, null where the engine is to run.  The roster is a small fixed table."""
    chosen = F.lit(True) if selected is None else F.col("engine").isin(selected)
    reason = (
        F.when(~chosen, "not selected")
        .when((F.col("level") == "user") & (F.coalesce(F.size("user_posts"), F.lit(0)) <= 0), "no timeline")
        .when((F.col("level") == "post") & F.col("post").isNull(), "no post")
    )
    return inputs.join(checked(engines), F.lit(True)).withColumn("skip_reason", reason)


def level_text(level: Column | str) -> Column:
    """What an engine reads: the post, else the first post of the account; or the timeline, else the post."""
    lvl = F.col(level) if isinstance(level, str) else level
    line = F.when(F.size("user_posts") > 0, F.array_join("user_posts", "\n"))
    return F.when(lvl == "user", F.coalesce(line, F.col("post"))).otherwise(F.coalesce(F.col("post"), F.get("user_posts", F.lit(0))))


def state(df: DataFrame, **known) -> DataFrame:
    """df brought to the prediction schema; what it lacks is filled in with the defaults of an answer."""
    default = {"city": F.lit(None).cast("string"), "confidence": F.lit(0.0), "top_k": F.array().cast(LIST), "latency_ms": F.lit(0.0), "cost_usd": F.lit(0.0), "abstain": F.lit(False), "failed": F.lit(False), "skipped": F.lit(False), "reason": F.lit(None).cast("string"), "note": F.lit("")} | known
    return df.withColumns({k: v for k, v in default.items() if k not in df.columns or k in known}).select(FIELDS)


def skipped(dispatched: DataFrame) -> DataFrame:
    note = F.concat(F.lit("not run: "), F.col("engine"), F.lit(" ("), F.col("skip_reason"), F.lit(")"))
    return state(dispatched.filter(F.col("skip_reason").isNotNull()), skipped=F.lit(True), reason=F.col("skip_reason"), note=note)


def mode(p: str = "") -> Column:
    """real, stub, failed or skipped."""
    c = lambda n: F.col(f"{p}{n}")
    return F.when(c("skipped"), "skipped").when(c("failed"), "failed").when(F.lower(F.trim(c("note"))).startswith("stub"), "stub").otherwise("real")


def usable() -> Column:
    return ~(F.col("failed") | F.col("skipped"))


#: Places of a block and queries of a row, which a task multiplies at once; blocks up to this number are broadcast.
PLACES, QUERIES, FEW = 4096, 512, 8


def _block_states(batches, k: int):
    """For each query and block of places: the greatest logit, the sum of exponentials scaled by it, and the k best places."""
    import numpy as np
    import pyarrow as pa

    def matrix(column):
        rows = column.flatten()
        v = np.array(rows.field("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return rows, np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    best = pa.list_(pa.struct([("place_ord", pa.int64()), ("place", pa.string()), ("logit", pa.float64())]))
    for batch in batches:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)
            (asked, q), (held, p) = matrix(one.column("queries")), matrix(one.column("places"))
            order = np.argsort(held.field("ord").to_numpy(zero_copy_only=False), kind="stable")
            logits = SHARPNESS * (q @ p[order].T)
            top = logits.max(axis=1)
            total = np.exp(logits - top[:, None]).sum(axis=1)
            first = np.argsort(-logits, axis=1, kind="stable")[:, :k]
            ords, names = held.field("ord").take(pa.array(order)).to_pylist(), held.field("place").take(pa.array(order)).to_pylist()
            lists = [[{"place_ord": ords[j], "place": names[j], "logit": float(logits[i, j])} for j in js] for i, js in enumerate(first)]
            yield pa.RecordBatch.from_arrays([asked.field("id"), pa.array(top), pa.array(total), pa.array(lists, best)], ["__id", "top", "total", "best"])


def encoder_topk(queries: DataFrame, places: DataFrame, k: int = 5, block: int = PLACES, at_once: int = QUERIES) -> DataFrame:
    """queries (row_id, vector) and places (place_ord, place, vector) -> row_id, city, confidence, top_k: the k likeliest
    places by the softmax of ten times the cosine over the whole catalogue, ties in catalogue order.

    The catalogue lies in blocks of ``block`` places.  Each meets rows of ``at_once`` queries in one matrix product, which leaves
    a state a query: the greatest logit, the sum of exponentials scaled by it, and the k best.  States of a query are merged
    by key, one for each block, so no pair of query and place is ever a row, whatever the catalogue's size.  Few blocks are
    broadcast; of more, queries go to each block by an equality join.

    Null vectors take no part; a vector of zeros has cosine 0 with all.  Repeated row_ids are queries of their own.
    """
    fine = lambda t: t.filter(F.col("vector").isNotNull())
    asked = written(fine(queries).select(F.monotonically_increasing_id().alias("__id"), "row_id", F.col("vector").cast("array<double>").alias("v")))
    held = written(fine(places).select(F.col("place_ord").cast("long").alias("ord"), "place", F.col("vector").cast("array<double>").alias("v")))
    blocks = max(1, -(-held.count() // block))
    own = held.groupBy(F.pmod(F.xxhash64("ord", "place"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("ord", "place", "v")).alias("places"))
    rows = asked.groupBy(F.floor(F.col("__id") / at_once).alias("__row")).agg(F.collect_list(F.struct(F.col("__id").alias("id"), "v")).alias("queries"))
    rows = rows.select("queries", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = rows.join(F.broadcast(own) if blocks <= FEW else own, "block").select("queries", "places")
    states = met.mapInArrow(lambda b: _block_states(b, k), "__id long, top double, total double, best array<struct<place_ord:bigint,place:string,logit:double>>")
    merged = states.groupBy("__id").agg(F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("top", "total"))).alias("parts"), F.flatten(F.collect_list("best")).alias("best"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["total"] * F.exp(x["top"] - F.col("top")))
    ranked = F.slice(F.array_sort(F.transform("best", lambda x: F.struct((-x["logit"]).alias("neg"), x["place_ord"].alias("ord"), x["place"].alias("place")))), 1, k)
    merged = merged.withColumn("total", total).withColumn("top_k", F.transform(ranked, lambda x: F.struct(x["place"].alias("place"), (F.exp(-x["neg"] - F.col("top")) / F.col("total")).alias("score"))))
    first = F.get("top_k", F.lit(0))
    return asked.select("__id", "row_id").join(merged, "__id").select("row_id", first["place"].alias("city"), first["score"].alias("confidence"), "top_k")


def reply_predictions(replies: DataFrame, places: DataFrame, k: int = 5) -> DataFrame:
    """Adds city, confidence, top_k, failed, error_class and outcome to replies.

    The first k entries of a reply's list are read; of these the catalogue's places with a finite confidence stay, in the
    reply's order and with repeats.  No JSON object: failed.  No entry left: failed too, with outcome no_catalogue_place.
    """
    names = places.agg(F.map_from_entries(F.collect_list(F.struct(F.lower("name"), "name"))).alias("names"))
    t = replies.withColumn("json", extract_json("reply"))
    raw = F.coalesce(F.from_json("json", "top_k array<array<string>>")["top_k"], F.array().cast("array<array<string>>"))
    t = t.withColumn("raw", F.slice(raw, 1, k)).join(F.broadcast(names), F.lit(True))
    fine = F.filter(F.transform("raw", lambda e: F.struct(F.col("names")[F.lower(F.get(e, F.lit(0)))].alias("place"), confidence(F.get(e, F.lit(1))).alias("score"))), lambda x: x["place"].isNotNull() & x["score"].isNotNull())
    t = t.withColumn("top_k", fine)
    unread, empty = F.col("json").isNull(), F.size("top_k") == 0
    return (
        t.withColumn("city", F.get("top_k", F.lit(0))["place"])
        .withColumn("confidence", F.coalesce(F.get("top_k", F.lit(0))["score"], F.lit(0.0)))
        .withColumn("failed", unread | empty)
        .withColumn("error_class", F.when(unread, "ValueError").when(empty, "NoCatalogueCity"))
        .withColumn("outcome", F.when(~unread & empty, "no_catalogue_place"))
        .drop("raw", "names", "json")
    )


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd and cost_is_estimated; a model without a price has no cost, never another's."""
    out = calls.join(checked(prices.select("model", "usd_in", "usd_out")), "model", "left")
    return out.withColumn("cost_usd", F.col("in_tokens") * F.col("usd_in") + F.col("out_tokens") * F.col("usd_out")).withColumn("cost_is_estimated", F.col("cost_usd").isNotNull()).drop("usd_in", "usd_out")


def describe(style: str) -> Column:
    """What an encoder embeds for a place: its bare name, an account of it, or a passage from its profile."""
    if style == "name":
        return F.col("name")
    if style == "account":
        return F.concat(F.lit("a social media user from "), F.col("name"))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return F.concat(F.lit("passage: "), F.concat_ws(". ", "name", listed("also known as ", F.col("aliases")), listed("landmarks include ", F.col("landmarks")), listed("local foods include ", F.col("foods")), F.nullif(F.trim("notes"), F.lit(""))))


#: What a prompt may end with, for models that talk around their answer.
ONLY_JSON = "\nAnswer with the JSON object alone, without a word around it."


def prompts(texts: DataFrame, places: DataFrame, k: int = 5, closing: str = "") -> DataFrame:
    """Adds prompt: the catalogue in its order, what to return, the text, and ``closing`` (empty, or ONLY_JSON)."""
    names = places.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    ask = F.format_string("Choose up to %d places from this list: %s. Answer as JSON {\"top_k\": [[place, confidence], ...]}.\nText: %s%s", F.lit(k), F.col("names"), F.col("text"), F.lit(closing))
    return texts.join(F.broadcast(names), F.lit(True)).withColumn("prompt", ask).drop("names")


#: Most texts, and bytes of texts, that an encoder is given at once; one longer text is given alone.
EMBED_TEXTS, EMBED_BYTES = 1024, 2**21


def _pieces(batch, column: str):
    """An Arrow batch in slices of at most EMBED_TEXTS rows and EMBED_BYTES of text; a slice has a row at least."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0)):
        n = n.as_py()
        if i > start and (i - start == EMBED_TEXTS or size + n > EMBED_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds vector by a caller's encoder, a bounded batch of texts at a time; a null text has a null vector.

    ``keep``: the columns to give back, all unless named; what isn't needed any more doesn't come back from the workers.
    """
    kept, kinds = texts.columns if keep is None else keep, dict(texts.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _pieces(batch, column):
                some = part.column(column)
                vectors = iter(encode(some.drop_null().to_pylist()))
                found = pa.array((next(vectors) if v else None for v in some.is_valid().to_pylist()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], [*kept, "vector"])

    return texts.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "vector array<double>"]))


def stored_vectors(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], path: str, model: str, template: str = "") -> DataFrame:
    """texts (text, ...) with vector, from a store of vectors at ``path`` that keeps what has been embedded.

    The store is a table keyed by model, template and the text's digest.  What it lacks is embedded, each different text once,
    and appended; so a second run embeds nothing.  A run that fails has appended nothing or whole files, and is made good
    by the next.  Null texts have null vectors.
    """
    spark = texts.sparkSession
    kind = "model string, template string, digest string, vector array<double>"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    own = lambda t: t.filter((F.col("model") == model) & (F.col("template") == template)).select("digest", "vector")
    keyed = texts.withColumn("__digest", F.sha2("text", 256))
    wanted = keyed.filter(F.col("text").isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.min("text").alias("text"))
    if found:
        wanted = wanted.join(own(spark.read.schema(kind).parquet(path)), "digest", "left_anti")
    wanted = written(wanted)
    if wanted.limit(1).count():
        embed(wanted, encode, keep=["digest"]).select(F.lit(model).alias("model"), F.lit(template).alias("template"), "digest", "vector").write.mode("append").parquet(path)
        found = True
    if not found:
        return keyed.drop("__digest").withColumn("vector", F.lit(None).cast("array<double>"))
    # Two runs at once may both have appended a text: one of its vectors is taken.
    store = own(spark.read.schema(kind).parquet(path)).groupBy(F.col("digest").alias("__d")).agg(F.min("vector").alias("vector"))
    return keyed.join(store, F.col("__digest") == F.col("__d"), "left").drop("__digest", "__d")


def check_predictions(predictions: DataFrame) -> DataFrame:
    """Rows of an engine that break the contract, with the fault: the four states exclude each other."""
    fault = (
        F.when(F.col("row_id").isNull() | F.col("engine").isNull(), "no key")
        .when(F.col("skipped") & (F.col("failed") | (F.size("top_k") > 0)), "skipped with an answer")
        .when(F.col("failed") & (F.col("city").isNotNull() | (F.size("top_k") > 0)), "failed with an answer")
        .when(F.col("abstain") & F.col("city").isNotNull(), "abstains with a place")
        .when(~F.col("confidence").between(0, 1), "confidence out of range")
    )
    return predictions.withColumn("fault", fault).filter(F.col("fault").isNotNull())


LEVELS = ("post", "user")


def known_engines(names: list[str], roster: DataFrame) -> list[str]:
    """names, unless the roster lacks some of them: unknown engines are refused by name."""
    have = {r["engine"] for r in roster.filter(F.col("engine").isin(list(names))).select("engine").collect()}
    if unknown := [n for n in names if n not in have]:
        raise ValueError(f"unknown engines: {', '.join(unknown)}")
    return list(names)


def register(roster: DataFrame, engine: str, level: str, third_party: bool = False, weight: float = 1.0) -> DataFrame:
    """The roster with a caller's engine as its last, so that dispatch, fusion and votes take it like any other."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if roster.filter(F.col("engine") == engine).limit(1).count():
        raise ValueError(f"{engine} is registered already")
    new = roster.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).cast("int").alias("ord")).select("ord", F.lit(engine).alias("engine"), F.lit(level).alias("level"), F.lit(third_party).alias("third_party"), F.lit(float(weight)).alias("weight"))
    return roster.unionByName(new)


def mean_pool(tokens: str | Column, mask: str | Column) -> Column:
    """Mean of the token vectors (array<array<double>>) whose mask is 1; null if none is."""
    tokens, mask = (F.col(c) if isinstance(c, str) else c for c in (tokens, mask))
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t)), lambda t: t.isNotNull())
    zero = F.array_repeat(F.lit(0.0), F.size(F.get(kept, F.lit(0))))
    total = F.aggregate(F.transform(kept, lambda t: t.cast("array<double>")), zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
