"""Mixing sources to target weights (operator 9): multivariate-hypergeometric splitting tree over permuted blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, prefix_sums, saved, table

SEED = 20_240_613
#: Documents of a block, on average, words of an output shard, and blocks among whose documents the last partial pass
#: is filled up.
BLOCK, SHARD_WORDS, EDGE = 64, 4_000_000, 4
#: A source's target stops at so many times its size.
MOST = 3
#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sized (doc_id, source, size, text_hash, perhaps row) with draw, a document's place in the permutation: a saved table of
    it without row, to plan with, and the rows.

    The draw is a hash of seed, source, doc_id, size, text and, among rows that agree in all of these, their number: so
    repeated rows have draws of their own, and which of them has which is of no matter.  Only if there are such rows
    are rows saved, with a number; they are numbered within ranges of their order of writing, whatever their number.
    """
    key = ["doc_id", "source", "size", "text_hash"]
    draw = lambda nth: F.xxhash64(F.lit(SEED), *key, nth)
    keys = saved(sized.select(*key))
    again = saved(keys.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1"))
    if not again.limit(1).count():
        first = draw(F.lit(0).cast("long"))
        planned = keys.withColumn("draw", first)
        return planned, sized.withColumn("draw", first) if "row" in sized.columns else planned
    known = join_small(saved(sized.withColumn("number", F.monotonically_increasing_id())), again, key)
    once = known.filter(F.col("rows").isNull()).withColumn("nth", F.lit(0).cast("long"))
    many = known.filter(F.col("rows").isNotNull()).withColumn("one", F.lit(1).cast("long"))
    many = prefix_sums(many, key, F.shiftright("number", 33) * (1 << 20) + F.expr("number % 8589934592 div 65536"), [F.col("number")], {"nth": "one"}).drop("one")
    rows = saved(once.unionByName(many).withColumn("draw", draw(F.col("nth"))).drop("number", "rows", "nth"))
    return rows.select(*key, "draw"), rows


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, docs) with target: weight shares of all sizes, none above ``most`` times its own size.

    A source that reaches its stop leaves the rest to the others by weight: target = least(most * size, weight * level),
    where the level is found along the order of most * size / weight.  One row per source; nothing per document.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double"))
    s = s.withColumn("stop", most * F.col("source_size").cast("double")).withColumn("turn", F.col("stop") / F.col("w"))
    by_turn = Window.orderBy("turn", F.asc_nulls_last("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.coalesce(F.sum("stop").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - below) / F.sum("w").over(by_turn.rowsBetween(0, Window.unboundedFollowing))).withColumn("at", F.row_number().over(by_turn))
    level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("at", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least("stop", F.col("w") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "docs", "target")


def split(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(source, quota) dealt exactly to ``shards`` shards: (source, shard, quota).

    The root holds every source's number of block draws.  Each node gives its left half a multivariate hypergeometric
    draw from its counts, of the left half's share of draws, and its right half the rest.  A level of the tree is one
    grouped pass in which a task holds one row per source; the draws depend on seed and node alone.
    """

    def halve(key, pdf):
        import numpy as np
        import pandas as pd

        low, high = key
        if high - low == 1:
            return pdf[["low", "high", "source", "quota"]]
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        middle, counts = (low + high) // 2, pdf["quota"].to_numpy(np.int64)
        take = int(counts.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, take, method="marginals")
        parts = [pdf.assign(low=low, high=middle, quota=left), pdf.assign(low=middle, high=high, quota=counts - left)]
        return pd.concat([p[p["quota"] > 0] for p in parts])[["low", "high", "source", "quota"]]

    rows = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "source", F.col("quota").cast("long").alias("quota"))
    for _ in range((shards - 1).bit_length()):
        rows = rows.groupBy("low", "high").applyInPandas(halve, rows.schema)
    return rows.select("source", F.col("low").alias("shard"), "quota")


class Mix:
    """The plan of a mix: per source its size, target and blocks; per block its draws.  Two saved tables, nothing per document."""

    def __init__(self, sized: DataFrame, seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS):
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        sources = targets(sizes).withColumn("blocks", F.ceil(F.col("docs") / block).cast("long"))
        ratio = F.col("target") / F.col("source_size")
        whole = F.when(F.col("source_size") > 0, F.floor(ratio + 1e-12)).otherwise(0).cast("int")
        self.sources = saved(sources.withColumn("epochs", whole).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))))
        placed = self._place(sized)
        blocks = placed.groupBy("source", "block", "epochs", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).withColumn("order", F.xxhash64(F.lit(seed), "source", "block"))
        blocks = saved(prefix_sums(blocks.withColumn("one", F.lit(1).cast("long")), ["source"], F.shiftright("order", 54), ["order", "block"], {"before": "words", "rank": "one"}))
        # In the last, partial pass whole blocks are taken while they fit.  Of the documents of the block at the edge and
        # of those after it, each is taken in order if it still fits, and at last the smallest one left, if that brings
        # the sum nearer.
        here = F.col("before") + F.col("words") > F.col("rest")
        edge = blocks.filter((F.col("before") <= F.col("rest")) & here).groupBy("source").agg(F.min("rank").alias("edge_rank"), F.min("before").alias("edge_before"))
        blocks = join_small(blocks, saved(edge), ["source"]).withColumn("edge", F.coalesce((F.col("rest") > 0) & F.col("rank").between(F.col("edge_rank"), F.col("edge_rank") + EDGE - 1), F.lit(False)))
        edges = join_small(placed.select("source", "block", "draw", "size"), saved(blocks.filter("edge").select("source", "block", "rank", "rest", "edge_before")), ["source", "block"]).filter(F.col("rank").isNotNull())
        edges = edges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "draw", F.col("size").cast("double").alias("words")))).alias("docs"), F.first(F.col("rest") - F.col("edge_before")).alias("left"))
        start = F.struct(F.col("left"), F.array().cast("array<bigint>").alias("picked"))
        fit = lambda a, x: F.when(x["words"] <= a["left"], F.struct((a["left"] - x["words"]).alias("left"), F.array_append(a["picked"], x["draw"]).alias("picked"))).otherwise(a)
        edges = edges.withColumn("run", F.aggregate("docs", start, fit))
        rest = F.array_min(F.transform(F.filter("docs", lambda x: ~F.array_contains("run.picked", x["draw"])), lambda x: F.struct(x["words"].alias("words"), x["draw"].alias("draw"))))
        edges = edges.withColumn("least", rest)
        more = F.coalesce(F.col("least.words") < 2 * F.col("run.left"), F.lit(False))
        edges = edges.select("source", F.when(more, F.array_append("run.picked", F.col("least.draw"))).otherwise(F.col("run.picked")).alias("picked"))
        blocks = join_small(blocks, saved(edges), ["source"]).withColumn("full", (F.col("before") + F.col("words") <= F.col("rest")) & ~F.col("edge"))
        blocks = blocks.withColumn("picked", F.when(F.col("edge"), F.col("picked")))
        blocks = blocks.withColumn("draws", F.col("epochs") + (F.col("full") | F.col("edge")).cast("int"))
        total = self.sources.agg(F.sum("target")).first()[0] or 0.0
        self.shards = max(1, -(-int(total) // shard_words))
        self.blocks = saved(self._deal(blocks.filter("draws > 0")).select("source", "block", "full", "picked", "shards"))

    def _place(self, sized: DataFrame) -> DataFrame:
        """Adds the source's figures, and each document's block."""
        out = join_small(sized, self.sources.select("source", "source_size", "target", "blocks", "epochs", "rest"), ["source"])
        return out.withColumn("block", F.pmod(F.shiftright("draw", 7), F.col("blocks")))

    def _deal(self, blocks: DataFrame) -> DataFrame:
        """Adds the array of shards that take the block, one for each draw.

        A source's draws are numbered pass by pass in the blocks' permuted order, and its quotas cut this line into
        disjoint ranges.  Ranges and draws meet in cells about as wide as a quota, not each with each.
        """
        quotas = blocks.groupBy("source").agg(F.sum("draws").alias("quota"))
        to = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranges = split(quotas, self.shards).withColumn("end", F.sum("quota").over(to)).withColumn("begin", F.col("end") - F.col("quota"))
        wide = blocks.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.sum("draws") / self.shards)).cast("long").alias("wide"), F.count("*").alias("whole"))
        wide = saved(wide)
        ranges = join_small(ranges, wide.select("source", "wide"), ["source"])
        ranges = ranges.withColumn("cell", F.explode(F.sequence(F.expr("begin div wide"), F.expr("(end - 1) div wide")))).select(F.col("source").alias("rs"), "cell", "begin", "end", "shard")
        # Passes are numbered over the blocks that have a draw in them: all of them, then those of the last, partial pass.
        each = join_small(blocks, wide, ["source"]).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("draws") - 1))).withColumn("draw_no", F.col("pass") * F.col("whole") + F.col("rank"))
        each = each.withColumn("cell", F.expr("draw_no div wide"))
        met = each.join(ranges, each["source"].eqNullSafe(ranges["rs"]) & (each["cell"] == ranges["cell"]) & (F.col("draw_no") >= F.col("begin")) & (F.col("draw_no") < F.col("end")))
        return met.groupBy("source", "block", "full", "picked").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))

    def apply(self, sized: DataFrame) -> DataFrame:
        """Adds source_size, target and shards, the array of shards that take the row (empty if none does)."""
        placed = self._place(sized)
        out = join_small(placed, self.blocks, ["source", "block"])
        again = F.col("full") | F.coalesce(F.array_contains("picked", F.col("draw")), F.lit(False))
        shards = F.coalesce(F.slice("shards", F.lit(1), F.col("epochs") + again.cast("int")), F.array().cast("array<bigint>"))
        return out.withColumn("shards", shards).select(*sized.columns, "source_size", "target", "shards")


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of docs.

    size counts the text's words; target is the source's; taken is size times the number of draws, which differ by at
    most one within a source; shards names the output shard of each draw.  A source's taken words miss its
    target by half a document at most, namely of the smallest one left of four blocks.  Reruns agree: all draws are hashes.

    Null text: size 0.  Null source: a source of its own, the last.  Null doc_id: a row like any other.  Repeated rows have
    draws of their own.  Very long texts are counted whole.  Sources of size 0 have target 0 and nothing is taken.  Empty
    table: no rows.  Other columns are ignored, whatever their names.
    """
    planned, sized = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")))
    return Mix(planned).apply(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row once per draw, brought to its shard and shuffled there; same columns.

    Which rows are taken how often is as in ``mix_sources``, nulls, empty and very long texts, ties and repeated rows
    included; rows that agree in doc_id, source and text but not elsewhere are told apart by their order.  Empty table: no
    rows.  All columns stay as they are, whatever their names.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    planned, sized = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), row))
    out = Mix(planned).apply(sized).select("row", "draw", F.posexplode("shards").alias("nth", "shard")).withColumn("order", F.xxhash64(F.lit(SEED), "shard", "draw", "nth"))
    return out.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
