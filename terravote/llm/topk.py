"""Exact top-k search (operator 10): three-phase uniform threshold over vertically split score lists.

A vector's dimensions are split into parts that lie in rows, and so in tasks, of their own.  A part's scores of all
candidates for a query are one list; a candidate's score is its sum over the lists.

Phase one gathers the k best entries of each list and adds what the other lists give them: the k-th best sum is a safe
cutoff, as k candidates reach it.  Phase two sends the cutoff with the queries, and each list returns its entries of at
least cutoff / lists: a candidate below that in every list can't reach the cutoff.  Candidates that every list returned
raise the cutoff; those that fall short of it even with the most that the other lists can add are out.  Phase three looks up
what is missing of the others, and ranks the sums.

Candidates stay where they are, in blocks of bounded size; queries come to them in batches of bounded size by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Queries of a batch, which is what is broadcast at once; candidates of a block; parts of a vector.
QUERY_ROWS, ROWS, PARTS = 4096, 4096, 2
#: Queries whose scores of a block a task holds at once, and pairs that one look-up row holds at most, about.
AT_ONCE, PAIRS = 256, 1 << 16
#: Beyond this a sum of products may not be exact in double precision, and exact integers are used instead.
EXACT = float(2**53)


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) with floor(256 x), of the rows whose vector is whole."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return df.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.expr("double(1)") * F.floor(e * 256)).alias("v"))


def _vectors(column):
    """Ids and matrix of one array<struct<id, v>> value."""
    import numpy as np

    rows = column.flatten()
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    return ids, np.array(rows.field("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)


def _scores(q, v):
    import numpy as np

    if not len(q) or not len(v) or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _best(scores, ids, k: int):
    """Where each query's k best entries stand, ties to the smaller id."""
    import numpy as np

    n = scores.shape[1]
    order = np.argsort(ids, kind="stable")
    scores = scores[:, order]
    keep = np.ones(scores.shape, bool)
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above, tie = scores > least, scores == least
        keep = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    i, j = np.nonzero(keep)
    return i, order[j]


def _lists(batches: Iterator, choose) -> Iterator:
    """For each row of a block and a batch of queries the entries that ``choose(scores, query slice, ids, batch row)`` picks."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)
            ids, v = _vectors(one.column("vectors"))
            qids, q = _vectors(one.column("queries"))
            for at in range(0, len(qids), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                scores = _scores(q[part], v)
                i, j = choose(scores, qids[part], ids, part, one)
                n = pa.array(np.full(len(i), one.column("part")[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(qids[part][i]), pa.array(ids[j]), n, pa.array(scores[i, j])], ["query_id", "vec_id", "part", "score"])


ENTRY = "query_id long, vec_id long, part int, score long"


def _missing(entries: DataFrame, blocks: DataFrame, queries: DataFrame, parts: int, row_blocks: int) -> DataFrame:
    """Entries (query_id, vec_id, part, score) of the lists that ``entries`` (query_id, vec_id, have array<part>) lacks.

    Pairs are sent to the block that holds their candidate, in rows of bounded size; vectors are not moved.
    """
    lacks = entries.select("query_id", "vec_id", F.explode(F.array_except(F.array(*(F.lit(p) for p in range(parts))), "have")).alias("part"))
    lacks = saved(lacks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")))
    sizes = lacks.groupBy("part", "block").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / PAIRS).cast("int"))
    chunks = lacks.join(sizes, ["part", "block"]).withColumn("chunk", F.pmod(F.xxhash64("query_id", "vec_id", F.lit(1)), F.col("chunks")))
    asked = chunks.groupBy("part", "block", "chunk").agg(F.collect_list("query_id").alias("qs"), F.collect_list("vec_id").alias("vs"))

    def look_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                ids, v = _vectors(one.column("vectors"))
                qids, q = _vectors(one.column("queries"))
                qs, vs = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("qs", "vs"))
                by_q, by_v = np.argsort(qids), np.argsort(ids)
                i, j = by_q[np.searchsorted(qids, qs, sorter=by_q)], by_v[np.searchsorted(ids, vs, sorter=by_v)]
                score = np.empty(len(i), np.int64)
                for at in range(0, len(i), 4096):
                    a, b = q[i[at : at + 4096]], v[j[at : at + 4096]]
                    exact = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT
                    score[at : at + 4096] = (a * b).sum(axis=1) if exact else (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
                n = pa.array(np.full(len(i), one.column("part")[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(vs), n, pa.array(score)], ["query_id", "vec_id", "part", "score"])

    return asked.join(blocks, ["part", "block"]).join(F.broadcast(queries), "part").select("part", "vectors", "queries", "qs", "vs").mapInArrow(look_up, ENTRY)


def _search(blocks: DataFrame, queries: DataFrame, k: int, parts: int, row_blocks: int) -> tuple[DataFrame, DataFrame]:
    """One batch of queries: its ranked results, and its collected entries.  ``queries`` has a row per part."""

    def gather(batches: Iterator) -> Iterator:
        import numpy as np

        def choose(scores, qids, ids, part, one):
            own = qids[:, None] == ids[None, :]
            i, j = _best(np.where(own, np.iinfo(np.int64).min, scores), ids, k)
            other = ~own[i, j]
            return i[other], j[other]

        return _lists(batches, choose)

    met = lambda q: blocks.join(F.broadcast(q), "part")
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    # Phase one: the lists' best entries, and what these candidates have in the other lists.
    top = met(queries).mapInArrow(gather, ENTRY).withColumn("rank", F.row_number().over(best("query_id", "part"))).filter(F.col("rank") <= k)
    top = saved(top.drop("rank"))
    known = top.groupBy("query_id", "vec_id").agg(F.collect_list("part").alias("have"), F.sum("score").alias("score"))
    rest = _missing(known, blocks, queries, parts, row_blocks).groupBy("query_id", "vec_id").agg(F.sum("score").alias("rest"))
    sums = known.join(rest, ["query_id", "vec_id"], "left").select("query_id", "vec_id", (F.col("score") + F.coalesce("rest", F.lit(0))).alias("score"))
    cut = sums.withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    greatest = top.groupBy("query_id").pivot("part", list(range(parts))).agg(F.max("score"))
    limits = greatest.join(cut, "query_id").select("query_id", "cutoff", F.array(*(F.col(str(p)) for p in range(parts))).alias("most"))
    every = F.aggregate("most", F.lit(0).cast("long"), lambda a, x: a + x)
    threshold = F.transform("most", lambda m: F.when(F.col("cutoff").isNull(), F.lit(-(2**62))).otherwise(F.greatest(F.ceil(F.col("cutoff") / parts), F.col("cutoff") - (every - m))).cast("long"))
    limits = saved(limits.withColumn("least", threshold))
    # Phase two: the queries go out with their thresholds: the uniform one, or what the other lists' greatest leave.
    table_of = queries.select("part", F.explode("queries").alias("x")).select("part", F.col("x.id").alias("query_id"), F.col("x.v").alias("v")).join(limits, "query_id")
    informed = table_of.groupBy("part").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "v", F.get("least", F.col("part")).alias("least"))).alias("queries"))

    def collect(batches: Iterator) -> Iterator:
        import numpy as np

        def choose(scores, qids, ids, part, one):
            least = one.column("queries").flatten().field("least").to_numpy(zero_copy_only=False)[part]
            return np.nonzero((scores >= least[:, None]) & (qids[:, None] != ids[None, :]))

        return _lists(batches, choose)

    entries = saved(met(informed).mapInArrow(collect, ENTRY))
    seen = saved(entries.groupBy("query_id", "vec_id").agg(F.collect_list("part").alias("have"), F.sum("score").alias("score")))
    # Candidates that every list returned are known, and the k-th best of them may raise the cutoff.  A list that did not
    # return a candidate adds less than its threshold, and no more than its greatest entry.
    known = seen.filter(F.size("have") == parts).withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") == k).select("query_id", F.col("score").alias("raised"))
    raised = saved(limits.join(known, "query_id", "left").withColumn("cutoff", F.greatest("cutoff", "raised")).select("query_id", "cutoff", F.zip_with("most", "least", lambda m, t: F.least(m, t - 1)).alias("bound")))
    more = F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0).cast("long"), lambda a, p: a + F.when(F.array_contains("have", p), F.lit(0)).otherwise(F.get("bound", p)))
    seen = seen.join(raised, "query_id").filter(F.col("cutoff").isNull() | (F.col("score") + more >= F.col("cutoff")))
    seen = saved(seen.select("query_id", "vec_id", "have", "score"))
    # Phase three: the missing scores of those that can still reach the cutoff.
    rest = _missing(seen, blocks, queries, parts, row_blocks).groupBy("query_id", "vec_id").agg(F.sum("score").alias("rest"))
    full = seen.join(rest, ["query_id", "vec_id"], "left").select("query_id", "vec_id", (F.col("score") + F.coalesce("rest", F.lit(0))).alias("score"))
    ranked = full.withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") <= k)
    return saved(ranked.select("query_id", "rank", "vec_id", "score")), entries


def top_k(df: DataFrame, *, every: int = 50, k: int = 5, parts: int = PARTS, query_rows: int = QUERY_ROWS, rows: int = ROWS, collected: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by ``every``.

    Exact: score is the integer inner product of floor(256 x), ties go to the smaller vec_id, a query's own row is no
    candidate, and all are given if there are fewer than k.  A task holds one part of ``rows`` vectors and of a batch of
    ``query_rows`` queries, which is broadcast; what is shuffled are the lists' best entries, the entries over the threshold
    and the pairs to look up.  ``collected`` takes each batch's table of entries over the threshold, for measurement.

    Null vectors, vectors with null or non-finite components and rows without vec_id take no part.  Rows that repeat a
    vec_id count once, with the greatest vector.  Vectors shorter than the longest count as padded with zeros.  Empty
    table: no rows.  Other columns are ignored, whatever their names.
    """
    whole = saved(quantised(df).groupBy("vec_id").agg(F.max("v").alias("v")))
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    n, width = size["n"], max(size["width"] or 0, 1)
    parts = min(parts, width)
    row_blocks, batches = max(1, -(-n // rows)), max(1, -(-size["asked"] // query_rows))
    padded = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    edges = [width * p // parts for p in range(parts + 1)]
    split = F.array(*(F.struct(F.lit(p).alias("part"), F.slice("v", a + 1, b - a).alias("v")) for p, (a, b) in enumerate(zip(edges, edges[1:]))))
    cut = padded.select("vec_id", F.explode(split).alias("x")).select("vec_id", "x.part", "x.v")
    one = F.struct(F.col("vec_id").alias("id"), "v")
    blocks = saved(cut.groupBy("part", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("block")).agg(F.collect_list(one).alias("vectors")))
    asked = saved(cut.filter(F.col("vec_id") % every == 0).groupBy("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(batches)).cast("int").alias("batch")).agg(F.collect_list(one).alias("queries")))
    out = None
    for b in range(batches):
        found, entries = _search(blocks, asked.filter(F.col("batch") == b).select("part", "queries"), k, parts, row_blocks)
        out = found if out is None else out.unionByName(found)
        if collected is not None:
            collected.append(entries)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
