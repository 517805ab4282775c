"""Source divergence audit (operator 13): token-start pointer sort.

A shard is some megabytes of whole texts in an Arrow buffer.  Every word start in it becomes a pointer; a multikey quicksort
brings the pointers into the words' order, eight bytes of a word at a time, without copying a word.  Equal words are then a
run of pointers: its length by language and source is the count, the changes of document along it the document frequency.
Shards' counts are added up by Spark; what follows is exact integer arithmetic on them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, saved, table

#: Bytes of text of a shard (a longer document is a shard of its own), and pointers below which a slice is sorted outright.
SHARD, SLICE = 8 << 20, 1 << 15
#: Pairs of sources of the same term that a task holds before it adds them up.
PAIRS = 1 << 20
#: Documents of a language that a term needs; terms reported for a group; what a probability of one is.
LEAST_DOCS, TERMS, ONE = 3, 200, 1_000_000_000


def _keys(data, starts, lengths, depth: int):
    """Bytes depth to depth + 8 of each word as one big-endian number, zeros after its end.  No word holds a zero byte."""
    import numpy as np

    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    left = np.clip(lengths - depth, 0, 8)
    key = view[np.minimum(starts + depth, len(data) - 8)].astype(np.uint64)
    empty = (8 * (8 - left)).astype(np.uint64)
    return np.where(left > 0, key >> np.minimum(empty, 63) << np.minimum(empty, 63), 0)


def _finish(data, starts, lengths, p, depth: int):
    """Sorts the pointers of a small slice, all unfinished runs together; returns them and each one's first of its run."""
    import numpy as np

    run, at = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(at):
        key = _keys(data, starts[p[at]], lengths[p[at]], depth)
        order = np.lexsort((key, run[at]))
        p[at], key = p[at][order], key[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (run[at][1:] != run[at][:-1])]))
        size = np.diff(np.append(head, len(at)))
        run[at] = np.repeat(at[head], size)
        at = at[((key & 0xFF) != 0) & (np.repeat(size, size) > 1)]
        depth += 8
    return p, run


def pointer_sort(data, starts, lengths, slice_: int = SLICE):
    """Multikey quicksort of the words at ``starts``: pointers in the order of the words (equal words in the order of the
    text), and where each run of equal words begins.  ``data`` ends with eight bytes more than the texts."""
    import numpy as np

    sorted_parts, heads, done = [], [], 0
    todo = [(np.arange(len(starts)), 0)]  # slices still to sort, the first in order at the end
    while todo:
        p, depth = todo.pop()
        if not len(p):
            continue
        if depth < 0:  # a run of equal words
            heads.append(np.array([done]))
        elif len(p) <= slice_:
            p, run = _finish(data, starts, lengths, p, depth)
            heads.append(done + np.unique(run))
        else:
            key = _keys(data, starts[p], lengths[p], depth)
            sample = np.sort(key[:: max(1, len(key) // 9)])
            pivot = sample[len(sample) // 2]
            same = key == pivot
            ends = not int(pivot) & 0xFF
            todo += [(p[key > pivot], depth), (p[same], -1 if ends else depth + 8), (p[key < pivot], depth)]
            continue
        sorted_parts.append(p)
        done += len(p)
    return np.concatenate([np.empty(0, np.int64), *sorted_parts]), np.concatenate([np.empty(0, np.int64), *heads])


def _shards(batch, size: int) -> Iterator:
    """Slices of whole texts of about ``size`` bytes."""
    import numpy as np

    sizes = batch.column("text").cast("large_string")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _count(shard, slice_: int):
    """lang, source, term, n, docs of a shard."""
    import numpy as np
    import pyarrow as pa

    text = shard.column("text").cast("large_string")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    size = int(ends[-1] - ends[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    data[(data >= 65) & (data <= 90)] += 32
    ends = ends - ends[0]
    word = ((data >= 97) & (data <= 122)) | (data >= 128)
    before = np.concatenate([[False], word[:-1]])
    before[ends[:-1]] = False  # a text begins anew (an empty last one at the spare bytes, which hold no word)
    starts = np.flatnonzero(word & ~before)
    gap = ~word
    gap[ends] = True
    breaks = np.flatnonzero(gap)
    lengths = breaks[np.searchsorted(breaks, starts, "right")] - starts
    doc = np.searchsorted(ends, starts, "right") - 1
    langs, sources = (shard.column(c).dictionary_encode() for c in ("lang", "source"))
    pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    groups, group = np.unique(pair, return_inverse=True)

    p, heads = pointer_sort(data, starts, lengths, slice_)
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))
    key = run * len(groups) + group[doc[p]]
    first = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[p][1:] != doc[p][:-1])])[: len(p)]
    found, n = np.unique(key, return_counts=True)
    docs = np.bincount(np.searchsorted(found, key[first]), minlength=len(found)) if len(p) else n
    whole = data.tobytes()
    words = pa.array([whole[a : a + m].decode() for a, m in zip(starts[p[heads]].tolist(), lengths[p[heads]].tolist())], pa.string())
    of = groups[found % max(len(groups), 1)]
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(of // max(len(sources.dictionary), 1))), sources.dictionary.take(pa.array(of % max(len(sources.dictionary), 1))), words.take(pa.array(found // max(len(groups), 1))), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, shard_bytes: int = SHARD, slice_: int = SLICE) -> DataFrame:
    """lang, source, term, n, docs: how often a term occurs in a group's documents, and in how many of them."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for shard in _shards(batch, shard_bytes):
                yield _count(shard, slice_)

    each = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)); exact for counts of any size."""
    n = F.col(n) if isinstance(n, str) else n
    return F.lit(1).cast("long") + F.call_function("div", F.lit(ONE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)"), (F.col(total) + F.col(terms)).cast("decimal(20,0)"))


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square fits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _shared(batches: Iterator, most: int) -> Iterator:
    """lang, source, item, value: for all ordered pairs of sources of a term, by how much the value differs from that of
    two sources of which one at a time has the term; added up within the task before it is handed on."""
    import numpy as np
    import pyarrow as pa

    def f(p, q):
        return (p - q) * (p - q) // q

    for batch in batches:
        at = 0
        sizes = batch.column("of").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.cumsum(sizes * sizes)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + most, "right")))
            size = sizes[at:to]
            rows = batch.slice(at, to - at)
            flat = rows.column("of").flatten()
            source = flat.field("source").dictionary_encode()
            code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
            lang = rows.column("lang").dictionary_encode()
            langs = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            # One row for each ordered pair: its term's k-th number is the source k div size against the source k mod size.
            term = np.repeat(np.arange(len(size)), size * size)
            k = np.arange(len(term)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
            a, b = start[term] + k // size[term], start[term] + k % size[term]
            a, b, term = a[a != b], b[a != b], term[a != b]
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            m = len(source.dictionary)
            keys, inverse = np.unique((langs[term] * m + code[a]) * m + code[b], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, inverse, value)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys // (m * m))), source.dictionary.take(pa.array(keys // m % m)), source.dictionary.take(pa.array(keys % m)), pa.array(total)], ["lang", "source", "item", "value"])
            at = to


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, terms: int = TERMS, shard_bytes: int = SHARD, slice_: int = SLICE, at_once: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the words of a language's sources lie apart.

    Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII.  A language keeps the V terms that at least
    ``least_docs`` of its documents hold.  A group (lang, source) with N kept occurrences gives each kept term
    p = 1 + floor(10^9 (count + 1) / (N + V)).  Part ``pair`` has a row for each other source of the language: the sum over
    the kept terms of floor((p - q)^2 / q), q being its p (0 if V = 0).  Part ``term`` has the ``terms`` terms with the greatest
    floor((p - q)^2 / q) of those that the group holds and whose p exceeds the language's q.  Ranks go by value, then item.

    Only counts are shuffled, added up before.  Pairs of sources are not made term by term: a pair's sum is that of two
    groups without terms, corrected by either group's own counts (a row for each different count) and by the terms of both,
    which tasks add up before they hand them on.  A language's sources are held in one row of a term and in V rows in all.

    Null text, lang or source is the empty string.  Empty texts have no terms, and their groups are rows of ``pair`` alone.
    Very long texts are shards of their own.  Null doc_id and repeated rows: documents like any others.  Ties: by item, in
    the order of UTF-8 bytes.  Empty table, or one source a language and no kept terms: no rows.  Other columns are ignored,
    whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    counts = saved(term_counts(docs, shard_bytes, slice_))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "in_lang")
    kept = saved(kept)
    langs = saved(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total")))
    rows = saved(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = saved(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    groups = join_small(docs.select("lang", "source").distinct(), totals, ["lang", "source"])
    groups = saved(join_small(groups, langs, ["lang"]).select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total"))))
    priced = groups.filter("v > 0").select("lang", "source", "total", "v", "lang_total", _p(F.lit(0), "total", "v").alias("p0"))
    rows = saved(join_small(rows, priced, ["lang", "source"], how="inner").select("lang", "source", "term", "n", "p0", _p("n", "total", "v").alias("p"), _p("in_lang", "lang_total", "v").alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = rows.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    top = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= terms)

    # All ordered pairs of a language's sources, which is what the report has; none of them is joined with terms.
    base = groups.filter("v > 0").select("lang", "source", "v", _p(F.lit(0), "total", "v").alias("p0"))
    other = base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = saved(base.join(other, "lang").filter(F.col("source") != F.col("item")))
    often = saved(rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")))
    none = pairs.select("lang", "source", "item", (F.col("v") * _f("p0", "q0")).alias("value"))
    own = often.join(other, "lang").filter(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("m") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"))
    theirs = often.join(other, "lang").filter(F.col("source") != F.col("item")).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (_f("q0", "p") - _f("q0", "p0"))).alias("value"))
    both = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("of")).filter(F.size("of") > 1).select("lang", "of").mapInArrow(lambda b: _shared(b, at_once), "lang string, source string, item string, value long")
    empty = groups.filter("v = 0").select("lang", "source")
    without = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    summed = none.unionByName(own).unionByName(theirs).unionByName(both).unionByName(without).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return apart.unionByName(top)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(text,'') AS text, coalesce(lang,'') AS lang, coalesce(source,'') AS source FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row)>=3),
    v AS (SELECT lang, count(*) AS v, sum(c) AS t FROM k GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT d.lang, d.source, coalesce(any_value(s.t),0) AS t FROM d LEFT JOIN (SELECT lang, source, sum(c) AS t FROM n GROUP BY ALL) s ON d.lang=s.lang AND d.source=s.source GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n.c,0) AS c, 1+(1000000000::HUGEINT*(coalesce(n.c,0)+1))//(g.t+v.v) AS p, 1+(1000000000::HUGEINT*(k.c+1))//(v.t+v.v) AS q
      FROM g JOIN k ON k.lang=g.lang JOIN v ON v.lang=g.lang LEFT JOIN n ON n.lang=g.lang AND n.source=g.source AND n.term=k.term),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p-b.p)*(a.p-b.p))//b.p) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL
      UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
    term AS (SELECT lang, source, term AS item, ((p-q)*(p-q))//q AS value FROM p WHERE c>0 AND p>q),
    r AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
      UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part='pair' OR rank<=200"""
