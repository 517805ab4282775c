"""SimHash near-dedup (operator 4): byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 byte positions.  The index posts each
distinct fingerprint by byte position and value; the postings that a pair shares are tallied, pairs with 5 or more are
retained, and these are verified bit by bit.

A list of one position and value holds a 256th of all fingerprints or more, and its pairs would grow with their square.
So the index is built within cells: all fingerprints that agree in three positions.  There are eight such triples of
positions, of which any 5 positions contain one, so every wanted pair is in a cell together; inside, each pair has 3 matches
to begin with, and the postings of the other five positions give the rest of its tally.

A cell with more than LONG members is posted again under every set of five positions that contains its triple, where each
pair has the 5 matches already.  What is there differs in 24 bits at most; where that is still over WIDE members, they
are posted again under each quarter of those 24 bits, one of which is equal in any wanted pair.  So no task ever holds a
cell of more than 2**18 members, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_small, saved, table
from .components import components

BITS, BYTES, SHARED = 3, 8, 5
SEED = 42
#: Any 5 of the 8 positions include 3 of the first four or 3 of the last four.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(BYTES), SHARED))
#: Cells with more members than the first are posted again under five positions, and those with more than the second
#: again under the quarters of their other bits.
LONG, WIDE = 256, 4096
#: Pairs of postings that are tallied at once, about.
AT_ONCE = 1 << 20


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        h = np.array([xxh64_intdigest(s, SEED) for s in shingles[i : i + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp, carried columns) of docs (doc_id, text, carried columns): one narrow pass."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), prints, *(b.column(c) for c in carried)], ["doc_id", "fp", *carried])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *(StructField(c, kinds[c]) for c in carried)])
    return docs.select("doc_id", "text", *carried).mapInArrow(run, schema)


def _close(a, b):
    """The verification: which pairs differ in at most BITS bits."""
    import numpy as np

    return np.bitwise_count(a ^ b) <= BITS


def _postings_pairs(group):
    """(i, j), i < j, of all rows that share a group number."""
    import numpy as np

    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    sizes = np.diff(np.append(starts, len(order)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(order)) - 1  # rows of the group after each
    i = np.repeat(np.arange(len(order)), left)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
    a, b = order[i], order[j]
    return np.minimum(a, b), np.maximum(a, b)


def _tallied(cell, fps, positions):
    """Pairs of a cell that share enough byte postings; ``positions``: of each cell number, those its members agree in.

    Positions that the whole cell agrees in count from the start; each other position is an inverted index of its own by
    cell and byte value.
    """
    import numpy as np

    octets, n, codes = fps.view(np.uint8).reshape(-1, BYTES), len(fps), []
    given = np.zeros((len(positions), BYTES), bool)
    for k, own in enumerate(positions):
        given[k, list(own)] = True
    kind = cell[1]
    for p in range(BYTES):
        rows = np.flatnonzero(~given[kind, p])
        if len(rows):
            i, j = _postings_pairs(cell[0][rows] * 256 + octets[rows, p])
            codes.append(rows[i] * n + rows[j])
    pair, tally = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
    i, j = pair // n, pair % n
    keep = tally + given[kind[i]].sum(axis=1) >= SHARED if len(i) else np.zeros(0, bool)
    return i[keep], j[keep]


class _Forest:
    def __init__(self, n: int):
        import numpy as np

        self.parent = np.arange(n)

    def union(self, i, j) -> None:
        """Joins all pairs at once: the greater root of each is hung on the smaller, until nothing changes."""
        import numpy as np

        while True:
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up


def _join_cell(fps, free: int):
    """Root index of each fingerprint of one cell (distinct, sorted), whose members differ in the bits ``free`` alone and so
    have their matches already.

    A small cell is verified row by row; in a larger one each fingerprint's neighbours are looked up, all at once.
    """
    import numpy as np

    forest, n = _Forest(len(fps)), len(fps)
    if n <= 1024:
        for i in range(n - 1):
            hit = np.flatnonzero(_close(fps[i + 1 :], fps[i]))
            if len(hit):
                forest.union(np.full(len(hit), i), hit + i + 1)
        return forest.parent
    for size in range(1, BITS + 1):
        for bits in combinations([k for k in range(64) if free >> k & 1], size):
            other = fps ^ np.uint64(sum(1 << k for k in bits))
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero((fps[at] == other) & (other > fps))
            if len(hit):
                forest.union(hit, at[hit])
    return forest.parent


def _links(batches: Iterator, masks: list[int], positions: list[tuple] | None) -> Iterator:
    """Sorted rows (cell kind, key, fp) to links (a, b): with ``positions`` by tallies, else all of a cell have their matches.

    A cell is held only while it is read.
    """
    import numpy as np
    import pyarrow as pa

    kept = None

    def solve(t, key, fp):
        edge = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        number, sizes = np.cumsum(edge) - 1, np.diff(np.append(np.flatnonzero(edge), len(t)))
        if positions is None:
            for s, n in zip(np.flatnonzero(edge)[sizes > 1], sizes[sizes > 1]):
                fps = np.unique(fp[s : s + n])
                root = _join_cell(fps, ~masks[t[s]] & (2**64 - 1))
                hung = np.flatnonzero(root != np.arange(len(fps)))
                yield fps[hung], fps[root[hung]]
            return
        # Cells are taken together as long as their pairs are not too many.
        some = np.flatnonzero((sizes > 1)[number])
        load = np.cumsum(sizes[number[some]]) // AT_ONCE
        for part in (some[load == k] for k in np.unique(load)):
            i, j = _tallied((number[part], t[part]), np.ascontiguousarray(fp[part]), positions)
            near = _close(fp[part][i], fp[part][j])
            yield fp[part][j[near]], fp[part][i[near]]

    def frames(columns):
        for a, b in solve(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        if kept is not None and now[0][-1] == kept[0][0][0] and now[1][-1] == kept[0][1][0]:  # only carries the open cell on
            kept.append(now)
            continue
        if kept is not None:
            now = [np.concatenate([*(k[i] for k in kept), now[i]]) for i in range(3)]
        other = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
        last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if last:
            yield from frames([x[:last] for x in now])
        kept = [[x[last:] for x in now]]
    if kept is not None:
        yield from frames([np.concatenate([k[i] for k in kept]) for i in range(3)])


def _search(postings: DataFrame, masks: list[int], positions: list[tuple] | None) -> DataFrame:
    dealt = postings.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.select("t", "key", "fp").mapInArrow(lambda x: _links(x, masks, positions), "a long, b long")


def _post(fps: DataFrame, masks: list[int], numbers) -> DataFrame:
    """A row (t, key, fp) for each of the cells in the array column ``numbers``."""
    table_of = F.array(*(F.lit(m) for m in masks))
    return fps.select("fp", F.explode(numbers).alias("t")).select("t", F.col("fp").bitwiseAND(F.get(table_of, F.col("t"))).alias("key"), "fp")


def _larger(postings: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The postings of cells with up to ``most`` members, and those of the larger ones, if there are any."""
    cells = saved(postings.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    if not cells.limit(1).count():
        return postings, None
    known = join_small(postings, cells, ["t", "key"])
    return known.filter(F.col("n").isNull()), known.filter(F.col("n").isNotNull()).select("t", "key", "fp")


def links(distinct: DataFrame, long: int = LONG, wide: int = WIDE) -> DataFrame:
    """Pairs (a, b) of fingerprints that join up everything within BITS bits."""
    masks, fives = [_mask(p) for p in TRIPLES], [_mask(p) for p in FIVES]
    wider = F.array(*(F.array(*(F.lit(k) for k, five in enumerate(FIVES) if set(t) <= set(five))) for t in TRIPLES))
    few, many = _larger(_post(distinct.select("fp"), masks, F.array(*(F.lit(k) for k in range(len(masks))))), long)
    found = _search(few, masks, TRIPLES)
    if many is None:
        return found
    again = saved(_post(many.select("fp", F.explode(F.get(wider, F.col("t"))).alias("five")).distinct().select("fp", F.array("five").alias("f")), fives, F.col("f")))
    few, many = _larger(again, wide)
    found = found.unionByName(_search(few, fives, None))
    if many is None:
        return found
    quarters = []
    for five in FIVES:
        free = [b for b in range(64) if b // 8 not in five]
        quarters.append([_mask(five) | sum(1 << b for b in free[k : k + 6]) for k in range(0, 24, 6)])
    quarters = [m - (1 << 64) if m >> 63 else m for own in quarters for m in (x % (1 << 64) for x in own)]
    parts = _post(many.select("fp", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: 4 * F.col("t") + q).alias("q")), quarters, F.col("q"))
    return found.unionByName(_search(parts, quarters, None))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Fingerprints: 3-word shingles of the whole text, A-Z lower-cased, repeats included.  Equal fingerprints are taken
    together first, so copies cost one posting set; documents are joined to components by fingerprint.

    Null, empty or wordless text: fingerprint zero, linked like any other.  Fewer than three words: one shingle.  Null
    doc_id: the row stays and takes the smallest doc_id that is reachable, null if there is none.  Repeated rows: a row
    each.  Very long texts are read whole, one at a time in a task.  Ties: a bit set in just half of the shingles is 0, and a
    component takes its smallest doc_id, so nothing depends on the order of rows.  Empty table: no rows.  Other columns are
    ignored, whatever their names.
    """
    prints = saved(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    named = saved(_components(saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))).select("fp", "component_id"))
    return join_small(prints, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(distinct: DataFrame) -> DataFrame:
    """distinct (fp, first, the smallest doc_id with it) to fp, root fingerprint and component_id of its component."""
    found = components(links(distinct))
    placed = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id, then fingerprint, then text.

    Groups are of rows, whatever their doc_ids: rows that repeat a doc_id stay or go by their own texts.  Null doc_ids
    come last within a group, and rows without one are grouped like any other.  Null, empty and wordless texts have
    fingerprint zero, are linked like any other, and so leave one row.  Of rows that agree in doc_id and text one stays, the
    first by a hash of all columns that can be hashed.  Very long texts are read whole.  Empty table: no rows.  All columns
    stay as they are, whatever their names.

    Rows are saved with their fingerprint and a row number; the numbers of rows that go are looked up, so that a table
    whose groups are few or small is not shuffled.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(*hashed).alias("hash"))
    rows = saved(fingerprints(rows, "row", "hash").withColumn("number", F.monotonically_increasing_id()))
    keys = rows.select("number", "doc_id", "fp", "hash", F.xxhash64("row.text").alias("text_hash"))
    named = saved(_components(saved(keys.groupBy("fp").agg(F.min("doc_id").alias("first")))))
    # In a group of rows the first by this order stays; the order is the same in every run.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.hex("fp").alias("fp"), "text_hash", "hash", "number")
    own = keys.groupBy("fp").agg(F.min(order).alias("least"))
    least = saved(own.join(named, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.number").alias("number")))
    go = saved(keys.select("number").join(least, "number", "left_anti").withColumn("goes", F.lit(True)))
    return join_small(rows, go, ["number"]).filter(F.col("goes").isNull()).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
