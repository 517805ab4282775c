"""Best-fit packing (operator 1): sum-of-squares bin packing of token pieces into fixed-length sequences."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .token_ids import id_encoder

#: Pieces packed together in one task.
GROUP = 4096
#: A sequence with more free places than this is opened again in the next round.
LOOSE = 24
ROUNDS = 3


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``size`` but the first, which takes the remainder."""
    first = n % size or min(n, size)
    return [(0, first), *((k, size) for k in range(first, n, size))]


def pack(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Sum-of-squares packing, in the order given: each item's bin and place, and each bin's free places.

    open_at[g] counts open bins with g free places.  An item goes where the sum of the squares of these counts becomes
    smallest, into an open bin or a new one; ties go to the fullest open bin.
    """
    import numpy as np

    open_at = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, places, free = [], [], []
    for n in lengths:
        here = open_at[n:]
        change = np.where(here > 0, 2 * (open_at[: size - n + 1] - here) + 2, np.iinfo(np.int64).max)
        if here[0]:
            change[0] = 1 - 2 * here[0]
        fresh = 2 * open_at[size - n] + 1 if n < size else 0
        gap = n + int(change.argmin())
        if change[gap - n] <= fresh:
            b = stacks[gap].pop()
            open_at[gap] -= 1
        else:
            b = len(free)
            free.append(size)
        bins.append(b)
        places.append(size - free[b])
        free[b] -= n
        if free[b]:
            open_at[free[b]] += 1
            stacks[free[b]].append(b)
    return bins, places, free


def pieces(docs: DataFrame, *, tokenizer: str, ranks: str | None, pattern: str | None, size: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  Narrow: no shuffle, one pass over the texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = id_encoder(tokenizer, ranks, pattern), end_id.to_bytes(4, sys.byteorder)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.ids(text.as_py() or "") + end
                if sys.byteorder == "big":
                    ids = b"".join(ids[i : i + 4][::-1] for i in range(0, len(ids), 4))
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    for column, x in zip(out, (doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _round(items: DataFrame, groups: int, size: int, number: int) -> DataFrame:
    """Items dealt to groups by a hash of their row number and packed within each; adds sequence_id, offset and free.

    Rows are numbered, so repeated rows are dealt like any others.  Sequences are numbered by group, round and, in the
    lower half, place in the group, which no group that fits a task can exceed.
    """

    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key, t):
        import pyarrow as pa

        t = t.select(names).sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "row"))])
        bins, places, free = pack(t.column("length").to_pylist(), size)
        long = lambda values: pa.array(values, pa.int64())
        t = t.append_column("sequence_id", long([((key[0].as_py() * ROUNDS + number) << 32) + 2 * b for b in bins]))
        return t.append_column("offset", long(places)).append_column("free", long([free[b] for b in bins]))

    dealt = items.select(*names, F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long")


def best_fit_packing(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs every document's ids, with ``end_id`` after them, into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole pieces of ``size`` tokens fill a sequence each.  The remainders, at most one per document, are dealt to groups
    of about 4096 and packed there, longest first, by the sum-of-squares rule.  Sequences left with over 24 free places are
    opened again, and their items, ever fewer, are dealt anew and packed among themselves; the third round is final.
    No row is lost and no task sees more than a group, whatever a source or document is.

    Null or empty text: one piece that holds end_id alone.  Null doc_id: kept as null.  Repeated rows: each is a document
    of its own, with pieces of its own, dealt to groups like any others.  Ties in length go by doc_id, piece, digest and
    row.  Very long texts are cut as any other.  Empty table: no rows.  Other columns of docs are ignored, whatever their
    names.
    """
    cuts = pieces(docs, tokenizer=tokenizer, ranks=ranks, pattern=pattern, size=size, end_id=end_id)
    cuts = saved(cuts.withColumn("row", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = cuts.filter(F.col("length") == size).select("*", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(names)
    items = cuts.filter(F.col("length") < size)
    for number in range(ROUNDS):
        groups = max(1, -(-items.count() // GROUP))
        packed = saved(_round(items, groups, size, number))
        last = number == ROUNDS - 1
        out = out.unionByName((packed if last else packed.filter(F.col("free") <= LOOSE)).select(names))
        items = packed.filter(F.col("free") > LOOSE)
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer=P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)
