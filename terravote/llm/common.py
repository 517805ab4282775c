"""Helpers shared by the training-data operators: shared-folder tables, size-checked joins, two-level prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravote.sources.shared import shared_dir

#: One word, as every operator here counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a table that may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whose tables are being saved, and the tables that owners have in the shared folder.
_owner: list[str] = []
_tables: dict[str, list[str]] = {}


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later readers neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _owner:
        _tables.setdefault(_owner[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables saved inside belong to ``name``, until ``removed`` takes them away."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def removed(spark: SparkSession, names: Iterable[str], reader: DataFrame) -> None:
    """Takes away the tables that belong to ``names``, but for those that ``reader`` reads.  Nothing is removed if reader is
    no table in files: what it is made from may be read later."""
    found = {n: _tables.pop(n, []) for n in names}
    if not any(found.values()):
        return
    needed = {f.rsplit("/", 1)[0] for f in reader.inputFiles()}
    read = lambda path: any(n.endswith(path.rsplit("/", 1)[-1]) for n in needed)
    for name, paths in found.items():
        for path in paths:
            if not needed or read(path):
                _tables.setdefault(name, []).append(path)
            else:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_small(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a (saved) table has no more rows than may be broadcast."""
    return small.limit(limit + 1).count() <= limit


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS, known: bool | None = None) -> DataFrame:
    """df joined to a table with at most one row per key; null keys match null keys.

    The small side is counted first (it should be a saved table), unless ``known`` tells what its count would.  Up to
    ``limit`` rows it is broadcast.  Beyond that it is an ordinary shuffled join, whose skewed partitions adaptive
    execution splits on df's side.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    right = small.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(c for c in small.columns if c not in keys))
    on = _all([df[k].eqNullSafe(right[n]) for k, n in zip(keys, names)])
    if known if known is not None else is_small(small, limit):
        right = F.broadcast(right)
    return df.join(right, on, how).drop(*names)


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def prefix_sums(df: DataFrame, group: Sequence[str], cell: Column, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums within each group, without bringing a whole group into one task.

    ``cell`` cuts a group into ordered ranges of the order (a row's cell never decreases along it).  Rows are sorted only
    within (group, cell); the cells' totals, one row each, carry the sum from cell to cell.  ``sums`` maps the new column
    to the summed one.  Null group keys form a group of their own.
    """
    df = df.withColumn("__cell", cell)
    cells = df.groupBy(*group, "__cell").agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()))
    over = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__cell").alias("__c"), *(F.coalesce(F.sum(f"__s_{n}").over(over), F.lit(0)).alias(f"__b_{n}") for n in sums))
    within = Window.partitionBy(*group, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()))
    on = [rows[g].eqNullSafe(cells[f"__g{i}"]) for i, g in enumerate(group)]
    out = rows.join(cells, _all([*on, rows["__cell"] == cells["__c"]]))
    return out.select(*(c for c in df.columns if c != "__cell"), *((F.col(f"__w_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums))
