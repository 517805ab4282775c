"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.sources.shared import checked, written

#: Different values of a group that one task may sort, and parts of a range that a pass counts.
SORTED, PARTS = 1 << 16, 4096


def exact_median(rows: DataFrame, by: list[str], value: Column, into: str, most: int = SORTED, parts: int = PARTS) -> DataFrame:
    """by and ``into``, the median of value in each group: the mean of its two middle values, exact.

    Equal values are counted before the shuffle.  While a group has more than ``most`` different values, a pass counts them in
    ``parts`` equal parts of their range and keeps the parts in which the middle lies; so no task holds a group, whatever
    its size.  Nulls and values that are no number don't count; a group without others has no row.  Null keys are a group.
    """
    v = value.cast("double")
    t = rows.select(*by, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    t = written(t.withColumn("__below", F.lit(0).cast("long")).withColumn("__n", F.lit(None).cast("long")))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] or [F.lit(True)]
    keyed = lambda d: d.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)})
    drop = [f"__k{i}" for i in range(len(by))]
    while True:
        ends = written(t.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__sum"), F.count("*").alias("__different"), F.max("__n").alias("__all"), F.max("__below").alias("__under")))
        size = ends.agg(F.max("__different").alias("most")).first()["most"] or 0
        ends = keyed(ends.withColumn("__all", F.coalesce("__all", "__sum")))
        t = t.join(checked(ends), same).drop(*drop)
        first, last = F.expr("(__all + 1) div 2 - __under"), F.expr("__all div 2 + 1 - __under")
        if size <= most:
            break
        # Halves first, so that a range as wide as all doubles doesn't overflow.
        place = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
        t = t.withColumn("__part", F.least(F.lit(parts - 1), F.floor(F.coalesce(F.when(F.col("__hi") > F.col("__lo"), place), F.lit(0.0)) * parts).cast("int")))
        order = Window.partitionBy(*by).orderBy("__part")
        c = t.groupBy(*by, "__part", "__all", "__under").agg(F.sum("__c").alias("__sum"))
        c = c.withColumn("__upto", F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        c = c.filter((F.col("__upto") >= first) & (F.col("__upto") - F.col("__sum") < last))
        c = c.withColumn("__before", F.min(F.col("__upto") - F.col("__sum")).over(Window.partitionBy(*by)))
        c = keyed(c.select(*by, F.col("__part").alias("__p"), "__before"))
        t = t.join(checked(written(c)), [*same, F.col("__part") == F.col("__p")])
        t = written(t.select(*by, "__v", "__c", (F.col("__under") + F.col("__before")).alias("__below"), F.col("__all").alias("__n")))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("__upto", upto).filter((F.col("__upto") >= first) & (F.col("__upto") - F.col("__c") < last))
    return t.groupBy(*by).agg((F.min("__v") * 0.5 + F.max("__v") * 0.5).alias(into))
