"""Points in intervals: joins by blocks of time, and counts by a sweep."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.sources.shared import written

#: Blocks of a level that make up one of the next, and most levels.
FAN, LEVELS = 8, 10


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """points with every interval of their key that holds them: start <= at < end; a null end is open.

    Time is cut into blocks, FAN of a level to one of the next.  An interval is in the few blocks, large ones first, that make
    it up; a point is in one block of every level; so a pair meets in exactly one block, by an equality join on key and
    block.  The lowest blocks are about as many as the intervals, so what a join makes is points times levels, intervals
    times blocks, and matches.  A hot key is spread over its blocks.  Points without key or time match nothing; intervals
    without a start hold nothing.  Columns of intervals but the key are added.
    """
    intervals = written(intervals.withColumn("__from", _micros(start)).withColumn("__to", _micros(end)))
    seen = points.agg(F.min(_micros(at)).alias("lo"), F.max(_micros(at)).alias("hi")).first()
    n = intervals.count()
    lo, hi = seen["lo"] or 0, seen["hi"] or 0
    depth = min(LEVELS, max(1, math.ceil(math.log(max(n, 2), FAN))))
    width = max(1, -(-(hi - lo + 1) // FAN**depth))
    first = f"greatest(0L, (__from - {lo}L) div {width}L)"
    last = f"least({FAN**depth - 1}L, (least(coalesce(__to, {hi + 1}L), {hi + 1}L) - 1 - {lo}L) div {width}L)"
    own = intervals.filter((F.col("__from") <= hi) & (F.col("__to").isNull() | (F.col("__to") > lo)) & (F.col("__to").isNull() | (F.col("__to") > F.col("__from"))))
    own = own.withColumn("__a", F.expr(first)).withColumn("__b", F.expr(last))

    def blocks(level: int) -> str:
        """The blocks of a level that the intervals' blocks of the next level don't hold."""
        size, up = FAN**level, FAN ** (level + 1)
        a, b = f"((__a + {size - 1}) div {size})", f"((__b + 1) div {size} - 1)"
        c, d = f"((__a + {up - 1}) div {up})", f"((__b + 1) div {up} - 1)"
        run = lambda x, y: f"if({x} <= {y}, sequence({x}, {y}), array())"
        whole = run(a, b) if level == depth - 1 else f"if({c} > {d}, {run(a, b)}, concat({run(a, f'{c} * {FAN} - 1')}, {run(f'({d} + 1) * {FAN}', b)}))"
        return f"transform({whole}, x -> struct({level} as level, bigint(x) as block))"

    own = own.withColumn("__at", F.explode(F.expr(f"concat({', '.join(map(blocks, range(depth)))})")))
    own = own.select(*(c for c in intervals.columns if c != key), F.col(key).alias("__key"), "__at.level", "__at.block").withColumnsRenamed({"level": "__level", "block": "__block"})
    asked = points.withColumn("__p", _micros(at)).filter(F.col("__p").isNotNull())
    place = f"((__p - {lo}L) div {width}L)"
    each = F.expr("array(" + ", ".join(f"struct({k} as level, {place} div {FAN**k} as block)" for k in range(depth)) + ")")
    asked = asked.withColumn("__q", F.explode(each))
    on = (F.col(key) == F.col("__key")) & (F.col("__q.level") == F.col("__level")) & (F.col("__q.block") == F.col("__block"))
    inside = (F.col("__from") <= F.col("__p")) & (F.col("__to").isNull() | (F.col("__p") < F.col("__to")))
    return asked.join(own, on & inside).drop("__p", "__q", "__key", "__level", "__block", "__from", "__to")


def running_total(rows: DataFrame, group: list[str], cell: Column, order: list[Column], value: str, into: str) -> DataFrame:
    """Adds the sum of value over a group's rows up to each row, itself included, without a group in one task.

    ``cell`` numbers ordered ranges of the order: rows are sorted within (group, cell), and the cells' totals carry on.
    """
    rows = rows.withColumn("__cell", cell)
    cells = rows.groupBy(*group, "__cell").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__cell").alias("__c"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__own", F.sum(value).over(within))
    on = F.col("__cell") == F.col("__c")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(cells, on).withColumn(into, F.col("__own") + F.col("__before")).drop("__cell", "__c", "__own", "__before", *(f"__g{i}" for i in range(len(group))))


def interval_counts(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, into: str = "n") -> DataFrame:
    """points with how many intervals of their key hold them: starts up to a point less ends up to it, in one sweep.

    No pair is made: starts, ends and points are put in one order of time, and a running total of starts (1) and ends (-1)
    is read where the points stand.  The order is cut into ranges of time, about 4,096 rows each on average, so a hot key is
    spread.  Points without key or time are left out.
    """
    moment = lambda c: _micros(c).alias("__at")
    fine = intervals.filter(F.col(end).isNull() | (F.col(end) > F.col(start)))
    starts = fine.select(F.col(key).alias("__key"), moment(start), F.lit(0).alias("__kind"), F.lit(1).cast("long").alias("__change"))
    ends = fine.select(F.col(key).alias("__key"), moment(end), F.lit(0).alias("__kind"), F.lit(-1).cast("long").alias("__change"))
    row = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    asked = points.select(F.col(key).alias("__key"), moment(at), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__change"), row.alias("__row"))
    events = written(starts.unionByName(ends).unionByName(asked, allowMissingColumns=True).filter("__at is not null and __key is not null"))
    size = events.agg(F.min("__at").alias("lo"), F.max("__at").alias("hi"), F.count("*").alias("n")).first()
    width = max(1, ((size["hi"] or 0) - (size["lo"] or 0) + 1) // max(1, size["n"] // 4096))
    cell = F.expr(f"(__at - {size['lo'] or 0}L) div {width}L")
    t = running_total(events, ["__key"], cell, [F.col("__at"), F.col("__kind")], "__change", "__n").filter("__kind = 1")
    return t.select(*(F.col(f"__row.`{c}`").alias(c) for c in points.columns), F.col("__n").alias(into))
