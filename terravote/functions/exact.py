"""Sums that don't depend on the order of their rows.

A double is cut into four whole numbers of 52 bits each, from 2**104 down to 2**-104; every row's parts are added up as
exact integers, before the shuffle like any sum, and the total is rounded to a double once.  Amounts of money are decimal
numbers as they are written, and add up as such.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

BITS = 52
UNIT = float(2**BITS)
#: Limbs of a number, the highest first; the lowest counts units of 2**-104, and bits below that are cut off each row alike.
LIMBS = 4
#: Beyond this a plain sum is given.
MOST = float(2**104)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _limbs(x: Column) -> list[Column]:
    """x as whole numbers under 2**52 in size (the first: any), all of its sign.  Every step is exact."""
    out, scaled = [], F.abs(x) / UNIT
    for _ in range(LIMBS):
        whole = F.floor(scaled)
        out.append(F.when(x < 0, -whole).otherwise(whole))
        scaled = (scaled - whole.cast("double")) * UNIT
    return out


@pandas_udf(DoubleType())
def _nearest(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """The double nearest to a number given by its limbs' sums; one row for each group, after the sums."""

    def value(limbs) -> float | None:
        if any(x is None for x in limbs):
            return None
        whole = 0
        for x in limbs:
            whole = (whole << BITS) + int(x)
        return whole / 2 ** (BITS * (LIMBS - 2))

    return pd.Series(map(value, zip(a, b, c, d)), dtype="float64")


def exact_sum(x: Column | str) -> Column:
    """Aggregate: the double nearest to the exact sum of a column of doubles, whatever the order and partitions of the rows.

    Nulls don't count; the sum of none is null.  Bits under 2**-104 are cut off.  If a value is infinite, no number, or 2**104
    and beyond, the sum is a plain one.
    """
    x = _col(x).cast("double")
    plain = (F.abs(x) < MOST) & ~F.isnan(x)
    sums = [F.sum(limb.cast("decimal(20,0)")) for limb in _limbs(F.when(plain, x))]
    return F.when(F.count(x) == F.count_if(plain), _nearest(*sums)).otherwise(F.sum(x))


def exact_avg(x: Column | str) -> Column:
    """Aggregate: the exact sum over the number of values; null of none."""
    return F.try_divide(exact_sum(x), F.count(_col(x)))


MONEY = "decimal(38,15)"


def money(x: Column | str) -> Column:
    """An amount as the decimal number that its shortest form writes, to 15 places."""
    return _col(x).cast(MONEY)
