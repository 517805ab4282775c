"""Intervals, tests and rates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

Z = 1.959963984540054


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson(hits, n) -> Column:
    """struct(lo, hi) of the 95 % score interval; (0, 0) without trials, and exact ends at no hit and all hits."""
    h, n = _c(hits).cast("double"), _c(n).cast("double")
    p, z2 = h / n, Z * Z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    lo = F.when(n <= 0, 0.0).when(h <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    hi = F.when(n <= 0, 0.0).when(h >= n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def ratio(part, whole) -> Column:
    """part / whole, 0 if there is no whole."""
    return F.coalesce(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), F.lit(0.0))


def mcnemar_statistic(a_only, b_only) -> Column:
    """Continuity-corrected statistic of two discordant counts."""
    b, c = _c(a_only).cast("double"), _c(b_only).cast("double")
    off = F.abs(b - c) - 1
    return F.when(b + c == 0, 0.0).otherwise(off * off / (b + c))


@pandas_udf(DoubleType())
def mcnemar_p(statistic: pd.Series) -> pd.Series:
    """Its p-value; Spark SQL has no error function, and there is one row per pair of engines."""
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2)))


def adjusted_precision(recall, false_alarms, prevalence: float) -> Column:
    """Precision at another share of positives."""
    hit = prevalence * _c(recall)
    return ratio(hit, hit + (1 - prevalence) * _c(false_alarms))
