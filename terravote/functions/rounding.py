"""Rounding as reports print it: half away from zero on the number as written, not on its binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _written(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double").cast("string").cast("decimal(38,18)")


def half_up(value: Column | str, places: int) -> Column:
    """Text with so many decimals, the leading zero kept."""
    return F.round(_written(value), places).cast(f"decimal(38,{places})").cast("string")


def share_text(value: Column | str, places: int = 2) -> Column:
    """The same without the zeros that lead: .68 and 1.00."""
    return F.regexp_replace(half_up(value, places), "^0+", "")


def is_tie(value: Column | str, places: int = 2) -> Column:
    """Whether the number, written with one more decimal, lies just between two with ``places`` decimals."""
    fine = F.bround(_written(value), places + 1)
    return F.abs(fine * 10 ** (places + 1)) % 10 == 5
