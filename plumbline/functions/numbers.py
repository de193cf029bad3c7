"""Number helpers that give the same double in any engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quantised(x: Column, places: int = 6) -> Column:
    """Rounded half up by whole numbers; null stays null, NaN becomes null."""
    scale = float(10**places)
    return F.when(~F.isnan(x), F.floor(x * scale + 0.5) / scale)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def scaled(x: Column, places: int = 3) -> Column:
    """As a whole number of the last place, so that sums don't depend on their order."""
    return F.floor(finite(x) * float(10**places) + 0.5).cast("bigint")
