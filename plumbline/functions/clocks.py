"""Offsets between two clocks of one recording, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Zones differ by whole quarters of an hour and by at most 14 hours; a minute of
# error is borne.
QUARTER_S, FARTHEST_S, BORNE_S = 900, 14 * 3_600, 60


def irregular_offset(seconds: Column) -> Column:
    """Whether an offset is no time zone: farther than any, or off a quarter of an hour by more
    than a minute either way; null stays null."""
    rest = F.pmod(seconds, F.lit(QUARTER_S))
    return (F.least(rest, F.lit(QUARTER_S) - rest) > BORNE_S) | (F.abs(seconds) > FARTHEST_S)
