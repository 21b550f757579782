"""Rounding of doubles for comparisons with other engines.

Equal exact values are reached along different operation orders and then differ in the
last bits.  ``grid`` snaps them to a decimal cell whose boundaries sit at an odd offset
that decimal and dyadic fractions never hit.  It stays in doubles, so it never
saturates: beyond the double's precision it leaves values as they are.  Ranking uses
the exact double unless a caller asks for ``tie_decimals``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_OFFSET = 0.0123


def grid(c: Column, decimals: int) -> Column:
    """Cell number (a double) of ``c`` on the 10^-decimals grid."""
    return F.rint(c * F.lit(float(10 ** decimals)) + F.lit(GRID_OFFSET))


def quantize(c: Column, decimals: int) -> Column:
    """``c`` snapped to its 10^-decimals cell; ``+ 0.0`` folds -0.0 into 0.0."""
    return grid(c, decimals) / F.lit(float(10 ** decimals)) + F.lit(0.0)


def rank_key(distance: Column, tie_decimals: int | None) -> Column:
    """What hits are ordered by: the distance itself, or its cell where near-equal distances
    shall count as ties."""
    return distance if tie_decimals is None else grid(distance, tie_decimals)


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
