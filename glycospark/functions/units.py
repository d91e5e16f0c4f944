"""Unit conversion and value clamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# mg/dL per mmol/L as used by the three families of exports.
DIVISOR_ROUNDED = 18.018
DIVISOR_PLAIN = 18.0
DIVISOR_EXACT = 18.0182


def round_even(col: Column, places: int) -> Column:
    """Scale, round half to even, scale back: the same result as the numeric libraries give."""
    scale = F.lit(10.0**places)
    return F.rint(col * scale) / scale


def mg_dl_to_mmol_l(col: Column, divisor: float = DIVISOR_ROUNDED, places: int | None = 2) -> Column:
    value = col / F.lit(divisor)
    return value if places is None else round_even(value, places)


def clamp_sentinel(col: Column, low: float = 39, high: float = 401) -> Column:
    """Sensor codes below and above the measuring range become its limits 40 and 400."""
    return F.when(col <= low, F.lit(40.0)).when(col >= high, F.lit(400.0)).otherwise(col)


def plausible(col: Column, low: float = 1.1, high: float = 33.3) -> Column:
    return col.isNotNull() & (col > 0) & col.between(low, high)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)
