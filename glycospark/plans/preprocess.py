"""From an irregular patient series to model-ready features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import carb_decays, carb_kernel, insulin_decays, insulin_kernel
from ..operators import clean as C, features as X
from ..functions.timefn import from_seconds
from ..operators.align import asof_grid, regular_bins, regularize
from ..operators.blocks import Carry, Keys, scan
from ..schema import REQUIRED_COLUMNS

OUTPUTS = {"food_g": ("carb_availability", "cob"), "dose_units": ("insulin_availability", "iob")}


def physiological_features(
    df: DataFrame, step: int, use_aggregation: bool = True, delivery: str | None = None, tie: Sequence[str] = (), keys: Keys = Keys(), precise: bool = False,
    active: bool = False,
) -> DataFrame:
    """Regularise, roll basal over, carbs and insulin on board, time of day, round (PHY3).

    A patient without any food (dose) value gets NULL on-board columns.  After
    aggregation every filled slot has a value, so only the as-of grid needs the
    check, and it shares a scan.  ``precise`` leaves out the rounding.  ``active`` asks only
    for the rows of the grid that have something on board, which a fine grid after
    aggregation then opens alone.
    """
    kernels = {"food_g": carb_kernel(step // 60), "dose_units": insulin_kernel(step // 60)}
    decays = {"food_g": carb_decays(step // 60), "dose_units": insulin_decays(step // 60)}
    responses = {c: dict(zip(OUTPUTS[c], kernels[c])) for c in OUTPUTS if c in df.columns}
    if active and use_aggregation and responses and "rate" not in df.columns:
        out = X.convolve_bins(regular_bins(df, step, tie)[0], responses, step, keys, positive_only=("dose_units",), decays=decays)
        if out is not None:
            out = out.withColumn("datetime", from_seconds(F.col("slot"))).drop("slot")
            out = out.withColumns({n: F.lit(None).cast("double") for c, names in OUTPUTS.items() if c not in responses for n in names})
            out = X.time_of_day(out)
            return out if precise else C.reduce_precision(out)
    grid = regularize(df, step, tie) if use_aggregation else asof_grid(df, step, "forward", keys, tie)
    if {"rate", "dose_units"} <= set(grid.columns):
        if delivery is None:
            raise ValueError("basal delivery must be given when a rate column is present: temp or automated")
        grid = X.rollover(grid, step, delivery, keys)
    have = [c for c in OUTPUTS if c in grid.columns]
    check = [] if use_aggregation else have
    if check:
        seen = {f"_seen_{c}": Carry("total", F.col(c).isNotNull().cast("int")) for c in check}
        grid = scan(grid, keys, **seen)
    out = X.convolve_grid(grid, responses, step, keys, positive_only=("dose_units",), decays=decays) if responses else grid
    for c, names in OUTPUTS.items():
        for name in names:
            if c not in have:
                out = out.withColumn(name, F.lit(None).cast("double"))
            elif c in check:
                out = out.withColumn(name, F.when(F.col(f"_seen_{c}") > 0, F.col(name)))
    out = X.time_of_day(out.drop(*[f"_seen_{c}" for c in check]))
    if active:
        out = out.where(F.greatest(*[F.abs(F.coalesce(n, F.lit(0.0))) for names in OUTPUTS.values() for n in names]) > 0)
    return out if precise else C.reduce_precision(out)


def preprocess(df: DataFrame, step: int, **kw) -> DataFrame:
    """Column check, then the feature pipeline for all patients at once (PHY4)."""
    return physiological_features(C.require_columns(df, REQUIRED_COLUMNS), step, **kw)
