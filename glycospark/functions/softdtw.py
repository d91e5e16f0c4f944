"""Shape and temporal distortion of a forecast, batched over many pairs.

The dynamic programme is swept along anti-diagonals, so every step is one array
operation over all pairs of an Arrow batch and all smoothing strengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Smoothing strengths and their column suffixes, and the weight.
GAMMAS = {0.001: "g0001", 0.01: "g001", 0.1: "g01"}
ALPHA = 0.5
COLUMNS = [f"{m}_{s}" for s in GAMMAS.values() for m in ("dilate", "shape", "temporal")]
SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in COLUMNS])

_FAR = 1e8


def distortion(pred: np.ndarray, actual: np.ndarray, gammas: Sequence[float], alpha: float = ALPHA):
    """(dilate, shape, temporal), each of shape (gammas, pairs), for arrays of shape (pairs, n).

    With the squared differences as cost, ``best`` at (i, j) is the soft minimum over the
    alignments that end there.  The temporal part is the derivative of the last ``best`` in
    the direction of the squared lags: a cell's share in the soft-optimal alignment times
    its lag.  It is carried along as ``slope``, by the soft-min weights of the three moves,
    so that two diagonals are all there is to keep.
    """
    pairs, n = pred.shape
    g = np.asarray(gammas, dtype=float)[:, None, None]
    far = lambda: np.full((len(gammas), pairs, n + 1), _FAR)  # noqa: E731  by row i; column d - i
    best, before = far(), far()
    before[:, :, 0] = 0.0
    slope, slope_before = np.zeros_like(best), np.zeros_like(best)
    for d in range(2, 2 * n + 1):
        i = np.arange(max(1, d - n), min(n, d - 1) + 1)
        z = np.stack([before[:, :, i - 1], best[:, :, i - 1], best[:, :, i]]) / -g
        top = z.max(axis=0)
        e = np.exp(z - top)
        total = e.sum(axis=0)
        now, slope_now = far(), np.zeros_like(best)
        now[:, :, i] = (actual[:, i - 1] - pred[:, d - i - 1]) ** 2 - g * (np.log(total) + top)
        slope_now[:, :, i] = (2 * i - d) ** 2 + (e * np.stack([slope_before[:, :, i - 1], slope[:, :, i - 1], slope[:, :, i]])).sum(axis=0) / total
        best, before, slope, slope_before = now, best, slope_now, slope
    shape, temporal = best[:, :, n], slope[:, :, n] / (n * n)
    return alpha * shape + (1 - alpha) * temporal, shape, temporal


def _batch(pred: pd.Series, actual: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(np.nan, index=pred.index, columns=COLUMNS)
    length = pred.map(lambda v: -1 if v is None else len(v))
    other = actual.map(lambda v: -1 if v is None else len(v))
    if (length != other).any():
        raise ValueError("forecast and actual must have the same length")
    for n in length.unique():
        if n < 2:
            continue
        rows = np.flatnonzero((length == n).to_numpy())
        size = max(1, 1_000_000 // (len(GAMMAS) * (n + 1)))  # bounds the arrays to about 8 MB each
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            p = np.stack([np.asarray(pred.iloc[r], dtype=float) for r in part])
            a = np.stack([np.asarray(actual.iloc[r], dtype=float) for r in part])
            for name, values in zip(("dilate", "shape", "temporal"), distortion(p, a, list(GAMMAS))):
                for suffix, v in zip(GAMMAS.values(), values):
                    out.iloc[part, out.columns.get_loc(f"{name}_{suffix}")] = v
    return out


@F.pandas_udf(SCHEMA)
def _dilate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for pred, actual in batches:
        yield _batch(pred, actual)


def dilate(pred: Column, actual: Column) -> Column:
    """Struct of nine doubles for two arrays of equal length (EVA15)."""
    return _dilate(pred, actual)
