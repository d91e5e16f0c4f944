"""Unit responses of the carbohydrate and insulin compartment models.

Both models are linear chains stepped with Euler's rule, so the response to any
amount is the amount times the unit response.  A response has at most 180 values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Fixed values of the two models.
ACTION_MINUTES = 180
CARB_TMAX, CARB_ABSORPTION = 40.0, 0.8
INSULIN_TMAX, INSULIN_ELIMINATION = 55.0, 0.138


def _chain(steps: int, ts: float, dose: float, rates: list[float]) -> list[list[float]]:
    """Amounts over time in a chain of compartments.

    ``rates[i]`` empties compartment i into compartment i + 1; the dose enters the
    first one during the first step.
    """
    level = [0.0] * (len(rates) + 1)
    history = [list(level)]
    for k in range(steps - 1):
        flow = [r * x for r, x in zip(rates, level)] + [0.0]
        inflow = [dose / ts if k == 0 else 0.0] + flow[:-1]
        level = [x + (i - o) * ts for x, i, o in zip(level, inflow, flow)]
        history.append(list(level))
    return history


def carb_kernel(ts_min: int) -> tuple[list[float], list[float]]:
    """(availability, carbs on board) of one gram."""
    rate = 1.0 / CARB_TMAX
    rows = _chain(ACTION_MINUTES // ts_min, ts_min, CARB_ABSORPTION, [rate, rate])
    return [r[1] for r in rows], [CARB_ABSORPTION - r[2] for r in rows]


def insulin_kernel(ts_min: int) -> tuple[list[float], list[float]]:
    """(availability, insulin on board) of one unit; on board never falls below 0."""
    rate = 1.0 / INSULIN_TMAX
    rows = _chain(ACTION_MINUTES // ts_min, ts_min, 1.0, [rate, rate, INSULIN_ELIMINATION])
    return [r[2] for r in rows], [max(0.0, 1.0 - r[3]) for r in rows]


def carb_decays(ts_min: int) -> list[float]:
    """Shares that the compartments of the carbohydrate chain keep from step to step."""
    return [1.0 - ts_min / CARB_TMAX]


def insulin_decays(ts_min: int) -> list[float]:
    return [1.0 - ts_min / INSULIN_TMAX, 1.0 - ts_min * INSULIN_ELIMINATION]


def as_exponentials(weights: Sequence[float], decays: Sequence[float]) -> tuple[list[tuple[float, int, float]], float] | None:
    """A response as ``sum of c * k**d * q**k`` over its steps k, plus an extra weight of step 0.

    Returns the terms (c, d, q) and that extra weight, or None if the response is no such
    sum.  The first decay may come twice, as in a chain with two equal rates.
    """
    k = np.arange(len(weights), dtype=float)
    basis = [(0, 1.0), *[(0, q) for q in decays], (1, decays[0])]
    if any(not 0 < q <= 1 for _, q in basis) or len(weights) <= 2 * len(basis):
        return None
    matrix = np.column_stack([k**d * q**k for d, q in basis])
    found = np.linalg.lstsq(matrix[1:], np.asarray(weights[1:], dtype=float), rcond=None)[0]
    off = np.asarray(weights) - matrix @ found
    if np.abs(off[1:]).max() > 1e-9 * max(map(abs, weights)):
        return None
    return [(float(c), d, q) for c, (d, q) in zip(found, basis)], float(off[0])
