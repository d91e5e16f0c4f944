"""Whole evaluations: episodes, forecasts, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import once
from ..functions.softdtw import COLUMNS, dilate
from ..operators import episodes as E, metrics as M
from ..operators.blocks import Keys
from ..session import stage


def _level(values: Column, levels: Sequence[float], target: float) -> Column:
    """Quantile ``target`` of a step from its values at the given levels, linear between two of them (EVA6)."""
    below = sum(q < target - 1e-12 for q in levels)
    at = lambda i: F.get(values, F.lit(i))
    if below == 0 or below == len(levels) or abs(levels[below] - target) <= 1e-12:
        return at(min(below, len(levels) - 1))
    weight = (target - levels[below - 1]) / (levels[below] - levels[below - 1])
    return at(below - 1) + F.lit(weight) * (at(below) - at(below - 1))


def _step_scores(levels: Sequence[float], threshold: float, intervals: dict[str, float]) -> Callable[[Column, Column], Column]:
    """What one step adds to the metrics of its episode, from its values and its actual."""

    def score(values: Column, y: Column) -> Column:
        point = _level(values, levels, 0.5)
        e = point - y
        out = [point.alias("f"), y.alias("y"), (e * e).alias("se"), F.abs(e).alias("ae"), (F.abs(e) / F.greatest(F.abs(y), F.lit(M.EPS))).alias("re")]
        if len(levels) > 1:
            known = F.array(*[F.lit(float(q)) for q in levels])
            loss = F.zip_with(known, values, lambda q, f: F.when(y >= f, q * (y - f)).otherwise((q - 1) * (y - f)))
            p = once(F.array_sort(values), lambda v: M.hypo_probability(known, v, threshold))
            out.append((F.aggregate(loss, F.lit(0.0), lambda s, x: s + x) / len(levels)).alias("loss"))
            out.append(F.pow(p - (y < threshold).cast("double"), F.lit(2)).alias("hypo"))
            for s, width in intervals.items():
                lo, hi = _level(values, levels, (1 - width) / 2), _level(values, levels, (1 + width) / 2)
                out += [y.between(lo, hi).cast("double").alias(f"in_{s}"), (hi - lo).alias(f"wide_{s}")]
            out.append(F.transform(values, lambda f: (y <= f).cast("long")).alias("under"))
        return F.struct(*out)

    return score


def _over_steps(field: str) -> Column:
    """Sum of a field over the steps of an episode."""
    return F.aggregate("steps", F.lit(0.0), lambda s, x: s + x[field])


def evaluate_nocturnal(
    episodes: DataFrame,
    forecaster: Callable[[DataFrame], DataFrame],
    levels: Sequence[float] = (),
    threshold: float = M.HYPO,
    with_dilate: bool = True,
    keep: bool = False,
    context_length: int | None = None,
) -> dict[str, DataFrame]:
    """Per episode, per patient, overall and by step (EVA17).

    ``episodes`` has (p_num, episode_id, anchor, context, target); ``forecaster`` adds
    ``values`` to its rows, for each step an array with one value per level (just the
    point forecast without ``levels``), or null where the model gave none; such episodes
    drop out.  Steps beyond the shorter of forecast and target are left out, and so are
    steps with a missing value.  With ``levels``, which must ascend, the metrics of a
    predictive distribution are added.  ``context_length`` hands the forecaster only the
    end of longer contexts, so that runs with other lengths meet on the same anchors.

    An episode is one row throughout: its steps are scored inside the row, by expressions
    over its arrays, and nothing is joined or grouped to get the per-episode metrics.  The
    row keeps the sums from which patient and overall metrics follow.  Only the profile by
    step opens the arrays again.  ``keep`` persists the per-episode table, for callers that
    use several of the results.
    """
    probabilistic = len(levels) > 0
    levels = list(levels) if probabilistic else [0.5]
    if levels != sorted(levels):
        raise ValueError("levels must ascend")
    intervals = {str(round(100 * x)): x for x in M.supported_levels(levels)} if probabilistic else {}
    if context_length:
        episodes = episodes.withColumn("context", F.when(F.size("context") > context_length, F.slice("context", -context_length, context_length)).otherwise(F.col("context")))

    def pairs(values: Column, f: Callable[[Column, Column], Column]) -> Column:
        n = F.greatest(F.lit(0), F.least(F.size(values), F.size("target")))
        return F.zip_with(F.slice(values, 1, n), F.slice("target", 1, n), f)

    score = _step_scores(levels, threshold, intervals)
    known = lambda values: F.exists(pairs(values, lambda v, y: _level(v, levels, 0.5) - y), lambda e: e.isNotNull())
    scored = lambda values: F.filter(pairs(values, score), lambda x: x["se"].isNotNull())
    # a filter on the steps would score every episode a second time
    rows = forecaster(episodes).where(once(F.col("values"), known))
    rows = rows.select("p_num", "episode_id", "anchor", "context", "values", once(F.col("values"), scored).alias("steps"))
    rows = rows.withColumn("n_steps", F.size("steps").cast("long"))

    mean = lambda field: _over_steps(field) / F.col("n_steps")
    first = F.get("steps", F.lit(0))["f"]
    metrics = {"mse": mean("se"), "mae": mean("ae"), "mape": mean("re") * 100, "discontinuity": F.abs(F.element_at("context", -1) - first)}
    means = ["discontinuity"]
    if probabilistic:
        metrics |= {"wql": mean("loss"), "brier": mean("hypo")}
        for s in intervals:
            metrics |= {f"coverage_{s}": mean(f"in_{s}"), f"sharpness_{s}": mean(f"wide_{s}")}
        # actuals at or below each quantile, for the pooled calibration
        none = F.array_repeat(F.lit(0).cast("long"), len(levels))
        metrics["below"] = F.aggregate("steps", none, lambda s, x: F.zip_with(s, x["under"], lambda a, b: a + b))
        means += ["wql", "brier", *[f"{m}_{s}" for s in intervals for m in ("coverage", "sharpness")]]
    metrics |= {"pred": F.transform("steps", lambda x: x["f"]), "target": F.transform("steps", lambda x: x["y"])}
    per_episode = rows.withColumns(metrics).withColumn("rmse", F.sqrt("mse"))
    if with_dilate:
        per_episode = per_episode.withColumn("_d", dilate(F.col("pred"), F.col("target"))).select("*", "_d.*").drop("_d")
        means += COLUMNS
    if keep:
        per_episode = stage(per_episode)

    n = F.col("n_steps")
    pooled = lambda c: F.sum(F.col(c) * n) / F.sum(n)
    by_patient = per_episode.groupBy("p_num").agg(
        F.count("*").alias("episodes"), pooled("mse").alias("mse"), F.sqrt(pooled("mse")).alias("rmse"), pooled("mae").alias("mae"),
        pooled("mape").alias("mape"), *([F.avg("wql").alias("wql"), F.avg("brier").alias("brier")] if probabilistic else []),
    )
    total = [F.count("*").alias("total_episodes"), F.sqrt(pooled("mse")).alias("overall_rmse")]
    total += [F.avg(c).alias("mean_discontinuity" if c == "discontinuity" else f"overall_{c}") for c in means]
    if probabilistic:
        miss = [F.abs(F.sum(F.get("below", F.lit(i))) / F.sum(n) - q) for i, q in enumerate(levels)]
        total.append((sum(miss[1:], miss[0]) / len(miss)).alias("overall_mace"))
    overall = per_episode.agg(*total)
    raw = rows.select("p_num", "episode_id", "anchor", "values", F.transform("steps", lambda x: x["y"]).alias("target"))
    out = {"forecasts": raw, "per_episode": per_episode.drop("steps"), "per_patient": by_patient, "overall": overall}
    if probabilistic:
        # no episode is without steps; a plain posexplode would filter on them all the same
        opened = rows.select(F.posexplode_outer("steps").alias("_i", "_s"))
        cells = [F.avg(f"_s.{a}_{s}").alias(f"{b}_{s}") for s in intervals for a, b in (("in", "coverage"), ("wide", "sharpness"))]
        out["by_step"] = opened.groupBy((F.col("_i") + 1).alias("step")).agg(*cells)
    return out


def evaluate_sliding(df: DataFrame, ctx: int, fh: int, keys: Keys = Keys(), pos: str | None = None) -> dict[str, DataFrame]:
    """Sliding windows with the last-value forecast per patient, and the weighted roll-up (EVA18)."""
    windows = E.row_windows(df, ctx, fh, keys=keys, pos=pos)
    steps = windows.select("p_num", "window_no", F.element_at("context", -1).alias("forecast"), F.explode("target").alias("actual"))
    per = steps.groupBy("p_num").agg((F.count("*") / fh).cast("long").alias("n_episodes"), *M.regression_aggs())
    return {"per_patient": per, "overall": M.weighted_rollup(per, [])}
