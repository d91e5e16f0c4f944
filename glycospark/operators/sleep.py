"""Sleep scores and windows from heart rate, steps and calories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .blocks import exact_quantiles, halo, own, scan, Carry, Keys
from .profile import hourly_profile

# Weights of the two scores.
SCORE_WEIGHTS = {"hr_bpm": 0.7, "steps": 0.2, "cals": 0.1}
PHYSIO_WEIGHTS = {"steps": 0.6, "hr_bpm": 0.3, "cals": 0.1}


def sleep_score(
    df: DataFrame, step: int, weights: Mapping[str, float] = SCORE_WEIGHTS, quantile: float = 0.6,
    keys: Keys = Keys(), pos: str = "pos",
) -> DataFrame:
    """Weighted min-max score, centred three-row mean, 1 above its quantile (WIN25).

    Missing values are interpolated by position and held at the ends.  The smoothed rows are
    written to the shared folder, as the quantiles and the scores both come from them.
    """
    by = list(keys.by)
    carries = {}
    for c in weights:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("k"), F.col(c).alias("v")))
        carries[f"_a_{c}"], carries[f"_b_{c}"] = Carry("last", known), Carry("next", known)
        carries[f"_lo_{c}"], carries[f"_hi_{c}"] = Carry("low", F.col(c)), Carry("high", F.col(c))
    filled = scan(df, keys, **carries)
    score = F.lit(0.0)
    for c, weight in weights.items():
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = a["v"] + (b["v"] - a["v"]) * ((F.col(pos) - a["k"]) / (b["k"] - a["k"]))
        x = F.coalesce(F.col(c), F.when(a.isNotNull() & b.isNotNull(), line), a["v"], b["v"])
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        part = F.when(hi != lo, (x - lo) / (hi - lo)).otherwise(0.0)
        score = score + F.when(lo.isNull(), 0.0).otherwise(part) * weight
    scored = filled.withColumn("_s", score).select(*df.columns, "_s")
    near = halo(scored, keys, back=step, ahead=step)
    smooth = own(near.withColumn("_m", F.avg("_s").over(keys.window().rowsBetween(-1, 1))))
    # the same sums in another order may differ in the last digits
    smooth = settle(smooth.withColumn("_m", F.round("_m", 9)).drop("_s"), "sleep")
    out = smooth.join(exact_quantiles(smooth, by, "_m", {"_cut": quantile}), by, "left")
    return out.withColumn("sleep_score", (F.col("_m") > F.col("_cut")).cast("double")).withColumnRenamed("_m", "raw_score").drop("_cut")


def sleep_hours(scores: DataFrame, length: int = 8) -> DataFrame:
    """The circular window with the lowest mean score per day (WIN26); first start on ties.

    A row counts for the starts whose window holds its hour; a day's sums for all of them are
    columns of one row, so that no row is repeated per start.
    """
    starts = range(24)
    rows = scores.select("p_num", F.to_date("datetime").alias("date"), F.hour("datetime").alias("_h"), "sleep_score")
    inside = [F.when(F.pmod(F.col("_h") - k, F.lit(24)) < length, F.col("sleep_score")) for k in starts]
    sums = [c for k in starts for c in (F.sum(inside[k]).alias(f"_s{k}"), F.count(inside[k]).alias(f"_n{k}"))]
    # the hours with rows, and those that a window holds, as bits
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_h")))
    held = F.array(*[F.lit(sum({1 << (k + j) % 24 for j in range(length)})) for k in starts])
    days = rows.groupBy("p_num", "date").agg(seen.alias("_seen"), *sums)
    means = F.zip_with(F.array(*[f"_s{k}" for k in starts]), F.array(*[f"_n{k}" for k in starts]), lambda s, n: F.round(F.when(n > 0, s / n), 9))
    windows = F.transform(means, lambda m, k: F.when(F.get(held, k).bitwiseAND(F.col("_seen")) != 0, F.struct(m.alias("m"), k.alias("k"))))
    best = days.select("p_num", "date", F.array_min(windows)["k"].alias("sleep_start"))
    return best.withColumn("sleep_end", (F.col("sleep_start") + length) % 24).withColumn("sleep_duration", F.lit(length))


def sleep_probability(df: DataFrame) -> DataFrame:
    """Physiological score blended with the patient's hourly profile (PHY5)."""
    steps, hr, cals = F.col("steps"), F.col("hr_bpm"), F.col("cals")
    parts = {
        "steps": F.when(steps == 0, 1.0).otherwise(F.exp(-steps / 10)),
        "hr_bpm": F.exp(-hr / 40),
        "cals": F.exp(-cals / 40),
    }
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    physio = clip(sum((parts[k] * w for k, w in PHYSIO_WEIGHTS.items()), F.lit(0.0)))
    profile = hourly_profile(df, ["steps", "hr_bpm", "cals"])
    joined = df.withColumn("hour", F.hour("datetime")).join(profile, ["p_num", "hour"])
    level = F.exp(-(F.col("mean_steps") + F.col("mean_hr_bpm") + F.col("mean_cals")) / 100)
    out = joined.withColumn("sleep_probability", clip(physio * 0.85 + level * 0.15))
    return out.drop("mean_steps", "mean_hr_bpm", "mean_cals", "hour")
