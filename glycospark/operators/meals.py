"""Meal announcements: counts, merging and the daily top meals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timefn import MICROS, from_seconds, micros, seconds
from ..schema import LOW_MEAL, MEAL
from ..session import settle
from .align import overlay_meals
from .blocks import BLOCK, Keys, halo, own
from .gaps import drop_gappy_days


def drop_days_with_meals(df: DataFrame, count: int, meal: str = MEAL) -> DataFrame:
    """Remove the days that have exactly ``count`` announced meals (MEA1)."""
    days = df.where(F.col("msg_type") == meal).groupBy("p_num", F.to_date("datetime").alias("_day")).agg(F.count("*").alias("_n"))
    out = df.withColumn("_day", F.to_date("datetime"))
    return out.join(days.where(F.col("_n") == count), ["p_num", "_day"], "left_anti").drop("_day")


def spaced_stamps(stamps: DataFrame, length: int, keys: Keys, col: str = "us") -> DataFrame:
    """Of the distinct stamps of each key those that a greedy pass keeps: more than ``length`` after the last kept one.

    Every stamp that follows a longer pause is kept; these are the starts.  Any other kept
    stamp is the successor of a kept one, the first stamp more than ``length`` after it, and
    that is never more than twice the length away.  So the successors are found within a
    halo, and which stamps the starts lead to by pointer doubling: a round follows, from
    all kept stamps at once, jumps of twice as many successors as the round before, and
    joins the jumps with themselves.  The rounds grow with the logarithm of the longest
    chain, joins are on (key, stamp), which is unique, and a run of stamps without a pause
    is spread over all tasks like any other.
    """
    by = list(keys.by)
    seconds_ = -(-length // MICROS)
    near = halo(stamps, keys, back=seconds_ + 1, ahead=2 * seconds_ + 1)
    reach = Window.partitionBy(*by, BLOCK).orderBy(col)
    near = near.withColumns(
        {
            "_prev": F.lag(col).over(reach),
            "_end": F.max(col).over(reach.rangeBetween(0, length)),
            "_next": F.min(col).over(reach.rangeBetween(length + 1, 2 * length)),
        }
    )
    start = F.col("_prev").isNull() | (F.col(col) - F.col("_prev") > length)
    # a successor after a pause is a start itself
    follows = F.when(F.col("_next") - F.col("_end") <= length, F.col("_next"))
    nodes = settle(own(near).select(*by, col, start.alias("_start"), follows.alias("_next")), "stamps")
    kept = [nodes.where("_start").select(*by, col)]
    jumps = nodes.where(F.col("_next").isNotNull()).select(*by, col, "_next")
    while True:
        every = kept[0]
        for more in kept[1:]:
            every = every.unionByName(more)
        reached = settle(every.join(jumps, [*by, col]).select(*by, F.col("_next").alias(col)), "reached")
        if reached.isEmpty():
            return every
        kept.append(reached)
        ahead = jumps.select(*by, F.col(col).alias("_next"), F.col("_next").alias("_far"))
        jumps = settle(jumps.join(ahead, [*by, "_next"]).select(*by, col, F.col("_far").alias("_next")), "jumps")


def merge_meals(
    df: DataFrame, length_s: int = 7200, min_carbs: float = 5, meal: str = MEAL, keys: Keys = Keys()
) -> DataFrame:
    """Greedy merge in time order (MEA2).

    A meal of at most ``min_carbs`` becomes a low-carb meal.  Any other absorbs the
    positive carbs of the rows in (t, t + length] and blanks them.  A blanked meal
    has no carbs left when its turn comes.

    Only which meals absorb depends on order; see :func:`spaced_stamps`, which runs jobs
    of its own.
    """
    us, length = micros(F.col("datetime")), length_s * MICROS
    by = list(keys.by)
    is_meal = F.coalesce(F.col("msg_type") == meal, F.lit(False))
    big = df.where(is_meal & (F.col("food_g") > min_carbs)).select(*by, "datetime", us.alias("us")).distinct()
    picked = spaced_stamps(big, length, Keys(keys.by, keys.time, (), min(keys.block, 8 * length_s))).select(
        *by, F.timestamp_micros("us").cast("timestamp_ntz").alias("datetime"), F.col("us").alias("_abs")
    )

    # no other meal absorbs inside an absorber's window, so both the absorber of a
    # row and the carbs an absorber gains lie within one window length
    marked = halo(df.join(picked, [*by, "datetime"], "left"), keys, back=length_s + 1, ahead=length_s + 1)
    marked = marked.withColumn("_us", us)
    upto = keys.window().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, BLOCK).orderBy("_us").rangeBetween(1, length)
    marked = marked.withColumns(
        {
            "_from": F.last("_abs", True).over(upto),
            "_gain": F.sum(F.when(F.col("food_g") > 0, F.col("food_g"))).over(ahead),
        }
    )
    swallowed = F.coalesce((F.col("_us") > F.col("_from")) & (F.col("_us") - F.col("_from") <= length), F.lit(False))
    absorbs = F.col("_abs").isNotNull() & is_meal & (F.col("food_g") > min_carbs)
    low = is_meal & (F.col("food_g") <= min_carbs)
    food = F.when(swallowed, F.lit(0.0)).when(absorbs, F.col("food_g") + F.coalesce("_gain", F.lit(0.0))).otherwise(F.col("food_g"))
    msg = F.when(swallowed & is_meal, F.lit(LOW_MEAL)).when(swallowed, F.lit("")).when(low, F.lit(LOW_MEAL)).otherwise(F.col("msg_type"))
    out = marked.withColumns({"_food": food, "_msg": msg}).drop("food_g", "msg_type")
    return own(out.withColumnsRenamed({"_food": "food_g", "_msg": "msg_type"})).select(*df.columns)


def keep_top_meals(
    df: DataFrame, n: int = 3, day_start_s: int = 4 * 3600, tie: Sequence[str] = (), meal: str = MEAL
) -> DataFrame:
    """Keep the n largest meals per shifted day, first come first on ties (TOP1)."""
    day = F.to_date(from_seconds(seconds(F.col("datetime")) - day_start_s))
    is_meal = F.coalesce(F.col("msg_type") == meal, F.lit(False))
    w = Window.partitionBy("p_num", "_day", "_meal").orderBy(F.desc_nulls_last("food_g"), "datetime", *tie)
    ranked = df.withColumn("_day", day).withColumn("_meal", is_meal).withColumn("_rk", F.row_number().over(w))
    lose = F.col("_meal") & (F.col("_rk") > n)
    return ranked.withColumns(
        {
            "food_g": F.when(lose, F.lit(0.0)).otherwise(F.col("food_g")),
            "msg_type": F.when(lose, F.lit("0")).otherwise(F.col("msg_type")),
        }
    ).select(*df.columns)


def meal_identification(
    df: DataFrame,
    max_null_run: int = 36,
    step: int = 300,
    day_start_s: int = 4 * 3600,
    min_carbs: float = 5,
    length_s: int = 7200,
    n_top: int = 3,
    tie: Sequence[str] = (),
    meal: str = MEAL,
) -> DataFrame:
    """Overlay, drop gappy days, merge, keep the top meals (MEA3)."""
    grid = overlay_meals(df, step, tie, meal)
    days = drop_gappy_days(grid, max_null_run, drop_null_rows=True)
    merged = merge_meals(days, length_s, min_carbs, meal)
    return keep_top_meals(merged, n_top, day_start_s, meal=meal)
