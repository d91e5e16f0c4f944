"""Alignment of irregular events onto regular grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.timefn import MICROS, floor_slot, from_seconds, micros, round_slot
from .blocks import WEEK, Carry, Keys, keep_last, scan, spread_range

MEAN_COLUMNS = ("bg_mM", "rate", "hr_bpm")
ZERO_IS_VALUE = ("rate",)  # zero rate means a suspended pump
FIRST_COLUMNS = ("isf", "cr", "iob", "bgInput")


def first_by(col: str | Column, order: Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.min_by(c, F.when(c.isNotNull(), order))


def last_by(col: str | Column, order: Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.max_by(c, F.when(c.isNotNull(), order))


FALLBACK_MINS = 5  # where a series shows no interval of its own


def interval_mode(df: DataFrame, keys: Keys = Keys(), fallback: int = FALLBACK_MINS) -> DataFrame:
    """Most common sampling interval per patient in whole minutes (AGG4).

    Ties go to the shorter interval; a patient with one row gets ``fallback``.
    """
    now = micros(F.col(keys.time))
    lagged = scan(df.select(*keys.by, keys.time, *keys.tie), keys, _p=Carry("prev", now))
    diffs = lagged.withColumn("_d", now - F.col("_p")).groupBy(*keys.by, "_d").agg(F.count("*").alias("_n"))
    best = F.min_by("_d", F.when(F.col("_d").isNotNull(), F.struct(-F.col("_n"), F.col("_d"))))
    minutes = F.floor(best / F.lit(60 * MICROS)).cast("int")
    return diffs.groupBy(*keys.by).agg(F.coalesce(minutes, F.lit(fallback)).alias("interval_mins"))


def positive_mins(mins: Column) -> Column:
    return F.when(mins > 0, mins).otherwise(FALLBACK_MINS)


def densify(
    bins: DataFrame, step: int | Column, by: Sequence[str] = ("p_num",), slot: str = "slot", block: int = WEEK, chunk: int = 4096
) -> DataFrame:
    """Full grid from the first to the last slot of each patient (JOIN13).

    ``slot`` holds epoch seconds; empty slots get NULL in every other column.  Each
    filled slot opens the empty ones up to the next filled slot in place, so only
    the filled slots are shuffled, never the grid.  Adds ``pos``, counted from 0.
    """
    width = F.lit(step) if isinstance(step, int) else step
    rest = [c for c in bins.columns if c not in (*by, slot, "_step", "pos")]
    known = bins.withColumn("_dt", from_seconds(F.col(slot)))
    carried = scan(known, Keys(tuple(by), "_dt", (), block), _next=Carry("next", F.col(slot)), _first=Carry("first", F.col(slot)))
    top = F.coalesce((F.col("_next") - F.col(slot)) / width - 1, F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    # in chunks, so that a long gap never becomes one long array
    pieces = carried.withColumn("_top", top).withColumn("_c", F.explode(F.sequence(zero, F.floor(F.col("_top") / chunk).cast("long"))))
    first = F.col("_c") * chunk
    rows = pieces.withColumn("_i", F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("_top")))))
    here = F.col("_i") == 0
    at = (F.col(slot) + F.col("_i") * width).cast("long")
    return rows.select(
        *by, at.alias(slot), ((at - F.col("_first")) / width).cast("long").alias("pos"), *[F.when(here, F.col(c)).alias(c) for c in rest]
    )


def regular_aggregates(
    df: DataFrame,
    mean: Sequence[str] = MEAN_COLUMNS,
    keep_zero: Sequence[str] = ZERO_IS_VALUE,
    first: Sequence[str] = FIRST_COLUMNS,
    order: Column | None = None,
    skip: Sequence[str] = ("p_num", "datetime"),
) -> list[Column]:
    """Aggregate per column chosen from its name and type (AGG2)."""
    order = F.col("datetime") if order is None else order
    aggs = []
    for field in df.schema.fields:
        name, col = field.name, F.col(field.name)
        if name in skip:
            continue
        if isinstance(field.dataType, T.NumericType) and name not in first:
            if name in mean:
                value = col if name in keep_zero else F.when(col != 0, col)
                aggs.append(F.avg(value).alias(name))
            else:
                aggs.append(F.coalesce(F.sum(col), F.lit(0).cast(field.dataType)).alias(name))
        else:
            aggs.append(first_by(name, order).alias(name))
    return aggs


def regular_bins(
    df: DataFrame, step: int | None = None, tie: Sequence[str] = (), drop: Sequence[str] = ()
) -> tuple[DataFrame, int | Column]:
    """The filled slots of every patient's regular grid (AGG2), and the slot width.

    ``step`` is the slot width in seconds; without it each patient's own sampling
    interval is used, or five minutes where that is less than one minute or unknown.
    """
    order = F.struct("datetime", *tie)
    source = df.drop(*drop) if drop else df
    aggs = regular_aggregates(source, order=order, skip=("p_num", "datetime", *tie))
    if step is None:
        modes = interval_mode(df).withColumn("_mins", positive_mins(F.col("interval_mins"))).select("p_num", "_mins")
        source = source.join(modes, "p_num").withColumn("_step", F.col("_mins").cast("long") * 60).drop("_mins")
        width: int | Column = F.col("_step")
        aggs.append(F.first("_step").alias("_step"))
    else:
        width = step
    slot = round_slot(F.col("datetime"), width)
    return source.withColumn("slot", slot).groupBy("p_num", "slot").agg(*aggs), width


def regularize(
    df: DataFrame, step: int | None = None, tie: Sequence[str] = (), drop: Sequence[str] = ()
) -> DataFrame:
    """Bring every patient onto a regular grid, aggregating rows of one slot (AGG2 + JOIN13).

    For ``step`` see :func:`regular_bins`.  Adds ``pos``, the position in the patient's grid.
    """
    grid = densify(*regular_bins(df, step, tie, drop))
    return grid.withColumn("datetime", from_seconds(F.col("slot"))).drop("slot")


def floor_bins(df: DataFrame, step: int, aggs: Sequence[Column], by: Sequence[str] = ("p_num",)) -> DataFrame:
    """Aggregates per floored slot of one source table (AGG1, AGG3)."""
    return df.groupBy(*by, floor_slot(F.col("datetime"), step).alias("slot")).agg(*aggs)


def asof_grid(
    df: DataFrame,
    step: int,
    direction: str = "forward",
    keys: Keys = Keys(),
    tie: Sequence[str] = (),
) -> DataFrame:
    """As-of join of observations onto each patient's grid, tolerance two thirds of a step (JOIN5).

    The grid starts at the first observation, unrounded.  Instead of a range join,
    each observation names the one slot (two for ``nearest``) it can fill; the
    closest observation per slot wins and the slots are joined to the grid.
    """
    width = step * MICROS
    tolerance = width * 2 // 3
    by = list(keys.by)
    now = micros(F.col(keys.time))
    bounds = df.groupBy(*by).agg(F.min(now).alias("_lo"), F.max(now).alias("_hi"))
    offset = now - F.col("_lo")
    down = F.floor(offset / F.lit(width)).cast("long")
    up = F.ceil(offset / F.lit(width)).cast("long")
    slots = {
        "forward": F.array(down),
        "backward": F.array(up),
        "nearest": F.array_distinct(F.array(down, up)),
    }[direction]
    placed = df.join(bounds, by).withColumn("_off", offset).withColumn("pos", F.explode(slots))
    gap = F.col("_off") - F.col("pos") * F.lit(width)
    near = placed.withColumn("_gap", gap).where(F.abs(F.col("_gap")) <= tolerance)
    rest = [c for c in df.columns if c not in (*by, keys.time, *tie)]
    # an earlier observation wins a tie in distance; of equal stamps the first
    # (forward) or the last (backward and nearest) one does
    within = [F.col(t) for t in tie] if direction == "forward" else [-F.col(t) for t in tie]
    pick = F.min_by(F.struct(*rest), F.struct(F.abs(F.col("_gap")), F.col("_gap"), *within))
    chosen = near.groupBy(*by, "pos").agg(pick.alias("_r")).select(*by, "pos", *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    edges = bounds.withColumn("_lo", F.col("_lo")).withColumn("_hi", F.col("_hi"))
    grid = spread_range(edges, by, "_lo", "_hi", width, "_us").drop("_hi")
    stamp = F.timestamp_micros(F.col("_us")).cast("timestamp_ntz")
    out = grid.join(chosen, [*by, "pos"], "left").withColumn(keys.time, stamp)
    return out.drop("_us", "_lo")


def overlay_meals(df: DataFrame, step: int, tie: Sequence[str] = (), meal: str = "ANNOUNCE_MEAL") -> DataFrame:
    """Resample meals and other rows apart, then let meal values win (JOIN6).

    The grid runs over the non-meal rows; ``food_g_keep`` is the meal's own value.
    """
    order = F.struct("datetime", *tie)
    cols = [c for c in df.columns if c not in ("p_num", "datetime", *tie)]
    slot = floor_slot(F.col("datetime"), step).alias("slot")
    is_meal = F.coalesce(F.col("msg_type") == meal, F.lit(False))
    other = df.where(~is_meal).groupBy("p_num", slot).agg(*[first_by(c, order).alias(c) for c in cols])
    shared = [c for c in ("bg_mM", "msg_type", "food_g") if c in cols]
    meals = df.where(is_meal).groupBy("p_num", slot).agg(*[first_by(c, order).alias(f"_m_{c}") for c in shared])
    grid = densify(other, step)
    joined = grid.join(meals, ["p_num", "slot"], "left")
    out = [F.coalesce(F.col(f"_m_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in cols]
    keep = F.col("_m_food_g") if "food_g" in shared else F.lit(0.0)
    return joined.select(
        "p_num", from_seconds(F.col("slot")).alias("datetime"), "pos", *out, keep.alias("food_g_keep")
    )


def join_sources(cgm: DataFrame, bolus: DataFrame, basal: DataFrame, on: Sequence[str] = ("p_num", "slot")) -> DataFrame:
    """CGM slots with bolus and basal; no bolus means 0, no basal stays NULL (JOIN1)."""
    on = list(on)
    out = cgm.join(bolus, on, "left").join(basal, on, "left")
    return out.fillna(0.0, [c for c in bolus.columns if c not in on and dict(bolus.dtypes)[c] == "double"])


def join_bins_keep_last(cgm: DataFrame, bins: DataFrame, step: int, order: Column) -> DataFrame:
    """CGM rows with the insulin of their rounded slot, last CGM row per slot (JOIN2).

    The last row is picked before the join, so both sides meet as one row per slot.
    """
    slotted = cgm.withColumn("slot", round_slot(F.col("datetime"), step))
    return keep_last(slotted, ["p_num", "slot"], order).join(bins, ["p_num", "slot"], "left")


def attach_closest(readings: DataFrame, messages: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Give each message to its closest reading; a later message overwrites (JOIN16).

    Readings and messages are scanned as one series; the reading before and the
    reading after a message are the only candidates.  A tie goes to the earlier.
    """
    by, t = list(keys.by), keys.time
    cols = [c for c in messages.columns if c not in (*by, t)]
    marks = readings.select(*by, t).distinct().withColumn("_kind", F.lit(0)).unionByName(
        messages.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    k = replace(keys, tie=("_kind", *keys.tie))
    reading_time = F.when(F.col("_kind") == 0, F.col(t))
    seen = scan(marks, k, _a=Carry("last", reading_time), _b=Carry("next", reading_time)).where("_kind = 1")
    us = micros
    before, after = us(F.col(t)) - us(F.col("_a")), us(F.col("_b")) - us(F.col(t))
    target = F.when(F.col("_b").isNull() | (before <= after), F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    placed = seen.withColumn("_to", target).where(F.col("_to").isNotNull())
    order = F.struct(t, *keys.tie)
    chosen = placed.groupBy(*by, F.col("_to").alias(t)).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    chosen = chosen.select(*by, t, *[F.col(f"_r.`{c}`").alias(c) for c in cols])
    return readings.join(chosen, [*by, t], "left")


def reconcile(a: DataFrame, b: DataFrame, step: int, tolerance: float = 0.5, value: str = "bg_mM") -> DataFrame:
    """Agreement of two sources of one patient's readings on rounded stamps (JOIN12)."""
    slot = round_slot(F.col("datetime"), step)
    one = lambda d, n: d.groupBy("p_num", slot.alias("slot")).agg(F.avg(value).alias(n))
    both = one(a, "_a").join(one(b, "_b"), ["p_num", "slot"]).withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    return both.groupBy("p_num").agg(
        F.count("*").alias("common_rows"),
        F.avg("_d").alias("mean_abs_diff"),
        F.max("_d").alias("max_abs_diff"),
        (F.avg((F.col("_d") <= tolerance).cast("double")) * 100).alias("pct_within"),
    )


def pct_on_boundary(df: DataFrame, step: int) -> DataFrame:
    """Share of stamps exactly on a slot boundary, per patient (JOIN12)."""
    on = (F.pmod(micros(F.col("datetime")), F.lit(step * MICROS)) == 0).cast("double")
    return df.groupBy("p_num").agg((F.avg(on) * 100).alias("pct_on_boundary"))
