"""NULL runs, gap filling, segmentation and day filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefn import micros
from .blocks import BLOCK, OWN, Carry, Keys, cut, halo, keep_last, own, scan

GRID_KEYS = Keys()


def interpolate_small_gaps(
    df: DataFrame, max_gap_rows: int, step: int, col: str = "bg_mM", keys: Keys = GRID_KEYS, out: str | None = None
) -> DataFrame:
    """Fill interior NULL runs of at most ``max_gap_rows`` linearly by position (WIN6).

    Longer runs and runs at the ends stay NULL.  A fillable run lies within
    ``max_gap_rows`` rows of its known neighbours, so a halo of that width is exact.
    Needs a regular grid of ``step`` seconds.
    """
    if max_gap_rows <= 0:
        return df if not out else df.withColumn(out, F.col(col))
    reach = max_gap_rows * step
    return own(_fill_small_gaps(halo(df, keys, reach, reach), col, max_gap_rows, step, keys, out or col))


def _fill_small_gaps(near: DataFrame, col: str, max_gap_rows: int, step: int, keys: Keys, out: str) -> DataFrame:
    """The value of a row or, in a small enough gap, of the line between its known neighbours in the block.

    The neighbours are columns of their own, so that each window is evaluated once.
    """
    t = keys.second()
    known = F.when(F.col(col).isNotNull(), F.struct(t.alias("t"), F.col(col).alias("v")))
    upto = (Window.unboundedPreceding, 0)
    sides = near.withColumns({"_a": F.last(known, True).over(keys.window().rowsBetween(*upto)), "_b": F.last(known, True).over(keys.window_back().rowsBetween(*upto))})
    a, b = F.col("_a"), F.col("_b")
    span = b["t"] - a["t"]
    line = a["v"] + (b["v"] - a["v"]) * ((t - a["t"]) / span)
    return sides.withColumn(out, F.when(F.col(col).isNotNull(), F.col(col)).when(span <= (max_gap_rows + 1) * step, line)).drop("_a", "_b")


def null_runs(df: DataFrame, col: str = "bg_mM", keys: Keys = GRID_KEYS, pos: str = "pos") -> DataFrame:
    """(start, end exclusive, length) of every run of NULLs (WIN4).

    Rows are numbered by ``pos``.  All rows of a run share the position of the last
    known value before it, which is the grouping key of the run.
    """
    known = F.when(F.col(col).isNotNull(), F.col(pos))
    marked = scan(df.select(*keys.by, keys.time, *keys.tie, pos, col), keys, _k=Carry("prev", known))
    runs = marked.where(F.col(col).isNull()).groupBy(*keys.by, F.coalesce("_k", F.lit(-1)).alias("_k"))
    return runs.agg(
        F.min(pos).alias("run_start"),
        (F.max(pos) + 1).alias("run_end"),
        F.count("*").alias("run_length"),
    ).drop("_k")


def longest_null_run(df: DataFrame, col: str = "bg_mM", keys: Keys = GRID_KEYS, pos: str = "pos") -> DataFrame:
    """Longest NULL run per series, 0 when there is none (WIN5)."""
    best = null_runs(df, col, keys, pos).groupBy(*keys.by).agg(F.max("run_length").alias("_m"))
    every = df.select(*keys.by).distinct()
    return every.join(best, list(keys.by), "left").select(*keys.by, F.coalesce("_m", F.lit(0)).alias("longest_run"))


def islands(df: DataFrame, col: str = "bg_mM", keys: Keys = GRID_KEYS, pos: str = "pos", step_pos: int = 1) -> DataFrame:
    """Rows with a known value and ``island``: the number of breaks before them.

    A break is a known row whose predecessor in the grid is NULL or missing.
    """
    known = df.where(F.col(col).isNotNull())
    lagged = scan(known, keys, _p=Carry("prev", F.col(pos)))
    start = F.when(F.col("_p").isNull() | (F.col(pos) - F.col("_p") != step_pos), 1).otherwise(0).cast("long")
    return scan(lagged.withColumn("_st", start), keys, island=Carry("sum", F.col("_st"))).drop("_st", "_p")


def segment(
    df: DataFrame,
    step: int,
    threshold_mins: int = 45,
    min_rows: int = 608,
    col: str = "bg_mM",
    keys: Keys = GRID_KEYS,
) -> DataFrame:
    """Fill small gaps, cut at the others, drop short pieces, number the rest from 0 (WIN7).

    One halo serves both: a row's fill looks ``threshold_mins`` to either side, and whether
    it starts a run depends on the fill of the row before.  Rows are then counted per block
    and run; only these counts are windowed by patient, and they meet the rows again by
    block, so that a long run stays spread.
    """
    by, cap = list(keys.by), max(0, threshold_mins * 60 // step)
    near = halo(df, keys, (cap + 1) * step, cap * step)
    t, w = keys.second(), keys.window()
    filled = _fill_small_gaps(near, col, cap, step, keys, col) if cap else near
    known = filled.where(F.col(col).isNotNull())
    prev = F.lag(t).over(w)
    start = F.when(prev.isNull() | (t - prev != step), F.col("pos"))
    rows = known.withColumn("_start", start).where(F.col(OWN)).drop(OWN)
    here = F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", F.coalesce(here, F.lit(-1))).drop("_start")  # -1: began in an earlier block

    series = Window.partitionBy(*by).orderBy(BLOCK, "_in")
    parts = rows.groupBy(*by, BLOCK, "_in").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_run", F.last(F.when(F.col("_in") >= 0, F.col("_in")), True).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    parts = _numbered_runs(parts, by, min_rows).drop("_run")
    return rows.join(parts, [*by, BLOCK, "_in"]).drop(BLOCK, "_in").withColumn("segment_id", _segment_name(by))


def number_segments(marked: DataFrame, keys: Keys, min_rows: int) -> DataFrame:
    """Number the runs ``_run`` that are long enough and name them ``{patient}_seg_{n}``.

    Counts per block and run are numbered and meet the rows by block, so that a long run
    stays spread.
    """
    by = list(keys.by)
    rows, _ = cut(marked, keys)
    parts = rows.groupBy(*by, BLOCK, "_run").agg(F.count("*").alias("_n"))
    parts = _numbered_runs(parts, by, min_rows)
    return rows.join(parts, [*by, BLOCK, "_run"]).drop(BLOCK, "_run").withColumn("segment_id", _segment_name(by))


def _numbered_runs(parts: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """Parts ``(_run, _n)`` of long enough runs with segment_rows and segment_no."""
    total = F.sum("_n").over(Window.partitionBy(*by, "_run"))
    long = parts.withColumn("segment_rows", total).where(F.col("segment_rows") >= min_rows).drop("_n")
    return long.withColumn("segment_no", F.dense_rank().over(Window.partitionBy(*by).orderBy("_run")) - 1)


def _segment_name(by: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in by], F.lit("seg"), F.col("segment_no").cast("string"))


def gap_stats(
    df: DataFrame, step: int, threshold_mins: int = 45, min_rows: int = 608, col: str = "bg_mM", keys: Keys = GRID_KEYS
) -> DataFrame:
    """Counters of the gap handling per patient (WIN8), from the runs alone."""
    by = list(keys.by)
    cap = threshold_mins * 60 // step
    size = df.groupBy(*by).agg(
        F.count("*").alias("total_rows_original"),
        F.count_if(F.col(col).isNull()).alias("total_nan_before"),
        F.max("pos").alias("_max"),
    )
    runs = null_runs(df, col, keys).join(size.select(*by, "_max"), by)
    inner = (F.col("run_start") > 0) & (F.col("run_end") <= F.col("_max"))
    fixed = inner & (F.col("run_length") <= cap)
    gaps = runs.groupBy(*by).agg(
        F.count_if(fixed).alias("num_gaps_interpolated"),
        F.count_if(~fixed).alias("num_gaps_segmented"),
        F.sum(F.when(~fixed, F.col("run_length")).otherwise(0)).alias("total_nan_after_interp"),
    )
    # the stretches between the remaining gaps are the segments
    open_runs = runs.where(~fixed).select(*by, F.col("run_start").alias("_s"), F.col("run_end").alias("_e"))
    ends = size.select(*by, (F.col("_max") + 1).alias("_s"), (F.col("_max") + 1).alias("_e"))
    w = Window.partitionBy(*by).orderBy("_s", "_e")
    pieces = open_runs.unionByName(ends).withColumn(
        "_len", F.col("_s") - F.coalesce(F.lag("_e").over(w), F.lit(0))
    ).where("_len > 0")
    segs = pieces.groupBy(*by).agg(
        F.count_if(F.col("_len") >= min_rows).alias("num_segments_created"),
        F.count_if(F.col("_len") < min_rows).alias("num_segments_discarded"),
        F.sum(F.when(F.col("_len") >= min_rows, F.col("_len")).otherwise(0)).alias("rows_retained"),
    )
    out = size.drop("_max").join(gaps, by, "left").join(segs, by, "left").fillna(0)
    return out.withColumn("rows_discarded", F.col("total_rows_original") - F.col("rows_retained")).withColumn(
        "detected_interval_mins", F.lit(step // 60)
    )


def split_on_breaks(df: DataFrame, step: int, min_rows: int, keys: Keys, order: Column | None = None) -> DataFrame:
    """Cut a series where two stamps are not exactly one step apart (WIN9).

    Duplicate stamps keep their last row first; short chunks are dropped and the
    others numbered from 0.
    """
    single = keep_last(df, [*keys.by, keys.time], order) if order is not None else df
    now = micros(F.col(keys.time))
    k = replace(keys, tie=())
    lagged = scan(single, k, _p=Carry("prev", now))
    start = F.when(F.col("_p").isNull() | (now - F.col("_p") != step * 1_000_000), now)
    marked = scan(lagged.withColumn("_st", start), k, _run=Carry("last", F.col("_st"))).drop("_st", "_p")
    return number_segments(marked, k, min_rows)


def day_counter(df: DataFrame, keys: Keys = GRID_KEYS, before: int = 5, after: int = 6) -> DataFrame:
    """Day number that advances when the hour goes from ``before`` to ``after`` (WIN10)."""
    hour = F.hour(keys.time)
    lagged = scan(df, keys, _h=Carry("prev", hour))
    turn = ((F.col("_h") == before) & (hour == after)).cast("long")
    return scan(lagged.withColumn("_t", F.coalesce(turn, F.lit(0))), keys, day=Carry("sum", F.col("_t"))).drop("_h", "_t")


def drop_gappy_days(
    df: DataFrame, max_run: int, col: str = "bg_mM", drop_null_rows: bool = False, tie: Sequence[str] = ()
) -> DataFrame:
    """Drop calendar days whose longest NULL run exceeds ``max_run`` (WIN11).

    A day is its own group, so nothing is carried between days.
    """
    day = F.to_date("datetime")
    keys = ["p_num", "_day"]
    w = Window.partitionBy(*keys).orderBy("datetime", *tie)
    numbered = df.withColumn("_day", day).select(*keys, "datetime", *tie, col).withColumn("_rn", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last_known = F.coalesce(F.max(F.when(F.col(col).isNotNull(), F.col("_rn"))).over(upto), F.lit(0))
    run = F.when(F.col(col).isNull(), F.col("_rn") - last_known).otherwise(0)
    good = numbered.withColumn("_run", run).groupBy(*keys).agg(F.max("_run").alias("_m")).where(F.col("_m") <= max_run)
    kept = df.withColumn("_day", day).join(good.select(*keys), keys, "left_semi").drop("_day")
    return kept.where(F.col(col).isNotNull()) if drop_null_rows else kept


def wrap_differences(df: DataFrame, keys: Keys, second_col: str = "second_of_day") -> DataFrame:
    """Seconds since the previous row on a 24-hour clock; the first row gets 0 (WIN1).

    ``keys.time`` is the input order; ``second_col`` has no date.
    """
    lagged = scan(df, keys, _p=Carry("prev", F.col(second_col)))
    diff = F.coalesce(F.pmod(F.col(second_col) - F.col("_p"), F.lit(86_400)), F.lit(0))
    return lagged.withColumn("time_diff", diff.cast("long")).drop("_p")


def absolute_time(df: DataFrame, keys: Keys, start_day: int, second_col: str = "second_of_day") -> DataFrame:
    """First stamp plus the running sum of the differences, as epoch seconds (WIN2)."""
    diffs = wrap_differences(df, keys, second_col)
    summed = scan(
        diffs, keys, _sum=Carry("sum", F.col("time_diff")), _first=Carry("first", F.col(second_col))
    )
    return summed.withColumn("epoch", (F.lit(start_day * 86_400) + F.col("_first") + F.col("_sum")).cast("long")).drop(
        "_sum", "_first"
    )


def rollover_dates(df: DataFrame, keys: Keys, start_day: int, minute_col: str = "minute_of_day") -> DataFrame:
    """The date advances whenever the minute of day falls; NULL stays NULL (WIN3)."""
    lagged = scan(df, keys, _p=Carry("prev", F.col(minute_col)))
    turn = F.coalesce((F.col(minute_col) < F.col("_p")).cast("long"), F.lit(0))
    days = scan(lagged.withColumn("_t", turn), keys, _d=Carry("sum", F.col("_t")))
    epoch = (F.lit(start_day) + F.col("_d")) * 86_400 + F.col(minute_col) * 60
    return days.withColumn("epoch", epoch.cast("long")).drop("_p", "_t", "_d")
