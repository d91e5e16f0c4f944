"""NULL runs, gap filling, segments, breaks and clock repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefn import micros, seconds
from ..operators import gaps as G
from ..operators.blocks import DAY, Keys
from .catalog import GRID, GRID_KEYS, R, RAW_KEYS, SER, STEP, Tables, epoch, grid, query, r, series

CAP, MIN_ROWS = 2, 3

RUNS = """
k AS (SELECT *, count(bg) OVER (PARTITION BY p_num ORDER BY t) AS grp FROM g),
runs AS (SELECT p_num, min(pos) AS run_start, max(pos) + 1 AS run_end, count(*) AS run_length
         FROM k WHERE bg IS NULL GROUP BY p_num, grp)"""

FILL = f"""
w AS (SELECT *,
    max(CASE WHEN bg IS NOT NULL THEN pos END) OVER (PARTITION BY p_num ORDER BY t) AS ap,
    min(CASE WHEN bg IS NOT NULL THEN pos END) OVER (PARTITION BY p_num ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp
  FROM g),
f AS (SELECT w.*, CASE WHEN w.bg IS NOT NULL THEN w.bg WHEN bp - ap - 1 <= {CAP}
    THEN a.bg + (b.bg - a.bg) * (w.pos - ap) / (bp - ap) END AS y
  FROM w LEFT JOIN g a ON a.p_num = w.p_num AND a.pos = w.ap LEFT JOIN g b ON b.p_num = w.p_num AND b.pos = w.bp)"""

SEGMENTS = f"""
i AS (SELECT *, pos - row_number() OVER (PARTITION BY p_num ORDER BY t) AS island FROM f WHERE y IS NOT NULL),
s AS (SELECT p_num, island, count(*) AS segment_rows FROM i GROUP BY ALL HAVING count(*) >= {MIN_ROWS}),
n AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY island) - 1 AS segment_no FROM s)"""


@query("win4_null_runs", f"WITH {GRID}, {RUNS} SELECT * FROM runs")
def win4(t: Tables):
    return G.null_runs(grid(t), keys=GRID_KEYS)


@query("win5_longest_null_run", f"""
WITH {GRID}, {RUNS}
SELECT p_num, coalesce(max(run_length), 0) AS longest_run FROM (SELECT DISTINCT p_num FROM g) LEFT JOIN runs USING (p_num) GROUP BY p_num""")
def win5(t: Tables):
    return G.longest_null_run(grid(t), keys=GRID_KEYS)


@query("win6_interpolate_small_gaps", f"WITH {GRID}, {FILL} SELECT p_num, t, {R('bg')} AS bg_mM, {R('y')} AS filled FROM f")
def win6(t: Tables):
    out = G.interpolate_small_gaps(grid(t), CAP, STEP, keys=GRID_KEYS, out="filled")
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), r("filled").alias("filled"))


@query("win7_segments", f"""
WITH {GRID}, {FILL}, {SEGMENTS}
SELECT i.p_num, i.t, {R('y')} AS bg_mM, segment_rows, CAST(segment_no AS INTEGER) AS segment_no,
  i.p_num || '_seg_' || segment_no AS segment_id
FROM i JOIN n USING (p_num, island)""")
def win7(t: Tables):
    out = G.segment(grid(t), STEP, CAP * STEP // 60, MIN_ROWS, keys=GRID_KEYS)
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), "segment_rows", "segment_no", "segment_id")


@query("win8_gap_statistics", f"""
WITH {GRID}, {RUNS}, {FILL},
after AS (SELECT p_num, count(*) AS rn, count(*) FILTER (bg IS NULL) AS nb, count(*) FILTER (y IS NULL) AS na FROM f GROUP BY p_num),
k2 AS (SELECT *, count(y) OVER (PARTITION BY p_num ORDER BY t) AS grp2 FROM f),
left_runs AS (SELECT p_num, count(DISTINCT grp2) AS n FROM k2 WHERE y IS NULL GROUP BY p_num),
all_runs AS (SELECT p_num, count(*) AS n FROM runs GROUP BY p_num),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY p_num ORDER BY t) AS island FROM f WHERE y IS NOT NULL),
s AS (SELECT p_num, count(*) AS n FROM isl GROUP BY p_num, island),
sg AS (SELECT p_num, count(*) FILTER (n >= {MIN_ROWS}) AS made, count(*) FILTER (n < {MIN_ROWS}) AS lost,
  coalesce(sum(n) FILTER (n >= {MIN_ROWS}), 0) AS kept FROM s GROUP BY p_num)
SELECT p_num, rn AS total_rows_original, nb AS total_nan_before, na AS total_nan_after_interp,
  coalesce(all_runs.n, 0) - coalesce(left_runs.n, 0) AS num_gaps_interpolated, coalesce(left_runs.n, 0) AS num_gaps_segmented,
  coalesce(made, 0) AS num_segments_created, coalesce(lost, 0) AS num_segments_discarded,
  CAST(coalesce(kept, 0) AS BIGINT) AS rows_retained, CAST(rn - coalesce(kept, 0) AS BIGINT) AS rows_discarded,
  {STEP // 60} AS detected_interval_mins
FROM after LEFT JOIN all_runs USING (p_num) LEFT JOIN left_runs USING (p_num) LEFT JOIN sg USING (p_num)""")
def win8(t: Tables):
    return G.gap_stats(grid(t), STEP, CAP * STEP // 60, MIN_ROWS, keys=GRID_KEYS)


@query("win9_split_on_time_breaks", f"""
WITH {SER}, h AS (SELECT p_num, us // {STEP * 1_000_000} * {STEP} AS t, arg_max(bg, (us, event_id)) AS bg FROM ser GROUP BY ALL),
i AS (SELECT *, t // {STEP} - row_number() OVER (PARTITION BY p_num ORDER BY t) AS island FROM h),
s AS (SELECT p_num, island, count(*) AS segment_rows FROM i GROUP BY ALL HAVING count(*) >= {MIN_ROWS}),
n AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY island) - 1 AS segment_no FROM s)
SELECT p_num, t, {R('bg')} AS bg_mM, segment_rows, CAST(segment_no AS INTEGER) AS segment_no FROM i JOIN n USING (p_num, island)""")
def win9(t: Tables):
    slot = (seconds(F.col("datetime")) - F.pmod(seconds(F.col("datetime")), F.lit(STEP)))
    src = series(t).select("p_num", F.timestamp_seconds(slot).cast("timestamp_ntz").alias("datetime"), "event_id", "bg_mM", micros(F.col("datetime")).alias("us"))
    out = G.split_on_breaks(src, STEP, MIN_ROWS, Keys(block=4 * DAY), F.struct("us", "event_id"))
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), "segment_rows", "segment_no")


@query("win10_day_counter", f"""
WITH {SER}, h AS (SELECT *, hour(ts) AS h, lag(hour(ts)) OVER (PARTITION BY p_num ORDER BY us, event_id) AS ph FROM ser)
SELECT p_num, event_id, CAST(sum(CASE WHEN ph = 5 AND h = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY p_num ORDER BY us, event_id) AS BIGINT) AS day FROM h""")
def win10(t: Tables):
    return G.day_counter(series(t), RAW_KEYS).select("p_num", "event_id", "day")


_DAYS = f"""
d AS (SELECT *, t // 86400 AS day FROM g),
k AS (SELECT *, count(bg) OVER (PARTITION BY p_num, day ORDER BY t) AS grp FROM d),
q AS (SELECT p_num, day, grp, count(*) FILTER (bg IS NULL) AS n FROM k GROUP BY ALL),
ok AS (SELECT p_num, day FROM q GROUP BY ALL HAVING max(n) <= 1)"""


@query("win11_drop_gappy_days", f"WITH {GRID}, {_DAYS} SELECT p_num, t, {R('bg')} AS bg_mM FROM d JOIN ok USING (p_num, day)")
def win11(t: Tables):
    return G.drop_gappy_days(grid(t), 1).select("p_num", epoch(), r("bg_mM").alias("bg_mM"))


@query("win11_drop_gappy_days_and_nulls", f"WITH {GRID}, {_DAYS} SELECT p_num, t, {R('bg')} AS bg_mM FROM d JOIN ok USING (p_num, day) WHERE bg IS NOT NULL")
def win11_nulls(t: Tables):
    return G.drop_gappy_days(grid(t), 1, drop_null_rows=True).select("p_num", epoch(), r("bg_mM").alias("bg_mM"))


def _clock(t: Tables):
    s = series(t)
    day = F.hour("datetime") * 3600 + F.minute("datetime") * 60 + F.second("datetime")
    return s.select("p_num", "datetime", "event_id", day.cast("long").alias("second_of_day"), F.floor(day / 60).cast("long").alias("minute_of_day"))


_CLOCK = f"{SER}, c AS (SELECT *, (us // 1000000) % 86400 AS sod FROM ser), " + """
d AS (SELECT *, coalesce((sod - lag(sod) OVER (PARTITION BY p_num ORDER BY us, event_id) + 86400) % 86400, 0) AS time_diff FROM c)"""


@query("win1_wrapped_differences", f"WITH {_CLOCK} SELECT p_num, event_id, time_diff FROM d")
def win1(t: Tables):
    return G.wrap_differences(_clock(t), RAW_KEYS).select("p_num", "event_id", "time_diff")


@query("win2_absolute_time", f"""
WITH {_CLOCK} SELECT p_num, event_id, CAST(20089 * 86400 + first_value(sod) OVER w + sum(time_diff) OVER w AS BIGINT) AS epoch
FROM d WINDOW w AS (PARTITION BY p_num ORDER BY us, event_id)""")
def win2(t: Tables):
    return G.absolute_time(_clock(t), RAW_KEYS, 20_089).select("p_num", "event_id", "epoch")


@query("win3_rollover_dates", f"""
WITH {_CLOCK}, m AS (SELECT *, sod // 60 AS mi, lag(sod // 60) OVER (PARTITION BY p_num ORDER BY us, event_id) AS pm FROM d)
SELECT p_num, event_id, CAST((20089 + sum(CASE WHEN mi < pm THEN 1 ELSE 0 END) OVER (PARTITION BY p_num ORDER BY us, event_id)) * 86400 + mi * 60 AS BIGINT) AS epoch
FROM m""")
def win3(t: Tables):
    return G.rollover_dates(_clock(t), RAW_KEYS, 20_089).select("p_num", "event_id", "epoch")
