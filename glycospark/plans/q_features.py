"""Basal, kernels, smoothing, imputation and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import carb_kernel, insulin_kernel
from ..operators import features as X
from ..operators.blocks import DAY, Keys
from .catalog import GRID, GRID_KEYS, R, RAW_KEYS, SER, STEP, Tables, epoch, grid, grid_sql, query, r, series

W = "(PARTITION BY p_num ORDER BY t)"
HALF_HOUR = 1800  # the kernels last three hours, so they need a finer grid
FINE_KEYS = Keys(block=DAY)
FINE = grid_sql(HALF_HOUR)


@query("win12_rollover_automated", f"""
WITH {grid_sql(3600)}
SELECT p_num, t, {R("dose + coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY p_num ORDER BY t ROWS UNBOUNDED PRECEDING), 0)")} AS dose_units FROM (
  SELECT p_num, t, coalesce(dose, 0) AS dose, rate FROM g)""")
def win12(t: Tables):
    out = X.rollover_automated(grid(t, 3600).fillna(0.0, ["dose_units"]), 3600, FINE_KEYS)
    return out.select("p_num", epoch(), r("dose_units").alias("dose_units"))


def temp_sql(step: int) -> str:
    """CTEs up to o: the grid with the last basal order of each slot, its rate r0, minutes d0 and position op."""
    order = lambda c: f"last_value(CASE WHEN rate IS NOT NULL THEN {c} END IGNORE NULLS) OVER w"
    return f"""{grid_sql(step)},
o AS MATERIALIZED (SELECT p_num, t, pos, bg, food, rate, dose, {order('pos')} AS op, {order('rate')} AS r0, {order('dur')} AS d0
  FROM g WINDOW w AS (PARTITION BY p_num ORDER BY t ROWS UNBOUNDED PRECEDING))"""


@query("win13_rollover_temp", f"""
WITH {temp_sql(3600)}
SELECT p_num, t, {R('coalesce(dose, 0) + CASE WHEN pos - op < floor(d0 / 60) THEN r0 ELSE 0 END')} AS dose_units FROM o""")
def win13(t: Tables):
    out = X.rollover_temp(grid(t, 3600).fillna(0.0, ["dose_units"]), 3600, FINE_KEYS)
    return out.select("p_num", epoch(), r("dose_units").alias("dose_units"))


def _kernel_sql(kernel, amount: str, names: tuple[str, str], where: str) -> str:
    values = ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(*kernel)))
    return f"""
WITH {FINE}, kern(k, a, b) AS (VALUES {values}),
c AS (SELECT p_num, t + k * {HALF_HOUR} AS t, sum({amount} * a) AS a, sum({amount} * b) AS b FROM g, kern WHERE {where} GROUP BY 1, 2)
SELECT g.p_num, g.t, {R('coalesce(c.a, 0)')} AS {names[0]}, {R('coalesce(c.b, 0)')} AS {names[1]} FROM g LEFT JOIN c ON c.p_num = g.p_num AND c.t = g.t"""


@query("phy1_carbs_on_board", _kernel_sql(carb_kernel(30), "food", ("carb_availability", "cob"), "food IS NOT NULL"))
def phy1(t: Tables):
    out = X.carbs_on_board(grid(t, HALF_HOUR), HALF_HOUR, FINE_KEYS)
    return out.select("p_num", epoch(), r("carb_availability").alias("carb_availability"), r("cob").alias("cob"))


@query("phy2_insulin_on_board", _kernel_sql(insulin_kernel(30), "dose", ("insulin_availability", "iob"), "dose > 0"))
def phy2(t: Tables):
    out = X.insulin_on_board(grid(t, HALF_HOUR), HALF_HOUR, FINE_KEYS)
    return out.select("p_num", epoch(), r("insulin_availability").alias("insulin_availability"), r("iob").alias("iob"))


@query("join8_kernel_join", f"""
WITH {GRID}, kern(k, w) AS (VALUES (0, 1.0), (1, 0.5), (2, 0.25)),
c AS (SELECT p_num, t + k * {STEP} AS t, sum(food * w) AS x FROM g, kern WHERE food <> 0 GROUP BY 1, 2)
SELECT g.p_num, g.t, {R('coalesce(c.x, 0)')} AS response FROM g LEFT JOIN c ON c.p_num = g.p_num AND c.t = g.t""")
def join8(t: Tables):
    out = X.convolve(grid(t), "food_g", {"response": [1.0, 0.5, 0.25]}, STEP, GRID_KEYS)
    return out.select("p_num", epoch(), r("response").alias("response"))


@query("cal1_time_of_day", f"""
WITH {SER} SELECT p_num, event_id, {R('sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)')} AS hour_sin,
  {R('cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)')} AS hour_cos FROM ser""")
def cal1(t: Tables):
    return X.time_of_day(series(t)).select("p_num", "event_id", (r("hour_sin") + 0).alias("hour_sin"), (r("hour_cos") + 0).alias("hour_cos"))


@query("cal2_future_covariates", f"""
WITH l AS (SELECT user_id AS p_num, epoch(date_trunc('hour', max(ts)))::BIGINT AS t0 FROM events GROUP BY 1),
s AS (SELECT p_num, CAST(i AS INTEGER) AS step, t0 + i * 300 AS t FROM (SELECT *, unnest(range(1, 25)) AS i FROM l))
SELECT p_num, step, t, {R('sin(2 * pi() * ((t % 86400) // 60) / 1440)')} AS hour_sin, {R('cos(2 * pi() * ((t % 86400) // 60) / 1440)')} AS hour_cos FROM s""")
def cal2(t: Tables):
    last = series(t).groupBy("p_num").agg(F.date_trunc("hour", F.max("datetime")).cast("timestamp_ntz").alias("datetime"))
    out = X.future_covariates(last, 24, 300)
    return out.select("p_num", "step", epoch(), (r("hour_sin") + 0).alias("hour_sin"), (r("hour_cos") + 0).alias("hour_cos"))


@query("win14_moving_average", f"WITH {GRID} SELECT p_num, t, {R('avg(bg) OVER (PARTITION BY p_num ORDER BY t ROWS 4 PRECEDING)')} AS moving_average FROM g")
def win14(t: Tables):
    return X.moving_average(grid(t), 5, STEP, keys=GRID_KEYS).select("p_num", epoch(), r("moving_average").alias("moving_average"))


@query("win15_centred_average", f"""
WITH {GRID} SELECT p_num, t, CASE WHEN count(bg) OVER w >= 3 THEN {R('avg(bg) OVER w')} END AS smoothed
FROM g WINDOW w AS (PARTITION BY p_num ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def win15(t: Tables):
    return X.centred_average(grid(t), 5, STEP, 3, keys=GRID_KEYS).select("p_num", epoch(), r("smoothed").alias("smoothed"))


@query("win15_weighted_average", f"""
WITH {GRID} SELECT p_num, t, {R('(lag(bg) OVER w + 2 * bg + lead(bg) OVER w) / 4')} AS smoothed FROM g WINDOW w AS {W}""")
def win15_weighted(t: Tables):
    out = X.centred_average(grid(t), 3, STEP, weights=[1, 2, 1], keys=GRID_KEYS)
    return out.select("p_num", epoch(), r("smoothed").alias("smoothed"))


@query("win16_exponential_adjusted", f"""
WITH {GRID}
SELECT a.p_num, a.t, {R('sum(b.bg * pow(0.7, a.pos - b.pos)) / sum(CASE WHEN b.bg IS NOT NULL THEN pow(0.7, a.pos - b.pos) END)')} AS smoothed
FROM g a JOIN g b ON b.p_num = a.p_num AND b.pos <= a.pos GROUP BY a.p_num, a.t""")
def win16(t: Tables):
    return X.exponential_average(grid(t), STEP, 0.3, keys=GRID_KEYS).select("p_num", epoch(), r("smoothed").alias("smoothed"))


def _recursive_sql(keep: str, alpha: str) -> str:
    return f"""
WITH RECURSIVE {GRID},
o AS (SELECT p_num, t, pos, bg, row_number() OVER (PARTITION BY p_num ORDER BY pos) AS i FROM g WHERE bg IS NOT NULL),
e AS (SELECT p_num, t, pos, i, bg AS y FROM o WHERE i = 1
  UNION ALL
  SELECT o.p_num, o.t, o.pos, o.i, (pow({keep}, o.pos - e.pos) * e.y + {alpha} * o.bg) / (pow({keep}, o.pos - e.pos) + {alpha}) FROM e JOIN o ON o.p_num = e.p_num AND o.i = e.i + 1)
SELECT g.p_num, g.t, {R('last_value(e.y IGNORE NULLS) OVER (PARTITION BY g.p_num ORDER BY g.t ROWS UNBOUNDED PRECEDING)')} AS smoothed
FROM g LEFT JOIN e ON e.p_num = g.p_num AND e.pos = g.pos"""


@query("win16_exponential_recursive", _recursive_sql("0.7", "0.3"))
def win16_recursive(t: Tables):
    slim = grid(t).select("p_num", "datetime", "pos", "bg_mM")
    return X.exponential_average(slim, STEP, 0.3, False, keys=GRID_KEYS).select("p_num", epoch(), r("smoothed").alias("smoothed"))


@query("win16_exponential_slow", _recursive_sql("0.999", "0.001"))
def win16_slow(t: Tables):
    """A memory of many blocks."""
    slim = grid(t).select("p_num", "datetime", "pos", "bg_mM")
    return X.exponential_average(slim, STEP, 0.001, False, keys=GRID_KEYS).select("p_num", epoch(), r("smoothed").alias("smoothed"))


@query("win17_cgm_features", f"""
WITH {SER}, a AS (SELECT *, us - lag(us) OVER (PARTITION BY p_num ORDER BY us, event_id) AS du, bg - lag(bg) OVER (PARTITION BY p_num ORDER BY us, event_id) AS db FROM ser),
x AS (SELECT *, avg(bg) OVER h1 AS m1, stddev_samp(bg) OVER h1 AS s1, avg(bg) OVER h3 AS m3, stddev_samp(bg) OVER h3 AS s3 FROM a
  WINDOW h1 AS (PARTITION BY p_num ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1800000000 FOLLOWING),
    h3 AS (PARTITION BY p_num ORDER BY us RANGE BETWEEN 5399999999 PRECEDING AND 5400000000 FOLLOWING))
SELECT p_num, event_id, {R('db / (du / 60000000.0)')} AS glucose_roc, {R('m1')} AS mean_1h, {R('s1')} AS std_1h, {R('m3')} AS mean_3h,
  {R('s3')} AS std_3h, {R('s3 / m3')} AS cv_3h, CAST(bg < 3.0 AS INTEGER) AS is_severe_hypo, CAST(bg < 3.9 AS INTEGER) AS is_hypo,
  CAST(bg BETWEEN 3.9 AND 10.0 AS INTEGER) AS in_range, CAST(bg > 10.0 AS INTEGER) AS is_hyper, CAST(bg > 13.9 AS INTEGER) AS is_severe_hyper,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
  CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day
FROM x""")
def win17(t: Tables):
    out = X.cgm_features(series(t), RAW_KEYS)
    nums = ["glucose_roc", "mean_1h", "std_1h", "mean_3h", "std_3h", "cv_3h"]
    rest = ["is_severe_hypo", "is_hypo", "in_range", "is_hyper", "is_severe_hyper", "hour", "weekday", "is_weekend", "time_of_day"]
    return out.select("p_num", "event_id", *[(r(c) + 0).alias(c) for c in nums], *rest)


_LAGS = ", ".join(f"lag(bg, {i}) OVER w AS lag_{i}" for i in range(1, 5))


@query("win18_lag_features", f"""
WITH {GRID}, x AS (SELECT p_num, t, bg, {_LAGS}, lead(bg, 2) OVER w AS target,
  (lag(bg, 1) OVER w - lag(bg, 2) OVER w) / 360 AS roc_lag_1, (lag(bg, 2) OVER w - lag(bg, 3) OVER w) / 360 AS roc_lag_2 FROM g WINDOW w AS {W})
SELECT p_num, t, {R('bg')} AS bg_mM, {', '.join(f'{R(f"lag_{i}")} AS lag_{i}' for i in range(1, 5))}, {R('target')} AS target,
  {R('roc_lag_1')} AS roc_lag_1, {R('roc_lag_2')} AS roc_lag_2
FROM x WHERE bg + lag_1 + lag_2 + lag_3 + lag_4 + target + roc_lag_1 + roc_lag_2 IS NOT NULL""")
def win18(t: Tables):
    out = X.lag_features(grid(t), STEP, 4, 2, 2, keys=GRID_KEYS)
    cols = ["bg_mM", "lag_1", "lag_2", "lag_3", "lag_4", "target", "roc_lag_1", "roc_lag_2"]
    return out.select("p_num", epoch(), *[(r(c) + 0).alias(c) for c in cols])


def _wearable(t: Tables):
    """Grid with glucose, heart rate, steps and calories that have gaps."""
    g = grid(t)
    return g.select("p_num", "datetime", "pos", "bg_mM", (F.col("rate") * 20).alias("hr_bpm"),
                    F.when(F.col("food_g") > 0, F.col("food_g")).alias("steps"), F.when(F.col("dose_units") > 0, F.col("dose_units")).alias("cals"))


WEARABLE = f"""{GRID},
h AS (SELECT p_num, t, pos, bg, rate * 20 AS hr, CASE WHEN food > 0 THEN food END AS steps, CASE WHEN dose > 0 THEN dose END AS cals FROM g)"""


@query("win19_impute", f"""
WITH {WEARABLE}, w AS (SELECT *,
  max(CASE WHEN bg IS NOT NULL THEN pos END) OVER b AS ba, min(CASE WHEN bg IS NOT NULL THEN pos END) OVER f AS bb,
  max(CASE WHEN hr IS NOT NULL THEN pos END) OVER b AS ha, min(CASE WHEN hr IS NOT NULL THEN pos END) OVER f AS hb,
  min(cals) OVER (PARTITION BY p_num) AS mc FROM h
  WINDOW b AS (PARTITION BY p_num ORDER BY t), f AS (PARTITION BY p_num ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT w.p_num, w.t, {R('coalesce(w.bg, x.bg + (y.bg - x.bg) * (w.pos - ba) / (bb - ba))')} AS bg_mM,
  {R('coalesce(w.hr, CASE WHEN hb IS NULL OR ha IS NULL THEN NULL WHEN w.pos - ha <= hb - w.pos THEN u.hr ELSE v.hr END)')} AS hr_bpm,
  {R('coalesce(w.steps, 0)')} AS steps, {R('coalesce(w.cals, mc)')} AS cals
FROM w LEFT JOIN h x ON x.p_num = w.p_num AND x.pos = ba LEFT JOIN h y ON y.p_num = w.p_num AND y.pos = bb
  LEFT JOIN h u ON u.p_num = w.p_num AND u.pos = ha LEFT JOIN h v ON v.p_num = w.p_num AND v.pos = hb""")
def win19(t: Tables):
    out = X.impute(_wearable(t), ["bg_mM", "hr_bpm", "steps", "cals"], {"hr": "nearest"}, GRID_KEYS)
    return out.select("p_num", epoch(), *[r(c).alias(c) for c in ("bg_mM", "hr_bpm", "steps", "cals")])


@query("prj23_reduce_features", f"""
WITH {WEARABLE}, ok AS (
  SELECT p_num FROM (SELECT p_num, t, row_number() OVER (PARTITION BY p_num ORDER BY t) AS i FROM h) GROUP BY p_num
  HAVING max(t) FILTER (i = 2) - max(t) FILTER (i = 1) = {STEP}),
w AS (SELECT h.*, max(CASE WHEN bg IS NOT NULL THEN pos END) OVER b AS ba, min(CASE WHEN bg IS NOT NULL THEN pos END) OVER f AS bb
  FROM h JOIN ok USING (p_num)
  WINDOW b AS (PARTITION BY p_num ORDER BY t), f AS (PARTITION BY p_num ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT w.p_num, w.t, {R('coalesce(w.steps, 0)')} AS steps, {R('coalesce(w.bg, x.bg + (y.bg - x.bg) * (w.pos - ba) / (bb - ba))')} AS bg_mM
FROM w LEFT JOIN h x ON x.p_num = w.p_num AND x.pos = ba LEFT JOIN h y ON y.p_num = w.p_num AND y.pos = bb""")
def prj23_reduce(t: Tables):
    out = X.reduce_features(_wearable(t), STEP // 60, ["steps"], ["bg_mM"], keys=GRID_KEYS)
    return out.select("p_num", epoch(), r("steps").alias("steps"), r("bg_mM").alias("bg_mM"))


_FF = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY p_num ORDER BY t ROWS UNBOUNDED PRECEDING), 0)"


@query("win20_fill_covariates", f"WITH {WEARABLE} SELECT p_num, t, {R(_FF.format(c='hr'))} AS hr_bpm, {R(_FF.format(c='cals'))} AS cals, 0.0::DOUBLE AS iob FROM h")
def win20(t: Tables):
    out = X.fill_covariates(_wearable(t), ["hr_bpm", "cals", "iob"], GRID_KEYS)
    return out.select("p_num", epoch(), r("hr_bpm").alias("hr_bpm"), r("cals").alias("cals"), "iob")


@query("win21_stack_targets", f"""
WITH {WEARABLE}
SELECT p_num || '__bg_mM' AS item_id, t, {R('bg')} AS target FROM h UNION ALL SELECT p_num || '__hr_bpm', t, {R('hr')} FROM h""")
def win21(t: Tables):
    out = X.stack_targets(_wearable(t).select("p_num", "datetime", "bg_mM", "hr_bpm"), ["bg_mM", "hr_bpm"], "p_num")
    return out.select("item_id", epoch(), r("target").alias("target"))


@query("win23_rank_normalised", """
SELECT c_custkey, round(((rank() OVER (ORDER BY c_acctbal) - 1 + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / (count(*) OVER () - 1)
  + (rank() OVER (ORDER BY c_nationkey) - 1 + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0) / (count(*) OVER () - 1)) / 2, 6) AS rank_score
FROM customer""")
def win23(t: Tables):
    return X.rank_normalised(t.customer, ["c_acctbal", "c_nationkey"]).select("c_custkey", r("rank_score").alias("rank_score"))


@query("prj24_standardise", f"""
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, {R('(value - m) / sd')} AS value_scaled, {R('(value - m) / sd * sd + m')} AS back FROM events, s""")
def prj24(t: Tables):
    e = t.events.select("event_id", "value")
    stats = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).select(F.struct("m", "sd")).scalar()
    out = X.standardise(e, ["value"]).withColumn("_s", stats)
    back = X.unscale(F.col("value_scaled"), F.col("_s.m"), F.col("_s.sd"))
    return out.select("event_id", r("value_scaled").alias("value_scaled"), r(back).alias("back"))


@query("prj24_window_scale", f"""
SELECT vec_id, {R('list_avg(embedding::DOUBLE[])', 5)} AS mean, {R('greatest(list_stddev_pop(embedding::DOUBLE[]), 0.1)', 5)} AS scale FROM embeddings""")
def prj24_window(t: Tables):
    m, s = X.window_scale(F.col("embedding").cast("array<double>"))
    return t.embeddings.select("vec_id", r(m, 5).alias("mean"), r(s, 5).alias("scale"))


@query("prj25_encode_categories", """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Unknown' ELSE o_orderpriority END AS activity FROM orders)
SELECT o_orderkey, activity, CAST(dense_rank() OVER (ORDER BY activity) - 1 AS INTEGER) AS activity_code FROM f""")
def prj25(t: Tables):
    src = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("activity"))
    return X.encode_categories(src, "activity", "activity_code")
