"""Grids, as-of joins and slot aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefn import round_slot
from ..operators import align as A
from ..operators.blocks import DAY, keep_last
from ..operators.clean import keep_overlap
from .catalog import GRID, R, RAW_KEYS, SER, STEP, US, Tables, epoch, grid, meals, query, r, round_slot_sql, series


@query("agg1_source_bins", f"""
WITH {SER}, b AS (SELECT *, us // {STEP * US} * {STEP} AS slot FROM ser)
SELECT p_num, slot, {R('avg(bg)')} AS bg_mean, arg_min(msg_type, (us, event_id)) AS msg_first,
  {R('sum(dose)')} AS dose_sum, {R("arg_max(rate, (us, event_id)) FILTER (rate IS NOT NULL)")} AS rate_last
FROM b GROUP BY p_num, slot""")
def agg1(t: Tables):
    order = F.struct("datetime", "event_id")
    return A.floor_bins(series(t), STEP, [
        r(F.avg("bg_mM")).alias("bg_mean"), A.first_by("msg_type", order).alias("msg_first"),
        r(F.sum("dose_units")).alias("dose_sum"), r(A.last_by("rate", order)).alias("rate_last"),
    ])


@query("agg2_regularize", f"""
WITH {GRID}
SELECT p_num, t, pos, {R('bg')} AS bg_mM, {R('food')} AS food_g, {R('dose')} AS dose_units,
  {R('rate')} AS rate, dur AS basal_duration_mins, msg_type FROM g""")
def agg2(t: Tables):
    return grid(t).select(
        "p_num", epoch(), "pos", r("bg_mM").alias("bg_mM"), r("food_g").alias("food_g"), r("dose_units").alias("dose_units"),
        r("rate").alias("rate"), "basal_duration_mins", "msg_type",
    )


@query("agg2_regularize_own_interval", f"""
WITH {SER}, d AS (
  SELECT p_num, us - lag(us) OVER (PARTITION BY p_num ORDER BY us, event_id) AS diff FROM
    (SELECT p_num, us // 3600000000 * 3600000000 AS us, event_id FROM ser)),
n AS (SELECT p_num, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY ALL),
w AS (SELECT p_num, arg_min(diff, (-n, diff)) // 60000000 AS mins FROM n GROUP BY p_num),
m AS (SELECT DISTINCT ser.p_num, CASE WHEN mins > 0 THEN mins ELSE 5 END AS mins FROM ser LEFT JOIN w ON w.p_num = ser.p_num),
b AS (
  SELECT p_num, mins * 60 AS step, mins * 60 * (us // (mins * 60000000) + CASE
      WHEN 2 * (us % (mins * 60000000)) > mins * 60000000
        OR (2 * (us % (mins * 60000000)) = mins * 60000000 AND us // (mins * 60000000) % 2 = 1) THEN 1 ELSE 0 END) AS slot, bg
  FROM (SELECT p_num, us // 3600000000 * 3600000000 AS us, bg FROM ser) JOIN m USING (p_num)),
x AS (SELECT p_num, any_value(step) AS step, min(slot) AS lo, max(slot) AS hi FROM b GROUP BY p_num)
SELECT p_num, any_value(step) AS step, any_value((hi - lo) // step + 1) AS n_slots, count(DISTINCT slot) AS n_filled,
  {R('avg(bg)', 4)} AS bg_mean
FROM b JOIN x USING (p_num, step) GROUP BY p_num""")
def agg2_auto(t: Tables):
    hourly = series(t).withColumn("datetime", F.date_trunc("hour", "datetime").cast("timestamp_ntz")).select(
        "p_num", "datetime", "event_id", "bg_mM")
    # count the readings of a slot so that the mean over all readings is exact
    counted = hourly.withColumn("n", F.lit(1)).withColumn("total", F.col("bg_mM"))
    g = A.regularize(counted, None, tie=("event_id",))
    secs = F.unix_seconds(F.col("datetime").cast("timestamp"))
    per = g.groupBy("p_num").agg(
        (F.max(secs) - F.min(secs)).alias("_span"), F.max("pos").alias("_p"), F.count("*").alias("n_slots"),
        F.count("n").alias("n_filled"), r(F.sum("total") / F.sum("n"), 4).alias("bg_mean"),
    )
    modes = A.interval_mode(hourly, RAW_KEYS).select("p_num", (A.positive_mins(F.col("interval_mins")).cast("long") * 60).alias("step"))
    return per.join(modes, "p_num").select("p_num", "step", "n_slots", "n_filled", "bg_mean")


@query("agg3_insulin_per_slot", f"""
WITH {SER}
SELECT p_num, {round_slot_sql('us', STEP)} AS slot,
  {R('sum(coalesce(dose, 0) + coalesce(rate, 0) + coalesce(food, 0))')} AS dose_units
FROM ser GROUP BY ALL""")
def agg3(t: Tables):
    dose = sum((F.coalesce(c, F.lit(0.0)) for c in ("dose_units", "rate", "food_g")), F.lit(0.0))
    return series(t).groupBy("p_num", round_slot(F.col("datetime"), STEP).alias("slot")).agg(r(F.sum(dose)).alias("dose_units"))


@query("agg4_interval_mode", """
WITH h AS (SELECT user_id AS p_num, event_id, epoch(date_trunc('hour', ts))::BIGINT AS s FROM events),
d AS (SELECT p_num, s - lag(s) OVER (PARTITION BY p_num ORDER BY s, event_id) AS diff FROM h),
n AS (SELECT p_num, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY ALL)
SELECT p_num, coalesce(CAST(arg_min(diff, (-n, diff)) // 60 AS INTEGER), 5) AS interval_mins FROM (SELECT DISTINCT p_num FROM h) LEFT JOIN n USING (p_num) GROUP BY p_num""")
def agg4(t: Tables):
    hourly = series(t).withColumn("datetime", F.date_trunc("hour", "datetime").cast("timestamp_ntz"))
    return A.interval_mode(hourly, RAW_KEYS)


def _asof_sql(direction: str) -> str:
    s, tol = STEP * US, STEP * US * 2 // 3
    near = {
        "forward": ("min", "o.us >= x.us", "o.us ASC, o.event_id ASC"),
        "backward": ("max", "o.us <= x.us", "o.us DESC, o.event_id DESC"),
        "nearest": ("min", "true", "abs(o.us - x.us) ASC, o.us ASC, o.event_id DESC"),
    }[direction]
    return f"""
WITH {SER}, b AS (SELECT p_num, min(us) AS lo, max(us) AS hi FROM ser GROUP BY p_num),
x AS (SELECT p_num, i AS pos, lo + {s} * i AS us FROM (SELECT *, unnest(range(0, (hi - lo) // {s} + 1)) AS i FROM b)),
c AS (
  SELECT x.p_num, x.pos, o.bg, o.msg_type, row_number() OVER (PARTITION BY x.p_num, x.pos ORDER BY {near[2]}) AS rn
  FROM x JOIN ser o ON o.p_num = x.p_num AND abs(o.us - x.us) <= {tol} AND {near[1]})
SELECT x.p_num, x.us // {US} AS t, x.pos, {R('c.bg')} AS bg_mM, c.msg_type
FROM x LEFT JOIN c ON c.p_num = x.p_num AND c.pos = x.pos AND c.rn = 1"""


def _asof(direction: str):
    def run(t: Tables):
        src = series(t).select("p_num", "datetime", "event_id", "bg_mM", "msg_type")
        out = A.asof_grid(src, STEP, direction, tie=("event_id",))
        return out.select("p_num", epoch(), "pos", r("bg_mM").alias("bg_mM"), "msg_type")

    return run


for _d in ("forward", "backward", "nearest"):
    query(f"join5_asof_{_d}", _asof_sql(_d))(_asof(_d))


@query("join13_densify", f"""
WITH {GRID} SELECT p_num, count(*) AS n_slots, count(bg) AS n_filled, min(t) AS lo, max(t) AS hi FROM g GROUP BY p_num""")
def join13(t: Tables):
    slots = series(t).groupBy("p_num", round_slot(F.col("datetime"), STEP).alias("slot")).agg(F.avg("bg_mM").alias("bg_mM"))
    d = A.densify(slots, STEP)
    return d.groupBy("p_num").agg(
        F.count("*").alias("n_slots"), F.count("bg_mM").alias("n_filled"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))


@query("join1_insulin_onto_cgm", f"""
WITH {SER}, b AS (SELECT *, us // {STEP * US} * {STEP} AS slot FROM ser),
c AS (SELECT p_num, slot, avg(bg) AS bg FROM b WHERE msg_type IN ('click', 'error') GROUP BY ALL),
d AS (SELECT p_num, slot, sum(dose) AS dose FROM b WHERE dose IS NOT NULL GROUP BY ALL),
e AS (SELECT p_num, slot, arg_max(rate, (us, event_id)) AS rate FROM b WHERE rate IS NOT NULL GROUP BY ALL)
SELECT p_num, slot, {R('bg')} AS bg_mM, {R('coalesce(dose, 0)')} AS dose_units, {R('rate')} AS rate
FROM c LEFT JOIN d USING (p_num, slot) LEFT JOIN e USING (p_num, slot)""")
def join1(t: Tables):
    s = series(t)
    cgm = A.floor_bins(s.where(F.col("msg_type").isin("click", "error")), STEP, [F.avg("bg_mM").alias("bg_mM")])
    bolus = A.floor_bins(s.where("dose_units is not null"), STEP, [F.sum("dose_units").alias("dose_units")])
    basal = A.floor_bins(s.where("rate is not null"), STEP, [A.last_by("rate", F.struct("datetime", "event_id")).alias("rate")])
    out = A.join_sources(cgm, bolus, basal)
    return out.select("p_num", "slot", r("bg_mM").alias("bg_mM"), r("dose_units").alias("dose_units"), r("rate").alias("rate"))


@query("join2_last_reading_with_insulin", f"""
WITH {SER}, b AS (SELECT *, {round_slot_sql('us', STEP)} AS slot FROM ser),
i AS (SELECT p_num, slot, sum(coalesce(dose, 0)) AS dose FROM b GROUP BY ALL)
SELECT p_num, slot, event_id, {R('bg')} AS bg_mM, {R('i.dose')} AS dose_units FROM (
  SELECT *, row_number() OVER (PARTITION BY p_num, slot ORDER BY us DESC, event_id DESC) AS rn
  FROM b WHERE msg_type = 'click') JOIN i USING (p_num, slot) WHERE rn = 1""")
def join2(t: Tables):
    s = series(t)
    bins = s.groupBy("p_num", round_slot(F.col("datetime"), STEP).alias("slot")).agg(
        F.sum(F.coalesce("dose_units", F.lit(0.0))).alias("dose_sum"))
    cgm = s.where("msg_type = 'click'").select("p_num", "datetime", "event_id", "bg_mM")
    out = A.join_bins_keep_last(cgm, bins, STEP, F.struct("datetime", "event_id"))
    return out.select("p_num", "slot", "event_id", r("bg_mM").alias("bg_mM"), r("dose_sum").alias("dose_units"))


@query("join3_demographics", """
SELECT o_orderkey, o_custkey, c_mktsegment AS sex, n_name AS nation FROM orders
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def join3(t: Tables):
    demo = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return t.orders.join(demo, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", "o_custkey", F.col("c_mktsegment").alias("sex"), F.col("n_name").alias("nation"))


@query("join6_meal_overlay", f"""
WITH {SER}, b AS (SELECT *, us // {STEP * US} * {STEP} AS slot FROM ser),
o AS (SELECT p_num, slot, arg_min(bg, (us, event_id)) AS bg, arg_min(msg_type, (us, event_id)) AS msg_type
      FROM b WHERE msg_type <> 'purchase' GROUP BY ALL),
m AS (SELECT p_num, slot, arg_min(bg, (us, event_id)) AS bg, arg_min(food, (us, event_id)) AS food
      FROM b WHERE msg_type = 'purchase' GROUP BY ALL),
x AS (SELECT p_num, lo + {STEP} * i AS slot FROM (
  SELECT p_num, lo, unnest(range(0, (hi - lo) // {STEP} + 1)) AS i FROM (
    SELECT p_num, min(slot) AS lo, max(slot) AS hi FROM o GROUP BY p_num)))
SELECT x.p_num, x.slot AS t, {R('coalesce(m.bg, o.bg)')} AS bg_mM,
  CASE WHEN m.slot IS NOT NULL THEN 'ANNOUNCE_MEAL' ELSE o.msg_type END AS msg_type,
  {R('m.food')} AS food_g, {R('m.food')} AS food_g_keep
FROM x LEFT JOIN o USING (p_num, slot) LEFT JOIN m USING (p_num, slot)""")
def join6(t: Tables):
    src = meals(t).select("p_num", "datetime", "event_id", "bg_mM", "msg_type", "food_g")
    out = A.overlay_meals(src, STEP, tie=("event_id",))
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), "msg_type", r("food_g").alias("food_g"), r("food_g_keep").alias("food_g_keep"))


@query("join12_reconcile_sources", f"""
WITH {SER}, b AS (SELECT *, {round_slot_sql('us', STEP)} AS slot FROM ser),
a AS (SELECT p_num, slot, avg(bg) AS x FROM b WHERE msg_type = 'click' GROUP BY ALL),
c AS (SELECT p_num, slot, avg(bg) AS y FROM b WHERE msg_type = 'view' GROUP BY ALL)
SELECT p_num, count(*) AS common_rows, {R('avg(abs(x - y))')} AS mean_abs_diff, {R('max(abs(x - y))')} AS max_abs_diff,
  {R('avg(CASE WHEN abs(x - y) <= 5 THEN 1.0 ELSE 0.0 END) * 100')} AS pct_within
FROM a JOIN c USING (p_num, slot) GROUP BY p_num""")
def join12(t: Tables):
    s = series(t)
    out = A.reconcile(s.where("msg_type = 'click'"), s.where("msg_type = 'view'"), STEP, 5.0)
    return out.select("p_num", "common_rows", r("mean_abs_diff").alias("mean_abs_diff"), r("max_abs_diff").alias("max_abs_diff"), r("pct_within").alias("pct_within"))


@query("join12_pct_on_boundary", """
SELECT o_custkey AS p_num, round(avg(CASE WHEN epoch_us(o_orderdate) % 172800000000 = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_on_boundary
FROM orders GROUP BY 1""")
def join12_boundary(t: Tables):
    s = t.orders.select(F.col("o_custkey").alias("p_num"), F.col("o_orderdate").alias("datetime"))
    return A.pct_on_boundary(s, 2 * DAY).select("p_num", r("pct_on_boundary").alias("pct_on_boundary"))


@query("join16_attach_closest", f"""
WITH {SER}, rd AS (SELECT DISTINCT p_num, us FROM ser WHERE msg_type = 'click'),
m AS (SELECT * FROM ser WHERE msg_type IN ('purchase', 'signup')),
a AS (SELECT m.p_num, m.us, m.event_id, m.msg_type, (SELECT max(us) FROM rd WHERE rd.p_num = m.p_num AND rd.us <= m.us) AS lo,
  (SELECT min(us) FROM rd WHERE rd.p_num = m.p_num AND rd.us > m.us) AS hi FROM m),
c AS (SELECT p_num, msg_type, us, event_id, CASE WHEN hi IS NULL OR us - lo <= hi - us THEN lo ELSE coalesce(hi, lo) END AS to_us FROM a),
d AS (SELECT p_num, to_us, arg_max(event_id, (us, event_id)) AS message_id FROM c WHERE to_us IS NOT NULL GROUP BY ALL)
SELECT p_num, us AS t_us, message_id FROM rd LEFT JOIN d ON d.p_num = rd.p_num AND d.to_us = rd.us""".replace("SELECT p_num, us AS t_us", "SELECT rd.p_num, rd.us AS t_us"))
def join16(t: Tables):
    s = series(t)
    readings = s.where("msg_type = 'click'").select("p_num", "datetime").distinct()
    messages = s.where(F.col("msg_type").isin("purchase", "signup")).select("p_num", "datetime", "event_id", F.col("event_id").alias("message_id"))
    out = A.attach_closest(readings, messages, RAW_KEYS)
    return out.select("p_num", F.unix_micros(F.col("datetime").cast("timestamp")).alias("t_us"), "message_id")


@query("prj15_overlap_clip", f"""
WITH {SER}, k AS (SELECT p_num, msg_type, min(us) AS a, max(us) AS b FROM ser GROUP BY ALL),
o AS (SELECT p_num, max(a) AS lo, min(b) AS hi FROM k GROUP BY p_num)
SELECT p_num, event_id, msg_type, {R('bg')} AS bg_mM FROM ser JOIN o USING (p_num) WHERE us BETWEEN lo AND hi""")
def prj15(t: Tables):
    return keep_overlap(series(t)).select("p_num", "event_id", "msg_type", r("bg_mM").alias("bg_mM"))


@query("win22_keep_last", """
SELECT user_id AS p_num, event_type AS msg_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def win22(t: Tables):
    src = t.events.select(F.col("user_id").alias("p_num"), F.col("event_type").alias("msg_type"), "ts", "event_id", "value")
    return keep_last(src, ["p_num", "msg_type"], F.struct("ts", "event_id")).drop("ts")
