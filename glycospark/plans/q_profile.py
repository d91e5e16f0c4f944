"""Feature pipelines, quality metrics, histograms, sleep and other profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import carb_kernel, insulin_kernel
from ..operators import clean as C, features as X, profile as P, sleep as Sl
from ..operators.blocks import DAY, Keys
from .catalog import GRID_KEYS, R, RAW_KEYS, SER, STEP, Tables, epoch, grid_sql, query, r, round_slot_sql, series
from .preprocess import physiological_features, preprocess
from .q_features import WEARABLE, _wearable, temp_sql
from .q_metrics import rounded

HOUR = 3600
HOUR_KEYS = Keys(block=2 * DAY)


def _kern(name: str, kernel) -> str:
    return f"{name}(k, a, b) AS (VALUES " + ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(*kernel))) + ")"


def _features_sql(base: str, dose: str) -> str:
    """Kernel sums as sums over the slots before; the grid is complete."""
    before = lambda c, weights: " + ".join(f"coalesce(lag({c}, {k}) OVER w, 0) * {x!r}" for k, x in enumerate(weights))
    (ca, cob), (ia, iob) = carb_kernel(60), insulin_kernel(60)
    return f"""{base},
d AS MATERIALIZED (SELECT p_num, t, bg, food, {dose} AS dose FROM gd),
x AS (SELECT p_num, t, bg, food, dose, CASE WHEN dose > 0 THEN dose END AS given FROM d),
y AS (SELECT *, {before('food', ca)} AS ca, {before('food', cob)} AS cob, {before('given', ia)} AS ia, {before('given', iob)} AS iob FROM x WINDOW w AS (PARTITION BY p_num ORDER BY t))
SELECT p_num, t, {R('bg', 2)} AS bg_mM, {R('dose', 2)} AS dose_units, {R('cob', 2)} AS cob, {R('ca', 2)} AS carb_availability,
  {R('iob', 2)} AS iob, {R('ia', 2)} AS insulin_availability, {R('sin(2 * pi() * ((t % 86400) // 60) / 1440)')} AS hour_sin
FROM y"""


_FFILL = "dose + coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY p_num ORDER BY t ROWS UNBOUNDED PRECEDING), 0)"
_COLS = ["bg_mM", "dose_units", "cob", "carb_availability", "iob", "insulin_availability"]


_HOURLY = grid_sql(HOUR)


@query("phy3_physiological_features", "WITH " + _features_sql(f"{_HOURLY}, gd AS (SELECT * FROM g)", _FFILL))
def phy3(t: Tables):
    src = series(t).drop("msg_type", "basal_duration_mins")
    out = physiological_features(src, HOUR, True, "automated", ("event_id",), HOUR_KEYS)
    return out.select("p_num", epoch(), *[(F.col(c) + 0).alias(c) for c in _COLS], (r("hour_sin") + 0).alias("hour_sin"))


_MINUTE = 60


def _minute_sql() -> str:
    def kern(name, kernel):
        return f"{name}(k, a, b) AS (VALUES " + ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(*kernel))) + ")"

    slot = round_slot_sql("us", _MINUTE)
    return f"""
WITH {SER}, m AS (SELECT p_num, {slot} AS t, coalesce(sum(food), 0) AS food, coalesce(sum(dose), 0) AS dose FROM ser GROUP BY ALL),
l AS (SELECT p_num, min(t) AS lo, max(t) AS hi FROM m GROUP BY p_num), {kern('kc', carb_kernel(1))}, {kern('ki', insulin_kernel(1))},
s AS (SELECT p_num, t + 60 * k AS t, food * a AS ca, food * b AS cob, 0.0 AS ia, 0.0 AS iob FROM m, kc WHERE food <> 0
  UNION ALL SELECT p_num, t + 60 * k, 0.0, 0.0, dose * a, dose * b FROM m, ki WHERE dose > 0)
SELECT p_num, t // 3600 AS hour, {R('sum(ca)', 4)} AS carb_availability, {R('sum(cob)', 4)} AS cob, {R('sum(ia)', 4)} AS insulin_availability, {R('sum(iob)', 4)} AS iob
FROM s JOIN l USING (p_num) WHERE t <= hi GROUP BY ALL HAVING sum(ca) + sum(cob) + sum(ia) + sum(iob) > 0.001"""


@query("phy3_on_board_by_minute", _minute_sql())
def phy3_minute(t: Tables):
    """Kernels of 180 steps on a grid of minutes, as hourly sums where there is something on board."""
    src = series(t).select("p_num", "datetime", "event_id", "food_g", "dose_units")
    out = physiological_features(src, _MINUTE, True, None, ("event_id",), Keys(block=DAY), precise=True, active=True)
    cols = ["carb_availability", "cob", "insulin_availability", "iob"]
    hours = out.groupBy("p_num", F.floor(F.unix_seconds(F.col("datetime").cast("timestamp")) / 3600).cast("bigint").alias("hour")).agg(*[F.sum(c).alias(c) for c in cols])
    hours = hours.where(sum((F.col(c) for c in cols[1:]), F.col(cols[0])) > 0.001)
    return hours.select("p_num", "hour", *[(r(c, 4) + 0).alias(c) for c in cols])


@query("phy4_preprocess_temp_basal", "WITH " + _features_sql(f"{temp_sql(HOUR)}, gd AS (SELECT * FROM o)", "dose + CASE WHEN pos - op < floor(d0 / 60) THEN r0 ELSE 0 END"))
def phy4(t: Tables):
    out = preprocess(series(t).drop("msg_type"), HOUR, use_aggregation=True, delivery="temp", tie=("event_id",), keys=HOUR_KEYS)
    return out.select("p_num", epoch(), *[(F.col(c) + 0).alias(c) for c in _COLS], (r("hour_sin") + 0).alias("hour_sin"))


@query("phy3_as_of_without_food", f"""
WITH {SER}, b AS (SELECT p_num, min(us) AS lo, max(us) AS hi FROM ser GROUP BY p_num),
x AS (SELECT p_num, i AS pos, lo + {HOUR * 1_000_000} * i AS us FROM (SELECT *, unnest(range(0, (hi - lo) // {HOUR * 1_000_000} + 1)) AS i FROM b)),
c AS (SELECT x.p_num, x.pos, o.bg, o.dose, row_number() OVER (PARTITION BY x.p_num, x.pos ORDER BY o.us, o.event_id) AS rn
  FROM x JOIN ser o ON o.p_num = x.p_num AND o.us >= x.us AND o.us - x.us <= {HOUR * 1_000_000 * 2 // 3}),
g AS (SELECT x.p_num, x.us, x.pos, bg, dose FROM x LEFT JOIN c ON c.p_num = x.p_num AND c.pos = x.pos AND rn = 1), {_kern('ki', insulin_kernel(60))},
i AS (SELECT p_num, pos + k AS pos, sum(dose * b) AS iob FROM g, ki WHERE dose > 0 GROUP BY 1, 2),
s AS (SELECT p_num, count(dose) AS n FROM g GROUP BY p_num)
SELECT g.p_num, g.us // 1000000 AS t, CASE WHEN n > 0 THEN {R('coalesce(iob, 0)', 2)} END AS iob, NULL::DOUBLE AS cob FROM g JOIN s USING (p_num) LEFT JOIN i ON i.p_num = g.p_num AND i.pos = g.pos""")
def phy3_asof(t: Tables):
    src = series(t).select("p_num", "datetime", "event_id", "bg_mM", "dose_units")
    out = physiological_features(src, HOUR, False, None, ("event_id",), Keys(tie=(), block=2 * DAY))
    return out.select("p_num", epoch(), (F.col("iob") + 0).alias("iob"), "cob")


@query("phy5_sleep_probability", f"""
WITH {WEARABLE}, f AS (SELECT p_num, t, coalesce(steps, 0) AS steps, coalesce(hr, 60) AS hr, coalesce(cals, 5) AS cals, (t % 86400) // 3600 AS hour FROM h),
p AS (SELECT p_num, hour, avg(steps) AS s, avg(hr) AS h, avg(cals) AS c FROM f GROUP BY ALL)
SELECT p_num, t, {R('''greatest(0, least(1, 0.85 * greatest(0, least(1, 0.6 * CASE WHEN steps = 0 THEN 1 ELSE exp(-steps / 10) END + 0.3 * exp(-hr / 40) + 0.1 * exp(-cals / 40)))
  + 0.15 * exp(-(s + h + c) / 100)))''')} AS sleep_probability FROM f JOIN p USING (p_num, hour)""")
def phy5(t: Tables):
    filled = _wearable(t).fillna({"steps": 0.0, "hr_bpm": 60.0, "cals": 5.0})
    return Sl.sleep_probability(filled).select("p_num", epoch(), r("sleep_probability").alias("sleep_probability"))


def _norm(c: str) -> str:
    return f"""CASE WHEN lo_{c} IS NULL THEN 0 WHEN hi_{c} <> lo_{c} THEN (coalesce(w.{c}, a_{c}.{c} + (b_{c}.{c} - a_{c}.{c}) * (w.pos - w.p_{c}) / (w.n_{c} - w.p_{c}), a_{c}.{c}, b_{c}.{c}) - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0 END"""


_SLEEP = f"""{WEARABLE},
w AS (SELECT *, {', '.join(f"max(CASE WHEN {c} IS NOT NULL THEN pos END) OVER bw AS p_{c}, min(CASE WHEN {c} IS NOT NULL THEN pos END) OVER fw AS n_{c}, min({c}) OVER al AS lo_{c}, max({c}) OVER al AS hi_{c}" for c in ('hr', 'steps', 'cals'))}
  FROM h WINDOW bw AS (PARTITION BY p_num ORDER BY t), fw AS (PARTITION BY p_num ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), al AS (PARTITION BY p_num)),
sc AS (SELECT w.p_num, w.t, 0.7 * {_norm('hr')} + 0.2 * {_norm('steps')} + 0.1 * {_norm('cals')} AS s FROM w
  {' '.join(f'LEFT JOIN h a_{c} ON a_{c}.p_num = w.p_num AND a_{c}.pos = w.p_{c} LEFT JOIN h b_{c} ON b_{c}.p_num = w.p_num AND b_{c}.pos = w.n_{c}' for c in ('hr', 'steps', 'cals'))}),
sm AS (SELECT p_num, t, round(avg(s) OVER (PARTITION BY p_num ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS m FROM sc),
cu AS (SELECT p_num, quantile_cont(m, 0.6) AS cut FROM sm GROUP BY p_num),
ss AS (SELECT p_num, t, m, CASE WHEN m > cut THEN 1.0 ELSE 0.0 END::DOUBLE AS sleep_score FROM sm JOIN cu USING (p_num))"""


@query("win25_sleep_score", f"WITH {_SLEEP} SELECT p_num, t, {R('m', 9)} AS raw_score, sleep_score FROM ss")
def win25(t: Tables):
    return Sl.sleep_score(_wearable(t), STEP, keys=GRID_KEYS).select("p_num", epoch(), r("raw_score", 9).alias("raw_score"), "sleep_score")


@query("win26_sleep_hours", f"""
WITH {_SLEEP}, st AS (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS sleep_start),
a AS (SELECT p_num, t // 86400 AS d, sleep_start, round(avg(sleep_score), 9) AS m FROM ss, st WHERE ((t % 86400) // 3600 - sleep_start + 24) % 24 < 8 GROUP BY ALL)
SELECT p_num, d AS epoch_day, CAST(arg_min(sleep_start, (m, sleep_start)) AS INTEGER) AS sleep_start, CAST((arg_min(sleep_start, (m, sleep_start)) + 8) % 24 AS INTEGER) AS sleep_end, 8 AS sleep_duration
FROM a GROUP BY ALL""")
def win26(t: Tables):
    out = Sl.sleep_hours(Sl.sleep_score(_wearable(t), STEP, keys=GRID_KEYS))
    return out.select("p_num", F.unix_date("date").cast("long").alias("epoch_day"), "sleep_start", "sleep_end", "sleep_duration")


@query("agg5_validation_table", f"""
WITH {SER} SELECT p_num, count(DISTINCT CAST(ts AS DATE)) AS num_days, count(*) AS num_data_points, CAST(min(ts) AS DATE)::VARCHAR AS start_date, CAST(max(ts) AS DATE)::VARCHAR AS end_date,
  CASE WHEN min(CAST(ts AS DATE)) = DATE '2024-01-01' OR (min(year(ts)) = 2024 AND max(year(ts)) = 2024) THEN 'artificial' ELSE 'real' END AS date_type,
  {R('avg(bg)')} AS avg_bg_mM, {R('min(bg)')} AS min_bg_mM, {R('max(bg)')} AS max_bg_mM, {R('avg(food)')} AS avg_carbs_g,
  CASE WHEN count(food) > 0 THEN {R('coalesce(min(food) FILTER (food > 0), 0)')} END AS min_carbs_g, {R('max(food)')} AS max_carbs_g,
  {R('avg(dose)')} AS avg_insulin_units, CASE WHEN count(dose) > 0 THEN {R('coalesce(min(dose) FILTER (dose > 0), 0)')} END AS min_insulin_units, {R('max(dose)')} AS max_insulin_units
FROM ser GROUP BY p_num""")
def agg5(t: Tables):
    out = P.validation_table(series(t), generic_start="2024-01-01")
    nums = [c for c in out.columns if c.startswith(("avg_", "min_", "max_"))]
    return rounded(out, *nums).withColumns({c: F.col(c).cast("date").cast("string") for c in ("start_date", "end_date")})


@query("agg5_demographic_mode", """
WITH x AS (SELECT c_nationkey AS p_num, c_mktsegment AS sex, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT p_num, sex, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT p_num, count(*) AS k, count(DISTINCT o_orderdate) AS d FROM x GROUP BY p_num)
SELECT s.p_num, s.k AS num_data_points, s.d AS num_days, (SELECT arg_min(sex, (-n, sex)) FROM n WHERE n.p_num = s.p_num) AS sex FROM s""")
def agg5_demo(t: Tables):
    src = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("p_num"), F.col("o_orderdate").alias("datetime"), F.col("c_mktsegment").alias("sex"))
    return P.validation_table(src, ("sex",)).select("p_num", "num_data_points", "num_days", "sex")


@query("agg6_shape_summary", "SELECT user_id AS p_num, count(*) AS n_rows, 9 AS n_columns FROM events GROUP BY 1")
def agg6(t: Tables):
    return P.shape_summary(series(t))


@query("agg7_quality_metrics", f"""
WITH {SER}, d AS (SELECT (us - lag(us) OVER (PARTITION BY p_num ORDER BY us, event_id)) / 60000000.0 AS m FROM ser), n AS (SELECT p_num, count(bg) AS n FROM ser GROUP BY p_num)
SELECT count(*) AS total_rows, count(DISTINCT p_num) AS unique_patients, count(*) FILTER (bg IS NULL) AS missing_glucose, 0::BIGINT AS missing_datetime, {R('avg(bg)')} AS glucose_mean,
  {R('stddev_samp(bg)')} AS glucose_std, {R('min(bg)')} AS glucose_min, {R('max(bg)')} AS glucose_max, {R('avg(CASE WHEN bg BETWEEN 3.9 AND 10 THEN 1.0 ELSE 0 END) * 100')} AS time_in_range,
  {R('avg(CASE WHEN bg < 3.9 THEN 1.0 ELSE 0 END) * 100')} AS time_below_range, {R('avg(CASE WHEN bg > 10 THEN 1.0 ELSE 0 END) * 100')} AS time_above_range,
  {R('(SELECT avg(n) FROM n)')} AS mean_readings_per_patient, {R('(SELECT stddev_samp(n) FROM n)')} AS std_readings_per_patient, (SELECT min(n) FROM n) AS min_readings_per_patient,
  (SELECT max(n) FROM n) AS max_readings_per_patient, {R('(SELECT avg(m) FROM d)', 4)} AS mean_interval_minutes, {R('(SELECT quantile_cont(m, 0.5) FROM d)', 4)} AS median_interval_minutes FROM ser""")
def agg7(t: Tables):
    out = P.quality_metrics(series(t), keys=RAW_KEYS)
    six = [c for c in out.columns if c.startswith(("glucose_", "time_", "mean_r", "std_r"))]
    return rounded(rounded(out, *six), "mean_interval_minutes", "median_interval_minutes", places=4)


@query("agg8_insulin_presence", """
WITH p AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT' AND o_totalprice > 200000) AS i FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS n_patients, count(*) FILTER (i) AS patients_with_insulin, count(*) FILTER (NOT i) AS patients_cgm_only FROM p""")
def agg8(t: Tables):
    dose = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200_000), F.col("o_totalprice"))
    return P.insulin_presence(t.orders.select(F.col("o_custkey").alias("p_num"), dose.alias("dose_units"), F.lit(0.0).alias("rate")))


@query("agg14_bg_histogram", f"""
WITH {SER}, b AS (SELECT msg_type, CAST(least(floor((bg - 2) / 0.5) + 1, 40) AS INTEGER) AS bin, CASE WHEN bg < 3.9 THEN 'hypo' WHEN bg > 10 THEN 'hyper' ELSE 'in_range' END AS band FROM ser WHERE bg BETWEEN 2 AND 22)
SELECT msg_type, bin, band, n, {R('n * 1.0 / sum(n) OVER (PARTITION BY msg_type)')} AS share FROM (SELECT msg_type, bin, band, count(*) AS n FROM b GROUP BY ALL)""")
def agg14(t: Tables):
    return rounded(P.histogram(series(t), ["msg_type"]), "share")


@query("agg17_hourly_profile", f"""
WITH {WEARABLE} SELECT p_num, CAST((t % 86400) // 3600 AS INTEGER) AS hour, {R('avg(steps)')} AS mean_steps, {R('avg(hr)')} AS mean_hr_bpm, {R('avg(cals)')} AS mean_cals FROM h GROUP BY ALL""")
def agg17(t: Tables):
    return rounded(P.hourly_profile(_wearable(t), ["steps", "hr_bpm", "cals"]), "mean_steps", "mean_hr_bpm", "mean_cals")


@query("agg18_potential_nights", """
WITH n AS (SELECT user_id AS p_num, CAST(ts AS DATE) AS d FROM events WHERE hour(ts) < 8 GROUP BY ALL HAVING count(*) >= 2) SELECT p_num, count(*) AS n_nights FROM n GROUP BY 1""")
def agg18(t: Tables):
    return P.potential_nights(series(t), 8, 2)


_CLASSES = ["TIR 85–100% (Low)", "TIR 85–100% (High)", "TIR 70–85% (Low)", "TIR 70–85% (High)", "TIR <70% (Low)", "TIR <70% (High)"]


@query("agg19_outcome_tally", """
WITH x AS (SELECT l_quantity / 5 + 3 AS ratio, 1 - l_discount * 4 AS tir, l_extendedprice / 400 AS glucose FROM lineitem)
SELECT CAST(floor((ratio - 5) / 0.5) AS INTEGER) AS bin, count(*) FILTER (tir >= 0.85 AND glucose < 125) AS n_0, count(*) FILTER (tir >= 0.85 AND glucose >= 125) AS n_1,
  count(*) FILTER (tir >= 0.7 AND tir < 0.85 AND glucose < 125) AS n_2, count(*) FILTER (tir >= 0.7 AND tir < 0.85 AND glucose >= 125) AS n_3,
  count(*) FILTER (tir < 0.7 AND glucose < 125) AS n_4, count(*) FILTER (tir < 0.7 AND glucose >= 125) AS n_5 FROM x WHERE ratio >= 5 AND ratio < 13 GROUP BY 1""")
def agg19(t: Tables):
    src = t.lineitem.select((F.col("l_quantity") / 5 + 3).alias("ratio"), P.outcome(1 - F.col("l_discount") * 4, F.col("l_extendedprice") / 400).alias("outcome"))
    return P.outcome_tally(src, "ratio", "outcome", _CLASSES, 5, 13, 0.5)


@query("agg20_time_feature_check", f"""
WITH {SER}, f AS (SELECT bg, sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS s, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS c FROM ser)
SELECT count(*) FILTER (s IS NULL) AS sin_nulls, count(*) FILTER (c IS NULL) AS cos_nulls, {R('min(s)')} AS sin_min, {R('max(s)')} AS sin_max, {R('min(c)')} AS cos_min, {R('max(c)')} AS cos_max,
  {R('max(abs(s * s + c * c - 1))')} AS max_deviation, {R('corr(s, bg)')} AS corr_sin, {R('corr(c, bg)')} AS corr_cos FROM f""")
def agg20(t: Tables):
    out = P.time_feature_check(X.time_of_day(series(t)))
    return rounded(out, *[c for c in out.columns if not c.endswith("nulls")])


# --- projections and filters that need no raw files ------------------------------------------


@query("prj4_unit_conversion", f"SELECT event_id, {R('value * 7 / 18.018')} AS rounded_divisor, {R('value * 7 / 18.0182')} AS exact_divisor FROM events")
def prj4(t: Tables):
    from ..functions.units import mg_dl_to_mmol_l

    v = F.col("value") * 7
    return t.events.select("event_id", (r(mg_dl_to_mmol_l(v, places=None)) + 0).alias("rounded_divisor"), (r(mg_dl_to_mmol_l(v, 18.0182, None)) + 0).alias("exact_divisor"))


@query("prj4_half_even_rounding", "SELECT o_orderkey, round_even(o_totalprice / 18.0, 2) AS bg_mM FROM orders")
def prj4_bround(t: Tables):
    from ..functions.units import mg_dl_to_mmol_l

    return t.orders.select("o_orderkey", mg_dl_to_mmol_l(F.col("o_totalprice"), 18.0, 2).alias("bg_mM"))


@query("prj9_sentinel_clamp", "SELECT event_id, CASE WHEN value * 5 <= 39 THEN 40 WHEN value * 5 >= 401 THEN 400 ELSE round(value * 5, 4) END::DOUBLE AS cgm FROM events")
def prj9(t: Tables):
    from ..functions.units import clamp_sentinel

    return t.events.select("event_id", r(clamp_sentinel(F.col("value") * 5), 4).alias("cgm"))


@query("prj10_plausible_values", f"WITH {SER} SELECT p_num, event_id, {R('bg')} AS bg_mM FROM ser WHERE bg > 0 AND bg BETWEEN 1.1 AND 33.3")
def prj10(t: Tables):
    return C.drop_implausible(series(t)).select("p_num", "event_id", r("bg_mM").alias("bg_mM"))


@query("prj10_removed_counts", f"""
WITH {SER} SELECT msg_type, count(*) AS n_rows, count(*) FILTER (bg IS NULL) AS n_null, count(*) FILTER (bg <= 0) AS n_not_positive,
  count(*) FILTER (bg > 0 AND NOT bg BETWEEN 1.1 AND 33.3) AS n_out_of_range, count(*) FILTER (bg BETWEEN 1.1 AND 33.3) AS n_kept FROM ser GROUP BY 1""")
def prj10_counts(t: Tables):
    return C.implausible_counts(series(t), by=["msg_type"])


@query("prj16_reduce_precision", "SELECT event_id, round_even(value / 7.0, 2) AS bg_mM, round_even(value / 11.0, 2) AS iob FROM events")
def prj16(t: Tables):
    return C.reduce_precision(t.events.select("event_id", (F.col("value") / 7.0).alias("bg_mM"), (F.col("value") / 11.0).alias("iob")))


@query("prj17_required_columns", "SELECT user_id AS p_num, count(*) AS n FROM events GROUP BY 1")
def prj17(t: Tables):
    return C.require_columns(series(t), ("p_num", "datetime", "bg_mM")).groupBy("p_num").agg(F.count("*").alias("n"))


@query("prj18_patient_column", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1")
def prj18(t: Tables):
    from ..functions.ids import patient_column

    src = t.events.select(F.col("user_id").alias("id"), "value")
    return src.groupBy(patient_column(src)).agg(F.count("*").alias("n"))


@query("prj20_column_audit", """
WITH x AS (SELECT value, CASE WHEN event_type = 'view' THEN value END AS rate, 1.0 AS flag, CASE WHEN user_id = 3 THEN 'inf'::DOUBLE ELSE value END AS dose FROM events)
SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS n_null, round(avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END), 6) AS pct_null, 0::BIGINT AS n_inf, false AS constant FROM x
UNION ALL SELECT 'rate', count(*) FILTER (rate IS NULL), round(avg(CASE WHEN rate IS NULL THEN 100.0 ELSE 0 END), 6), 0, false FROM x
UNION ALL SELECT 'flag', 0, 0.0, 0, true FROM (SELECT 1) UNION ALL SELECT 'dose', 0, 0.0, count(*) FILTER (isinf(dose)), false FROM x""")
def prj20(t: Tables):
    src = t.events.select("value", F.when(F.col("event_type") == "view", F.col("value")).alias("rate"), F.lit(1.0).alias("flag"),
                          F.when(F.col("user_id") == 3, F.lit(float("inf"))).otherwise(F.col("value")).alias("dose"))
    return rounded(C.audit_columns(src, ["value", "rate", "flag", "dose"]), "pct_null")


@query("prj22_keep_columns", f"WITH {SER} SELECT p_num, event_id, {R('bg')} AS bg_mM FROM ser")
def prj22(t: Tables):
    return C.keep_columns(series(t), ["p_num", "event_id", "bg_mM", "no_such_column"]).withColumn("bg_mM", r("bg_mM"))


@query("prj23_same_resolution", """
WITH o AS (SELECT o_custkey AS p_num, date_trunc('year', o_orderdate) AS ts, o_orderkey, o_totalprice FROM orders),
d AS (SELECT *, min(ts) OVER (PARTITION BY p_num) AS a FROM o), s AS (SELECT p_num, epoch(min(ts) FILTER (ts > a)) - epoch(min(a)) AS gap FROM d GROUP BY p_num)
SELECT d.p_num, epoch(ts)::BIGINT AS t, o_orderkey, o_totalprice FROM d JOIN s USING (p_num) WHERE gap = 365 * 86400""")
def prj23(t: Tables):
    year = F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")
    src = t.orders.select(F.col("o_custkey").alias("p_num"), year.alias("datetime"), "o_orderkey", "o_totalprice")
    return C.same_resolution(src, 365 * 1440, ["o_orderkey", "o_totalprice"]).select("p_num", epoch(), "o_orderkey", "o_totalprice")
