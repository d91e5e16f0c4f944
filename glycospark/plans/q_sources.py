"""Raw layouts, run folders, meals and sinks.

Raw files are first derived from the driver tables into a scratch folder, then read
back through the readers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.ids import canonical_id
from ..operators import clean as C, meals as Me
from ..session import scratch
from ..sinks import writers as Wr
from ..sources import raw as Src, runs as Rn
from .catalog import R, RAW_KEYS, SER, STEP, Tables, epoch, meals, query, r, round_slot_sql, series
from .q_boards import RUNS, runs
from .q_metrics import ACT, LEVELS, PT, QF, point, rounded

ISO = "yyyy-MM-dd HH:mm:ss"
SAS = "ddMMMyy:HH:mm:ss"


def _text(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def _stamp(fmt: str, col: str = "ts"):
    return F.date_format(col, fmt)


# --- text layouts -----------------------------------------------------------------------


def _pump_folder(t: Tables) -> str:
    path, e = scratch(t.spark, "pump"), t.events
    pid, v = F.col("user_id").cast("string"), F.col("value")
    _text(e.where("event_type in ('click', 'error')").select(pid.alias("PtID"), F.col("event_type").alias("Period"), _stamp(ISO).alias("DataDtTm"), (v * 5).alias("CGM")), f"{path}/cgm")
    # every stamp of this table is in the clinical format, half of them only as adjusted
    sas = F.upper(_stamp(SAS))
    _text(e.where("event_type = 'view'").select(F.col("event_id").alias("RecID"), pid.alias("PtID"), F.lit("not a date").alias("DataDtTm"), sas.alias("DataDtTm_adjusted"), v.alias("CommandedBasalRate")), f"{path}/basal")
    _text(e.where("event_type = 'signup'").select(F.col("event_id").alias("RecID"), pid.alias("PtID"), _stamp(ISO).alias("DataDtTm"), F.lit("").alias("DataDtTm_adjusted"), v.alias("BolusAmount"), F.lit("normal").alias("BolusType")), f"{path}/bolus")
    return path


_PUMP = f"""s AS (SELECT *, us // 1000000 AS sec, us // {STEP * 1_000_000} * {STEP} AS slot FROM ser),
c AS (SELECT CAST(p_num AS VARCHAR) AS p_num, slot, avg(value * 5) AS cgm FROM s WHERE msg_type IN ('click', 'error') GROUP BY ALL),
d AS (SELECT CAST(p_num AS VARCHAR) AS p_num, slot, sum(value) AS dose FROM s WHERE msg_type = 'signup' GROUP BY ALL),
e AS (SELECT CAST(p_num AS VARCHAR) AS p_num, slot, sec, max(value) AS rate FROM s WHERE msg_type = 'view' GROUP BY ALL),
f AS (SELECT p_num, slot, arg_max(rate, sec) AS rate FROM e GROUP BY ALL),
x AS (SELECT p_num, lo + {STEP} * i AS slot FROM (SELECT p_num, lo, unnest(range(0, (hi - lo) // {STEP} + 1)) AS i FROM (SELECT p_num, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY p_num)))"""


@query("src1_pump_trial_tables", f"""
WITH {SER}, {_PUMP} SELECT p_num, slot AS t, {R('cgm / 18.0')} AS bg_mM, {R('coalesce(dose, 0)')} AS dose_units, {R('rate')} AS rate
FROM x LEFT JOIN c USING (p_num, slot) LEFT JOIN d USING (p_num, slot) LEFT JOIN f USING (p_num, slot)""")
def src1(t: Tables):
    out = Src.clean_pump_trial(Src.pump_trial(t.spark, _pump_folder(t)), STEP)
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), r("dose_units").alias("dose_units"), r("rate").alias("rate"))


def _device_folder(t: Tables) -> str:
    path, v, kind = scratch(t.spark, "device"), F.col("value"), F.col("event_type")
    dose = lambda k: F.when(kind == k, v)
    log = t.events.select(
        F.col("user_id").cast("string").alias("PtID"), _stamp(ISO).alias("DeviceDtTm"), F.when(kind != "error", v * 4).alias("CGMVal"),
        dose("view").alias("BasalDelivPrev"), dose("signup").alias("BolusDelivPrev"), dose("purchase").alias("MealBolusDelivPrev"), F.lit("Usual").alias("MealSize"))
    _text(log, f"{path}/log")
    demo = t.customer.select(F.col("c_custkey").cast("string").alias("PtID"), (F.col("c_nationkey") + 10).alias("DiagAge"), F.col("c_mktsegment").alias("Sex"))
    _text(demo, f"{path}/screening")
    return path


_CLAMP = "CASE WHEN v * 4 <= 39 THEN 40 WHEN v * 4 >= 401 THEN 400 ELSE v * 4 END"
_DEVICE = f"""dv AS (SELECT CAST(user_id AS VARCHAR) AS p_num, epoch_us(ts) // 1000000 AS sec, event_type AS kind, value AS v FROM events),
sl AS (SELECT *, {round_slot_sql('sec * 1000000', STEP)} AS slot FROM dv),
cg AS (SELECT p_num, sec, min(slot) AS slot, min({_CLAMP}) AS bg FROM sl WHERE kind <> 'error' GROUP BY ALL),
ib AS (SELECT p_num, slot, sum(CASE WHEN kind IN ('view', 'signup', 'purchase') THEN v ELSE 0 END) AS dose FROM sl GROUP BY ALL)"""


@query("src2_device_log", f"""
WITH {_DEVICE} SELECT cg.p_num, sec AS t, {R('bg')} AS bg_mg_dl, {R('dose')} AS dose_units, c_nationkey + 10 AS age_at_diagnosis, c_mktsegment AS sex, 'Usual' AS meal_size_text
FROM (SELECT *, row_number() OVER (PARTITION BY p_num, slot ORDER BY sec DESC) AS rn FROM cg) cg JOIN ib USING (p_num, slot) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cg.p_num WHERE rn = 1""")
def src2(t: Tables):
    out = Src.clean_device_frame(*Src.device_log(t.spark, _device_folder(t)), STEP)
    return out.select("p_num", epoch(), r("bg_mg_dl").alias("bg_mg_dl"), r("dose_units").alias("dose_units"), "age_at_diagnosis", "sex", "meal_size_text")


@query("src3_cgm_extract", f"WITH {_DEVICE} SELECT p_num, sec AS t, {R('bg')} AS bg_mg_dl FROM cg")
def src3(t: Tables):
    log, _ = Src.device_log(t.spark, _device_folder(t))
    return Src.cgm_history(log).select("p_num", epoch(), r("bg_mg_dl").alias("bg_mg_dl"))


@query("src3_insulin_extract", f"WITH {_DEVICE} SELECT p_num, sec - 300 AS t, {R('CASE WHEN kind IN (' + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'signup' + chr(39) + ', ' + chr(39) + 'purchase' + chr(39) + ') THEN v ELSE 0 END')} AS dose_units FROM dv")
def src3_insulin(t: Tables):
    log, _ = Src.device_log(t.spark, _device_folder(t))
    return Src.insulin_history(log).select("p_num", epoch(), r("dose_units").alias("dose_units"))


@query("src4_sensor_csv_tree", f"""
SELECT CAST(user_id AS VARCHAR) AS p_num, epoch_us(ts) // 1000000 AS t, {R('value / 18.0182')} AS bg_mM, CASE WHEN event_type = 'view' THEN 'café' END AS note
FROM events WHERE event_type IN ('click', 'error', 'view') AND value / 18.0182 BETWEEN 1.1 AND 33.3""")
def src4(t: Tables):
    return _sensor_rows(Src.sensor_csv(t.spark, _sensor_tree(t), ".csv")).select("p_num", epoch(), r("bg_mM").alias("bg_mM"), F.col("Note").alias("note"))


def _sensor_rows(df: DataFrame) -> DataFrame:
    out = C.assemble_stamp(C.rename(df, C.HEADER_SYNONYMS)).withColumn("bg_mM", F.col("bg_mg_dl").cast("double") / 18.0182)
    return C.drop_implausible(out)


def _sensor_tree(t: Tables) -> str:
    """Files with columns in three orders, one of them in Latin-1 with a further column, and a decoy of another name."""
    path, e = scratch(t.spark, "sensor"), t.events
    day, hour = _stamp("yyyy-MM-dd").alias("DeviceDate"), _stamp("HH:mm:ss").alias("DeviceTime")
    rec, who, value = F.col("event_id").alias("RecID"), F.col("user_id").alias("PtID"), F.col("value").alias("GlucoseValue")
    e.where("event_type = 'click'").select(rec, who, day, hour, value).write.option("header", True).csv(f"{path}/a")
    e.where("event_type = 'error'").select(value, hour, day, who, rec).write.option("header", True).csv(f"{path}/b/deep")
    view = e.where("event_type = 'view'").select(who, F.lit("café").alias("Note"), value, rec, day, hour)
    view.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/c")
    e.where("event_type = 'signup'").select(F.concat_ws(",", "user_id", "value").alias("line")).write.text(f"{path}/decoy")
    return path


@query("src4_quoted_line_breaks", """
SELECT CAST(event_id AS VARCHAR) AS rec, 'said "' || event_type || '",' || chr(10) || 'then ' || user_id AS note, CAST(user_id AS VARCHAR) AS p_num FROM events
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'plain', CAST(o_custkey AS VARCHAR) FROM orders""")
def src4_breaks(t: Tables):
    """Notes of two lines with quotes and commas, beside files of another header without."""
    path = scratch(t.spark, "sensor")
    note = F.concat(F.lit('"said ""'), F.col("event_type"), F.lit('"",\nthen '), F.col("user_id").cast("string"), F.lit('"'))
    one = t.events.select(F.concat_ws(",", F.col("event_id").cast("string"), note, F.col("user_id").cast("string")).alias("value"))
    two = t.orders.select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("plain")).alias("value"))
    for name, rows, head in (("a", one, "RecID,Note,PtID"), ("b", two, "PtID,RecID,Note")):
        text = rows.mapInPandas(lambda batches, head=head: _with_head(batches, head), "value string")
        text.write.text(f"{path}/{name}")
    out = Src.sensor_csv(t.spark, path, ".txt")
    return out.select(F.col("RecID").alias("rec"), F.col("Note").alias("note"), F.col("PtID").alias("p_num"))


def _with_head(batches, head: str):
    """Each file begins with its header."""
    first = True
    for pdf in batches:
        if first and len(pdf):
            pdf = pd.concat([pd.DataFrame({"value": [head]}), pdf])
            first = False
        yield pdf


@query("src4_expected_columns", """
SELECT * FROM (VALUES ('RecID', true, (SELECT count(*) FROM events WHERE event_type IN ('click', 'error', 'view'))),
  ('Note', true, (SELECT count(*) FROM events WHERE event_type = 'view')), ('Units', false, 0)) t(name, present, n_set)""")
def src4_columns(t: Tables):
    return Src.sensor_report(Src.sensor_csv(t.spark, _sensor_tree(t), ".csv"), ("RecID", "Note", "Units"))


WIDE_MEASURES = ("bg", "carbs")


def _wide_csv(t: Tables) -> str:
    """Events as wide rows: two measures and six hours of lags in half-hour steps."""
    path = scratch(t.spark, "wide")
    names = C.lag_columns(WIDE_MEASURES, 6, 30)
    lag = lambda i: F.when(F.pmod(F.col("event_id") + i, F.lit(3)) != 0, F.col("value") + i)
    cols = [(lag(i) if n.startswith("bg") else F.when(F.col("event_type") == "purchase", F.col("value"))).alias(n) for i, n in enumerate(names)]
    t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("p_num"), _stamp("HH:mm:ss").alias("time"), *cols).write.option("header", True).csv(path)
    return path


@query("src5_wide_lag_csv", "SELECT user_id AS p_num, count(*) AS n_rows, 27 AS n_columns FROM events GROUP BY 1")
def src5(t: Tables):
    df = Src.wide_lag_csv(t.spark, _wide_csv(t))
    return df.groupBy(F.col("p_num").cast("long").alias("p_num")).agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query("prj12_zero_lag_columns", f"""
SELECT event_id AS id, {R('CASE WHEN (event_id + 11) % 3 <> 0 THEN value + 11 END')} AS bg_mM, {R("CASE WHEN event_type = 'purchase' THEN value END")} AS food_g,
  CASE WHEN event_type = 'purchase' AND value <> 0 THEN 'ANNOUNCE_MEAL' ELSE '' END AS msg_type FROM events""")
def prj12(t: Tables):
    df = Src.wide_lag_csv(t.spark, _wide_csv(t))
    out = C.zero_lag(df, {"bg": "bg_mM", "carbs": "food_g"})
    return out.select(F.col("id").cast("long").alias("id"), r(F.col("bg_mM").cast("double")).alias("bg_mM"), r(F.col("food_g").cast("double")).alias("food_g"), "msg_type")


@query("prj13_unpivot_lags", f"""
WITH i AS (SELECT *, unnest(range(0, 12)) AS i FROM events)
SELECT event_id AS id, CAST((11 - i) * 1800 AS INTEGER) AS lag_s, ((epoch_us(ts) // 1000000) % 86400 - (11 - i) * 1800 + 86400) % 86400 AS second_of_day,
  {R('CASE WHEN (event_id + i) % 3 <> 0 THEN value + i END')} AS bg, {R("CASE WHEN event_type = 'purchase' THEN value END")} AS carbs FROM i""")
def prj13(t: Tables):
    from ..functions.timefn import second_of_day

    df = Src.wide_lag_csv(t.spark, _wide_csv(t)).withColumn("second_of_day", second_of_day(F.col("time")))
    out = C.unpivot_lags(df, WIDE_MEASURES, ("id",))
    return out.select(F.col("id").cast("long").alias("id"), "lag_s", "second_of_day", r("bg").alias("bg"), r("carbs").alias("carbs"))


def _offset_tables(t: Tables, folder: str) -> None:
    e, day = t.events, F.datediff("ts", F.lit("2024-01-05"))
    head = [F.col("user_id").alias("PtID"), day.alias("DeviceDtTmDaysFromEnroll"), _stamp("HH:mm:ss").alias("DeviceTm")]
    v, none = F.col("value"), lambda n, ty="double": F.lit(None).cast(ty).alias(n)
    _text(e.where("event_type = 'signup'").select(*head, F.lit("Normal").alias("BolusType"), v.alias("Normal"), none("ExpectedNormal"), none("Extended"), none("ExpectedExtended")), f"{folder}/bolus")
    _text(e.where("event_type = 'purchase'").select(*head, none("BgInput"), v.alias("CarbInput"), none("InsulinOnBoard"), (v / 10).alias("InsulinCarbRatio"), none("InsulinSensitivity")), f"{folder}/wizard")
    _text(e.where("event_type in ('click', 'error')").select(*head, F.when(F.col("event_type") == "click", "CGM").otherwise("Calibration").alias("RecordType"), v.alias("GlucoseValue")), f"{folder}/cgm")
    suspend = F.pmod(F.col("event_id"), F.lit(4)) == 0
    _text(e.where("event_type = 'view'").select(*head, F.when(suspend, "suspend").otherwise("scheduled").alias("BasalType"), F.when(~suspend, v).alias("Rate"), (v * 60000).alias("Duration"), none("SuprBasalType", "string"), none("SuprRate")), f"{folder}/basal")


_OFFSET = f"""ev AS (SELECT *, CAST(ts AS DATE) - DATE '2024-01-05' AS dd, 1577836800 + (CAST(ts AS DATE) - DATE '2024-01-05') * 86400 + (epoch_us(ts) // 1000000) % 86400 AS t FROM events),
u AS (
  SELECT user_id, t, 'bolus' AS msg_type, value AS dose, NULL AS food, NULL AS cr, NULL AS bg, NULL AS rate, NULL AS mins FROM ev WHERE event_type = 'signup' AND dd >= 0
  UNION ALL SELECT user_id, t, 'wizard', NULL, value, value / 10, NULL, NULL, NULL FROM ev WHERE event_type = 'purchase' AND dd >= 0
  UNION ALL SELECT user_id, t, 'cgm', NULL, NULL, NULL, value, NULL, NULL FROM ev WHERE event_type = 'click' AND dd >= 0
  UNION ALL SELECT user_id, t, 'basal', NULL, NULL, NULL, NULL, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END, value FROM ev WHERE event_type = 'view' AND dd >= 0)"""


@query("src6_day_offset_events", f"""
WITH {_OFFSET} SELECT CAST(user_id AS VARCHAR) AS pid, t, msg_type AS "tableType", {R('dose')} AS "normalBolus", {R('food')} AS "foodG", {R('cr')} AS cr, {R('bg')} AS "bgMgdl", {R('rate')} AS rate, {R('mins')} AS "basalDurationMins" FROM u""")
def src6(t: Tables):
    folder = scratch(t.spark, "offset")
    _offset_tables(t, folder)
    out = Src.day_offset_export(t.spark, folder)
    return out.select("pid", epoch("date"), "tableType", *[r(c).alias(c) for c in ("normalBolus", "foodG", "cr", "bgMgdl", "rate", "basalDurationMins")])


@query("set1_event_union", f"WITH {_OFFSET} SELECT msg_type AS \"tableType\", CAST(user_id AS VARCHAR) AS pid, count(*) AS n, 18 AS n_columns FROM u GROUP BY ALL")
def set1(t: Tables):
    folder = scratch(t.spark, "offset")
    _offset_tables(t, folder)
    out = Src.day_offset_export(t.spark, folder)
    return out.groupBy("tableType", "pid").agg(F.count("*").alias("n")).withColumn("n_columns", F.lit(len(out.columns)))


@query("prj1_translate_pump_export", f"""
WITH {_OFFSET} SELECT CAST(user_id AS VARCHAR) AS p_num, t, msg_type, round_even(bg / 18.018, 2) AS "bg_mM", {R('food')} AS food_g, {R('dose')} AS dose_units, {R('mins')} AS basal_duration_mins FROM u""")
def prj1(t: Tables):
    folder = scratch(t.spark, "offset")
    _offset_tables(t, folder)
    out = C.translate_day_offset(Src.day_offset_export(t.spark, folder))
    return out.select("p_num", epoch(), "msg_type", "bg_mM", r("food_g").alias("food_g"), r("dose_units").alias("dose_units"), r("basal_duration_mins").alias("basal_duration_mins"))


@query("prj7_day_offset_stamp", "SELECT event_id, 1577836800 + (CAST(ts AS DATE) - DATE '2024-01-01') * 86400 + (epoch_us(ts) // 1000000) % 86400 AS t FROM events")
def prj7(t: Tables):
    stamp = C.offset_stamp(F.datediff("ts", F.lit("2024-01-01")), _stamp("HH:mm:ss"))
    return t.events.select("event_id", stamp.alias("datetime")).select("event_id", epoch())


@query("prj14_suspend_rate", f"SELECT event_id, {R("CASE WHEN event_type = 'error' THEN 0 ELSE value END")} AS rate FROM events")
def prj14(t: Tables):
    return t.events.select("event_id", r(C.suspend_rate(F.when(F.col("event_type") == "error", "suspend").otherwise("scheduled"), F.col("value"))).alias("rate"))


def _app_tables(t: Tables):
    e, gid = t.events, F.concat(F.lit("g"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    readings = e.where("event_type in ('click', 'error')").select(gid.alias("gid"), F.col("ts").alias("date"), F.col("value").alias("bgl"), F.lit("flat").alias("trend"), F.lit("cgm").alias("source"))
    messages = e.where("event_type in ('purchase', 'signup')").select(
        F.col("event_id").cast("string").alias("id"), gid.alias("gid"), F.col("ts").alias("date"), F.when(F.col("event_type") == "purchase", "ANNOUNCE_MEAL").otherwise("DOSE_INSULIN").alias("type"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("food_g"), F.when(F.col("event_type") == "signup", F.col("value")).alias("dose_units"))
    groups = Src.numbered_patients(e.select(gid.alias("gid")))
    return readings, messages, groups


_APP = """no AS (SELECT user_id, 'app_' || (row_number() OVER (ORDER BY user_id) - 1) AS p_num FROM (SELECT DISTINCT user_id FROM events))"""


@query("src7_app_events", f"""
WITH {_APP} SELECT p_num, epoch_us(ts) // 1000000 AS t, CASE WHEN event_type IN ('click', 'error') THEN value END AS bgl,
  CASE event_type WHEN 'purchase' THEN 'ANNOUNCE_MEAL' WHEN 'signup' THEN 'DOSE_INSULIN' END AS msg_type, CASE WHEN event_type = 'purchase' THEN value END AS food_g
FROM events JOIN no USING (user_id) WHERE event_type <> 'view'""")
def src7(t: Tables):
    return Src.app_events(*_app_tables(t)).select("p_num", epoch("date"), "bgl", "msg_type", "food_g")


@query("join4_readings_groups", f"WITH {_APP} SELECT p_num, epoch_us(ts) // 1000000 AS t, value AS bgl FROM events JOIN no USING (user_id) WHERE event_type IN ('click', 'error') AND p_num IN ('app_0', 'app_3')")
def join4(t: Tables):
    out = Src.app_events(*_app_tables(t), patients=["app_0", "app_3"])
    return out.where("msg_type is null").select("p_num", epoch("date"), "bgl")


@query("set2_readings_messages", f"WITH {_APP} SELECT p_num, count(*) AS n, count(*) FILTER (event_type IN ('click', 'error')) AS n_readings FROM events JOIN no USING (user_id) WHERE event_type <> 'view' GROUP BY 1")
def set2(t: Tables):
    return Src.app_events(*_app_tables(t)).groupBy("p_num").agg(F.count("*").alias("n"), F.count("bgl").alias("n_readings"))


@query("src8_patient_map", f"WITH {_APP} SELECT 'g' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS gid, p_num FROM no")
def src8(t: Tables):
    return Src.patient_map(_app_tables(t)[2])


@query("win24_numbered_patients", "SELECT c_name AS gid, 'app_' || (row_number() OVER (ORDER BY c_name) - 1) AS p_num FROM (SELECT DISTINCT c_name FROM customer)")
def win24(t: Tables):
    return Src.numbered_patients(t.customer.select(F.col("c_name").alias("gid")))


@query("prj2_translate_app_export", """
SELECT CAST(user_id AS VARCHAR) AS p_num, epoch_us(ts) // 1000000 AS t, CASE WHEN event_type <> 'error' THEN round_even(value / 18.018, 2) END AS "bg_mM", CASE WHEN event_type = 'purchase' THEN value END AS food_g FROM events""")
def prj2(t: Tables):
    v = F.col("value").cast("string")
    raw = t.events.select(F.col("user_id").cast("string").alias("patient_id"), F.col("ts").alias("date"), F.when(F.col("event_type") == "error", "HIGH").otherwise(v).alias("bgl"),
                          F.when(F.col("event_type") == "purchase", v).otherwise("n/a").alias("food_g"))
    return C.translate_app(raw).select("p_num", epoch(), "bg_mM", "food_g")


@query("prj3_header_synonyms", "SELECT user_id AS p_num, value AS bg_mg_dl, event_id AS record_id FROM events")
def prj3(t: Tables):
    raw = t.events.select(F.col("user_id").alias("PtID"), F.col("value").alias("SensorGlucose"), F.col("event_id").alias("RecID"))
    return C.rename(raw, C.HEADER_SYNONYMS)


@query("prj5_flexible_stamps", "SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000000 - CASE WHEN event_type = 'view' THEN 0 ELSE 0 END END AS t FROM events")
def prj5(t: Tables):
    kind = F.col("event_type")
    raw = t.events.select("event_id", F.when(kind == "view", F.upper(_stamp(SAS))).when(kind == "click", _stamp(ISO)).otherwise("?").alias("adj"),
                          F.when(kind == "error", "unknown").otherwise(_stamp(ISO)).alias("raw"))
    return C.parse_stamps(raw, "adj", "raw").select("event_id", epoch())


@query("prj6_assembled_stamps", "SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events")
def prj6(t: Tables):
    raw = t.events.select("event_id", _stamp("yyyy-MM-dd").alias("date"), _stamp("HH:mm:ss").alias("time"))
    return C.assemble_stamp(raw).select("event_id", epoch())


@query("prj8_canonical_ids", """
SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'tam_' || o_custkey WHEN 1 THEN 'tam_' || o_custkey WHEN 2 THEN 'tam_' || o_custkey ELSE 'tam_' || o_custkey END AS p_num FROM orders""")
def prj8(t: Tables):
    k, way = F.col("o_custkey").cast("string"), F.col("o_custkey") % 4
    raw = F.when(way == 0, F.concat(F.lit("p0"), k)).when(way == 1, F.concat(k, F.lit(".0"))).when(way == 2, F.concat(F.lit("site-"), F.lpad(k, 8, "0"))).otherwise(F.concat(k, F.lit("x")))
    return t.orders.select("o_orderkey", canonical_id(raw, "tam").alias("p_num"))


@query("prj11_clean_device_log", f"""
SELECT event_id, {R('CASE WHEN value * 4 <= 39 THEN 40 WHEN value * 4 >= 401 THEN 400 ELSE value * 4 END / 18.0')} AS bg_mM, CASE WHEN event_type = 'signup' THEN value ELSE 0 END AS dose_units, 'closed_loop' AS insulin_delivery
FROM events WHERE event_type <> 'error'""")
def prj11(t: Tables):
    kind = F.col("event_type")
    raw = t.events.select("event_id", F.col("ts").alias("datetime"), F.when(kind != "error", F.col("value") * 4).alias("bg_mg_dl"), F.when(kind == "signup", F.col("value")).alias("dose_units"))
    return C.clean_device_log(raw).select("event_id", r("bg_mM").alias("bg_mM"), "dose_units", "insulin_delivery")


# --- processed tables, sinks ----------------------------------------------------------------


def _canon(t: Tables) -> DataFrame:
    s = series(t)
    return s.select(F.concat(F.lit("app_"), F.col("p_num").cast("string")).alias("p_num"), "datetime", "event_id", "bg_mM")


@query("src9_pruned_parquet", "SELECT 'app_' || user_id AS p_num, event_id FROM events WHERE user_id IN (1, 5)")
def src9(t: Tables):
    path = scratch(t.spark, "processed")
    Wr.append_partitioned(_canon(t), path, 3)
    return Src.processed_parquet(t.spark, path, ["p_num", "event_id"], ["app_1", "app_5"], size=3)


@query("src10_partition_files", "SELECT 'app_' || user_id AS p_num, count(*) AS n FROM events GROUP BY 1")
def src10(t: Tables):
    path = scratch(t.spark, "processed")
    Wr.append_partitioned(_canon(t).where("event_id % 2 = 0"), path, 5)
    Wr.append_partitioned(_canon(t).where("event_id % 2 = 1"), path, 5)
    return Src.processed_parquet(t.spark, path).groupBy("p_num").agg(F.count("*").alias("n"))


@query("src11_per_patient_csv", "SELECT event_type AS p_num, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def src11(t: Tables):
    from pyspark.sql import types as T

    path = scratch(t.spark, "percsv")
    for pid in ("click", "error", "purchase", "signup", "view"):
        t.events.where(F.col("event_type") == pid).select("event_id", "value").write.option("header", True).csv(f"{path}/{pid}_full.csv")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    return Src.processed_csv(t.spark, path, schema).groupBy("p_num").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("agg21_file_statistics", f"""
WITH {SER} SELECT msg_type AS file, count(*) AS total_readings, CAST(min(us) // 1000000 AS BIGINT) AS first_time, CAST(max(us) // 1000000 AS BIGINT) AS last_time, {R('avg(value)')} AS glucose_mean,
  {R('stddev_samp(value)')} AS glucose_std, min(value) AS glucose_min, max(value) AS glucose_max, {R('count(*) * 5 / 60.0 / 24')} AS estimated_days, {R('quantile_cont(value, 0.5)')} AS glucose_median FROM ser GROUP BY 1""")
def agg21(t: Tables):
    from pyspark.sql import types as T

    from ..operators.profile import file_statistics

    path = scratch(t.spark, "cases")
    t.events.select(_stamp(ISO).alias("hora"), F.col("value").alias("glucemia"), F.col("event_type").alias("case")).write.partitionBy("case").option("header", True).csv(path)
    schema = T.StructType([T.StructField("hora", T.TimestampNTZType()), T.StructField("glucemia", T.DoubleType())])
    df = t.spark.read.option("timestampNTZFormat", ISO).csv(path, schema=schema, header=True, recursiveFileLookup=True)
    named = df.select(F.regexp_extract(F.col("_metadata.file_path"), r"case=([^/]*)/", 1).alias("file"), F.col("hora").alias("datetime"), F.col("glucemia").alias("bg_mM"))
    out = file_statistics(named)
    six = ("glucose_mean", "glucose_std", "estimated_days", "glucose_median")
    return rounded(out, *six).withColumns({c: F.unix_seconds(F.col(c).cast("timestamp")) for c in ("first_time", "last_time")})


@query("snk1_partitioned_append", "SELECT CAST(user_id // 10 AS INTEGER) AS \"partition\", count(*) AS n, count(DISTINCT user_id) AS n_patients FROM events GROUP BY 1")
def snk1(t: Tables):
    path = scratch(t.spark, "snk1")
    for kind in ("event_id % 2 = 0", "event_id % 2 = 1"):
        Wr.append_partitioned(_canon(t).where(kind), path, 10)
    return t.spark.read.parquet(path).groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("p_num").alias("n_patients"))


@query("snk2_bounded_files", "SELECT CAST(user_id // 50 AS INTEGER) AS \"partition\", count(*) AS n, true AS bounded FROM events GROUP BY 1")
def snk2(t: Tables):
    path = scratch(t.spark, "snk2")
    Wr.write_partitioned(_canon(t), path, 50, rows_per_file=1000)
    files = t.spark.read.parquet(path).groupBy("partition", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("k"))
    return files.groupBy("partition").agg(F.sum("k").alias("n"), (F.max("k") <= 1000).alias("bounded"))


_PACKED = (7, 0.006)  # patients and MB a file


@query("snk2_packed_files", f"""
WITH r AS (SELECT user_id // 50 AS part, user_id, 24 + octet_length(encode('app_' || user_id)) AS b FROM events), u AS (SELECT part, user_id, count(*) AS n, sum(b) AS b FROM r GROUP BY ALL)
SELECT CAST(part AS INTEGER) AS "partition", CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS patients, true AS patients_bounded, true AS bytes_bounded, true AS whole FROM u GROUP BY part""")
def snk2_packed(t: Tables):
    """What the files hold: no more patients or bytes than allowed, and a patient that fits into a file is in one."""
    path, (patients, mb) = scratch(t.spark, "snk2"), _PACKED
    src = _canon(t).select("p_num", "datetime", "event_id", F.col("bg_mM").alias("bg"))
    Wr.write_packed(src, path, 50, patients, mb)
    back = t.spark.read.schema("p_num string, datetime timestamp_ntz, event_id bigint, bg double, partition int, batch string").parquet(path)
    back = back.withColumn("_b", Wr.row_bytes(src))
    files = back.groupBy("partition", F.col("_metadata.file_path").alias("f")).agg(F.count_distinct("p_num").alias("k"), F.sum("_b").alias("b"))
    bounds = files.groupBy("partition").agg((F.max("k") <= patients).alias("patients_bounded"), (F.max("b") <= int(mb * 1e6)).alias("bytes_bounded"))
    each = back.groupBy("partition", "p_num").agg(F.count("*").alias("n"), F.sum("_b").alias("b"), F.count_distinct(F.col("_metadata.file_path")).alias("f"))
    whole = (F.col("f") == 1) | (F.col("b") > int(mb * 1e6))
    each = each.groupBy("partition").agg(F.sum("n").alias("n"), F.sum("b").alias("bytes"), F.count("*").alias("patients"), F.bool_and(whole).alias("whole"))
    return each.join(bounds, "partition")


@query("snk3_processed_series", "SELECT 'events' AS dataset, 'app_' || user_id AS p_num, count(*) AS n FROM events GROUP BY ALL")
def snk3(t: Tables):
    path = scratch(t.spark, "snk3")
    Wr.write_series(_canon(t), path, "events")
    return t.spark.read.parquet(path).groupBy("dataset", "p_num").agg(F.count("*").alias("n"))


@query("snk4_split_store", """
SELECT part, count(*) AS n, true AS other_missing FROM (SELECT CASE WHEN user_id IN (1, 4, 7) THEN 'validation' ELSE 'train' END AS part FROM events) GROUP BY part""")
def snk4(t: Tables):
    root, params = scratch(t.spark, "snk4"), {"pct": 0.8, "dataset": "events"}
    rows = series(t).withColumn("part", F.when(F.col("p_num").isin(1, 4, 7), "validation").otherwise("train"))
    Wr.write_split(rows, root, params)
    other = Wr.read_split(t.spark, root, {**params, "pct": 0.9})
    return Wr.read_split(t.spark, root, params).groupBy("part").agg(F.count("*").alias("n")).withColumn("other_missing", F.lit(other is None))


@query("snk5_three_tier_results", f"""
WITH {PT} SELECT run, count(DISTINCT (episode, p_num)) AS n_episodes, count(*) AS n_steps FROM pt GROUP BY run""")
def snk5(t: Tables):
    path, p = scratch(t.spark, "snk5"), point(t)
    steps = F.sort_array(F.collect_list(F.struct("step", "forecast")))
    eps = p.groupBy("run", "p_num", F.col("episode").cast("string").alias("episode_id")).agg(F.avg("forecast").alias("mean"), F.transform(steps, lambda s: s["forecast"]).alias("pred"))
    summary = p.groupBy("run").agg(F.count("*").alias("n_steps"))
    Wr.write_results(summary, eps, p.groupBy("step").agg(F.avg("forecast").alias("mean")), path, {"evaluation": "nocturnal"})
    tier1 = t.spark.read.schema("run string, n_steps bigint").json(f"{path}/results_summary")
    tier2 = t.spark.read.parquet(f"{path}/episodes").groupBy("run").agg(F.count("*").alias("n_episodes"))
    tier3 = t.spark.read.parquet(f"{path}/forecasts").groupBy("run").agg(F.sum(F.size("pred")).cast("long").alias("n_steps"))
    return tier1.join(tier2, "run").join(tier3, ["run", "n_steps"]).select("run", "n_episodes", "n_steps")


@query("snk6_leaderboard_csv", f"""
WITH {RUNS} SELECT model, run_id, {R('rmse')} AS rmse FROM runs WHERE rmse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY runs.rmse, run_id) = 1""")
def snk6(t: Tables):
    path = scratch(t.spark, "snk6")
    Wr.write_leaderboards(runs(t).drop("covariate_cols"), path)
    df = t.spark.read.csv(f"{path}/best_by_model", header=True)
    return df.select("model", "run_id", r(F.col("rmse").cast("double")).alias("rmse"))


# --- run folders ------------------------------------------------------------------------------

# A run is a (nation, priority, status) group of orders.  Some files are broken, lack
# the rmse or have no episodes.
_GROUPS = f"""gr AS (SELECT replace(n_name, ' ', '_') AS run_id, CASE WHEN o_orderstatus = 'O' THEN '512ctx_96fh' WHEN o_orderstatus = 'F' THEN '256ctx_72fh' ELSE '512ctx_48fh' END AS ctx_fh,
  'm' || left(o_orderpriority, 1) AS model, n_nationkey AS nk, avg(o_totalprice) / 100003 AS rmse, avg(c_acctbal) / 1009 AS wql, count(*) AS n, count(DISTINCT o_custkey) AS np
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""


def _run_groups(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.col("o_orderstatus")
    ctx = F.when(status == "O", "512ctx_96fh").when(status == "F", "256ctx_72fh").otherwise("512ctx_48fh")
    return t.orders.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.regexp_replace("n_name", " ", "_").alias("run_id"), ctx.alias("ctx_fh"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("model"), F.col("n_nationkey").alias("nk"),
    ).agg((F.avg("o_totalprice") / 100003).alias("rmse"), (F.avg("c_acctbal") / 1009).alias("wql"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("np"))


def _write_tree(df: DataFrame, body, root: str) -> None:
    keys = ["ctx_fh", "model", "run_id"]
    df.select(*keys, body.alias("value")).repartition(*keys).write.partitionBy(*keys).text(root)


def _run_tree(t: Tables, standard: bool = False):
    """Folder of result files and the configs of its runs."""
    root, g = scratch(t.spark, "runs") + "/forecasting", _run_groups(t)
    nk = F.col("nk")
    mode = F.when(nk % 2 == 0, "zero-shot").otherwise("fine-tuned")
    config = F.struct(F.lit(512).alias("context_length"), F.lit(96).alias("forecast_length"))
    patients = F.array(F.struct(F.lit("a").alias("patient_id"), F.when(nk != 5, F.col("n") - 1).otherwise(0).alias("episodes")), F.struct(F.lit("b").alias("patient_id"), F.when(nk != 5, 1).otherwise(0).alias("episodes")))
    common = [F.col("model").alias("model"), F.lit("events").alias("dataset"), mode.alias("mode"), config.alias("config"), patients.alias("per_patient")]
    if standard:
        overall = F.when(nk != 3, F.struct(F.col("rmse").alias("rmse"), (F.col("rmse") / 2).alias("mae"), F.lit(None).cast("double").alias("mape"), (F.col("rmse") * F.col("rmse")).alias("mse")))
        body = F.to_json(F.struct(*common, overall.alias("overall")))
    else:
        total = F.when(nk % 4 == 0, F.col("n"))  # otherwise summed over the patients
        body = F.to_json(F.struct(*common, F.when(nk != 3, F.col("rmse")).alias("overall_rmse"), F.col("wql").alias("overall_wql"), total.alias("total_episodes")))
    _write_tree(g, F.when(nk == 7, F.substring(body, 1, 20)).otherwise(body), root)
    covs = F.when(nk % 3 == 0, F.array(F.lit("iob"), F.lit("cob"))).when(nk % 3 == 1, F.array(F.lit("iob")))
    cfg = F.to_json(F.struct(F.struct(covs.alias("covariate_cols"), F.lit("holdout_10pct").alias("config_dir"), F.lit("ckpt.pt").alias("checkpoint")).alias("cli_args")))
    _write_tree(g, cfg, root + "_config")
    return root, Rn.run_configs(t.spark, root + "_config", "part-*").withColumn("run_path", F.regexp_replace("run_path", "forecasting_config", "forecasting"))


@query("src13_run_directories", f"WITH {_GROUPS} SELECT run_id, model AS model_dir, ctx_fh, 'forecasting' AS experiment_type FROM gr")
def src13(t: Tables):
    root, _ = _run_tree(t)
    return Rn.run_directories(t.spark, root, "part-*").select("run_id", "model_dir", "ctx_fh", "experiment_type")


@query("src14_nocturnal_runs", f"""
WITH {_GROUPS} SELECT run_id, model, ctx_fh, CASE WHEN nk % 2 = 0 THEN 'zeroshot' ELSE 'finetuned' END AS mode, {R('rmse')} AS rmse, {R('wql')} AS wql, n AS total_episodes, 512::BIGINT AS context_length, 'ckpt.pt' AS checkpoint,
  CASE WHEN nk % 2 = 0 THEN 'zero_shot' WHEN nk % 3 = 0 THEN 'iob_cob' WHEN nk % 3 = 1 THEN 'iob' ELSE 'bg_only' END AS cov_bucket FROM gr WHERE nk NOT IN (3, 5, 7)""")
def src14(t: Tables):
    root, cfg = _run_tree(t)
    out = Rn.nocturnal_runs(t.spark, root, cfg, ("part-*",))
    return out.select("run_id", "model", "ctx_fh", "mode", r("rmse").alias("rmse"), r("wql").alias("wql"), "total_episodes", "context_length", "checkpoint", "cov_bucket")


@query("src15_standard_runs", f"""
WITH {_GROUPS} SELECT run_id, model, ctx_fh, CASE WHEN nk % 2 = 0 THEN 'zeroshot' ELSE 'finetuned' END AS mode, {R('rmse')} AS rmse, {R('rmse / 2')} AS mae, CASE WHEN nk = 5 THEN 0 ELSE n END AS total_episodes, 96::BIGINT AS forecast_length FROM gr WHERE nk NOT IN (3, 7)""")
def src15(t: Tables):
    root, cfg = _run_tree(t, standard=True)
    out = Rn.standard_runs(t.spark, root, cfg, "part-*")
    return out.select("run_id", "model", "ctx_fh", "mode", r("rmse").alias("rmse"), r("mae").alias("mae"), "total_episodes", "forecast_length")


@query("src12_run_summaries", f"""
WITH {RUNS} SELECT run_id, CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS source, model, epoch(timestamp)::BIGINT AS t, {R('rmse')} AS rmse, forecast_length::BIGINT AS forecast_length FROM runs""")
def src12(t: Tables):
    from ..schema import RUN_SUMMARY

    root, src = scratch(t.spark, "summaries"), runs(t)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in src.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_SUMMARY.fields]
    for name, keep in (("even", 0), ("odd", 1)):
        src.where(F.col("run_id").cast("long") % 2 == keep).select(*cols).write.option("header", True).csv(f"{root}/{name}")
    out = Rn.run_summaries(t.spark, [f"{root}/even", f"{root}/absent", f"{root}/odd"])
    source = F.element_at(F.split("source_summary", "/"), -2)
    return out.select("run_id", source.alias("source"), "model", epoch("timestamp"), r("rmse").alias("rmse"), "forecast_length")


@query("src16_prediction_arrays", f"""
WITH {ACT}, p AS (SELECT episode, step, row_number() OVER (PARTITION BY episode ORDER BY step) AS k, base, actual FROM act),
ok AS (SELECT episode FROM p GROUP BY episode HAVING max(step) < 7)
SELECT CAST(episode AS VARCHAR) AS episode_id, CAST(k AS INTEGER) AS step, {R('base')} AS forecast, {R('actual')} AS actual FROM p JOIN ok USING (episode)""")
def src16(t: Tables):
    item = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("step", c))), lambda s: s[c])
    arrays = point(t).groupBy(F.col("episode").cast("string").alias("episode_id")).agg(item("forecast").alias("pred"), item("actual").alias("target_bg"), F.max("step").alias("_m"))
    # episodes that reach step 7 lose their last forecast, so their lengths differ
    cut = F.when(F.col("_m") == 7, F.slice("pred", F.lit(1), F.size("pred") - 1)).otherwise(F.col("pred"))
    path = scratch(t.spark, "arrays")
    arrays.withColumn("pred", cut).drop("_m").write.parquet(path)
    return rounded(Rn.prediction_actual(t.spark.read.parquet(path)), "forecast", "actual")


@query("src16_legacy_results_all", """
SELECT CAST(l_suppkey AS VARCHAR) AS patient_id, count(DISTINCT l_orderkey) AS n_episodes, count(*) AS n_values, round(sum(l_quantity), 4) + 0.0 AS total
FROM lineitem GROUP BY 1""")
def src16_legacy_all(t: Tables):
    return _legacy_totals(t)


#: Lines of a result document, about.
_DOCUMENT = 5_000


def _legacy_totals(t: Tables) -> DataFrame:
    """All episodes written as result files and read back; a supplier's are spread over the files by a hash."""
    values = F.collect_list("l_quantity")
    eps = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(values.alias("pred"), values.alias("target_bg"))
    item = F.struct(F.col("l_suppkey").cast("string").alias("patient_id"), F.col("l_orderkey").cast("string").alias("anchor"), "pred", "target_bg")
    bucket = F.pmod(F.xxhash64("l_suppkey", "l_orderkey"), F.lit(t.lineitem.count() // _DOCUMENT + 1))
    files = eps.groupBy(bucket.alias("bucket")).agg(F.to_json(F.struct(F.collect_list(item).alias("per_episode"))).alias("value"))
    path = scratch(t.spark, "legacy")
    files.write.partitionBy("bucket").text(path)
    out = Rn.legacy_episodes(t.spark, path).withColumn("x", F.explode("target_bg"))
    return out.groupBy("patient_id").agg(F.count_distinct("anchor").alias("n_episodes"), F.count("*").alias("n_values"), r(F.sum("x"), 4).alias("total"))


@query("src17_quantile_tensors", f"""
WITH {QF}, k AS (SELECT *, dense_rank() OVER (PARTITION BY episode ORDER BY step) AS k FROM qf)
SELECT CAST(episode AS VARCHAR) AS episode_id, CAST(k AS INTEGER) AS step, CAST(q AS DOUBLE) AS q, {R('forecast')} AS forecast, {R('actual')} AS actual FROM k""")
def src17(t: Tables):
    # an episode's steps are gathered once; the rows of its levels follow from its points in place
    points = point(t).groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("step", "forecast", "actual"))).alias("_s"))
    row = lambda q: F.transform("_s", lambda s: s["forecast"] * (0.5 + F.lit(q)))
    tensor = F.array(*[row(q) for q in LEVELS])
    stored = points.select(F.col("episode").cast("string").alias("episode_id"), tensor.alias("quantile_forecasts"), F.transform("_s", lambda s: s["actual"]).alias("actuals"))
    path = scratch(t.spark, "tensors")
    stored.write.parquet(path)
    return rounded(Rn.quantile_tensor(t.spark.read.parquet(path), LEVELS), "forecast", "actual")


@query("src18_reader_registry", f"WITH {_OFFSET} SELECT msg_type AS \"tableType\", count(*) AS n FROM u GROUP BY 1")
def src18(t: Tables):
    folder = scratch(t.spark, "offset")
    _offset_tables(t, folder)
    return Src.DEFAULT.load(t.spark, "day_offset", folder).groupBy("tableType").agg(F.count("*").alias("n"))


MEA = f"""{SER.replace("event_type AS msg_type", "CASE WHEN event_type = 'purchase' THEN 'ANNOUNCE_MEAL' ELSE event_type END AS msg_type")}"""


@query("mea1_days_with_meal_count", f"""
WITH {MEA}, d AS (SELECT p_num, CAST(ts AS DATE) AS d FROM ser WHERE msg_type = 'ANNOUNCE_MEAL' GROUP BY ALL HAVING count(*) = 1)
SELECT event_id FROM ser WHERE (p_num, CAST(ts AS DATE)) NOT IN (SELECT (p_num, d) FROM d)""")
def mea1(t: Tables):
    return Me.drop_days_with_meals(meals(t), 1).select("event_id")


_MERGE = f"""WITH RECURSIVE {MEA},
m AS (SELECT p_num, us, food FROM ser WHERE msg_type = 'ANNOUNCE_MEAL'),
big AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY us) AS i FROM m WHERE food > 20),
f AS (SELECT p_num, us, i, us AS last, true AS ab FROM big WHERE i = 1
  UNION ALL SELECT b.p_num, b.us, b.i, CASE WHEN b.us - f.last > 43200000000 THEN b.us ELSE f.last END, b.us - f.last > 43200000000 FROM f JOIN big b ON b.p_num = f.p_num AND b.i = f.i + 1),
ab AS (SELECT p_num, us AS a FROM f WHERE ab),
x AS (SELECT ser.*, (SELECT max(a) FROM ab WHERE ab.p_num = ser.p_num AND ab.a <= ser.us) AS a FROM ser),
y AS (SELECT *, a IS NOT NULL AND us > a AND us - a <= 43200000000 AS swallowed, a = us AND msg_type = 'ANNOUNCE_MEAL' AND food > 20 AS absorbs FROM x),
g AS (SELECT p_num, a, sum(food) AS gain FROM y WHERE swallowed AND food > 0 GROUP BY ALL),
z AS (SELECT y.p_num, y.ts, y.us, y.event_id, CASE WHEN swallowed THEN 0 WHEN absorbs THEN food + coalesce(gain, 0) ELSE food END AS food_g,
  CASE WHEN swallowed AND msg_type = 'ANNOUNCE_MEAL' THEN 'LOW_CARB_MEAL' WHEN swallowed THEN '' WHEN msg_type = 'ANNOUNCE_MEAL' AND food <= 20 THEN 'LOW_CARB_MEAL' ELSE msg_type END AS msg_type
  FROM y LEFT JOIN g ON g.p_num = y.p_num AND g.a = y.a)"""


@query("mea2_greedy_meal_merge", f"{_MERGE} SELECT p_num, event_id, {R('food_g')} AS food_g, msg_type FROM z")
def mea2(t: Tables):
    out = Me.merge_meals(meals(t).select("p_num", "datetime", "event_id", "msg_type", "food_g"), 43_200, 20, keys=RAW_KEYS)
    return out.select("p_num", "event_id", r("food_g").alias("food_g"), "msg_type")


@query("top1_top_carb_meals", f"""
WITH {MEA}, k AS (SELECT *, row_number() OVER (PARTITION BY p_num, (us - 14400000000) // 86400000000, msg_type = 'ANNOUNCE_MEAL' ORDER BY food DESC NULLS LAST, us, event_id) AS rk FROM ser)
SELECT event_id, {R("CASE WHEN msg_type = 'ANNOUNCE_MEAL' AND rk > 1 THEN 0 ELSE food END")} AS food_g, CASE WHEN msg_type = 'ANNOUNCE_MEAL' AND rk > 1 THEN '0' ELSE msg_type END AS msg_type FROM k""")
def top1(t: Tables):
    return Me.keep_top_meals(meals(t), 1, tie=("event_id",)).select("event_id", r("food_g").alias("food_g"), "msg_type")


@query("mea3_meal_identification", f"""
WITH RECURSIVE {MEA}, b AS (SELECT *, us // 21600000000 * 21600 AS slot FROM ser),
o AS (SELECT p_num, slot, arg_min(bg, (us, event_id)) AS bg, arg_min(msg_type, (us, event_id)) AS msg FROM b WHERE msg_type <> 'ANNOUNCE_MEAL' GROUP BY ALL),
m AS (SELECT p_num, slot, arg_min(bg, (us, event_id)) AS bg, arg_min(food, (us, event_id)) AS food FROM b WHERE msg_type = 'ANNOUNCE_MEAL' GROUP BY ALL),
x AS (SELECT p_num, lo + 21600 * i AS slot FROM (SELECT p_num, lo, unnest(range(0, (hi - lo) // 21600 + 1)) AS i FROM (SELECT p_num, min(slot) AS lo, max(slot) AS hi FROM o GROUP BY p_num))),
j AS (SELECT x.p_num, x.slot AS t, coalesce(m.bg, o.bg) AS bg, CASE WHEN m.slot IS NOT NULL THEN 'ANNOUNCE_MEAL' ELSE o.msg END AS msg, m.food FROM x LEFT JOIN o USING (p_num, slot) LEFT JOIN m USING (p_num, slot)),
k AS (SELECT *, t // 86400 AS day, count(bg) OVER (PARTITION BY p_num, t // 86400 ORDER BY t) AS grp FROM j),
q AS (SELECT p_num, day, grp, count(*) FILTER (bg IS NULL) AS n FROM k GROUP BY ALL),
ok AS (SELECT p_num, day FROM q GROUP BY ALL HAVING max(n) <= 2),
d AS (SELECT k.* FROM k JOIN ok USING (p_num, day) WHERE bg IS NOT NULL),
big AS (SELECT p_num, t, food, row_number() OVER (PARTITION BY p_num ORDER BY t) AS i FROM d WHERE msg = 'ANNOUNCE_MEAL' AND food > 20),
f AS (SELECT p_num, t, i, t AS last, true AS ab FROM big WHERE i = 1
  UNION ALL SELECT c.p_num, c.t, c.i, CASE WHEN c.t - f.last > 21600 THEN c.t ELSE f.last END, c.t - f.last > 21600 FROM f JOIN big c ON c.p_num = f.p_num AND c.i = f.i + 1),
y AS (SELECT d.*, (SELECT max(f.t) FROM f WHERE ab AND f.p_num = d.p_num AND f.t <= d.t) AS a FROM d),
w AS (SELECT *, a IS NOT NULL AND t > a AND t - a <= 21600 AS sw FROM y),
g AS (SELECT p_num, a, sum(food) AS gain FROM w WHERE sw AND food > 0 GROUP BY ALL),
z AS (SELECT w.p_num, w.t, w.bg, CASE WHEN sw THEN 0 WHEN w.a = w.t THEN food + coalesce(gain, 0) ELSE food END AS food,
  CASE WHEN sw AND msg = 'ANNOUNCE_MEAL' THEN 'LOW_CARB_MEAL' WHEN sw THEN '' WHEN msg = 'ANNOUNCE_MEAL' AND food <= 20 THEN 'LOW_CARB_MEAL' ELSE msg END AS msg FROM w LEFT JOIN g ON g.p_num = w.p_num AND g.a = w.a),
r AS (SELECT *, row_number() OVER (PARTITION BY p_num, (t - 14400) // 86400, msg = 'ANNOUNCE_MEAL' ORDER BY food DESC NULLS LAST, t) AS rk FROM z)
SELECT p_num, t, {R('bg')} AS bg_mM, {R("CASE WHEN msg = 'ANNOUNCE_MEAL' AND rk > 1 THEN 0 ELSE food END")} AS food_g, CASE WHEN msg = 'ANNOUNCE_MEAL' AND rk > 1 THEN '0' ELSE msg END AS msg_type FROM r""")
def mea3(t: Tables):
    src = meals(t).select("p_num", "datetime", "event_id", "bg_mM", "msg_type", "food_g")
    out = Me.meal_identification(src, 2, STEP, 4 * 3600, 20, STEP, 1, ("event_id",))
    return out.select("p_num", epoch(), r("bg_mM").alias("bg_mM"), r("food_g").alias("food_g"), "msg_type")
