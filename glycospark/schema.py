"""Canonical column names and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

P_NUM, DATETIME, BG = "p_num", "datetime", "bg_mM"
MSG, FOOD, DOSE, RATE = "msg_type", "food_g", "dose_units", "rate"
BASAL_MINS, HR, STEPS, CALS = "basal_duration_mins", "hr_bpm", "steps", "cals"
COB, CARB_AVAIL, IOB, INS_AVAIL = "cob", "carb_availability", "iob", "insulin_availability"
HOUR_SIN, HOUR_COS = "hour_sin", "hour_cos"

MEAL = "ANNOUNCE_MEAL"
LOW_MEAL = "LOW_CARB_MEAL"

REQUIRED_COLUMNS = (P_NUM, DATETIME, BG)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_TS = T.TimestampNTZType()

SERIES = _struct(
    p_num=_S, datetime=_TS, bg_mM=_D, msg_type=_S, food_g=_D, dose_units=_D, rate=_D,
    basal_duration_mins=_D, hr_bpm=_D, steps=_D, cals=_D, activity=_S,
)

# Raw layouts. Everything that needs parsing is read as text first.
PUMP_CGM = _struct(PtID=_S, Period=_S, DataDtTm=_S, CGM=_D)
PUMP_BASAL = _struct(RecID=_S, PtID=_S, DataDtTm=_S, DataDtTm_adjusted=_S, CommandedBasalRate=_D)
PUMP_BOLUS = _struct(RecID=_S, PtID=_S, DataDtTm=_S, DataDtTm_adjusted=_S, BolusAmount=_D, BolusType=_S)
DEVICE_LOG = _struct(
    PtID=_S, DeviceDtTm=_S, CGMVal=_D, BasalDelivPrev=_D, BolusDelivPrev=_D,
    MealBolusDelivPrev=_D, MealSize=_S,
)
SCREENING = _struct(PtID=_S, DiagAge=_I, Sex=_S)
SENSOR_CSV = _struct(RecID=_S, PtID=_S, DeviceDate=_S, DeviceTime=_S, GlucoseValue=_D)
_DAY = dict(PtID=_S, DeviceDtTmDaysFromEnroll=_I, DeviceTm=_S)
DAY_OFFSET = {
    "bolus": _struct(**_DAY, BolusType=_S, Normal=_D, ExpectedNormal=_D, Extended=_D, ExpectedExtended=_D),
    "wizard": _struct(**_DAY, BgInput=_D, CarbInput=_D, InsulinOnBoard=_D, InsulinCarbRatio=_D, InsulinSensitivity=_D),
    "cgm": _struct(**_DAY, RecordType=_S, GlucoseValue=_D),
    "basal": _struct(**_DAY, BasalType=_S, Rate=_D, Duration=_D, SuprBasalType=_S, SuprRate=_D),
}
READINGS = _struct(gid=_S, date=_TS, bgl=_D, trend=_S, source=_S)
MESSAGES = _struct(
    id=_S, gid=_S, date=_TS, type=_S, food_g=_D, dose_units=_D, dose_type=_S, exercise_mins=_D,
    exercise_level=_S,
)
GROUPS = _struct(gid=_S, p_num=_S)

# One row per evaluation run, in file order.
RUN_METRICS = (
    "rmse", "mae", "mape", "mse", "wql", "brier_3_9", "mace",
    "coverage_50", "coverage_80", "coverage_90", "coverage_95",
    "sharpness_50", "sharpness_80", "sharpness_90", "sharpness_95",
    "dilate_g0001", "shape_g0001", "temporal_g0001", "dilate_g001", "shape_g001", "temporal_g001",
    "dilate_g01", "shape_g01", "temporal_g01",
)
RUN_SUMMARY = T.StructType(
    [T.StructField(n, _S) for n in (
        "run_id", "run_path", "checkpoint", "experiment_type", "ctx_fh", "model", "dataset", "mode", "timestamp")]
    + [T.StructField(n, _L) for n in ("context_length", "forecast_length")]
    + [T.StructField(n, _D) for n in RUN_METRICS]
    + [T.StructField("total_episodes", _L), T.StructField("git_commit", _S)]
)

_PER_PATIENT = T.ArrayType(_struct(patient_id=_S, episodes=_L))
_RUN_HEAD = [
    T.StructField("model", _S), T.StructField("dataset", _S), T.StructField("mode", _S), T.StructField("timestamp", _S),
    T.StructField("checkpoint", _S), T.StructField("cov_bucket", _S), T.StructField("git_commit", _S),
    T.StructField("config", _struct(context_length=_L, forecast_length=_L)),
    T.StructField("total_episodes", _L), T.StructField("per_patient", _PER_PATIENT),
]
# Result names of a nocturnal run and their column in the run table.
NOCTURNAL_METRICS = {("overall_brier" if m == "brier_3_9" else f"overall_{m}"): m for m in RUN_METRICS if m not in ("mae", "mape", "mse")}
NOCTURNAL_JSON = T.StructType([*_RUN_HEAD, *[T.StructField(n, _D) for n in NOCTURNAL_METRICS], T.StructField("_corrupt", _S)])
STANDARD_JSON = T.StructType(
    [*_RUN_HEAD, T.StructField("overall", _struct(rmse=_D, mae=_D, mape=_D, mse=_D)), T.StructField("_corrupt", _S)]
)
_COVS = T.ArrayType(_S)
CONFIG_JSON = T.StructType(
    [
        T.StructField("cli_args", _struct(covariate_cols=_COVS, config_dir=_S, dataset=_S, checkpoint=_S)),
        T.StructField("model_config", _struct(covariate_cols=_COVS)),
        T.StructField("_corrupt", _S),
    ]
)
