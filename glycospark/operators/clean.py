"""Projections, filters and cleaning of raw exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timefn import from_seconds, parse_flexible, second_of_day
from ..functions.units import clamp_sentinel, mg_dl_to_mmol_l, plausible, round_even
from ..schema import MEAL

DAY = 86_400

# Canonical names of the day-offset export and of the app export.
DAY_OFFSET_NAMES = {
    "pid": "p_num", "date": "datetime", "tableType": "msg_type", "bgMgdl": "bg_mM", "foodG": "food_g",
    "normalBolus": "dose_units", "basalDurationMins": "basal_duration_mins",
}
APP_NAMES = {"patient_id": "p_num", "bgl": "bg_mM", "date": "datetime"}
APP_NUMERIC = ("bg_mM", "food_g", "dose_units", "exercise_mins")

# Header synonyms of the sensor exports.
HEADER_SYNONYMS = {
    "PtID": "p_num", "PatientID": "p_num", "SubjectID": "p_num", "ParticipantID": "p_num", "ID": "p_num",
    "GlucoseValue": "bg_mg_dl", "Glucose": "bg_mg_dl", "GlucoseLevel": "bg_mg_dl", "CGM": "bg_mg_dl",
    "SensorGlucose": "bg_mg_dl", "Value": "bg_mg_dl", "BG": "bg_mg_dl",
    "DeviceDate": "date", "Date": "date",
    "DeviceTime": "time", "Time": "time",
    "DisplayTime": "display_time", "InternalTime": "internal_time",
    "RecID": "record_id", "RecordType": "record_type",
}

ROUNDED_COLUMNS = ("bg_mM", "food_g", "dose_units", "cob", "carb_availability", "iob", "insulin_availability")


def rename(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Canonical column names (PRJ1, PRJ3); names that are absent are skipped."""
    return df.drop(*drop).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def translate_day_offset(df: DataFrame) -> DataFrame:
    """Pump export to canonical names; readings in mmol/L (PRJ1)."""
    out = rename(df, DAY_OFFSET_NAMES, ("expectedNormalBolus", "expectedExtendedBolus", "suprBasalType", "suprRate"))
    return out.withColumn("bg_mM", mg_dl_to_mmol_l(F.col("bg_mM")))


def translate_app(df: DataFrame) -> DataFrame:
    """App export: names, numbers that do not parse become NULL, mmol/L (PRJ2)."""
    out = rename(df, APP_NAMES)
    for c in APP_NUMERIC:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.withColumn("bg_mM", mg_dl_to_mmol_l(F.col("bg_mM")))


def parse_stamps(df: DataFrame, adjusted: str | None, raw: str, out: str = "datetime") -> DataFrame:
    """The adjusted stamp where it parses, else the raw one (PRJ5)."""
    parts = ([parse_flexible(F.col(adjusted))] if adjusted and adjusted in df.columns else []) + [parse_flexible(F.col(raw))]
    return df.withColumn(out, F.coalesce(*parts))


def assemble_stamp(df: DataFrame, out: str = "datetime") -> DataFrame:
    """From date and time, else display time, else any date or time column (PRJ6)."""
    iso = lambda c: c.try_cast("timestamp_ntz")
    if {"date", "time"} <= set(df.columns):
        stamp = iso(F.concat_ws(" ", "date", "time"))
    elif "display_time" in df.columns:
        stamp = iso(F.col("display_time"))
    else:
        other = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
        if not other:
            raise ValueError(f"no date or time column among {df.columns}")
        stamp = iso(F.col(other[0]))
    return df.withColumn(out, stamp)


def offset_stamp(days: Column, clock: Column, base: str = "2020-01-01") -> Column:
    """Enrolment day offset plus time of day (PRJ7)."""
    start = F.unix_date(F.lit(base).cast("date"))
    return from_seconds((start + days).cast("long") * DAY + second_of_day(clock))


def suspend_rate(kind: Column, rate: Column) -> Column:
    """A suspended pump delivers nothing (PRJ14)."""
    return F.when(kind == "suspend", F.lit(0.0)).otherwise(rate)


def keep_overlap(df: DataFrame, kind: str = "msg_type", time: str = "datetime") -> DataFrame:
    """Rows inside the span shared by all record types of a patient (PRJ15).

    Bounds are one row per patient; a patient without a shared span drops out.
    """
    per_kind = df.groupBy("p_num", kind).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    bounds = per_kind.groupBy("p_num").agg(F.max("_a").alias("_lo"), F.min("_b").alias("_hi"))
    return df.join(bounds, "p_num").where(F.col(time).between(F.col("_lo"), F.col("_hi"))).select(*df.columns)


def reduce_precision(df: DataFrame, columns: Sequence[str] = ROUNDED_COLUMNS) -> DataFrame:
    """Two places, half to even (PRJ16)."""
    return df.withColumns({c: round_even(F.col(c), 2) for c in columns if c in df.columns})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming missing and available columns (PRJ17)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist (PRJ22)."""
    return df.select(*[c for c in wanted if c in df.columns])


def drop_implausible(df: DataFrame, col: str = "bg_mM", low: float = 1.1, high: float = 33.3) -> DataFrame:
    return df.where(plausible(F.col(col), low, high))


def implausible_counts(df: DataFrame, col: str = "bg_mM", low: float = 1.1, high: float = 33.3, by: Sequence[str] = ()) -> DataFrame:
    """Rows the filter removes, by reason (PRJ10)."""
    c = F.col(col)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(c.isNull()).alias("n_null"),
        F.count_if(c <= 0).alias("n_not_positive"),
        F.count_if((c > 0) & ~c.between(low, high)).alias("n_out_of_range"),
        F.count_if(plausible(c, low, high)).alias("n_kept"),
    )


def clean_device_log(df: DataFrame, divisor: float = 18.0) -> DataFrame:
    """Drop rows without stamp or reading, fill doses and food with 0, add constants (PRJ11)."""
    out = df.withColumn("bg_mM", clamp_sentinel(F.col("bg_mg_dl")) / F.lit(divisor)).dropna(subset=["datetime", "bg_mM"])
    out = out.fillna(0.0, [c for c in ("dose_units", "food_g") if c in out.columns])
    return out.withColumn("insulin_delivery", F.lit("closed_loop"))


def lag_columns(measures: Sequence[str], hours: int = 6, step: int = 5) -> list[str]:
    """Column names ``{measure}-{h}:{mm}`` from the longest lag to zero (SRC5)."""
    lags = range(hours * 60 - step, -1, -step)
    return [f"{m}-{x // 60}:{x % 60:02d}" for m in measures for x in lags]


def zero_lag(df: DataFrame, names: Mapping[str, str], keep: Sequence[str] = ("id", "p_num", "time")) -> DataFrame:
    """Only the zero-lag column of each measure, renamed; meal rows tagged (PRJ12)."""
    have = {f"{m}-0:00": new for m, new in names.items() if f"{m}-0:00" in df.columns}
    out = df.select(*[c for c in keep if c in df.columns], *[F.col(f"`{c}`").alias(n) for c, n in have.items()])
    if "food_g" in have.values():
        out = out.withColumn("msg_type", F.when(F.col("food_g").try_cast("double") != 0, MEAL).otherwise(""))
    return out


def unpivot_lags(df: DataFrame, measures: Sequence[str], keep: Sequence[str] = ("id", "p_num"), time_s: str = "second_of_day") -> DataFrame:
    """Wide lag columns to rows; each row's time is the instance's minus its lag (PRJ13).

    The unpivot is one array per input row, so nothing is shuffled.
    """
    pattern = "-"
    lags = sorted({c.split(pattern)[-1] for c in df.columns if pattern in c}, key=lambda x: -(int(x.split(":")[0]) * 60 + int(x.split(":")[1])))
    entries = [
        F.struct(
            F.lit(int(lag.split(":")[0]) * 3600 + int(lag.split(":")[1]) * 60).alias("lag_s"),
            *[(F.col(f"`{m}-{lag}`") if f"{m}-{lag}" in df.columns else F.lit(None).cast("double")).cast("double").alias(m) for m in measures],
        )
        for lag in lags
    ]
    rows = df.select(*keep, F.col(time_s).alias("_s"), F.explode(F.array(*entries)).alias("_e"))
    return rows.select(
        *keep, "_e.lag_s", F.pmod(F.col("_s") - F.col("_e.lag_s"), F.lit(DAY)).cast("long").alias("second_of_day"),
        *[F.col(f"_e.{m}").alias(m) for m in measures],
    )


def audit_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs, infinities and spread of each column, one row per column (PRJ20)."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        x = F.col(c)
        aggs += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"nulls_{c}"),
            F.count_if(F.abs(x) == float("inf")).alias(f"infs_{c}"),
            F.stddev_samp(x).alias(f"std_{c}"),
        ]
    one = df.agg(*aggs)
    entry = lambda c: F.struct(
        F.lit(c).alias("column"), F.col(f"nulls_{c}").alias("n_null"),
        (F.col(f"nulls_{c}") / F.col("n") * 100).alias("pct_null"), F.col(f"infs_{c}").alias("n_inf"),
        F.coalesce(F.col(f"std_{c}") == 0, F.lit(True)).alias("constant"),
    )
    return one.select(F.explode(F.array(*map(entry, columns))).alias("_e")).select("_e.*")


def combine_datasets(frames: Mapping[str, DataFrame], tag: str = "source_dataset") -> DataFrame:
    """Union of data sets on their common columns (SET3)."""
    common = [c for c in next(iter(frames.values())).columns if all(c in d.columns for d in frames.values())]
    if not common:
        raise ValueError("the data sets share no column")
    return reduce(DataFrame.unionByName, [d.select(*common).withColumn(tag, F.lit(n)) for n, d in frames.items()])


def same_resolution(df: DataFrame, interval_mins: int, columns: Sequence[str], keys=None) -> DataFrame:
    """Patients whose second stamp follows the first by the wanted interval (PRJ23).

    The two earliest stamps are an aggregate: the minimum, and the minimum above it.
    """
    t = F.unix_seconds(F.col("datetime").cast("timestamp"))
    first = df.groupBy("p_num").agg(F.min(t).alias("_1"))
    later = df.select("p_num", t.alias("_t")).join(first, "p_num").where(F.col("_t") > F.col("_1"))
    fit = later.groupBy("p_num").agg((F.min("_t") - F.min("_1")).alias("_d")).where(F.col("_d") == interval_mins * 60)
    return df.join(fit, "p_num", "left_semi").select("p_num", "datetime", *columns)
