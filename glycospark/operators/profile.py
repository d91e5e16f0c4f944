"""Quality metrics, cohort tables and other summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefn import micros
from .blocks import Carry, Keys, exact_quantiles, scan, with_row
from .episodes import midnight_episodes

DAY = 86_400


def validation_table(
    df: DataFrame, demographics: Sequence[str] = (), generic_start: str | None = None, split: str | None = None
) -> DataFrame:
    """One validation row per patient (AGG5)."""
    v = F.col
    day = F.to_date("datetime")
    aggs = [
        F.count_distinct(day).alias("num_days"),
        F.count("*").alias("num_data_points"),
        F.min("datetime").alias("start_date"),
        F.max("datetime").alias("end_date"),
    ]
    if generic_start:
        start = F.lit(generic_start).cast("date")
        same_year = (F.min(F.year("datetime")) == F.year(start)) & (F.max(F.year("datetime")) == F.year(start))
        kind = F.when((F.min(day) == start) | same_year, "artificial").otherwise("real")
    else:
        kind = F.first(F.lit("real"))
    aggs.append(kind.alias("date_type"))
    for c in demographics:
        aggs.append(F.mode(F.col(c), True).alias(c))
    for c, name in (("bg_mM", "bg_mM"), ("food_g", "carbs_g"), ("dose_units", "insulin_units")):
        if c not in df.columns:
            continue
        low = F.min(c) if c == "bg_mM" else F.when(F.count(c) > 0, F.coalesce(F.min(F.when(v(c) > 0, v(c))), F.lit(0.0)))
        aggs += [F.avg(c).alias(f"avg_{name}"), low.alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    if split:
        aggs += [F.count_if(v(split) == "train").alias("train_rows"), F.count_if(v(split) == "validation").alias("validation_rows")]
    return df.groupBy("p_num").agg(*aggs)


def shape_summary(df: DataFrame, by: Sequence[str] = ("p_num",)) -> DataFrame:
    """Rows and columns per patient or instance (AGG6)."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def quality_metrics(df: DataFrame, low: float = 3.9, high: float = 10.0, keys: Keys = Keys()) -> DataFrame:
    """One row of quality metrics over the whole table (AGG7)."""
    bg = F.col("bg_mM")
    share = lambda cond: (F.avg(cond.cast("double")) * 100)
    main = df.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct("p_num").alias("unique_patients"),
        F.count_if(bg.isNull()).alias("missing_glucose"),
        F.count_if(F.col("datetime").isNull()).alias("missing_datetime"),
        F.avg(bg).alias("glucose_mean"), F.stddev_samp(bg).alias("glucose_std"),
        F.min(bg).alias("glucose_min"), F.max(bg).alias("glucose_max"),
        share(bg.between(low, high)).alias("time_in_range"),
        share(bg < low).alias("time_below_range"),
        share(bg > high).alias("time_above_range"),
    )
    per = df.groupBy("p_num").agg(F.count(bg).alias("_n")).agg(
        F.avg("_n").alias("mean_readings_per_patient"), F.stddev_samp("_n").alias("std_readings_per_patient"),
        F.min("_n").alias("min_readings_per_patient"), F.max("_n").alias("max_readings_per_patient"),
    )
    gaps = intervals(df, keys)
    mean = gaps.agg(F.avg("interval_mins").alias("mean_interval_minutes"))
    median = exact_quantiles(gaps, [], "interval_mins", {"median_interval_minutes": 0.5})
    out = with_row(with_row(with_row(main, per, "_p"), mean, "_m"), median, "_d")
    return out.select(*main.columns, "_p.*", "_m.*", "_d.*")


def intervals(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Minutes since the previous row of the same patient."""
    now = micros(F.col(keys.time))
    lagged = scan(df.select(*keys.by, keys.time, *keys.tie), keys, _p=Carry("prev", now))
    return lagged.where(F.col("_p").isNotNull()).select(*keys.by, ((now - F.col("_p")) / 60_000_000).alias("interval_mins"))


def insulin_presence(df: DataFrame, dose: str = "dose_units", rate: str = "rate") -> DataFrame:
    """Patients with any insulin and patients with CGM only (AGG8)."""
    any_insulin = F.bool_or((F.coalesce(F.col(dose), F.lit(0.0)) > 0) | (F.coalesce(F.col(rate), F.lit(0.0)) > 0))
    per = df.groupBy("p_num").agg(F.count("*").alias("_n"), any_insulin.alias("_i"))
    return per.agg(
        F.sum("_n").alias("total_rows"), F.count("*").alias("n_patients"),
        F.count_if("_i").alias("patients_with_insulin"), F.count_if(~F.col("_i")).alias("patients_cgm_only"),
    )


def cohort_summary(
    df: DataFrame, cohort: str, ctx: int, fh: int, step: int, threshold: float = 3.9, max_gap: int = 11, order: Column | None = None,
    gridded: bool = False,
) -> DataFrame:
    """Rows, readings and midnight episodes per cohort (AGG9, AGG10).

    Episodes are cut once for all cohorts: the cohort is part of the series key.
    """
    base = df.groupBy(cohort).agg(
        F.count_distinct("p_num").alias("n_patients"), F.count("bg_mM").alias("n_rows"),
        F.avg("bg_mM").alias("mean_bg"), F.stddev_samp("bg_mM").alias("std_bg"),
    )
    series = df.withColumn("p_num", F.struct("p_num", F.col(cohort).alias("c")))
    eps = midnight_episodes(series, ctx, fh, step, "bg_mM", (), max_gap, order, gridded).where("usable")
    low = F.array_min("target")
    per = eps.withColumn("_min", low).groupBy(F.col("p_num.c").alias(cohort)).agg(
        F.count("*").alias("n_episodes"), F.count_if(F.col("_min") < threshold).alias("n_episodes_with_hypo"),
        F.avg("_min").alias("mean_min_bg"),
    )
    out = base.join(per, cohort, "left").fillna(0, ["n_episodes", "n_episodes_with_hypo"])
    return out.withColumn("hypo_rate", F.when(F.col("n_episodes") > 0, F.col("n_episodes_with_hypo") / F.col("n_episodes")))


def dataset_share(df: DataFrame, source: str = "source_dataset") -> DataFrame:
    """Rows, share and patients per source (AGG11)."""
    counts = df.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_distinct("p_num").alias("n_patients"))
    return counts.withColumn("pct", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()) * 100)


def column_matrix(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Known values of each column per data set, and whether all data sets have it (AGG12).

    One pass over each data set; a column a data set lacks counts 0.
    """
    names = list(frames)
    parts = []
    for name, df in frames.items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])
        parts.append(counts.select(F.explode(pairs).alias("_p")).select("_p.*", F.lit(name).alias("dataset")))
    long = reduce(DataFrame.unionByName, parts)
    wide = long.groupBy("column").agg(
        *[F.coalesce(F.sum(F.when(F.col("dataset") == n, F.col("n"))), F.lit(0)).alias(n) for n in names],
        (F.count("*") == len(names)).alias("in_final"),
    )
    return wide


def histogram(df: DataFrame, by: Sequence[str], col: str = "bg_mM", low: float = 2, high: float = 22, bins: int = 40,
              hypo: float = 3.9, hyper: float = 10.0) -> DataFrame:
    """Fixed-width histogram with hypo and hyper bands (AGG14)."""
    b = F.width_bucket(F.col(col), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    b = F.when(F.col(col) == high, F.lit(bins)).otherwise(b)
    band = F.when(F.col(col) < hypo, "hypo").when(F.col(col) > hyper, "hyper").otherwise("in_range")
    inside = df.where(F.col(col).between(low, high))
    counts = inside.groupBy(*by, b.cast("int").alias("bin"), band.alias("band")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col("n") / total)


def theoretical_midnights(df: DataFrame, ctx: int, fh: int, step: int) -> DataFrame:
    """Calendar midnights with room for a whole window, per patient (AGG15)."""
    t = micros(F.col("datetime"))
    us = step * 1_000_000
    day = DAY * 1_000_000
    b = df.groupBy("p_num").agg((F.min(t) + F.lit(ctx * us)).alias("_e"), (F.max(t) - F.lit((fh - 1) * us)).alias("_l"))
    first, last = F.ceil(F.col("_e") / day), F.floor(F.col("_l") / day)
    return b.select("p_num", F.greatest(F.lit(0), last - first + 1).cast("long").alias("n_theoretical"))


def gap_sensitivity(df: DataFrame, ctx: int, fh: int, step: int, caps: Sequence[int], order: Column | None = None) -> DataFrame:
    """Theoretical midnights against usable episodes under each gap cap (AGG15)."""
    out = theoretical_midnights(df, ctx, fh, step)
    for cap in caps:
        eps = midnight_episodes(df, ctx, fh, step, "bg_mM", (), cap, order).where("usable")
        out = out.join(eps.groupBy("p_num").agg(F.count("*").alias(f"n_cap_{cap}")), "p_num", "left")
    return out.fillna(0)


def holdout_characteristics(episodes: DataFrame, by: Sequence[str], threshold: float = 3.9) -> DataFrame:
    """Patients, episodes, hypo episodes and rate per split (AGG16)."""
    hypo = F.array_min("target") < threshold
    return episodes.withColumn("_h", hypo).groupBy(*by).agg(
        F.count_distinct("p_num").alias("n_patients"), F.count("*").alias("n_episodes"),
        F.count_if("_h").alias("n_hypo"), F.avg(F.col("_h").cast("double")).alias("hypo_rate"),
    )


def hourly_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean level per patient and hour (AGG17)."""
    return df.groupBy("p_num", F.hour("datetime").alias("hour")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def potential_nights(df: DataFrame, hours: int, min_rows: int) -> DataFrame:
    """Nights with enough readings in their first hours (AGG18)."""
    nights = df.where(F.hour("datetime") < hours).groupBy("p_num", F.to_date("datetime").alias("_d")).agg(F.count("*").alias("_n"))
    return nights.where(F.col("_n") >= min_rows).groupBy("p_num").agg(F.count("*").alias("n_nights"))


def outcome(tir: Column, glucose: Column, full: Column | None = None, mid: float = 125) -> Column:
    """Outcome class of a meal from its time in range and trend (AGG19)."""
    way = F.when(glucose < mid, "(Low)").otherwise("(High)")
    tier = F.when(tir >= 0.85, "TIR 85–100%").when(tir >= 0.70, "TIR 70–85%").otherwise("TIR <70%")
    text = F.concat_ws(" ", tier, way)
    return text if full is None else F.when(full, "TIR 100%").otherwise(text)


def outcome_tally(df: DataFrame, ratio: str, outcome_col: str, classes: Sequence[str], low: float, high: float, width: float) -> DataFrame:
    """Counts of outcome classes per ratio bin (AGG19)."""
    b = F.floor((F.col(ratio) - low) / width).cast("int")
    inside = df.where((F.col(ratio) >= low) & (F.col(ratio) < high))
    counts = [F.count_if(F.col(outcome_col) == c).alias(f"n_{i}") for i, c in enumerate(classes)]
    return inside.groupBy(b.alias("bin")).agg(*counts)


def time_feature_check(df: DataFrame) -> DataFrame:
    """NULLs, range, unit-circle identity and correlation with glucose (AGG20)."""
    s, c = F.col("hour_sin"), F.col("hour_cos")
    return df.agg(
        F.count_if(s.isNull()).alias("sin_nulls"), F.count_if(c.isNull()).alias("cos_nulls"),
        F.min(s).alias("sin_min"), F.max(s).alias("sin_max"), F.min(c).alias("cos_min"), F.max(c).alias("cos_max"),
        F.max(F.abs(s * s + c * c - 1)).alias("max_deviation"),
        F.corr(s, "bg_mM").alias("corr_sin"), F.corr(c, "bg_mM").alias("corr_cos"),
    )


def file_statistics(df: DataFrame, file: str = "file", col: str = "bg_mM", step_mins: int = 5) -> DataFrame:
    """Statistics per input file (AGG21)."""
    out = df.groupBy(file).agg(
        F.count("*").alias("total_readings"),
        F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"),
        F.avg(col).alias("glucose_mean"), F.stddev_samp(col).alias("glucose_std"),
        F.min(col).alias("glucose_min"), F.max(col).alias("glucose_max"),
        (F.count("*") * step_mins / 60 / 24).alias("estimated_days"),
    )
    return out.join(exact_quantiles(df, [file], col, {"glucose_median": 0.5}), file, "left")
