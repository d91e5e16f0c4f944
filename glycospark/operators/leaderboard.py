"""Run tables, best runs and roll-ups.

Run tables have one row per evaluation run.  They are small next to the series but
are still handled as ordinary DataFrames, keyed by model and data set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .blocks import keep_last
from .metrics import array_rmse

# Fixed values of the study: data sets, metrics, covariate buckets, model classes.
DATASETS = ("aleppo_2017", "brown_2019", "lynch_2022", "tamborlane_2008")
METRICS = (
    "rmse", "wql", "sharpness_50", "coverage_50", "sharpness_80", "coverage_80",
    "brier_3_9", "dilate_g001", "shape_g001", "temporal_g001",
)
BUCKETS = ("zero_shot", "bg_only", "iob", "iob_cob")
UNIVERSAL_BUCKETS = ("zero_shot", "bg_only")
NATIVE_BUCKETS = {"aleppo_2017": ("iob_cob",), "brown_2019": ("iob",), "lynch_2022": ("iob",), "tamborlane_2008": ()}
IMPLIED_BUCKETS = {"iob_cob": ("iob_cob", "iob"), "iob": ("iob",)}
TIME_COVARIATES = ("hour_sin", "hour_cos", "minute_sin", "minute_cos", "day_sin", "day_cos")
CARB_COVARIATES = ("cob", "carb_availability", "carbs")
INSULIN_COVARIATES = ("iob", "ia", "insulin_availability")
CLASS_ORDER = ("naive", "statistical", "deep_learning", "foundation")
# model: class, zero-shot capable, fine-tunable, past covariates, univariate only, probabilistic
MODELS = {
    "naive_baseline/Naive": ("naive", False, True, False, True, False),
    "naive_baseline/Average": ("naive", False, True, False, True, False),
    "statistical/AutoARIMA": ("statistical", False, True, False, True, True),
    "statistical/Theta": ("statistical", False, True, False, True, False),
    "statistical/NPTS": ("statistical", False, True, False, True, True),
    "deepar": ("deep_learning", False, True, False, False, True),
    "tft": ("deep_learning", False, True, True, False, True),
    "patchtst": ("deep_learning", False, True, False, True, False),
    "tide": ("deep_learning", False, True, False, False, False),
    "tsmixer": ("deep_learning", False, True, True, False, True),
    "timegrad": ("deep_learning", False, True, False, True, True),
    "chronos2": ("foundation", True, True, True, False, True),
    "moirai": ("foundation", True, True, True, False, True),
    "toto": ("foundation", True, True, True, False, True),
    "timesfm": ("foundation", True, True, False, True, True),
    "ttm": ("foundation", True, True, True, False, False),
    "sundial": ("foundation", True, False, False, True, True),
    "moment": ("foundation", True, True, True, False, False),
}
RUN_KEYS = ("model", "dataset", "mode", "checkpoint", "ctx_fh")
WHITELIST = tuple(METRICS) + ("mace", "mean_discontinuity", "mae", "mape")


def model_properties(spark: SparkSession) -> DataFrame:
    """The model dimension (LDB7)."""
    schema = (
        "model string, model_class string, zero_shot_capable boolean, fine_tunable boolean, "
        "supports_past_covariates boolean, univariate_only boolean, probabilistic boolean"
    )
    return spark.createDataFrame([(k, *v) for k, v in MODELS.items()], schema)


def parent(model: Column) -> Column:
    return F.split(model, "/")[0]


def attach_properties(runs: DataFrame, props: DataFrame) -> DataFrame:
    """Class and covariate support by model name, else by its parent's name (LDB7)."""
    own = props.select("model", F.col("model_class").alias("_c"), F.col("supports_past_covariates").alias("_s"))
    up = props.select(
        F.col("model").alias("_parent"), F.col("model_class").alias("_pc"), F.col("supports_past_covariates").alias("_ps")
    )
    out = runs.join(own, "model", "left").withColumn("_parent", parent(F.col("model"))).join(up, "_parent", "left")
    return out.withColumn("model_class", F.coalesce("_c", "_pc", F.lit("deep_learning"))).withColumn(
        "supports_past_covariates", F.coalesce("_s", "_ps", F.lit(False))
    ).drop("_parent", "_c", "_s", "_pc", "_ps")


def summarise(runs: DataFrame, metric: str = "rmse") -> DataFrame:
    """Run table in leaderboard order (LDB1)."""
    return runs.orderBy("model", "dataset", F.asc_nulls_last(metric))


def latest_runs(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, tie: Sequence[str] = ("run_id",)) -> DataFrame:
    """Latest run per key, NULL keys as '' (LDB2)."""
    filled = runs.fillna("", [k for k in keys if k in runs.columns])
    order = F.struct(F.col("timestamp").isNotNull(), "timestamp", *tie)
    return keep_last(filled, list(keys), order)


def covariate_bucket(mode: Column, cols: Column) -> Column:
    """Bucket of a run from its mode and covariate list (LDB3)."""
    lower = F.transform(F.coalesce(cols, F.array().cast("array<string>")), lambda c: F.lower(c))
    rest = F.array_except(lower, F.array(*map(F.lit, TIME_COVARIATES)))
    carb = F.arrays_overlap(rest, F.array(*map(F.lit, CARB_COVARIATES)))
    insulin = F.arrays_overlap(rest, F.array(*map(F.lit, INSULIN_COVARIATES)))
    return F.when(mode == "zeroshot", "zero_shot").when(insulin & carb, "iob_cob").when(insulin, "iob").otherwise("bg_only")


def covariate_variant(cols: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(cols), ","), F.lit(""))


def attach_buckets(runs: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Bucket and variant, from the run's own list or its config (LDB3)."""
    out = runs if configs is None else runs.join(configs.select("run_path", "covariate_cols"), "run_path", "left")
    return out.withColumn("cov_bucket", covariate_bucket(F.col("mode"), F.col("covariate_cols"))).withColumn(
        "cov_variant", covariate_variant(F.col("covariate_cols"))
    ).drop("covariate_cols")


def attach_config_dir(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Holdout-config folder of each run from its config file (LDB4)."""
    return runs.join(configs.select("run_path", "config_dir"), "run_path", "left")


def filter_config_dir(runs: DataFrame, config_dir: str) -> DataFrame:
    return runs.where(F.col("config_dir") == config_dir)


def pick_best(
    runs: DataFrame,
    groups: Sequence[str] = ("model", "dataset", "cov_bucket"),
    tie: Sequence[str] = ("run_id",),
    column_wise: bool = True,
) -> DataFrame:
    """Best run per group: rmse, then wql, then the newest (TOP2).

    ``column_wise`` gives each column its first known value in that order;
    otherwise the best run's own row is returned.
    """
    clean = runs.where(F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    wql_missing = F.col("wql").isNull() | F.isnan("wql")
    newest = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    order = F.struct(
        F.col("rmse"), wql_missing, F.when(~wql_missing, F.col("wql")), newest.isNull(), newest, *[F.col(t) for t in tie]
    )
    rest = [c for c in runs.columns if c not in groups]
    if column_wise:
        known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) if dict(runs.dtypes)[c] in ("double", "float") else F.col(c).isNotNull()
        return clean.groupBy(*groups).agg(*[F.min_by(c, F.when(known(c), order)).alias(c) for c in rest]).select(*runs.columns)
    best = clean.groupBy(*groups).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in groups else F.col(f"_r.`{c}`").alias(c) for c in runs.columns])


def best_by_metric(runs: DataFrame, groups: Sequence[str], metric: str = "rmse", tie: Sequence[str] = ("run_id",)) -> DataFrame:
    """Arg-min run per group; groups without the metric drop out (TOP3, TOP6)."""
    if metric not in WHITELIST:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(WHITELIST)}")
    known = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    rest = [c for c in runs.columns if c not in groups]
    best = known.groupBy(*groups).agg(F.min_by(F.struct(*rest), F.struct(metric, *tie)).alias("_r"))
    return best.select(*[F.col(c) if c in groups else F.col(f"_r.`{c}`").alias(c) for c in runs.columns])


def best_and_worst(episodes: DataFrame, k: int, metric: str = "rmse", tie: str = "episode_id") -> DataFrame:
    """The k best and k worst episodes (TOP4)."""
    known = episodes.where(F.col(metric).isNotNull())
    best = known.orderBy(F.col(metric), tie).limit(k).withColumn("rank_group", F.lit("best"))
    worst = known.orderBy(F.col(metric).desc(), tie).limit(k).withColumn("rank_group", F.lit("worst"))
    return best.unionByName(worst)


def percentile_episode(episodes: DataFrame, pct: float, by: str = "p_num", metric: str = "rmse", tie: str = "episode_id") -> DataFrame:
    """The episode at an rmse percentile of each patient (TOP5); daily episodes are few per patient."""
    w = Window.partitionBy(by).orderBy(metric, tie)
    n = F.count("*").over(Window.partitionBy(by))
    at = F.rint(F.lit(pct / 100) * (F.col("_n") - 1)).cast("int")
    ranked = episodes.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", n)
    return ranked.where(F.col("_rn") == at).drop("_rn", "_n")


def best_from_forecasts(
    forecasts: DataFrame, by: Sequence[str], run: str = "run", exclude: DataFrame | None = None
) -> DataFrame:
    """Best run re-derived from its stored forecasts (TOP7)."""
    pool = forecasts if exclude is None else forecasts.join(exclude, run, "left_anti")
    scores = pool.groupBy(*by, run).agg(F.sqrt(F.avg(F.pow(F.col("forecast") - F.col("actual"), 2))).alias("rmse"))
    return scores.groupBy(*by).agg(F.min_by(run, F.struct("rmse", run)).alias(run), F.min("rmse").alias("rmse"))


def best_available(runs: DataFrame, available: DataFrame, groups: Sequence[str], metric: str = "rmse") -> DataFrame:
    """Best run that has usable episode files; the next best otherwise (TOP8)."""
    return best_by_metric(runs.join(available, "run_id", "left_semi"), groups, metric)


def best_bucket(scores: DataFrame, groups: Sequence[str] = ("model", "dataset"), metric: str = "auroc") -> DataFrame:
    """Rows of the bucket with the best mean metric over splits (TOP9)."""
    means = scores.groupBy(*groups, "cov_bucket").agg(F.avg(metric).alias("_m")).where(F.col("_m").isNotNull())
    top = means.groupBy(*groups).agg(F.min_by("cov_bucket", F.struct(-F.col("_m"), "cov_bucket")).alias("cov_bucket"))
    return scores.join(top, [*groups, "cov_bucket"], "left_semi")


def pivot_wide(best: DataFrame, datasets: Sequence[str] = DATASETS, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(class, model, bucket) by data set and metric, in fixed order (LDB5)."""
    order = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("model_class"))
    bucket = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("cov_bucket"))
    keep = best.where(F.col("dataset").isin(*datasets) & F.col("cov_bucket").isin(*BUCKETS))
    aggs = [F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d}__{m}") for d in datasets for m in metrics]
    return keep.groupBy("model_class", "model", "cov_bucket").agg(*aggs).orderBy(order, "model", bucket)


def valid_buckets(spark: SparkSession, native: Mapping[str, Sequence[str]] = NATIVE_BUCKETS) -> DataFrame:
    """(data set, covariate bucket) pairs that make sense, with the implied ones."""
    rows = sorted({(d, i) for d, bs in native.items() for b in bs for i in IMPLIED_BUCKETS.get(b, (b,))})
    return spark.createDataFrame(rows, "dataset string, cov_bucket string")


def expected_combinations(props: DataFrame, valid: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    """All (model, data set, bucket) that should have a run (SET4).

    Each model opens its buckets per data set; covariate buckets come from an equi
    join on the data set.
    """
    base = F.array_compact(
        F.array(F.when(F.col("zero_shot_capable"), F.lit("zero_shot")), F.when(F.col("fine_tunable"), F.lit("bg_only")))
    )
    per_set = props.withColumn("dataset", F.explode(F.array(*map(F.lit, datasets))))
    plain = per_set.select("model", "dataset", F.explode(base).alias("cov_bucket"))
    cov = per_set.where(F.col("fine_tunable") & F.col("supports_past_covariates")).join(valid, "dataset")
    return plain.unionByName(cov.select("model", "dataset", "cov_bucket")).distinct()


def missing_combinations(expected: DataFrame, best: DataFrame) -> DataFrame:
    """Expected combinations without a run (JOIN14)."""
    keys = ["model", "dataset", "cov_bucket"]
    return expected.join(best.select(*keys).distinct(), keys, "left_anti")


def misplaced_combinations(best: DataFrame, valid: DataFrame) -> DataFrame:
    """Covariate runs on data sets that lack the covariate (LDB6)."""
    return best.where(~F.col("cov_bucket").isin(*UNIVERSAL_BUCKETS)).join(valid, ["dataset", "cov_bucket"], "left_anti")


def grand_summary(
    runs: DataFrame,
    props: DataFrame,
    valid: DataFrame,
    configs: DataFrame | None = None,
    forecast_length: int | None = 96,
    ctx: int | None = None,
    datasets: Sequence[str] = DATASETS,
    metrics: Sequence[str] = METRICS,
) -> dict[str, DataFrame]:
    """The six tables of the leaderboard (LDB8)."""
    pool = runs
    if forecast_length is not None:
        pool = pool.where(F.col("forecast_length") == forecast_length)
    if ctx is not None:
        pool = pool.where(F.col("ctx_fh").startswith(f"{ctx}ctx_"))
    pool = pool.join(props.select("model"), "model", "left_semi")
    bucketed = attach_buckets(latest_runs(pool), configs)
    best = pick_best(bucketed)
    classed = attach_properties(best, props)
    expected = expected_combinations(props, valid, datasets)
    return {
        "results_wide": pivot_wide(classed, datasets, metrics),
        "best_runs_long": best,
        "missing_combinations": missing_combinations(expected, best),
        "misplaced_combinations": misplaced_combinations(classed, valid),
        "model_properties": props,
        "all_runs_bucketed": bucketed,
    }


def step_sweep(runs: DataFrame, labels: Mapping[str, str], final_step: int) -> DataFrame:
    """Training step and series label of each run from its checkpoint path (LDB10).

    Without a step number it is 0 for a zero-shot run and the final step otherwise.
    """
    found = F.regexp_extract(F.coalesce("checkpoint", F.lit("")), r"step_(\d+)", 1)
    step = F.when(found != "", found.cast("int")).when(F.col("mode") == "zeroshot", 0).otherwise(final_step)
    label = F.lit("other")
    for fragment, name in reversed(list(labels.items())):
        label = F.when(F.col("checkpoint").contains(fragment), name).otherwise(label)
    return runs.withColumn("train_step", step).withColumn("series", label)


def sweep_table(runs: DataFrame, labels: Mapping[str, str], final_step: int, keys: Sequence[str] = ("dataset",), order: Sequence[str] = ("timestamp", "run_id")) -> DataFrame:
    """One run per training step, series and data set, zero-shot runs as step 0 of every series (LDB10).

    Of several runs the latest by ``order`` stays.
    """
    swept = step_sweep(runs, labels, final_step)
    every = F.array(*[F.lit(name) for name in dict.fromkeys(labels.values())])
    zero = F.col("mode").eqNullSafe("zeroshot")
    spread = swept.withColumn("series", F.explode(F.when(zero, every).otherwise(F.array("series"))))
    spread = spread.withColumn("train_step", F.when(zero, 0).otherwise(F.col("train_step")))
    return keep_last(spread, ["train_step", "series", *keys], F.struct(*order))


def episode_rmse(episodes: DataFrame, pred: str = "pred", actual: str = "target") -> DataFrame:
    return episodes.withColumn("rmse", array_rmse(F.col(pred), F.col(actual)))
