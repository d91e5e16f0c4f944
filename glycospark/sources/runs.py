"""Readers for run folders, run summaries and stored forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.leaderboard import covariate_bucket
from ..schema import CONFIG_JSON, NOCTURNAL_JSON, NOCTURNAL_METRICS, RUN_METRICS, RUN_SUMMARY, STANDARD_JSON

# File names of a run folder.
NOCTURNAL_FILES = ("results_summary.json", "nocturnal_results.json")
STANDARD_FILE = "results.json"
CONFIG_FILE = "experiment_config.json"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def run_summaries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Run tables of several CSV files with their source file (SRC12).

    Missing paths are skipped; with none left it is an error.
    """
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of the summary files exists: {list(paths)}")
    df = spark.read.csv(found, schema=RUN_SUMMARY, header=True)
    return df.withColumn("source_summary", F.col("_metadata.file_path")).withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))


def _path_part(path: Column, from_end: int) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -from_end), "^[^=]*=", "")


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Whole files of one name below ``type/ctx_fh/model/run`` with the path keys.

    Folders whose name starts with ``_`` are reserved and left out.  Folder names of
    the form ``key=value`` count as their value.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    out = raw.withColumn("_path", F.col("_metadata.file_path"))
    keys = {"run_id": 2, "model_dir": 3, "ctx_fh": 4, "experiment_type": 5}
    out = out.withColumns({k: _path_part(F.col("_path"), n) for k, n in keys.items()})
    out = out.withColumn("run_path", F.regexp_replace("_path", r"/[^/]*$", "")).drop("_path")
    return out.where(~F.col("ctx_fh").startswith("_"))


def _run_files(spark: SparkSession, root: str, schema, name: str) -> DataFrame:
    """The files parsed with a fixed schema; malformed ones are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = _files(spark, root, name).withColumn("_j", F.from_json("value", schema, options)).drop("value")
    good = parsed.where(F.col("_j").isNotNull() & F.col("_j._corrupt").isNull())
    return good.select("*", *[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields if f.name != "_corrupt"]).drop("_j")


def run_directories(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Keys of all run folders that hold a file of this name (SRC13)."""
    keys = ["experiment_type", "ctx_fh", "model_dir", "run_id", "run_path"]
    return _files(spark, root, name).select(*keys).distinct()


def run_configs(spark: SparkSession, root: str, name: str = CONFIG_FILE) -> DataFrame:
    """Covariates and holdout folder from the config of each run (LDB3, LDB4)."""
    cfg = _run_files(spark, root, CONFIG_JSON, name)
    cols = F.coalesce("cli_args.covariate_cols", "model_config.covariate_cols", F.array().cast("array<string>"))
    return cfg.select(
        "run_path", cols.alias("covariate_cols"), F.col("cli_args.config_dir").alias("config_dir"),
        F.col("cli_args.checkpoint").alias("config_checkpoint"),
    )


def _with_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    joined = runs.join(configs, "run_path", "left")
    return joined.withColumn("checkpoint", F.coalesce("checkpoint", "config_checkpoint"))


def _episodes() -> Column:
    return F.coalesce(F.aggregate("per_patient", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["episodes"], F.lit(0))), F.lit(0))


def _mode() -> Column:
    return F.regexp_replace(F.lower(F.coalesce("mode", F.lit(""))), "-", "")


def _summary_columns(df: DataFrame) -> DataFrame:
    have = {**{m: F.lit(None).cast("double") for m in RUN_METRICS}, **{m: F.col(m) for m in RUN_METRICS if m in df.columns}}
    head = [F.col(f.name) if f.name not in RUN_METRICS else have[f.name].alias(f.name) for f in RUN_SUMMARY.fields]
    extra = [F.col("cov_bucket")] if "cov_bucket" in df.columns else []
    return df.select(*head, *extra)


def nocturnal_runs(
    spark: SparkSession, root: str, configs: DataFrame | None = None, names: Sequence[str] = NOCTURNAL_FILES
) -> DataFrame:
    """One typed row per nocturnal run (SRC14).

    Broken files, runs without an rmse and runs without episodes are left out.  The
    newer result file of a run wins over the older one.
    """
    parts = [_run_files(spark, root, NOCTURNAL_JSON, n).withColumn("_prio", F.lit(i)) for i, n in enumerate(names)]
    files = reduce(DataFrame.unionByName, parts)
    rest = [c for c in files.columns if c not in ("run_path", "_prio")]
    runs = files.groupBy("run_path").agg(F.min_by(F.struct(*rest), F.col("_prio")).alias("_r")).select("run_path", "_r.*")
    runs = runs.withColumn("mode", _mode()).withColumn("total_episodes", F.coalesce("total_episodes", _episodes()))
    runs = runs.where(F.col("overall_rmse").isNotNull() & ~F.isnan("overall_rmse") & (F.col("total_episodes") != 0))
    runs = _with_config(runs, run_configs(spark, root) if configs is None else configs)
    runs = runs.withColumn("cov_bucket", F.coalesce("cov_bucket", covariate_bucket(F.col("mode"), F.col("covariate_cols"))))
    runs = runs.withColumnsRenamed(NOCTURNAL_METRICS)
    runs = runs.withColumns({"context_length": F.col("config.context_length"), "forecast_length": F.col("config.forecast_length"),
                             "model": F.coalesce("model", "model_dir")})
    return _summary_columns(runs)


def standard_runs(spark: SparkSession, root: str, configs: DataFrame | None = None, name: str = STANDARD_FILE) -> DataFrame:
    """One typed row per sliding-window run (SRC15)."""
    runs = _run_files(spark, root, STANDARD_JSON, name).where(F.col("overall").isNotNull())
    runs = _with_config(runs, run_configs(spark, root) if configs is None else configs)
    runs = runs.withColumn("mode", _mode()).withColumn("total_episodes", _episodes()).drop("cov_bucket")
    runs = runs.withColumns({"context_length": F.col("config.context_length"), "forecast_length": F.col("config.forecast_length"),
                             "model": F.coalesce("model", "model_dir"),
                             **{m: F.col(f"overall.{m}") for m in ("rmse", "mae", "mape", "mse")}})
    return _summary_columns(runs)


def prediction_actual(df: DataFrame, pred: str = "pred", actual: str = "target_bg", episode: str = "episode_id") -> DataFrame:
    """Long forecasts from per-episode arrays (SRC16); episodes of unequal length drop out."""
    same = df.where(F.size(pred) == F.size(actual))
    pairs = F.arrays_zip(F.col(pred).alias("forecast"), F.col(actual).alias("actual"))
    rows = same.select(episode, F.posexplode(pairs).alias("_i", "_p"))
    return rows.select(episode, (F.col("_i") + 1).alias("step"), "_p.forecast", "_p.actual")


def quantile_tensor(df: DataFrame, levels: Sequence[float], tensor: str = "quantile_forecasts", actual: str = "actuals", episode: str = "episode_id") -> DataFrame:
    """Long quantile forecasts from nested arrays (SRC17); wrong shapes are an error."""
    bad = (F.size(tensor) != len(levels)) | F.exists(tensor, lambda row: F.size(row) != F.size(actual))
    message = F.concat(F.lit("quantile forecast of wrong shape: "), F.col(episode).cast("string"))
    checked = df.withColumn(tensor, F.when(bad, F.raise_error(message)).otherwise(F.col(tensor)))
    rows = checked.select(episode, actual, F.posexplode(tensor).alias("_q", "_row"))
    steps = rows.select(episode, actual, "_q", F.posexplode("_row").alias("_i", "forecast"))
    level = F.element_at(F.array(*[F.lit(float(q)) for q in levels]), F.col("_q") + 1)
    return steps.select(episode, (F.col("_i") + 1).alias("step"), level.alias("q"), "forecast",
                        F.element_at(actual, F.col("_i") + 1).alias("actual"))


def legacy_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Per-episode arrays of the older single result file (SRC16)."""
    schema = "per_episode array<struct<patient_id string, anchor string, pred array<double>, target_bg array<double>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.posexplode("per_episode").alias("_i", "_e"))
    return rows.select(F.col("_i").cast("string").alias("episode_id"), "_e.*")
