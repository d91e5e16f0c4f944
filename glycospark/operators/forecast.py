"""Forecasting over episode rows: user functions and two native baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.arrays import once
from .blocks import with_row

DEFAULT_LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("episode_id", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("q", T.DoubleType()),
        T.StructField("forecast", T.DoubleType()),
    ]
)


def predict_batch(
    episodes: DataFrame,
    model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    probabilistic: bool = False,
    supports_quantiles: bool = True,
    fitted: bool = True,
) -> DataFrame:
    """Run a user's batch forecaster over Arrow batches of episode rows (UDF1).

    ``model`` turns frames of (episode_id, context, ...) into long frames
    (episode_id, step, q, forecast); point forecasts use q = 0.5.
    """
    if not fitted:
        raise ValueError("the model has not been fitted")
    if probabilistic and not supports_quantiles:
        raise ValueError("the model gives no quantiles")
    return episodes.mapInPandas(model, FORECAST_SCHEMA)


def missing_forecasts(episodes: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Episodes for which the model returned nothing (JOIN9, UDF1)."""
    return episodes.select("episode_id").join(forecasts.select("episode_id").distinct(), "episode_id", "left_anti")


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda z, x: F.struct(
        (z["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (z["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n")
    ), lambda z: F.when(z["n"] > 0, z["s"] / z["n"]))


def array_quantile(ordered: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array without NULLs."""
    place = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    a = F.try_element_at(ordered, low + 1)
    b = F.try_element_at(ordered, F.least(low + 2, F.size(ordered)))
    return a + (b - a) * (place - low)


def baseline(episodes: DataFrame, steps: int, kind: str = "Naive", context: str = "context") -> DataFrame:
    """Last value or mean of the context over all steps, as expressions (UDF2)."""
    known = F.array_compact(F.col(context))
    value = {"Naive": F.element_at(known, -1), "Average": _mean(known)}[kind]
    ahead = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return episodes.select("episode_id", value.alias("_v"), ahead).select(
        "episode_id", "step", F.lit(0.5).alias("q"), F.col("_v").alias("forecast")
    )


def baseline_quantiles(
    episodes: DataFrame, steps: int, levels: Sequence[float] = DEFAULT_LEVELS, context: str = "context"
) -> DataFrame:
    """Empirical quantiles of the context as the predictive distribution (UDF2)."""
    ordered = F.array_sort(F.array_compact(F.col(context)))
    knots = F.array(*[F.struct(F.lit(q).alias("q"), array_quantile(F.col("_o"), q).alias("forecast")) for q in levels])
    ahead = F.sequence(F.lit(1), F.lit(steps))
    rows = episodes.withColumn("_o", ordered).select("episode_id", knots.alias("_k"))
    rows = rows.select("episode_id", F.explode("_k").alias("_k"))
    return rows.withColumn("step", F.explode(ahead)).select("episode_id", "step", "_k.q", "_k.forecast")


def predict_arrays(episodes: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], out: str = "values") -> DataFrame:
    """Run a user's batch forecaster that keeps the episode row (UDF1).

    ``model`` turns frames of episode rows into the same rows with a column ``out``: for
    each step a list with one value per level, or None where it gives no forecast.
    """
    schema = T.StructType([*episodes.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
    return episodes.mapInPandas(model, schema)


def baseline_arrays(
    episodes: DataFrame, steps: int, levels: Sequence[float] = DEFAULT_LEVELS, context: str = "context", out: str = "values"
) -> DataFrame:
    """:func:`baseline_quantiles` within the episode row: per step one value for each level (UDF2)."""
    ordered = F.array_sort(F.array_compact(F.col(context)))
    knots = lambda o: F.when(F.size(o) > 0, F.array_repeat(F.array(*[array_quantile(o, q) for q in levels]), steps))
    return episodes.withColumn(out, once(ordered, knots))


def arrays_of(episodes: DataFrame, forecasts: DataFrame, levels: Sequence[float], out: str = "values") -> DataFrame:
    """Long forecasts (episode_id, step, q, forecast) gathered into the episode rows, by one aggregate and one join.

    A step without a row at some level has null there; an episode without forecasts has a null ``out``.
    """
    at = [F.max(F.when(F.abs(F.col("q") - q) < 1e-9, F.col("forecast"))) for q in levels]
    steps = forecasts.groupBy("episode_id", "step").agg(F.array(*at).alias("_v"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("step", "_v"))), lambda x: x["_v"])
    return episodes.join(steps.groupBy("episode_id").agg(packed.alias(out)), "episode_id", "left")


def actuals(episodes: DataFrame, target: str = "target") -> DataFrame:
    """(episode, step, actual) from the target arrays."""
    rows = episodes.select("episode_id", F.posexplode(target).alias("_i", "actual"))
    return rows.select("episode_id", (F.col("_i") + 1).alias("step"), "actual")


def pair(forecasts: DataFrame, truth: DataFrame, on: Sequence[str] = ("episode_id", "step")) -> DataFrame:
    """Forecasts met by their actual values; unmatched episodes drop out (JOIN9)."""
    return forecasts.join(truth, list(on))


def check_forecasts(forecasts: DataFrame, by: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Validity per episode (PRJ21): ``empty``, ``all_bad``, ``some_bad`` or ``ok``."""
    bad = F.col("forecast").isNull() | F.isnan("forecast") | (F.abs(F.col("forecast")) == float("inf"))
    out = forecasts.groupBy(*by).agg(F.count("*").alias("n_values"), F.count_if(bad).alias("n_bad"))
    state = F.when(F.col("n_bad") == F.col("n_values"), "all_bad").when(F.col("n_bad") > 0, "some_bad").otherwise("ok")
    return out.withColumn("state", state)


#: Rows of a patient that a transformer gets in one frame, unless the caller says otherwise.
GROUP_ROWS = 2_000_000


def apply_per_patient(
    df: DataFrame,
    transform: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    by: Sequence[str] = ("p_num",),
    block_seconds: int | None = None,
    time: str = "datetime",
    most_rows: int = GROUP_ROWS,
) -> DataFrame:
    """A user's transformer on every patient (UDF3).

    With ``block_seconds`` it runs per patient and time block, which bounds the group.
    Transformers that need the whole series leave it out; then a patient must not have more
    than ``most_rows`` rows, which one aggregate checks before any row reaches Python.
    Groups may be many and small: they reach Python in Arrow batches, not one by one.
    """
    if block_seconds:
        block = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / block_seconds)
        return _apply_in_batches(df, [*by, block], transform, schema)
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    if largest and largest["n"] > most_rows:
        raise ValueError(f"{dict(zip(by, largest))} has {largest['n']} rows, more than {most_rows} for one frame: give block_seconds, or fit by an aggregate (fit_patients)")
    return _apply_in_batches(df, list(by), transform, schema)


#: Rows of results that are put together before they go back.
_RESULT_ROWS = 10_000


def _apply_in_batches(df: DataFrame, by: Sequence[str | Column], transform: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``df.groupBy(*by).applyInPandas(transform, schema)`` for many small groups.

    A window puts the groups behind each other and marks their first rows; batches are cut
    there, and a group that goes on in the next batch waits for its rest.  Whole numbers and
    truth values turn into others in pandas where a batch holds a NULL, so they are sent
    without NULLs as well, for the groups that have none.
    """
    keys = {f"_by_{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(by)}
    plain = {f.name: f"_plain_{i}" for i, f in enumerate(df.schema.fields) if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    filled = {out: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c, out in plain.items()}
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1
    columns = df.columns
    marked = df.withColumns({**keys, **filled}).withColumn("_first", first).drop(*keys)

    def frame(rows: pd.DataFrame, whole: dict[str, np.ndarray]) -> pd.DataFrame:
        out = rows.copy()
        out.index = pd.RangeIndex(len(out))
        for c, values in whole.items():
            if not out[c].isna().any():
                out[c] = values
        return out

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
        """The groups, and None at the end of a batch."""
        open_: list[pd.DataFrame] = []  # parts of the group that may go on

        def joined() -> pd.DataFrame:
            rows = pd.concat(open_) if len(open_) > 1 else open_[0]
            return frame(rows[columns], {c: rows[p].to_numpy() for c, p in plain.items() if rows[c].dtype != rows[p].dtype})

        for batch in batches:
            at = [*np.flatnonzero(batch["_first"].to_numpy()).tolist(), len(batch)]
            if at[0] > 0:
                open_.append(batch.iloc[: at[0]])
            if len(at) == 1:
                continue
            if open_:
                yield joined()
            data = batch[columns]
            whole = {c: batch[p].to_numpy() for c, p in plain.items() if data[c].dtype != batch[p].dtype}
            for a, b in zip(at[:-2], at[1:-1]):
                yield frame(data.iloc[a:b], {c: v[a:b] for c, v in whole.items()})
            open_ = [batch.iloc[at[-2] :]]
            yield None
        if open_:
            yield joined()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[pd.DataFrame] = []
        like, n = None, 0
        for group in groups(batches):
            result = None if group is None else transform(group)
            if result is not None and not isinstance(result, pd.DataFrame):
                raise TypeError(f"the transformer gave {type(result).__name__}, not a DataFrame")
            kind = like if result is None else [(c, result[c].dtype) for c in result.columns]
            # frames of other types would change each other's values
            if ready and (result is None or kind != like or n >= _RESULT_ROWS):
                yield pd.concat(ready, ignore_index=True)
                ready, n = [], 0
            if result is not None and len(result):
                ready.append(result)
                like, n = kind, n + len(result)
        if ready:
            yield pd.concat(ready, ignore_index=True)

    return marked.mapInPandas(run, schema)


def fit_patients(df: DataFrame, col: str, by: str = "p_num") -> DataFrame:
    """Fitted mean and deviation per patient, and over all as the fallback (UDF3)."""
    return df.groupBy(by).agg(F.avg(col).alias("fit_mean"), F.stddev_pop(col).alias("fit_std"))


def transform_with_fallback(df: DataFrame, fitted: DataFrame, pooled: DataFrame, col: str, by: str = "p_num") -> DataFrame:
    """Scale with the patient's fit; patients not seen in fitting use the pooled one (UDF3)."""
    joined = with_row(df.join(fitted, by, "left"), pooled, "_all")
    mean = F.coalesce("fit_mean", F.col("_all.fit_mean"))
    std = F.coalesce("fit_std", F.col("_all.fit_std"))
    return joined.withColumn("scaled", (F.col(col) - mean) / std).withColumn("seen", F.col("fit_mean").isNotNull()).drop(
        "fit_mean", "fit_std", "_all"
    )
