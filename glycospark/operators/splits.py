"""Train, validation and holdout splits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefn import micros
from .blocks import Keys, hash_rank, number_rows, with_row

DAY = 86_400


@dataclass(frozen=True)
class TemporalHoldout:
    holdout_percentage: float = 0.2
    min_train_samples: int = 50
    min_holdout_samples: int = 10


@dataclass(frozen=True)
class PatientHoldout:
    holdout_patients: tuple = ()
    holdout_percentage: float | None = None
    min_train_patients: int = 1
    min_holdout_patients: int = 1
    seed: int = 42


@dataclass(frozen=True)
class HoldoutConfig:
    dataset_name: str
    holdout_type: str  # temporal, patient_based or hybrid
    temporal: TemporalHoldout | None = None
    patient: PatientHoldout | None = None
    extra: Mapping = field(default_factory=dict)

    def __post_init__(self):
        need = {"temporal": (self.temporal,), "patient_based": (self.patient,), "hybrid": (self.temporal, self.patient)}
        if self.holdout_type not in need:
            raise ValueError(f"unknown holdout type {self.holdout_type!r}")
        if any(part is None for part in need[self.holdout_type]):
            raise ValueError(f"{self.holdout_type} holdout lacks its settings")


def hash_rank_key(seed: int, col: Column) -> Column:
    """A reproducible shuffle key: md5 of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string")))


def fill_patient_id(df: DataFrame, source: str, col: str = "p_num") -> DataFrame:
    """NULL patient ids take their group's key; ``id_filled`` marks them (PRJ19)."""
    return df.withColumn("id_filled", F.col(col).isNull()).withColumn(col, F.coalesce(F.col(col), F.col(source)))


def temporal_plan(counts: DataFrame, cfg: TemporalHoldout, n: str = "n_rows") -> DataFrame:
    """Per patient: rows to hold out and why a patient is skipped or adjusted (SPL1)."""
    size = F.col(n)
    hold = F.floor(size * F.lit(cfg.holdout_percentage)).cast("long")
    short = size - hold < cfg.min_train_samples
    raised = hold < cfg.min_holdout_samples
    still_short = raised & (size - cfg.min_holdout_samples < cfg.min_train_samples)
    reason = F.when(short, "skipped_train").when(still_short, "skipped_adjusted").when(raised, "adjusted").otherwise("ok")
    return counts.withColumn("n_holdout", F.when(raised, F.lit(cfg.min_holdout_samples)).otherwise(hold).cast("long")).withColumn(
        "split_reason", reason
    )


def temporal_split(df: DataFrame, cfg: TemporalHoldout, keys: Keys = Keys()) -> DataFrame:
    """Label the last rows of every patient ``holdout`` (SPL1).

    Patients without enough training rows drop out; :func:`temporal_plan` on the
    row counts tells why.
    """
    planned = temporal_plan(number_rows(df, keys, "_rn", "n_rows"), cfg)
    kept = planned.where(F.col("split_reason").isin("ok", "adjusted"))
    label = F.when(F.col("_rn") > F.col("n_rows") - F.col("n_holdout"), "holdout").otherwise("train")
    return kept.withColumn("split", label).select(*df.columns, "split")


def ranked_patients(df: DataFrame, seed: int, col: str = "p_num") -> DataFrame:
    """Distinct ids with their place in the seeded order and their number."""
    ids = df.select(col).distinct().withColumn("_h", hash_rank_key(seed, F.col(col)))
    return hash_rank(ids, "_h", col, "place", "n_patients").drop("_h")


def holdout_patients(df: DataFrame, cfg: PatientHoldout, col: str = "p_num") -> DataFrame:
    """The held-out ids: the explicit list, else a seeded sample (SPL2, SPL5)."""
    if cfg.holdout_patients:
        return df.select(col).distinct().where(F.col(col).isin(*cfg.holdout_patients))
    if cfg.holdout_percentage is None:
        raise ValueError("give either holdout_patients or holdout_percentage")
    n = F.greatest(F.lit(cfg.min_holdout_patients), F.floor(F.col("n_patients") * F.lit(cfg.holdout_percentage)))
    return ranked_patients(df, cfg.seed, col).where(F.col("place") <= n).select(col)


def patient_split(df: DataFrame, cfg: PatientHoldout, col: str = "p_num") -> DataFrame:
    """Label whole patients ``train`` or ``holdout``; too few of either is an error (SPL2)."""
    held = holdout_patients(df, cfg, col).withColumn("_held", F.lit(True))
    ids = df.select(col).distinct().join(held, col, "left")
    sizes = ids.agg(
        F.count_if(F.col("_held").isNull()).alias("_n_train"), F.count_if(F.col("_held")).alias("_n_held")
    )
    check = F.when(
        F.col("_n_train") < cfg.min_train_patients,
        F.raise_error(F.concat(F.lit("not enough training patients: "), F.col("_n_train").cast("string"))),
    ).when(
        F.col("_n_held") < cfg.min_holdout_patients,
        F.raise_error(F.concat(F.lit("not enough holdout patients: "), F.col("_n_held").cast("string"))),
    )
    sizes = sizes.select(check.cast("string").alias("_err"), "_n_train")
    labels = with_row(ids, sizes, "_s").select(
        col, F.when(F.col("_s._err").isNull() & F.col("_held"), "holdout").otherwise("train").alias("split")
    )
    return df.join(labels, col)


def hybrid_split(df: DataFrame, patient: PatientHoldout, temporal: TemporalHoldout, keys: Keys = Keys()) -> DataFrame:
    """Held-out patients as a whole, the tails of all others (SPL3), in one pass.

    ``split_type`` tells which part of the holdout a row belongs to.
    """
    by = patient_split(df, patient).withColumnRenamed("split", "_ps")
    planned = temporal_plan(number_rows(by, keys, "_rn", "n_rows"), temporal)
    whole = F.col("_ps") == "holdout"
    tail = F.col("_rn") > F.col("n_rows") - F.col("n_holdout")
    kept = planned.where(whole | F.col("split_reason").isin("ok", "adjusted"))
    return kept.withColumn("split", F.when(whole | tail, "holdout").otherwise("train")).withColumn(
        "split_type", F.when(whole, "patient").when(tail, "temporal").otherwise("train")
    ).select(*df.columns, "split", "split_type")


def split(df: DataFrame, cfg: HoldoutConfig, keys: Keys = Keys(), id_source: str | None = None) -> DataFrame:
    """Dispatch on the holdout type after filling missing ids (SPL4)."""
    if id_source:
        df = fill_patient_id(df, id_source).drop("id_filled")
    if cfg.holdout_type == "temporal":
        return temporal_split(df, cfg.temporal, keys)
    if cfg.holdout_type == "patient_based":
        return patient_split(df, cfg.patient)
    return hybrid_split(df, cfg.patient, cfg.temporal, keys)


def part(df: DataFrame, which: str | None = None) -> DataFrame:
    """Train only, holdout only, or both (SPL7, SET6)."""
    return df if which is None else df.where(F.col("split") == which)


def overlap(train: DataFrame, holdout: DataFrame, col: str = "p_num") -> DataFrame:
    """Patients on both sides (SET5)."""
    return train.select(col).intersect(holdout.select(col))


def validate_split(df: DataFrame, min_train: int = 100, min_holdout: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """One row of flags per data set: sizes, shared patients, order in time (SPL6)."""
    is_train, is_hold = F.col("split") == "train", F.col("split") == "holdout"
    us = micros(F.col("datetime"))
    per = df.groupBy(*by, "p_num").agg(
        F.count_if(is_train).alias("_tr"),
        F.count_if(is_hold).alias("_ho"),
        F.max(F.when(is_train, us)).alias("_last"),
        F.min(F.when(is_hold, us)).alias("_first"),
    )
    both = (F.col("_tr") > 0) & (F.col("_ho") > 0)
    return per.groupBy(*by).agg(
        F.sum("_tr").alias("train_rows"),
        F.sum("_ho").alias("holdout_rows"),
        F.count_if(F.col("_tr") > 0).alias("train_patients"),
        F.count_if(F.col("_ho") > 0).alias("holdout_patients"),
        F.count_if(both).alias("shared_patients"),
        F.count_if(both & (F.col("_last") >= F.col("_first"))).alias("order_violations"),
        (F.sum("_tr") >= min_train).alias("train_large_enough"),
        (F.sum("_ho") >= min_holdout).alias("holdout_large_enough"),
    )


def day_boundary_plan(df: DataFrame, days: int | Column, hour: int = 6, include_partial: bool = False) -> DataFrame:
    """Per patient: where validation starts and ends, or why there is no split (SPL8)."""
    t = micros(F.col("datetime"))
    size = df.groupBy("p_num").agg(
        F.min(t).alias("first"),
        F.max(t).alias("last"),
        F.max(F.when(F.hour("datetime") == hour, t)).alias("boundary"),
        F.count("*").alias("n_rows"),
    )
    day = F.lit(DAY * 1_000_000)
    end = F.col("last") if include_partial else F.col("boundary")
    k = F.lit(days) if isinstance(days, int) else days
    out = size.withColumn("span_days", F.floor((F.col("last") - F.col("first")) / day).cast("long"))
    out = out.withColumn("validation_end", end).withColumn("validation_start", end - k * day)
    problem = (
        F.when(F.col("boundary").isNull(), "no_boundary")
        .when(F.col("span_days") < 1, "too_short")
        .when(F.col("validation_start") < F.col("first"), "too_few_days")
    )
    return out.withColumn("problem", problem)


def day_boundary_split(df: DataFrame, plan: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Label rows train or validation (SPL8).

    Validation runs from its start to its end; training is every row up to and
    including the start, except the last of these.  A training row can be the first
    validation row's neighbour only, so that row is the latest one at or before the
    start and is found with an aggregate.
    """
    ok = plan.where(F.col("problem").isNull()).select("p_num", "validation_start", "validation_end")
    t = micros(F.col("datetime"))
    joined = df.join(ok, "p_num")
    order = F.struct("datetime", *keys.tie)
    cut = joined.where(t <= F.col("validation_start")).groupBy("p_num").agg(F.max(order).alias("_cut"))
    rows = joined.join(cut, "p_num", "left").withColumn(
        "split",
        F.when((t >= F.col("validation_start")) & (t <= F.col("validation_end")), "validation").when(
            (t <= F.col("validation_start")) & (order < F.col("_cut")), "train"
        ),
    )
    return rows.where(F.col("split").isNotNull()).select(*df.columns, "split")


def percentage_plan(df: DataFrame, pct: float = 0.8, hour: int = 6) -> DataFrame:
    """Whole-day plan with at least one day on each side (SPL9)."""
    t = micros(F.col("datetime"))
    spans = df.groupBy("p_num").agg(F.floor((F.max(t) - F.min(t)) / F.lit(DAY * 1_000_000)).cast("long").alias("_days"))
    train = F.greatest(F.lit(1), F.least(F.floor(F.col("_days") * F.lit(pct)).cast("long"), F.col("_days") - 1))
    spans = spans.where("_days >= 2").withColumn("_k", F.col("_days") - train)
    joined = df.join(spans.select("p_num", "_k"), "p_num")
    plan = day_boundary_plan(joined, 0, hour).join(spans.select("p_num", "_k"), "p_num")
    start = F.col("validation_end") - F.col("_k") * F.lit(DAY * 1_000_000)
    problem = F.when(F.col("boundary").isNull(), "no_boundary").when(start < F.col("first"), "too_few_days")
    return plan.withColumn("validation_start", start).withColumn("problem", problem).withColumnRenamed("_k", "validation_days")


def percentage_split(df: DataFrame, pct: float = 0.8, hour: int = 6, keys: Keys = Keys()) -> DataFrame:
    if pct == 1:
        return df.withColumn("split", F.lit("train"))
    return day_boundary_split(df, percentage_plan(df, pct, hour), keys)


def three_way_split(df: DataFrame, val_days: int, test_days: int, min_days: int = 1) -> DataFrame:
    """Fine-tune, validation and test by days before the last stamp (SPL10)."""
    t, day = micros(F.col("datetime")), DAY * 1_000_000
    ends = df.groupBy("p_num").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    ends = ends.where(F.col("_hi") - F.lit((val_days + test_days) * day) - F.col("_lo") >= min_days * day)
    test, val = F.col("_hi") - test_days * day, F.col("_hi") - (test_days + val_days) * day
    label = F.when(t >= test, "test").when(t >= val, "validation").otherwise("finetune")
    return df.join(ends, "p_num").withColumn("split", label).select(*df.columns, "split")


def verify_left_out(df: DataFrame, patient) -> DataFrame:
    """The target patient's rows; an error when it is not in the holdout (SPL11)."""
    hit = df.agg(F.count_if((F.col("p_num") == F.lit(patient)) & (F.col("split") == "holdout")).alias("_n"))
    check = F.when(F.col("_n") == 0, F.raise_error(F.lit(f"patient {patient} is not in the holdout"))).otherwise(F.col("_n"))
    rows = df.where((F.col("p_num") == F.lit(patient)) & (F.col("split") == "holdout"))
    return with_row(rows, hit.select(check.alias("n")), "_hit").where(F.col("_hit.n") > 0).drop("_hit")


def train_val_patients(df: DataFrame, ratio: float, seed: int, col: str = "p_num") -> DataFrame:
    """Seeded partition of the patients with at least one for training (SPL12)."""
    n_val = F.least(F.floor(F.col("n_patients") * F.lit(ratio)), F.col("n_patients") - 1)
    return ranked_patients(df, seed, col).select(
        col, F.when(F.col("place") <= n_val, "validation").otherwise("train").alias("part")
    )


def sample_patients(df: DataFrame, n: int, seed: int = 42, explicit: Sequence | None = None, col: str = "p_num") -> DataFrame:
    """Patients of a report: an explicit list or a seeded sample of n (SPL13)."""
    if explicit:
        return df.select(col).distinct().where(F.col(col).isin(*explicit))
    return ranked_patients(df, seed, col).where(F.col("place") <= n).select(col)


def sample_episodes(episodes: DataFrame, per_patient: int, seed: int = 42, by: str = "p_num", episode: str = "episode_id") -> DataFrame:
    """n episodes per patient in hash order (SPL14)."""
    key = hash_rank_key(seed, F.col(episode))
    w = Window.partitionBy(by).orderBy(key, episode)
    return episodes.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= per_patient).drop("_rk")


def split_id(params: Mapping) -> str:
    """Short name of a parameter set (SNK4)."""
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:8]
