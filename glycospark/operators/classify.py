"""Episode classification: ROC and precision-recall over whole tables.

Rows are first counted per distinct score.  Running counts over the scores come
from :func:`value_prefix`, which needs no global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .blocks import value_prefix


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives at, above and in total per (group, score)."""
    y = F.col(label).cast("boolean")
    counts = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    )
    out = value_prefix(counts, by, "score", {"pos_less": "pos", "neg_less": "neg"})
    return out.withColumns(
        {
            "tp": F.col("pos_less_total") - F.col("pos_less"),
            "fp": F.col("neg_less_total") - F.col("neg_less"),
            "n_pos": F.col("pos_less_total"),
            "n_neg": F.col("neg_less_total"),
        }
    ).drop("pos_less_total", "neg_less_total", "pos_less")


def classification(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Base rate, AUROC, average precision and its skill (EVA22).

    NULL when a group has one class only.
    """
    y = F.col(label).cast("boolean")
    sizes = df.groupBy(*by).agg(
        F.count("*").alias("n_episodes"), F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg")
    ).withColumn("base_rate", F.col("n_pos") / F.col("n_episodes"))
    s = score_counts(df, by, score, label)
    area = F.sum(F.col("pos") * (F.col("neg_less") + F.col("neg") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    pairs = F.max("n_pos") * F.max("n_neg")
    both = pairs > 0
    curve = s.groupBy(*by).agg(
        F.when(both, area / pairs).alias("auroc"),
        F.when(both, ap / F.max("n_pos")).alias("auprc"),
        F.when(both, ap / F.max("n_pos") - F.max("n_pos") / (F.max("n_pos") + F.max("n_neg"))).alias("auprc_skill"),
    )
    return sizes.join(curve, list(by), "left")


def curves(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score (EVA23)."""
    s = score_counts(df, by, score, label)
    return s.select(
        *by, "score", "tp", "fp",
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def youden(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Threshold with the largest tpr - fpr, the higher one on ties (EVA23)."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    return points.groupBy(*by).agg(
        F.max_by("score", F.struct(j, F.col("score"))).alias("threshold"), F.max(j).alias("youden_j")
    )


def confusion(df: DataFrame, by: Sequence[str], score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion matrix at fixed thresholds (EVA23)."""
    y = F.col(label).cast("boolean")
    opened = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.col(score) >= F.col("threshold")
    return opened.groupBy(*by, "threshold").agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )
