"""Patient ids of the form ``prefix_number``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Short names of the public studies and the app export.
PREFIXES = {
    "aleppo_2017": "ale",
    "brown_2019": "bro",
    "lynch_2022": "lyn",
    "tamborlane_2008": "tam",
    "kaggle_brisT1D": "bri",
    "app_export": "app",
}


def prefix_for(dataset: str) -> str:
    if dataset not in PREFIXES:
        raise ValueError(f"no id prefix for data set {dataset!r}; known: {sorted(PREFIXES)}")
    return PREFIXES[dataset]


def canonical_id(raw: Column, prefix: str | Column) -> Column:
    """``prefix_number`` from the trailing digits, else from all digits of a raw id."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    plain = F.trim(raw.cast("string"))
    whole = F.when(plain.contains("."), plain.try_cast("double").cast("long").cast("string"))
    text = F.coalesce(whole, plain)
    tail = F.regexp_extract(text, r"(\d+)$", 1)
    digits = F.when(tail != "", tail).otherwise(F.regexp_replace(text, r"\D", ""))
    number = F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))
    message = F.concat(F.lit("no digits in patient id: "), F.coalesce(text, F.lit("NULL")))
    return F.when(number.isNull(), F.raise_error(message)).otherwise(F.concat(head, F.lit("_"), number))


def patient_column(df: DataFrame) -> str:
    for name in ("p_num", "id"):
        if name in df.columns:
            return name
    raise ValueError(f"no patient column (p_num or id) among {df.columns}")
