"""Registry of queries over the driver tables, each with its reference SQL.

Series concepts map onto the tables like this: a patient is a user of ``events``,
a reading is any event's value / 5.0173, meals are purchases (value / 1.00173), doses
are sign-ups (value / 10.0173), basal rates are views (value / 100.173, lasting
30 * k minutes).  The odd divisors keep rounded results off exact ties, which the
two engines break differently.
"""

from __future__ import annotations

import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timefn import seconds
from ..operators.align import regularize
from ..operators.blocks import DAY, Keys
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STEP = 21_600  # six-hour slots: about 120 per user
US = 1_000_000
GRID_KEYS = Keys(block=8 * DAY)
RAW_KEYS = Keys(tie=("event_id",), block=2 * DAY, rows=200_000)


@dataclass
class Tables:
    """The driver tables of one folder."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(prepare(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def r(col: Column | str, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places)


def R(expr: str, places: int = 6) -> str:
    """SQL twin of :func:`r`; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, {places}) + 0.0)"


def epoch(col: str = "datetime") -> Column:
    return seconds(F.col(col)).alias("t")


# --- inputs: Spark ---------------------------------------------------------------


def series(t: Tables) -> DataFrame:
    """Events as an irregular patient series."""
    e, v, kind = t.events, F.col("value"), F.col("event_type")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return e.select(
        F.col("user_id").alias("p_num"),
        F.col("ts").alias("datetime"),
        "event_id",
        kind.alias("msg_type"),
        (v / 5.0173).alias("bg_mM"),
        F.when(kind == "purchase", v / 1.00173).alias("food_g"),
        F.when(kind == "signup", v / 10.0173).alias("dose_units"),
        F.when(kind == "view", v / 100.173).alias("rate"),
        F.when(kind == "view", k * 30).alias("basal_duration_mins"),
    )


def grid(t: Tables, step: int = STEP) -> DataFrame:
    """The series on a regular grid."""
    return regularize(series(t), step, tie=("event_id",))


def meals(t: Tables) -> DataFrame:
    """The series with purchases as announced meals."""
    kind = F.when(F.col("msg_type") == "purchase", "ANNOUNCE_MEAL").otherwise(F.col("msg_type"))
    return series(t).withColumn("msg_type", kind)


# --- inputs: SQL -------------------------------------------------------------------

SER = """ser AS (
  SELECT user_id AS p_num, ts, epoch_us(ts) AS us, event_id, event_type AS msg_type, value, value / 5.0173 AS bg,
    CASE WHEN event_type = 'purchase' THEN value / 1.00173 END AS food,
    CASE WHEN event_type = 'signup' THEN value / 10.0173 END AS dose,
    CASE WHEN event_type = 'view' THEN value / 100.173 END AS rate,
    CASE WHEN event_type = 'view' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 30 END AS dur
  FROM events)"""


def round_slot_sql(us: str, step: int) -> str:
    s = step * US
    return (
        f"({step} * (({us}) // {s} + CASE WHEN 2 * (({us}) % {s}) > {s} OR "
        f"(2 * (({us}) % {s}) = {s} AND (({us}) // {s}) % 2 = 1) THEN 1 ELSE 0 END))"
    )


def grid_sql(step: int = STEP) -> str:
    """CTEs ser, bin, bnd and g (the regular grid)."""
    return f"""{SER},
bin AS (
  SELECT p_num, slot, avg(nullif(bg, 0)) AS bg, coalesce(sum(food), 0) AS food, coalesce(sum(dose), 0) AS dose,
    avg(rate) AS rate, coalesce(sum(dur), 0) AS dur, arg_min(msg_type, (us, event_id)) AS msg_type
  FROM (SELECT *, {round_slot_sql('us', step)} AS slot FROM ser) GROUP BY p_num, slot),
bnd AS (SELECT p_num, min(slot) AS lo, max(slot) AS hi FROM bin GROUP BY p_num),
g AS (
  SELECT x.p_num, x.slot AS t, x.pos, bg, food, dose, rate, dur, msg_type
  FROM (SELECT p_num, lo + {step} * i AS slot, i AS pos
        FROM (SELECT p_num, lo, unnest(range(0, (hi - lo) // {step} + 1)) AS i FROM bnd)) x
  LEFT JOIN bin USING (p_num, slot))"""


GRID = grid_sql()
