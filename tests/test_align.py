import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from glycospark.functions.timefn import round_slot
from glycospark.operators import align as A
from glycospark.operators.blocks import DAY, Keys


def test_round_slot_is_half_to_even(spark):
    df = spark.createDataFrame([("2024-01-01 00:02:30",), ("2024-01-01 00:07:30",), ("2024-01-01 00:02:30.000001",)], "s string")
    out = df.select(round_slot(F.col("s").cast("timestamp_ntz"), 300).alias("t")).collect()
    base = 1704067200
    assert [r.t - base for r in out] == [0, 600, 300]


def test_bins_average_sum_and_first(frame):
    df = frame(
        datetime=["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 00:06", "2024-01-01 00:15"],
        bg_mM=[4.0, 4.0, 6.0, 7.0], rate=[1.0, 0.0, 1.0, None], hr_bpm=[60.0, 0.0, 80.0, 70.0], food_g=[None, 5.0, 7.0, None],
        msg_type=["A", "B", "C", "D"],
    ).drop("pos")
    out = A.regularize(df, 300)
    assert values(out, "bg_mM") == [4.0, 5.0, None, 7.0]
    assert values(out, "rate") == [1.0, 0.5, None, None]  # a zero rate counts
    assert values(out, "hr_bpm") == [60.0, 80.0, None, 70.0]  # a zero heart rate does not
    assert values(out, "food_g") == [0.0, 12.0, None, 0.0]  # empty sum 0, missing bin NULL
    assert values(out, "msg_type") == ["A", "B", None, "D"]
    assert values(out, "p_num") == ["a"] * 4


def test_interval_mode_prefers_shorter_on_ties(frame):
    df = frame(datetime=["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 00:20", "2024-01-01 00:25", "2024-01-01 00:40"], bg_mM=[1.0] * 5)
    assert A.interval_mode(df).first()["interval_mins"] == 5


@pytest.mark.parametrize("direction", ["forward", "backward", "nearest"])
def test_asof_matches_merge_asof(spark, direction):
    rng = np.random.default_rng(5)
    n, step = 120, 300
    secs = np.sort(rng.choice(np.arange(0, 40 * step), n, replace=False)).astype(int)
    secs = secs[rng.random(n) < 0.4]
    pdf = pd.DataFrame({"datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(secs, "s"), "bg_mM": rng.random(len(secs))})
    grid = pd.DataFrame({"datetime": pd.date_range(pdf.datetime.min(), pdf.datetime.max(), freq=f"{step}s")})
    want = pd.merge_asof(grid, pdf, on="datetime", direction=direction, tolerance=pd.Timedelta(seconds=step * 2 / 3))
    df = spark.createDataFrame(pdf.assign(p_num="a")).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    got = values(A.asof_grid(df, step, direction), "bg_mM")
    assert got == [None if v != v else v for v in want["bg_mM"]]


def test_meal_overlay_keeps_meal_values(frame):
    df = frame(step_min=3, bg_mM=[float(i) for i in range(10)], food_g=[None, 50.0] + [None] * 5 + [75.0, None, None],
               msg_type=["x", "ANNOUNCE_MEAL"] + ["x"] * 5 + ["ANNOUNCE_MEAL", "x", "x"]).drop("pos")
    out = A.overlay_meals(df, 300)
    assert values(out, "food_g_keep") == [50.0, None, None, None, 75.0, None][: out.count()]
    assert values(out, "msg_type")[0] == "ANNOUNCE_MEAL"


def test_closest_reading_takes_earlier_on_ties(frame, spark):
    readings = frame(datetime=["2024-01-01 00:00", "2024-01-01 00:10"], bg_mM=[1.0, 2.0]).select("p_num", "datetime")
    messages = frame(datetime=["2024-01-01 00:05", "2024-01-01 00:06", "2023-12-31 23:00"], v=[1.0, 2.0, 3.0]).select("p_num", "datetime", "v")
    out = A.attach_closest(readings, messages, Keys(block=DAY))
    assert values(out, "v") == [1.0, 2.0]
