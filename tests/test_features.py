import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from glycospark.functions.kernels import as_exponentials, carb_decays, carb_kernel, insulin_decays, insulin_kernel
from glycospark.operators import features as X, sleep as Sl
from glycospark.operators.blocks import Carry, Keys, affine_scan, scan
from glycospark.plans.preprocess import physiological_features, preprocess

HOUR = Keys(block=3600)


def test_temporary_basal(frame):
    rate, dur = [None] * 18, [None] * 18
    rate[0], dur[0], rate[12], dur[12] = 1.2, 60.0, 0.8, 30.0
    out = X.rollover_temp(frame(bg_mM=[5.0] * 18, dose_units=[0.0] * 18, rate=rate, basal_duration_mins=dur), 300, HOUR)
    assert values(out, "dose_units") == pytest.approx([0.1] * 12 + [0.8 / 12] * 6)


def test_rate_without_duration_stops_the_one_before(frame):
    out = X.rollover_temp(frame(dose_units=[0.0] * 5, rate=[1.2, None, 2.4, None, None], basal_duration_mins=[60.0, None, None, None, None]), 300, HOUR)
    assert values(out, "dose_units") == pytest.approx([0.1, 0.1, 0.0, 0.0, 0.0])


def test_temporary_basal_matches_loop(frame):
    rng = np.random.default_rng(0)
    n = 150
    rate = [float(rng.integers(0, 5)) if rng.random() < 0.15 else None for _ in range(n)]
    dur = [float(rng.integers(0, 120)) if r is not None and rng.random() < 0.8 else None for r in rate]
    want, active = [], None
    for i in range(n):
        if rate[i] is not None:
            active = None if dur[i] is None else (i + int(dur[i] / 5), rate[i] / 12)
        want.append(active[1] if active and i < active[0] else 0.0)
    out = X.rollover_temp(frame(dose_units=[0.0] * n, rate=rate, basal_duration_mins=dur), 300, HOUR)
    assert values(out, "dose_units") == pytest.approx(want)


def test_automated_basal_fills_forward(frame):
    out = X.rollover_automated(frame(dose_units=[0.0, 0.0, 1.0, 0.0, None], rate=[None, 1.2, None, 0.0, None]), 300, HOUR)
    assert values(out, "dose_units") == pytest.approx([0.0, 0.1, 1.1, 0.0, None])


def test_kernels_have_the_expected_shape():
    avail, cob = carb_kernel(5)
    assert len(avail) == 36 and avail[:2] == [0.0, 0.0] and cob[0] == pytest.approx(0.8)
    assert all(a >= b for a, b in zip(cob, cob[1:]))
    # first two steps by hand: q1 = 0.8, then 0.8 / 40 * 5 moves on
    assert avail[2] == pytest.approx(0.1)
    _, iob = insulin_kernel(5)
    assert iob[0] == 1.0 and min(iob) >= 0.0


def test_both_convolutions_agree(frame):
    rng = np.random.default_rng(2)
    food = [float(rng.integers(5, 60)) if rng.random() < 0.1 else None for _ in range(120)]
    df = frame(bg_mM=[5.0] * 120, food_g=food)
    a, b = carb_kernel(5)
    joined = X.carbs_on_board(df, 300, HOUR)
    windowed = X.convolve_grid(df, {"food_g": {"carb_availability": a, "cob": b}}, 300, HOUR)
    want = np.zeros(120)
    for i, g in enumerate(food):
        for k, w in enumerate(b):
            if g is not None and i + k < 120:
                want[i + k] += g * w
    assert values(joined, "cob") == pytest.approx(list(want))
    assert values(windowed, "cob") == pytest.approx(list(want))
    assert values(windowed, "carb_availability") == pytest.approx(values(joined, "carb_availability"))


def test_pipeline_needs_basal_kind_and_columns(frame):
    df = frame(bg_mM=[5.0] * 3, dose_units=[1.0] * 3, rate=[1.0] * 3).drop("pos")
    with pytest.raises(ValueError, match="basal delivery"):
        physiological_features(df, 300)
    with pytest.raises(ValueError, match="missing columns"):
        preprocess(df.drop("bg_mM"), 300)
    out = physiological_features(df, 300, delivery="automated")
    assert {"iob", "insulin_availability", "cob", "hour_sin"} <= set(out.columns)
    assert values(out, "cob") == [None] * 3


def test_unknown_future_covariate(frame):
    with pytest.raises(ValueError, match="supported"):
        X.future_covariates(frame(bg_mM=[1.0]), 3, 300, ["iob"])


def test_future_covariates_cross_midnight(frame):
    out = X.future_covariates(frame(datetime=["2024-01-01 23:55"], bg_mM=[1.0]), 2, 300).toPandas()
    assert list(out.datetime) == [pd.Timestamp("2024-01-02 00:00"), pd.Timestamp("2024-01-02 00:05")]
    np.testing.assert_allclose(out.hour_sin**2 + out.hour_cos**2, 1)


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("alpha, block", [(0.3, 86400), (0.3, 900), (0.001, 3000), (0.95, 86400), (1.0, 3600)])
def test_exponential_smoothing_matches_pandas(frame, adjust, alpha, block):
    """Leading and long gaps, memories of many blocks, blocks without a value."""
    rng = np.random.default_rng(4)
    v = [None if rng.random() < 0.3 else float(rng.random() * 10) for _ in range(600)]
    v[:40] = [None] * 40
    v[200:460] = [None] * 260
    want = pd.Series(v, dtype=float).ewm(alpha=alpha, adjust=adjust).mean()
    out = X.exponential_average(frame(bg_mM=v), 300, alpha, adjust, keys=Keys(block=block))
    got = values(out, "smoothed")
    assert got[:40] == [None] * 40
    np.testing.assert_allclose(np.array(got[40:], float), want[40:], rtol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Generate" not in plan  # native, and no row is copied to another block


def test_smoothing_keeps_patients_apart(frame):
    one, two = frame(p_num="a", bg_mM=[1.0] * 30), frame(p_num="b", bg_mM=[None] * 3 + [9.0] * 27)
    out = X.exponential_average(one.unionByName(two), 300, 0.01, False, keys=Keys(block=1200)).toPandas()
    assert set(out[out.p_num == "a"].smoothed.round(9)) == {1.0}
    assert set(out[out.p_num == "b"].smoothed.dropna().round(9)) == {9.0}


def test_affine_scan_sums_with_decay(frame):
    """A one-compartment state: what is left of all doses before."""
    rng = np.random.default_rng(9)
    doses = [float(rng.integers(1, 9)) if rng.random() < 0.2 else None for _ in range(300)]
    half = lambda gap: F.pow(F.lit(0.5), gap / 3600)
    out = affine_scan(frame(dose=doses), Keys(block=7200), F.col("dose"), half, {"left": lambda gap, v: v}, 0.5 ** (300 / 3600))
    state, want = None, []
    last = None
    for k, d in enumerate(doses):
        if d is not None:
            state = d + (0 if state is None else state * 0.5 ** ((k - last) / 12))
            last = k
        want.append(state)
    got = values(out, "left")
    assert [g is None for g in got] == [x is None for x in want]
    np.testing.assert_allclose([g for g in got if g is not None], [x for x in want if x is not None])


@pytest.mark.parametrize("rows,need,centre", [(5, 3, True), (4, 1, True), (5, 5, True), (5, 1, False)])
def test_centred_mean_matches_pandas(frame, rows, need, centre):
    rng = np.random.default_rng(rows)
    v = [None if rng.random() < 0.3 else float(rng.random() * 10) for _ in range(60)]
    want = pd.Series(v, dtype=float).rolling(rows, min_periods=need, center=centre).mean()
    got = values(X.centred_average(frame(bg_mM=v), rows, 300, need, keys=HOUR, centre=centre), "smoothed")
    np.testing.assert_allclose(np.array(got, float), want)


@pytest.mark.parametrize("ts", [1, 2, 3])
def test_long_kernels_are_sums_of_exponentials(ts):
    for kernel, decays in ((carb_kernel(ts), carb_decays(ts)), (insulin_kernel(ts), insulin_decays(ts))):
        for weights in kernel:
            terms, extra = as_exponentials(weights, decays)
            k = np.arange(len(weights))
            got = sum(c * k.astype(float) ** d * q**k for c, d, q in terms) + extra * (k == 0)
            np.testing.assert_allclose(got, weights, atol=1e-10)
    assert as_exponentials(np.sin(np.arange(100)).tolist(), [0.9]) is None
    assert as_exponentials([1.0, 0.5, 0.25], [0.5]) is None  # too short to tell


def test_minute_kernels_match_convolution(frame):
    """Running sums over blocks, against a plain convolution; nothing is left after the kernel's end."""
    rng = np.random.default_rng(12)
    n = 900
    food = [float(rng.integers(5, 80)) if rng.random() < 0.03 else None for _ in range(n)]
    dose = [float(rng.random() * 6) if rng.random() < 0.05 else (-1.0 if rng.random() < 0.02 else None) for _ in range(n)]
    food[500:], dose[500:] = [None] * (n - 500), [None] * (n - 500)
    df = frame(step_min=1, food_g=food, dose_units=dose)
    responses = {"food_g": dict(zip(("ca", "cob"), carb_kernel(1))), "dose_units": dict(zip(("ia", "iob"), insulin_kernel(1)))}
    out = X.convolve_grid(df, responses, 60, Keys(block=7200), ("dose_units",), {"food_g": carb_decays(1), "dose_units": insulin_decays(1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lag(") < 40
    for col, amounts, names in (("food_g", food, ("ca", "cob")), ("dose_units", dose, ("ia", "iob"))):
        u = np.array([a if a is not None and (a > 0 or col == "food_g") else 0.0 for a in amounts])
        for name in names:
            want = np.convolve(u, responses[col][name])[:n]
            np.testing.assert_allclose(values(out, name), want, atol=1e-9)
            assert abs(np.array(values(out, name))[700:]).max() < 1e-9


def test_active_rows_are_those_of_the_whole_grid(spark):
    """Amounts around block ends, overlapping and a year apart: the same sums, and no grid in between."""
    import datetime
    import random

    rng, start = random.Random(5), datetime.datetime(2024, 1, 1, 21)
    minutes = sorted({rng.randrange(900) for _ in range(40)} | {100, 179, 180, 280, 359, 360, 400 * 1440, 400 * 1440 + 30})
    rows = [("a", start + datetime.timedelta(minutes=m), rng.choice([None, 0.0, 20.0, 55.5]), rng.choice([None, -1.0, 1.5, 4.0])) for m in minutes]
    rows += [("b", start, 10.0, None)]
    df = spark.createDataFrame(rows, "p_num string, datetime timestamp_ntz, food_g double, dose_units double")
    cols = ["carb_availability", "cob", "insulin_availability", "iob"]
    short = df.where("datetime < '2024-02-01'")
    read = lambda x: {(r.p_num, r.datetime): r for r in x.collect()}
    whole, part = (read(physiological_features(short, 60, keys=Keys(block=86_400), precise=True, active=a)) for a in (False, True))
    assert set(part) <= set(whole) and 0 < len(part) < len(whole) + 1
    for key, r in whole.items():
        for c in cols:
            assert (part[key][c] if key in part else 0.0) == pytest.approx(r[c], abs=1e-9)
        if key in part:
            assert all(part[key][c] == r[c] for c in ("pos", "food_g", "dose_units", "hour_sin"))
    long = physiological_features(df, 60, keys=Keys(block=86_400), precise=True, active=True)
    assert long.count() < 2_000  # the grid has 576,000


def test_sleep_rows_are_read_once_and_not_repeated(spark):
    """The smoothed rows come from the shared folder; the start of a day is that of plain sums over its hours."""
    import datetime as dt
    import random

    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(p, t0 + dt.timedelta(hours=k), k, *[rng.random() * 9 if rng.random() > 0.4 else None for _ in range(3)]) for p in (1, 2) for k in range(5, 24 * 12 + 7)]
    df = spark.createDataFrame(rows, "p_num long, datetime timestamp_ntz, pos long, hr_bpm double, steps double, cals double")
    scores = Sl.sleep_score(df, 3600, keys=Keys(block=86_400))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan and "Scan parquet" in plan
    sparse = scores.where("pos % 5 < 3").withColumn("sleep_score", F.when(F.col("pos") % 4 != 1, F.col("sleep_score") + F.col("raw_score")))
    days = {}
    for r in sparse.collect():
        days.setdefault((r.p_num, r.datetime.date()), []).append((r.datetime.hour, r.sleep_score))
    want = {}
    for key, cells in days.items():
        means = []
        for s in range(24):
            held = [v for h, v in cells if (h - s) % 24 < 8]
            known = [v for v in held if v is not None]
            if held:
                means.append((round(sum(known) / len(known), 9) if known else -1.0, s))
        want[key] = min(means)[1]
    out = Sl.sleep_hours(sparse)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {(r.p_num, r.date): r.sleep_start for r in got} == want
    assert all(r.sleep_end == (r.sleep_start + 8) % 24 and r.sleep_duration == 8 for r in got)


def test_scan_carries_the_bounds_of_a_series(spark):
    df = spark.createDataFrame([(p, k * 90_000, v) for p, vs in ((1, [None, 4.0, -2.0, 9.0]), (2, [None, None])) for k, v in enumerate(vs)], "p_num long, s long, v double")
    df = df.withColumn("datetime", F.timestamp_seconds("s").cast("timestamp_ntz"))
    out = scan(df, Keys(block=86_400), lo=Carry("low", F.col("v")), hi=Carry("high", F.col("v"))).select("p_num", "lo", "hi").distinct()
    assert {tuple(r) for r in out.collect()} == {(1, -2.0, 9.0), (2, None, None)}
