import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from glycospark.operators import meals as M, splits as S
from glycospark.operators.blocks import Keys

HOUR = Keys(block=3600)


def merge_rule(t, food, msg, length, low):
    """Greedy rule on lists, in time order."""
    food, msg = list(food), list(msg)
    for i in [i for i, m in enumerate(msg) if m == "ANNOUNCE_MEAL"]:
        if food[i] <= low:
            msg[i] = "LOW_CARB_MEAL"
            continue
        inside = [j for j in range(len(t)) if 0 < t[j] - t[i] <= length]
        food[i] += sum(food[j] for j in inside if food[j] is not None and food[j] > 0)
        later = {j for j in inside if msg[j] == "ANNOUNCE_MEAL"}
        for j in inside:
            food[j], msg[j] = 0.0, ("LOW_CARB_MEAL" if j in later else "")
    return food, msg


def test_greedy_merge_matches_rule(frame):
    rng = np.random.default_rng(6)
    n = 200
    meal = rng.random(n) < 0.25
    food = [float(rng.integers(0, 40)) if m or rng.random() < 0.1 else None for m in meal]
    msg = ["ANNOUNCE_MEAL" if m else "x" for m in meal]
    df = frame(step_min=15, food_g=food, msg_type=msg)
    out = M.merge_meals(df, 7200, 5, keys=HOUR)
    want_food, want_msg = merge_rule([i * 900 for i in range(n)], food, msg, 7200, 5)
    assert values(out, "food_g") == want_food
    assert values(out, "msg_type") == want_msg


def greedy(stamps, length):
    kept = []
    for t in sorted(stamps):
        if not kept or t - kept[-1] > length:
            kept.append(t)
    return kept


def spaced(spark, stamps, length_s, block):
    rows = [(p, t * 1_000_000) for p, ts in stamps.items() for t in ts]
    df = spark.createDataFrame(rows, "p_num string, us long").select("p_num", F.timestamp_micros("us").cast("timestamp_ntz").alias("datetime"), "us")
    out = M.spaced_stamps(df, length_s * 1_000_000, Keys(block=block))
    got = {}
    for r in out.collect():
        got.setdefault(r.p_num, []).append(r.us // 1_000_000)
    return {p: sorted(ts) for p, ts in got.items()}


@pytest.mark.parametrize("length, block", [(7200, 3600), (7200, 86_400), (60, 600)])
def test_spaced_stamps_match_a_greedy_pass(spark, length, block):
    rng = np.random.default_rng(length + block)
    stamps = {p: np.unique(np.cumsum(rng.exponential(scale * length, 150)).astype(int)).tolist() for p, scale in (("a", 0.3), ("b", 0.9), ("c", 2.5))}
    stamps["d"] = [0, length, length + 1, 2 * length, 2 * length + 1, 2 * length + 2, 4 * length + 3]  # at the limits
    assert spaced(spark, stamps, length, block) == {p: greedy(ts, length) for p, ts in stamps.items()}


def test_a_run_without_a_pause_takes_few_rounds(spark, monkeypatch):
    """One patient, 20,000 stamps a minute apart, one island: the chain has 500 links."""
    rounds = []
    write = M.settle
    monkeypatch.setattr(M, "settle", lambda df, label: rounds.append(label) or write(df, label))
    stamps = {"a": list(range(0, 20_000 * 60, 60))}
    assert spaced(spark, stamps, 2400, 7200) == {"a": greedy(stamps["a"], 2400)}
    assert rounds.count("reached") <= 11


def test_no_stamps_and_one(spark):
    assert spaced(spark, {}, 60, 600) == {} and spaced(spark, {"a": [5]}, 60, 600) == {"a": [5]}


def test_top_meals_and_meal_days(frame):
    df = frame(step_min=60, start="2024-01-01 06:00", food_g=[50.0, 0.0, 30.0, 20.0, 0.0], msg_type=["ANNOUNCE_MEAL", "", "ANNOUNCE_MEAL", "ANNOUNCE_MEAL", ""])
    assert values(M.keep_top_meals(df, 2), "food_g") == [50.0, 0.0, 30.0, 0.0, 0.0]
    assert values(M.keep_top_meals(df, 2), "msg_type")[3] == "0"
    assert M.drop_days_with_meals(df, 3).count() == 0
    assert M.drop_days_with_meals(df, 2).count() == 5


def test_temporal_holdout_reasons(frame):
    df = frame(bg_mM=[1.0] * 20)
    one = lambda cfg: S.temporal_plan(df.groupBy("p_num").agg(F.count("*").alias("n_rows")), cfg).first()
    assert (one(S.TemporalHoldout(0.2, 10, 2)).n_holdout, one(S.TemporalHoldout(0.2, 10, 2)).split_reason) == (4, "ok")
    assert one(S.TemporalHoldout(0.2, 10, 6)).split_reason == "adjusted"
    assert one(S.TemporalHoldout(0.2, 18, 2)).split_reason == "skipped_train"
    assert one(S.TemporalHoldout(0.2, 16, 6)).split_reason == "skipped_adjusted"
    out = S.temporal_split(df, S.TemporalHoldout(0.2, 10, 2), HOUR)
    assert values(out, "split") == ["train"] * 16 + ["holdout"] * 4


def test_patient_holdout_errors(frame):
    df = frame(p_num="a", bg_mM=[1.0] * 3).unionByName(frame(p_num="b", bg_mM=[1.0] * 3))
    out = S.patient_split(df, S.PatientHoldout(("b", "zz")))
    assert values(out, "split") == ["train"] * 3 + ["holdout"] * 3
    with pytest.raises(Exception, match="not enough training"):
        S.patient_split(df, S.PatientHoldout(("a", "b"))).collect()
    with pytest.raises(Exception, match="not enough holdout"):
        S.patient_split(df, S.PatientHoldout(("zz",))).collect()
    with pytest.raises(Exception, match="not in the holdout"):
        S.verify_left_out(out, "a").collect()
    with pytest.raises(ValueError):
        S.HoldoutConfig("d", "hybrid", S.TemporalHoldout())


def test_day_boundary_split_leaves_one_row_out(frame):
    df = frame(step_min=60, bg_mM=[1.0] * 24 * 5)
    plan = S.day_boundary_plan(df, 2)
    out = S.day_boundary_split(df, plan)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    # last 06:00 is on day 5; validation covers two days and both its ends
    assert counts == {"validation": 49, "train": 24 * 2 + 6}


def test_seeded_samples_repeat(frame, spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("p_num"))
    a = sorted(r[0] for r in S.sample_patients(df, 7, 1).collect())
    b = sorted(r[0] for r in S.sample_patients(df, 7, 1).collect())
    c = sorted(r[0] for r in S.sample_patients(df, 7, 2).collect())
    assert a == b and a != c and len(a) == 7
    assert S.split_id({"a": 1, "b": 2}) == S.split_id({"b": 2, "a": 1})
