"""The nocturnal evaluation against plain numpy, episode by episode."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glycospark.operators import forecast as Fc, metrics as M
from glycospark.plans.evaluation import evaluate_nocturnal

LEVELS = [0.1, 0.3, 0.5, 0.7, 0.9]
FH = 6
NIGHT = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    eps, answers = [], {}
    for k in range(40):
        target = (rng.random(FH) * 8 + 2).tolist()
        eps.append((k % 3, f"e{k}", NIGHT, (rng.random(12) * 9 + 2).tolist(), target))
        answers[f"e{k}"] = np.sort(rng.random((FH if k % 5 else FH - 2, len(LEVELS))) * 9 + 1, axis=1).tolist()
    del answers["e7"]  # the model gives nothing here
    return eps, answers


@pytest.fixture(scope="module")
def episodes(spark, data):
    return spark.createDataFrame(data[0], "p_num long, episode_id string, anchor timestamp_ntz, context array<double>, target array<double>")


def model_of(answers):
    def model(batches):
        for pdf in batches:
            pdf["values"] = [answers.get(i) for i in pdf["episode_id"]]
            yield pdf

    return lambda eps: Fc.predict_arrays(eps, model)


def plain(data, threshold):
    eps, answers = data
    rows = []
    for p, i, _, context, target in eps:
        if i not in answers:
            continue
        v = np.array(answers[i])
        y, mid = np.array(target)[: len(v)], v[:, 2]
        q = np.array(LEVELS)
        e = y[:, None] - v
        row = {"p_num": p, "episode_id": i, "n": len(v), "se": (mid - y) ** 2, "ae": np.abs(mid - y), "re": np.abs(mid - y) / y, "discontinuity": abs(context[-1] - mid[0])}
        row["wql"] = np.where(e >= 0, q * e, (q - 1) * e).mean()
        row["brier"] = np.mean([(np.interp(threshold, x, LEVELS) - (t < threshold)) ** 2 for x, t in zip(v, y)])
        for s, lo, hi in ((50, 0.25, 0.75), (80, 0.1, 0.9)):
            a, b = (np.array([np.interp(x, LEVELS, r) for r in v]) for x in (lo, hi))
            row[f"coverage_{s}"], row[f"sharpness_{s}"] = ((y >= a) & (y <= b)).mean(), (b - a).mean()
        row["under"] = (y[:, None] <= v).sum(axis=0)
        rows.append(row)
    return rows


def test_all_tables_match_numpy(episodes, data):
    out = evaluate_nocturnal(episodes, model_of(data[1]), LEVELS, threshold=4.5)
    want = plain(data, 4.5)
    got = out["per_episode"].toPandas().set_index("episode_id")
    assert sorted(got.index) == sorted(r["episode_id"] for r in want)
    for r in want:
        g = got.loc[r["episode_id"]]
        assert g["rmse"] == pytest.approx(np.sqrt(r["se"].mean())) and g["n_steps"] == r["n"] and g["anchor"] == NIGHT
        for c in ("discontinuity", "wql", "brier", "coverage_50", "sharpness_50", "coverage_80", "sharpness_80"):
            assert g[c] == pytest.approx(r[c]), c
        assert len(g["pred"]) == r["n"] and g["dilate_g01"] is not None
    total = out["overall"].first()
    every = np.concatenate([r["se"] for r in want])
    under, steps = sum(r["under"] for r in want), sum(r["n"] for r in want)
    assert total.total_episodes == 39 and total.overall_rmse == pytest.approx(np.sqrt(every.mean()))
    assert total.overall_mace == pytest.approx(np.abs(under / steps - LEVELS).mean())
    assert total.overall_brier == pytest.approx(np.mean([r["brier"] for r in want]))
    assert total.overall_shape_g01 == pytest.approx(got["shape_g01"].mean())
    for r in out["per_patient"].collect():
        mine = [x for x in want if x["p_num"] == r.p_num]
        assert r.episodes == len(mine) and r.wql == pytest.approx(np.mean([x["wql"] for x in mine]))
        assert r.mape == pytest.approx(100 * np.concatenate([x["re"] for x in mine]).mean())
        assert r.mae == pytest.approx(np.concatenate([x["ae"] for x in mine]).mean())
    by_step = {r.step: r.sharpness_80 for r in out["by_step"].collect()}
    for k in range(FH):
        wide = [data[1][r["episode_id"]][k][4] - data[1][r["episode_id"]][k][0] for r in want if r["n"] > k]
        assert by_step[k + 1] == pytest.approx(np.mean(wide))


def test_long_forecasts_give_the_same(spark, episodes, data):
    rows = [(i, s + 1, q, x) for i, v in data[1].items() for s, r in enumerate(v) for q, x in zip(LEVELS, r)]
    long = spark.createDataFrame(rows, "episode_id string, step int, q double, forecast double")
    cols = ["episode_id", "wql", "brier", "rmse"]
    one = evaluate_nocturnal(episodes, lambda e: Fc.arrays_of(e, long, LEVELS), LEVELS, with_dilate=False)["per_episode"].select(cols).orderBy("episode_id").toPandas()
    two = evaluate_nocturnal(episodes, model_of(data[1]), LEVELS, with_dilate=False)["per_episode"].select(cols).orderBy("episode_id").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_point_forecasts_trimmed_contexts_and_gaps(spark, episodes):
    last = lambda e: e.withColumn("values", F.array_repeat(F.array(F.element_at("context", 1)), FH))
    out = evaluate_nocturnal(episodes, last, with_dilate=False, context_length=3)["per_episode"]
    rows = {r.episode_id: r for r in out.collect()}
    for r in episodes.collect():
        assert rows[r.episode_id].pred == [r.context[-3]] * FH and len(rows[r.episode_id].context) == 3
    assert "brier" not in out.columns
    holes = spark.createDataFrame([(1, "a", NIGHT, [5.0], [6.0, None, 8.0]), (1, "b", NIGHT, [5.0], [None]), (1, "c", NIGHT, [5.0], [])], episodes.schema)
    same = lambda e: e.withColumn("values", F.array_repeat(F.array(F.lit(7.0)), 3))
    got = evaluate_nocturnal(holes, same, with_dilate=False)
    assert [(r.episode_id, r.n_steps, r.mae) for r in got["per_episode"].collect()] == [("a", 2, 1.0)]
    assert evaluate_nocturnal(holes.where("false"), same, with_dilate=False)["overall"].first().total_episodes == 0
    with pytest.raises(ValueError, match="ascend"):
        evaluate_nocturnal(holes, same, [0.9, 0.1])


def test_no_exchange_between_forecast_and_episode_row(episodes, data):
    plan = evaluate_nocturnal(episodes, model_of(data[1]), LEVELS)["per_episode"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    assert M.supported_levels(LEVELS) == [0.5, 0.8]


def test_steps_are_scored_once(episodes):
    """Filters on the steps took the whole scoring along, several times over."""
    out = evaluate_nocturnal(episodes, lambda e: Fc.baseline_arrays(e, FH, LEVELS), LEVELS, with_dilate=False)
    for name in ("by_step", "per_patient", "overall"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(", under, ") == 1 and plan.count("array_sort") <= 4, name


def test_whole_patients_only_behind_a_size_bound(spark):
    df = spark.createDataFrame([("a", k) for k in range(20)] + [("b", 1)], "p_num string, v long")
    count = lambda pdf: pd.DataFrame({"p_num": [pdf["p_num"].iloc[0]], "n": [len(pdf)]})
    out = Fc.apply_per_patient(df, count, "p_num string, n long")
    assert sorted(map(tuple, out.collect())) == [("a", 20), ("b", 1)]
    with pytest.raises(ValueError, match="20 rows, more than 10"):
        Fc.apply_per_patient(df, count, "p_num string, n long", most_rows=10)
    assert Fc.apply_per_patient(df.limit(0), count, "p_num string, n long").collect() == []


def test_many_small_groups_reach_the_transformer_in_batches(spark):
    """As with applyInPandas: the same frames, whatever their neighbours in the batch hold."""
    import datetime as dt

    big = 2**53 + 1
    rows = []
    for i in range(400):
        day = dt.datetime(2024, 1, 1 + i % 7, i % 24)
        rows.append((None if i % 5 == 0 else i % 9, day, None if i % 50 == 0 else big + 2 * i, None if i % 70 == 0 else i % 2 == 0, None if i % 3 == 0 else i / 7, f"x{i}", [i, None]))
    df = spark.createDataFrame(rows, "p long, datetime timestamp_ntz, id long, flag boolean, x double, s string, a array<int>")

    def show(pdf):
        told = ",".join(f"{c}:{pdf[c].dtype}" for c in pdf.columns)
        pdf["told"] = told
        pdf["n"] = len(pdf)
        assert list(pdf.index) == list(range(len(pdf)))
        return pdf[["id", "s", "told", "n"]] if len(pdf) != 8 else pdf.iloc[:0]

    schema = "id long, s string, told string, n int"
    block = F.floor(F.unix_seconds(F.col("datetime").cast("timestamp")) / 86_400)
    cases = [(df.groupBy("p", block), {"by": ["p"], "block_seconds": 86_400}), (df.groupBy("p"), {"by": ["p"]})]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for grouped, args in cases:
        want = sorted(map(str, grouped.applyInPandas(show, schema).collect()))
        for batch in ("3", "64", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            try:
                out = Fc.apply_per_patient(df, show, schema, **args)
                assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # a stream per group
                assert sorted(map(str, out.collect())) == want
            finally:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(Exception, match="not a DataFrame"):
        Fc.apply_per_patient(df, lambda pdf: 1, schema, by=["p"]).collect()
