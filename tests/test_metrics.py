import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospark.functions.softdtw import COLUMNS, dilate
from glycospark.operators import classify as K, metrics as M


def long(spark, qf, y, levels):
    """qf: (steps, levels), y: (steps)."""
    rows = [("r", "e", s + 1, float(q), float(qf[s][i]), float(y[s])) for s in range(len(y)) for i, q in enumerate(levels)]
    return spark.createDataFrame(rows, "run string, episode string, step int, q double, forecast double, actual double")


def test_pinball_known_value(spark):
    # over by 1 at level 0.5 costs 0.5
    df = long(spark, [[5.0], [5.0]], [4.0, 4.0], [0.5])
    assert M.wql(df, ["run"]).first().wql == pytest.approx(0.5)


def test_brier_and_pit_match_numpy(spark):
    rng = np.random.default_rng(1)
    levels = [0.1, 0.3, 0.5, 0.7, 0.9]
    qf = np.sort(rng.random((300, 5)) * 8, axis=1)
    qf[::17, 2] = qf[::17, 1]  # tied knots
    y = rng.random(300) * 9
    y[::23] = qf[::23, 4]  # at the highest quantile
    y[5::40] = qf[5::40, 1]
    steps = M.gather_steps(long(spark, qf, y, levels))
    p = np.array([np.interp(3.9, v, levels) for v in qf])
    got = M.with_hypo_probability(steps).orderBy("step").toPandas()
    strict = ~np.any(np.isclose(qf, 3.9), axis=1)
    np.testing.assert_allclose(got.p_hypo[strict], p[strict], atol=1e-12)
    assert M.brier(steps, ["run"]).first().brier == pytest.approx(np.mean((p - (y < 3.9)) ** 2))
    pit = M.with_pit(steps).orderBy("step").toPandas().pit
    for i in range(300):
        v = qf[i]
        if y[i] < v[0]:
            assert pit[i] == 0
        elif y[i] > v[-1]:
            assert pit[i] == 1
        elif len(set(v)) == 5:
            assert pit[i] == pytest.approx(np.interp(y[i], v, levels))
    assert pit.between(0, 1).all()


def test_intervals_and_interpolated_levels(spark):
    levels = [0.1, 0.3, 0.5, 0.7, 0.9]
    steps = M.gather_steps(long(spark, [[1, 2, 3, 4, 5]] * 2, [1.0, 4.9], levels))
    r = M.interval_scores(steps, ["run"], M.supported_levels(levels)).first()
    assert M.supported_levels(levels) == [0.5, 0.8]
    assert (r.coverage_80, r.sharpness_80) == (1.0, 4.0)
    assert (r.coverage_50, r.sharpness_50) == (0.0, pytest.approx(2.5))
    strict = steps.select(M.quantile_at(0.05, F.col("levels"), F.col("values"), strict=True))
    with pytest.raises(Exception, match="outside"):
        strict.collect()


def test_crossing_quantiles_are_sorted_or_refused(spark):
    steps = M.gather_steps(long(spark, [[1.0, 0.5, 2.0]], [1.0], [0.1, 0.5, 0.9]))
    assert M.repair_crossings(steps).first()["values"] == [0.5, 1.0, 2.0]
    s = M.crossing_stats(steps, ["run"]).first()
    assert (s.n_inverted, s.max_violation) == (1, 0.5)
    bad = M.gather_steps(long(spark, [[5.0, 0.5, 6.0]], [1.0], [0.1, 0.5, 0.9]))
    with pytest.raises(Exception, match="cross"):
        M.repair_crossings(bad).collect()


def softdtw_rule(pred, actual, gamma):
    """Plain double loop; the path from numeric derivatives of the cost."""

    def value(cost):
        n = len(pred)
        r = np.full((n + 1, n + 1), 1e8)
        r[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, n + 1):
                z = -np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
                r[i, j] = cost[i - 1, j - 1] - gamma * (np.log(np.exp(z - z.max()).sum()) + z.max())
        return r[n, n]

    n = len(pred)
    cost = (np.array(actual)[:, None] - np.array(pred)[None, :]) ** 2
    t = 0.0
    for i in range(n):
        for j in range(n):
            up, down = cost.copy(), cost.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            t += (value(up) - value(down)) / 2e-5 * (i - j) ** 2
    s = value(cost)
    return 0.5 * s + 0.5 * t / n**2, s, t / n**2


def test_shape_metrics(spark):
    rng = np.random.default_rng(0)
    pairs = [([1.0, 2, 3, 4, 5], [1.0, 2, 3, 4, 5]), ([0.0, 1, 2, 3, 4], [1.0, 2, 3, 4, 5]), (list(rng.random(6)), list(rng.random(6))), ([1.0], [2.0])]
    df = spark.createDataFrame([(i, list(map(float, p)), list(map(float, a))) for i, (p, a) in enumerate(pairs)], "i int, p array<double>, a array<double>")
    out = df.select("i", dilate(F.col("p"), F.col("a")).alias("d")).orderBy("i").select("d.*").toPandas()
    assert abs(out.shape_g0001[0]) < 0.01 and abs(out.temporal_g0001[0]) < 1e-6
    assert out.shape_g0001[1] == pytest.approx(2.0, abs=0.01) and out.temporal_g0001[1] == pytest.approx(0.16, abs=0.01)
    want = softdtw_rule(*pairs[2], 0.1)
    np.testing.assert_allclose(out.loc[2, ["dilate_g01", "shape_g01", "temporal_g01"]].astype(float), want, rtol=1e-4, atol=1e-6)
    assert out.loc[3, COLUMNS].isna().all()


def test_classification_matches_definition(spark):
    rng = np.random.default_rng(8)
    y, s = rng.random(400) < 0.3, rng.integers(0, 40, 400) / 7
    df = spark.createDataFrame([("g", bool(a), float(b)) for a, b in zip(y, s)] + [("one", True, 1.0)], "g string, y boolean, s double")
    out = {r.g: r for r in K.classification(df, ["g"], "s", "y").collect()}
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]])
    assert out["g"].auroc == pytest.approx(auc)
    cut = sorted(set(s), reverse=True)
    tp = np.array([(y & (s >= c)).sum() for c in cut])
    n = np.array([(s >= c).sum() for c in cut])
    assert out["g"].auprc == pytest.approx(np.sum(np.diff(np.r_[0, tp]) / y.sum() * tp / n))
    assert out["one"].auroc is None and out["one"].base_rate == 1.0


def test_known_levels_gather_in_columns_of_fixed_width(spark):
    """The same steps as a list gives, absent and empty levels too, without collecting lists."""
    levels = [0.1, 0.5, 0.9]
    df = long(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]], [1.0, 2.0, 3.0], levels)
    df = df.where("NOT (step = 2 AND q = 0.5)").withColumn("forecast", F.when(F.expr("NOT (step = 3 AND q = 0.9)"), F.col("forecast")))
    known = M.gather_steps(df, levels=levels)
    assert sorted(map(repr, known.collect())) == sorted(map(repr, M.gather_steps(df).collect()))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    with pytest.raises(Exception, match="unknown forecast level"):
        M.gather_steps(df, levels=[0.1, 0.5]).collect()
    with pytest.raises(Exception, match="two forecasts"):
        M.gather_steps(df.union(df), levels=levels).collect()


def test_trim_runs_its_input_once(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("k"), F.col("id").cast("double").alias("v")).groupBy("k").agg(F.sum("v").alias("v"))
    df = df.withColumn("v", F.when(F.col("k") == 3, 1e6).otherwise(F.col("v")))
    out = M.iqr_trim(df, "v")
    assert out.count() == 19
    assert all("/trim-" in f for f in out.inputFiles()) and out.inputFiles()


def test_sample_summary_runs_its_input_once(spark):
    rows = [("e", s, float(x), 5.0) for s in (1, 2) for x in range(11)]
    df = spark.createDataFrame(rows, "episode string, step int, sample double, actual double").repartition(2)
    out = M.sample_summary(df, ["episode"], 2.0)
    assert out.inputFiles() and all("/samples-" in f for f in out.inputFiles())
    assert [(r.step, r.p10, r.p90, r.p_hypo) for r in out.orderBy("step").collect()] == [(s, 1.0, 9.0, pytest.approx(2 / 11)) for s in (1, 2)]
