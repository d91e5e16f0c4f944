"""Forecast metrics.

Forecasts come from ``lineitem``: an order is an episode, a line number a step, the
summed quantity the actual value, and the mean price sets the predictive
distribution.  The order gives the run (priority) and the patient (customer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.softdtw import COLUMNS, GAMMAS, dilate
from ..operators import classify as K, episodes as E, forecast as Fc, metrics as M
from .catalog import R, Tables, query, r
from .q_episodes import CTX, EPISODES, FH, NUMBERED, midnight, numbered

LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
THR = 12.0  # plays the hypo threshold on quantities

ACT = """act AS (
  SELECT l_orderkey AS episode, CAST(l_linenumber AS INTEGER) AS step, o_orderpriority AS run, o_custkey AS p_num,
    sum(l_quantity) AS actual, sum(l_extendedprice) / count(*) / 1013 AS base
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""
PT = f"{ACT},\npt AS (SELECT run, p_num, episode, step, actual, base AS forecast FROM act)"
QF = f"""{ACT},
qf AS (SELECT run, p_num, episode, step, actual, q, base * (0.5 + q) AS forecast FROM act, (SELECT unnest({list(LEVELS)}) AS q))"""
# one row per step with the bracketing quantiles of the threshold
PH = f"""{QF},
n AS (SELECT run, p_num, episode, step, actual, count(*) FILTER (forecast < {THR}) AS below, list(forecast ORDER BY q) AS v, list(CAST(q AS DOUBLE) ORDER BY q) AS l FROM qf GROUP BY ALL),
ph AS (SELECT run, p_num, episode, step, actual, CASE WHEN below = 0 THEN l[1] WHEN below = 9 THEN l[9]
  ELSE l[below] + CASE WHEN v[below + 1] > v[below] THEN ({THR} - v[below]) / (v[below + 1] - v[below]) ELSE 0 END * (l[below + 1] - l[below]) END AS p FROM n)"""


def point(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("step")).agg(
        F.sum("l_quantity").alias("actual"), (F.sum("l_extendedprice") / F.count("*") / 1013).alias("forecast"))
    o = t.orders.select(F.col("o_orderkey").alias("episode"), F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("p_num"))
    return rows.join(o, "episode")


def quantiles(t: Tables) -> DataFrame:
    q = F.explode(F.array(*[F.lit(x) for x in LEVELS]))
    return point(t).withColumn("q", q).withColumn("forecast", F.col("forecast") * (0.5 + F.col("q")))


def steps(t: Tables, keys=("run", "episode", "step")) -> DataFrame:
    return M.gather_steps(quantiles(t), keys, LEVELS)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, places) + 0 for c in cols})


_REG = (f"{R('avg((forecast - actual) ** 2)', 4)} AS mse, {R('sqrt(avg((forecast - actual) ** 2))')} AS rmse, {R('avg(abs(forecast - actual))')} AS mae, "
        f"{R('avg(abs(forecast - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100', 4)} AS mape")


def _reg(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "mse", "mape", places=4), "rmse", "mae")


@query("eva1_regression", f"WITH {PT} SELECT run, {_REG} FROM pt GROUP BY run")
def eva1(t: Tables):
    return _reg(M.regression(point(t), ["run"]))


@query("eva1_vector_regression", f"""
WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS actual, unnest(b.embedding)::DOUBLE AS forecast FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {R('sqrt(avg((forecast - actual) ** 2))', 5)} AS rmse, {R('avg(abs(forecast - actual))', 5)} AS mae FROM p GROUP BY vec_id""")
def eva1_vectors(t: Tables):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("actual"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("pred"))
    err = F.zip_with("pred", "actual", lambda p, y: F.abs(p - y))
    mae = F.aggregate(err, F.lit(0.0), lambda s, x: s + x) / F.size("actual")
    return a.join(b, "vec_id").select("vec_id", r(M.array_rmse(F.col("pred"), F.col("actual")), 5).alias("rmse"), r(mae, 5).alias("mae"))


@query("eva2_training_regression", f"WITH {PT} SELECT run, {_REG.replace('avg(abs(forecast - actual) / greatest', 'avg(CASE WHEN actual <> 0 THEN 1 END * abs(forecast - actual) / greatest')} FROM (SELECT run, forecast, CASE WHEN actual = 1 THEN 0 ELSE actual END AS actual FROM pt) GROUP BY run")
def eva2(t: Tables):
    pts = point(t).withColumn("actual", F.when(F.col("actual") == 1, 0.0).otherwise(F.col("actual")))
    return _reg(M.regression(pts, ["run"], skip_zero=True))


@query("eva3_wql", f"""
WITH {QF} SELECT run, {R('avg(CASE WHEN actual >= forecast THEN q * (actual - forecast) ELSE (q - 1) * (actual - forecast) END)')} AS wql FROM qf GROUP BY run""")
def eva3(t: Tables):
    return rounded(M.wql(quantiles(t), ["run"]), "wql")


@query("eva4_brier", f"WITH {PH} SELECT run, {R(f'avg((p - CASE WHEN actual < {THR} THEN 1 ELSE 0 END) ** 2)')} AS brier FROM ph GROUP BY run")
def eva4(t: Tables):
    return rounded(M.brier(steps(t), ["run"], THR), "brier")


@query("eva5_hypo_probability", f"""
WITH {PH} SELECT run, episode, min(actual) < {THR} AS has_hypo, {R('max(p)')} AS max_phat, {R('avg(p)')} AS mean_phat FROM ph GROUP BY ALL""")
def eva5(t: Tables):
    return rounded(M.episode_hypo(steps(t), ["run", "episode"], THR), "max_phat", "mean_phat")


_WIDE = f"""{QF},
s AS (SELECT run, episode, step, actual, list(forecast ORDER BY q) AS v FROM qf GROUP BY ALL),
iv AS (SELECT *, v[2] + 0.5 * (v[3] - v[2]) AS lo_50, v[7] + 0.5 * (v[8] - v[7]) AS hi_50, v[1] AS lo_80, v[9] AS hi_80 FROM s)"""
_COVER = ", ".join(f"{R(f'avg(CASE WHEN actual BETWEEN lo_{s} AND hi_{s} THEN 1.0 ELSE 0.0 END)')} AS coverage_{s}, {R(f'avg(hi_{s} - lo_{s})')} AS sharpness_{s}" for s in (50, 80))


@query("eva6_interpolated_quantile", f"WITH {_WIDE} SELECT run, episode, step, {R('v[2] + 0.5 * (v[3] - v[2])')} AS q25, {R('v[1]')} AS q05, {R('v[5]')} AS q50 FROM iv")
def eva6(t: Tables):
    s = steps(t)
    at = lambda q: M.quantile_at(q, F.col("levels"), F.col("values"))
    return s.select("run", "episode", "step", r(at(0.25)).alias("q25"), r(at(0.05)).alias("q05"), r(at(0.5)).alias("q50"))


@query("eva7_eva8_coverage_sharpness", f"WITH {_WIDE} SELECT run, {_COVER} FROM iv GROUP BY run")
def eva7(t: Tables):
    levels = M.supported_levels(LEVELS)
    out = M.interval_scores(steps(t), ["run"], levels)
    return rounded(out, *[c for c in out.columns if c != "run"])


@query("eva9_coverage_by_step", f"WITH {_WIDE} SELECT run, step, {_COVER} FROM iv GROUP BY ALL")
def eva9(t: Tables):
    out = M.interval_scores(steps(t), ["run", "step"], M.supported_levels(LEVELS))
    return rounded(out, *[c for c in out.columns if c not in ("run", "step")])


_REL = f"{QF},\nrel AS (SELECT run, CAST(q AS DOUBLE) AS q, avg(CASE WHEN actual <= forecast THEN 1.0 ELSE 0.0 END) AS empirical FROM qf GROUP BY ALL)"


@query("eva10_mace", f"WITH {_REL} SELECT run, {R('avg(abs(empirical - q))')} AS mace FROM rel GROUP BY run")
def eva10(t: Tables):
    return rounded(M.mace(quantiles(t), ["run"]), "mace")


@query("eva11_reliability_curve", f"WITH {_REL} SELECT run, q, {R('empirical')} AS empirical FROM rel")
def eva11(t: Tables):
    return rounded(M.reliability(quantiles(t), ["run"]), "empirical")


@query("eva11_calibration_error", f"""
WITH {_REL}, c AS (SELECT run, (abs(empirical - q) + lag(abs(empirical - q)) OVER w) / 2 * (q - lag(q) OVER w) AS a FROM rel WINDOW w AS (PARTITION BY run ORDER BY q))
SELECT run, {R('sum(a)')} AS ece FROM c GROUP BY run""")
def eva11_ece(t: Tables):
    return rounded(M.calibration_error(quantiles(t), ["run"]), "ece")


_PIT = f"""{QF},
s AS (SELECT run, episode, step, actual, list(forecast ORDER BY q) AS v, list(CAST(q AS DOUBLE) ORDER BY q) AS l,
  count(*) FILTER (forecast <= actual) AS le, count(*) FILTER (forecast < actual) AS lt FROM qf GROUP BY ALL),
pit AS (SELECT run, episode, step, CASE WHEN le = 0 THEN 0.0 WHEN lt = 9 THEN 1.0 ELSE l[least(le, 8)] + CASE WHEN v[least(le, 8) + 1] > v[least(le, 8)]
  THEN greatest(0, least(1, (actual - v[least(le, 8)]) / (v[least(le, 8) + 1] - v[least(le, 8)]))) ELSE 0.5 END * (l[least(le, 8) + 1] - l[least(le, 8)]) END AS pit FROM s)"""


@query("eva12_pit_values", f"WITH {_PIT} SELECT run, episode, step, {R('pit')} AS pit FROM pit")
def eva12(t: Tables):
    return M.with_pit(steps(t)).select("run", "episode", "step", r("pit").alias("pit"))


_DENS = f"""{_PIT},
cell AS (SELECT run, CAST((step - 1) // 2 AS INTEGER) AS step_bin, CAST(least(floor(round(pit, 9) * 10), 9) AS INTEGER) AS pit_bin, count(*) AS n FROM pit GROUP BY ALL),
dens AS (SELECT *, n * 10.0 / sum(n) OVER (PARTITION BY run, step_bin) AS density FROM cell)"""


def _density(t: Tables):
    return M.pit_density(M.with_pit(steps(t)).withColumn("pit", F.round("pit", 9)), 10, 2)


@query("eva13_pit_density", f"WITH {_DENS} SELECT run, step_bin, pit_bin, n, {R('density')} AS density FROM dens")
def eva13(t: Tables):
    return rounded(_density(t), "density")


@query("eva13_pit_deviation", f"WITH {_DENS} SELECT run, step_bin, {R('(sum(abs(density - 1)) + 10 - count(*)) / 10')} AS deviation FROM dens GROUP BY ALL")
def eva13_dev(t: Tables):
    return rounded(M.pit_deviation(_density(t), 10), "deviation")


# quantiles that cross: the median is pushed down a little
_CROSS = f"""{QF},
x AS (SELECT run, episode, step, q, actual, CASE WHEN q = 0.5 THEN forecast - 0.11 * base1 ELSE forecast END AS forecast FROM (SELECT *, forecast / (0.5 + q) AS base1 FROM qf)),
d AS (SELECT run, episode, step, lag(forecast) OVER (PARTITION BY run, episode, step ORDER BY q) - forecast AS d FROM x)"""


def _crossing(t: Tables):
    base = F.col("forecast") / (0.5 + F.col("q"))
    bent = quantiles(t).withColumn("forecast", F.when(F.col("q") == 0.5, F.col("forecast") - 0.11 * base).otherwise(F.col("forecast")))
    return M.gather_steps(bent, levels=LEVELS)


@query("eva14_crossing_guard", f"""
WITH {_CROSS} SELECT run, count(*) FILTER (d > 1e-9) AS n_inverted, count(d) AS n_pairs, {R('max(greatest(d, 0))')} AS max_violation FROM d GROUP BY run""")
def eva14(t: Tables):
    out = M.crossing_stats(_crossing(t), ["run"])
    return rounded(out, "max_violation").withColumns({c: F.col(c).cast("long") for c in ("n_inverted", "n_pairs")})


@query("eva14_crossing_repair", f"""
WITH {_CROSS}, z AS (SELECT run, episode, step, list(forecast ORDER BY forecast) AS v FROM x GROUP BY ALL)
SELECT run, episode, step, {R('v[4]')} AS q40, {R('v[5]')} AS q50 FROM z""")
def eva14_repair(t: Tables):
    out = M.repair_crossings(_crossing(t), 100.0)
    return out.select("run", "episode", "step", r(F.col("values")[3]).alias("q40"), r(F.col("values")[4]).alias("q50"))


def _full_dilate_sql(n: int) -> str:
    """The nine shape columns by a recursion over anti-diagonals, for pairs of series of n values.

    ``r1`` and ``r2`` hold the soft minima of the last two diagonals by row, ``s1`` and ``s2``
    their derivatives in the direction of the squared lags.
    """
    x, y, z = "r2[i]", "r1[i]", "r1[i + 1]"
    w = lambda c: f"exp((least({x}, {y}, {z}) - {c}) / gamma)"
    cell = f"CASE WHEN i < 1 OR d + 1 - i < 1 OR d + 1 - i > {n} THEN"
    best = f"{cell} 1e8 ELSE (a[i] - p[d + 1 - i]) ** 2 + least({x}, {y}, {z}) - gamma * ln({w(x)} + {w(y)} + {w(z)}) END"
    slope = f"{cell} 0.0 ELSE (2 * i - d - 1) ** 2 + ({w(x)} * s2[i] + {w(y)} * s1[i] + {w(z)} * s1[i + 1]) / ({w(x)} + {w(y)} + {w(z)}) END"
    rows = f"range(0, {n + 1})"
    show = [f"max({e}) FILTER (gamma = {g}) AS {m}_{s}" for g, s in GAMMAS.items() for m, e in (("dilate", "0.5 * shape + 0.5 * temporal"), ("shape", "shape"), ("temporal", "temporal"))]
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (
  SELECT a.vec_id, gamma, a.e AS a, b.e AS p, 1 AS d, [1e8 for i in {rows}] AS r1, [CASE WHEN i = 0 THEN 0.0 ELSE 1e8 END for i in {rows}] AS r2, [0.0::DOUBLE for i in {rows}] AS s1, [0.0::DOUBLE for i in {rows}] AS s2
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1, (SELECT unnest({list(GAMMAS)}) AS gamma)
  UNION ALL
  SELECT vec_id, gamma, a, p, d + 1, list_transform({rows}, lambda i: {best}), r1, list_transform({rows}, lambda i: {slope}), s1 FROM w WHERE d < {2 * n}),
u AS (SELECT vec_id, gamma, r1[{n + 1}] AS shape, s1[{n + 1}] / {n * n} AS temporal FROM w WHERE d = {2 * n}),
k AS (SELECT vec_id, {', '.join(show)} FROM u GROUP BY vec_id)
SELECT vec_id, {', '.join(f'{R(c)} AS {c}' for c in COLUMNS)} FROM k"""


@query("eva15_dilate", _full_dilate_sql(64))
def eva15(t: Tables):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("actual"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("pred"))
    out = a.join(b, "vec_id").withColumn("_d", dilate(F.col("pred"), F.col("actual")))
    return out.select("vec_id", *[r(F.col(f"_d.{c}")).alias(c) for c in COLUMNS])


def _alignments(n: int) -> list[list[tuple[int, int]]]:
    """All monotone alignments of two series of n values."""
    if n == 0:
        return [[]]
    open_, done = [[(1, 1)]], []
    while open_:
        path = open_.pop()
        i, j = path[-1]
        if (i, j) == (n, n):
            done.append(path)
        open_ += [[*path, (i + a, j + b)] for a, b in ((1, 1), (1, 0), (0, 1)) if i + a <= n and j + b <= n]
    return sorted(done)


def dilate_sql(source: str, key: str, n: int) -> str:
    """CTE dl: the nine shape columns per key of ``source`` (key, a, p), by listing every alignment."""
    rows = ", ".join(f"({[i for i, _ in x]}, {[j for _, j in x]})" for x in _alignments(n))
    cells = lambda e: f"list_sum(list_transform(range(1, len(ii) + 1), lambda k: {e}))"
    cols = []
    for gamma, s in GAMMAS.items():
        w = f"exp((c0 - c) / {gamma})"
        shape, temporal = f"(min(c0) - {gamma} * ln(sum({w})))", f"(sum({w} * lag) / sum({w}) / {n * n})"
        cols += [f"0.5 * {shape} + 0.5 * {temporal} AS dilate_{s}", f"{shape} AS shape_{s}", f"{temporal} AS temporal_{s}"]
    return f"""al AS (SELECT * FROM (VALUES {rows}) t(ii, jj)),
ac AS (SELECT {key}, {cells('(a[ii[k]] - p[jj[k]]) ** 2')} AS c, {cells('(ii[k] - jj[k]) ** 2')} AS lag FROM {source}, al),
am AS (SELECT *, min(c) OVER (PARTITION BY {key}) AS c0 FROM ac),
dl AS (SELECT {key}, {', '.join(cols)} FROM am GROUP BY {key})"""


@query("eva15_dilate_short", f"""
WITH x AS (SELECT a.vec_id, CAST(a.embedding[1:4] AS DOUBLE[]) AS a, CAST(b.embedding[1:4] AS DOUBLE[]) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
{dilate_sql('x', 'vec_id', 4)}
SELECT vec_id, {', '.join(f'{R(c)} AS {c}' for c in COLUMNS)} FROM dl""")
def eva15_short(t: Tables):
    a = t.embeddings.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("actual"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("pred"))
    out = a.join(b, "vec_id").withColumn("_d", dilate(F.col("pred"), F.col("actual")))
    return out.select("vec_id", *[r(F.col(f"_d.{c}")).alias(c) for c in COLUMNS])


@query("eva16_discontinuity", f"""
WITH {EPISODES}, e AS (SELECT p_num, anchor, max(y) FILTER (k = {CTX - 1}) AS last, avg(y) FILTER (k < {CTX}) AS pred FROM ep GROUP BY ALL)
SELECT p_num, {R('avg(abs(last - pred))')} AS mean_discontinuity FROM e GROUP BY p_num""")
def eva16(t: Tables):
    pred = F.array(F.aggregate("context", F.lit(0.0), lambda s, x: s + x) / CTX)
    eps = E.usable(midnight(t)).withColumn("_d", M.discontinuity(F.col("context"), pred))
    return eps.groupBy("p_num").agg(r(F.avg("_d")).alias("mean_discontinuity"))


_SE = f"{PT},\nse AS (SELECT run, episode, step, (forecast - actual) ** 2 AS se, abs(forecast - actual) AS ae FROM pt)"


@query("eva19_horizon_profile", f"""
WITH {_SE} SELECT run, step, count(*) AS n, {R('sqrt(avg(se))')} AS rmse,
  {', '.join(f"{R(f'sqrt(quantile_cont(se, {p}))')} AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM se GROUP BY ALL""")
def eva19(t: Tables):
    out = M.horizon_profile(point(t), ["run"])
    return rounded(out, "rmse", "p10", "p25", "p50", "p75", "p90")


@query("eva20_horizon_stats", f"""
WITH {_SE}, m AS (SELECT run, step, avg(se) AS mse, quantile_cont(ae, 0.25) AS q25, quantile_cont(ae, 0.75) AS q75 FROM se GROUP BY ALL)
SELECT run, step, {R('sqrt(mse)')} AS rmse, {R('q25')} AS q25, {R('q75')} AS q75, {R('sqrt(avg(mse) OVER (PARTITION BY run ORDER BY step))')} AS cum_rmse FROM m""")
def eva20(t: Tables):
    return rounded(M.horizon_stats(point(t), ["run"]), "rmse", "q25", "q75", "cum_rmse")


@query("eva21_cumulative_rmse", f"""
WITH {_SE}, c AS (SELECT run, step, sqrt(avg(se) OVER (PARTITION BY run, episode ORDER BY step)) AS c FROM se)
SELECT run, step, {R('avg(c)')} AS mean_cum_rmse, {R('stddev_pop(c)')} AS std_cum_rmse, count(*) AS n_episodes FROM c WHERE step IN (1, 3, 6) GROUP BY ALL""")
def eva21(t: Tables):
    return rounded(M.cumulative_rmse(point(t), (1, 3, 6)), "mean_cum_rmse", "std_cum_rmse")


_LAB = "lab AS (SELECT source, toxic, quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"
_RANK = f"""{_LAB},
rk AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS rk FROM lab),
a AS (SELECT source, count(*) AS n, sum(quality) AS np, count(*) - sum(quality) AS nn, sum(rk) FILTER (quality = 1) AS rs FROM rk GROUP BY source),
d AS (SELECT source, s, sum(quality) AS p, count(*) AS c FROM lab GROUP BY ALL),
cu AS (SELECT source, s, p, sum(p) OVER w AS tp, sum(c) OVER w AS tot FROM d WINDOW w AS (PARTITION BY source ORDER BY s DESC)),
ap AS (SELECT source, sum(p * 1.0 * tp / tot) AS x FROM cu GROUP BY source)"""


def _labelled(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")


@query("eva22_episode_classification", f"""
WITH {_RANK} SELECT source, n AS n_episodes, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, {R('np * 1.0 / n')} AS base_rate,
  CASE WHEN np > 0 AND nn > 0 THEN {R('(rs - np * (np + 1) / 2.0) / (np * nn)')} END AS auroc, CASE WHEN np > 0 AND nn > 0 THEN {R('x / np')} END AS auprc,
  CASE WHEN np > 0 AND nn > 0 THEN {R('x / np - np * 1.0 / n')} END AS auprc_skill FROM a JOIN ap USING (source)""")
def eva22(t: Tables):
    return rounded(K.classification(_labelled(t), ["source"], "n_chars", "quality"), "base_rate", "auroc", "auprc", "auprc_skill")


_CURVE = f"""{_LAB},
d AS (SELECT s, sum(quality) AS p, count(*) - sum(quality) AS n FROM lab GROUP BY s),
cu AS (SELECT s AS score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM d WINDOW w AS (ORDER BY s DESC))"""


@query("eva23_roc_pr_points", f"""
WITH {_CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {R('tp * 1.0 / np')} AS tpr, {R('fp * 1.0 / nn')} AS fpr, {R('tp * 1.0 / (tp + fp)')} AS "precision" FROM cu""")
def eva23(t: Tables):
    return rounded(K.curves(_labelled(t), [], "n_chars", "quality"), "tpr", "fpr", "precision")


@query("eva23_youden_threshold", f"""
WITH {_CURVE}, j AS (SELECT score, round(tp * 1.0 / np - fp * 1.0 / nn, 12) AS j FROM cu) SELECT arg_max(score, (j, score)) AS threshold, {R('max(j)')} AS youden_j FROM j""")
def eva23_youden(t: Tables):
    return rounded(K.youden(K.curves(_labelled(t), [], "n_chars", "quality"), []), "youden_j")


@query("eva23_confusion_matrix", f"""
WITH {_LAB} SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (s >= th AND quality = 1) AS tp, count(*) FILTER (s >= th AND quality = 0) AS fp,
  count(*) FILTER (s < th AND quality = 1) AS fn, count(*) FILTER (s < th AND quality = 0) AS tn FROM lab, (SELECT unnest([200, 1000, 5000]) AS th) GROUP BY th""")
def eva23_confusion(t: Tables):
    return K.confusion(_labelled(t), [], "n_chars", "quality", (200, 1000, 5000))


_SAMP = """sm AS (SELECT o_orderpriority AS run, l_orderkey AS episode, CAST(l_linenumber AS INTEGER) AS step, l_quantity AS sample FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderpriority, l_orderkey, CAST(l_linenumber AS INTEGER), l_extendedprice / 2011 FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
su AS (SELECT run, episode, step, quantile_cont(sample, 0.1) AS p10, quantile_cont(sample, 0.25) AS p25, quantile_cont(sample, 0.75) AS p75, quantile_cont(sample, 0.9) AS p90,
  avg(CASE WHEN sample < 12 THEN 1.0 ELSE 0.0 END) AS p_hypo, avg(sample) AS actual FROM sm GROUP BY ALL)"""


def _samples(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("episode"), F.col("o_orderpriority").alias("run"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("step"),
                             F.explode(F.array("l_quantity", F.col("l_extendedprice") / 2011)).alias("sample")).join(o, "episode")
    mean = rows.groupBy("run", "episode", "step").agg(F.avg("sample").alias("actual"))
    return rows.join(mean, ["run", "episode", "step"])


@query("eva24_sample_paths", f"WITH {_SAMP} SELECT run, episode, step, {', '.join(f'{R(c)} AS {c}' for c in ('p10', 'p25', 'p75', 'p90', 'p_hypo'))} FROM su")
def eva24(t: Tables):
    return rounded(M.sample_summary(_samples(t), ["run", "episode"], THR).drop("actual"), "p10", "p25", "p75", "p90", "p_hypo")


@query("eva24_sample_calibration", f"""
WITH {_SAMP} SELECT run, episode, {R('max(p_hypo)')} AS max_p_hypo, {R('avg(CASE WHEN actual BETWEEN p25 AND p75 THEN 1.0 ELSE 0.0 END)')} AS calibration_50,
  {R('avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END)')} AS calibration_80 FROM (SELECT * EXCLUDE (p10, p25, p75, p90, actual), round(p10, 9) AS p10, round(p25, 9) AS p25, round(p75, 9) AS p75, round(p90, 9) AS p90, round(actual, 9) AS actual FROM su) GROUP BY ALL""")
def eva24_calibration(t: Tables):
    s = M.sample_summary(_samples(t), ["run", "episode"], THR)
    s = s.withColumns({c: F.round(c, 9) for c in ("p10", "p25", "p75", "p90", "actual")})
    return rounded(M.sample_calibration(s, ["run", "episode"]), "max_p_hypo", "calibration_50", "calibration_80")


_COVRUN = f"""{_WIDE}, cr AS (SELECT run, step, avg(CASE WHEN actual BETWEEN lo_50 AND hi_50 THEN 1.0 ELSE 0.0 END) AS c50, avg(hi_50 - lo_50) AS s50 FROM iv GROUP BY ALL),
q AS (SELECT quantile_cont(s50, 0.25) AS q1, quantile_cont(s50, 0.75) AS q3 FROM cr)"""


@query("eva25_coverage_error_trimmed", f"""
WITH {_COVRUN} SELECT run, step, {R('0.5 - c50')} AS coverage_50_error, {R('s50')} AS sharpness_50 FROM cr, q WHERE s50 <= q3 + 0.1 * (q3 - q1)""")
def eva25(t: Tables):
    runs = M.interval_scores(steps(t), ["run", "step"], [0.5])
    out = M.iqr_trim(M.coverage_errors(runs, {"coverage_50": 0.5}), "sharpness_50", 0.1)
    return rounded(out.select("run", "step", "coverage_50_error", "sharpness_50"), "coverage_50_error", "sharpness_50")


_SPLITTED = f"""{PT}, e AS (SELECT run, episode, p_num, sqrt(avg((forecast - actual) ** 2)) AS rmse FROM pt GROUP BY ALL),
sp AS (SELECT *, CASE WHEN p_num IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) AND run <> '5-LOW' THEN 'patient' ELSE 'temporal' END AS split_type FROM e)"""


@query("eva26_split_breakdown", f"""
WITH {_SPLITTED} SELECT r.run, s.split_type, count(sp.episode) AS n_episodes, {R('avg(rmse)')} AS mean_rmse
FROM (SELECT DISTINCT run FROM sp) r CROSS JOIN (VALUES ('patient'), ('temporal')) s(split_type)
LEFT JOIN sp ON sp.run = r.run AND sp.split_type = s.split_type GROUP BY ALL""")
def eva26(t: Tables):
    eps = M.regression(point(t), ["run", "episode", "p_num"])
    held = t.customer.where("c_nationkey < 8").select(F.col("c_custkey").alias("p_num"))
    eps = E.label_split_type(eps, held).withColumn("split_type", F.when(F.col("run") == "5-LOW", "temporal").otherwise(F.col("split_type")))
    return rounded(M.by_split(eps, ["run"], [F.avg("rmse").alias("mean_rmse")]), "mean_rmse")


_MODELS = "md AS (SELECT 'price' AS model, actual, base AS forecast FROM act UNION ALL SELECT 'half', actual, base / 2 FROM act)"


@query("eva27_compare_models", f"WITH {ACT}, {_MODELS} SELECT model, count(*) AS n, {_REG} FROM md GROUP BY model")
def eva27(t: Tables):
    p = point(t)
    both = p.withColumn("_m", F.explode(F.array(F.struct(F.lit("price").alias("model"), F.col("forecast").alias("f")),
                                                F.struct(F.lit("half").alias("model"), (F.col("forecast") / 2).alias("f")))))
    return _reg(M.compare_models(both.select("_m.model", "actual", F.col("_m.f").alias("forecast"))))


@query("agg13_weighted_rollup", f"""
WITH {PT}, pp AS (SELECT run, p_num, count(DISTINCT episode) AS n, sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(abs(forecast - actual)) AS mae,
  avg(abs(forecast - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS mape FROM pt GROUP BY ALL)
SELECT run, {R('sqrt(sum(rmse * rmse * n) / sum(n))')} AS rmse, {R('sum(mae * n) / sum(n)')} AS mae, {R('sum(mape * n) / sum(n)', 4)} AS mape, CAST(sum(n) AS BIGINT) AS n_episodes
FROM pp GROUP BY run""")
def agg13(t: Tables):
    per = point(t).groupBy("run", "p_num").agg(F.count_distinct("episode").alias("n_episodes"), *M.regression_aggs())
    return rounded(rounded(M.weighted_rollup(per, ["run"]), "rmse", "mae"), "mape", places=4)


# --- forecasts over episodes -------------------------------------------------------------


@query("udf1_batch_forecaster", f"""
WITH {NUMBERED}, m AS (SELECT episode_id, avg(y) FILTER (k < {CTX}) AS f FROM e GROUP BY ALL)
SELECT episode_id, CAST(s AS INTEGER) AS step, 0.5::DOUBLE AS q, {R('f * (1 + s / 10.0)')} AS forecast FROM m, (SELECT unnest(range(1, {FH + 1})) AS s)""")
def udf1(t: Tables):
    def drift(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            means = np.array([np.mean(c) for c in pdf["context"]])
            ids = pdf["episode_id"].to_numpy()
            yield pd.concat([pd.DataFrame({"episode_id": ids, "step": s, "q": 0.5, "forecast": means * (1 + s / 10)}) for s in range(1, FH + 1)])

    return rounded(Fc.predict_batch(numbered(t).select("episode_id", "context"), drift), "forecast")


def _baseline_sql(value: str) -> str:
    return f"""
WITH {NUMBERED}, m AS (SELECT episode_id, {value} AS f FROM e WHERE k < {CTX} GROUP BY ALL)
SELECT episode_id, CAST(s AS INTEGER) AS step, 0.5::DOUBLE AS q, {R('f')} AS forecast FROM m, (SELECT unnest(range(1, {FH + 1})) AS s)"""


@query("udf2_naive_baseline", _baseline_sql("arg_max(y, k)"))
def udf2(t: Tables):
    return rounded(Fc.baseline(numbered(t), FH), "forecast")


@query("udf2_average_baseline", _baseline_sql("avg(y)"))
def udf2_average(t: Tables):
    return rounded(Fc.baseline(numbered(t), FH, "Average"), "forecast")


@query("udf2_quantile_baseline", f"""
WITH {NUMBERED}, m0 AS (SELECT episode_id, quantile_cont(y, [0.1, 0.5, 0.9]) AS fs FROM e WHERE k < {CTX} GROUP BY episode_id),
m AS (SELECT episode_id, unnest([0.1, 0.5, 0.9]) AS q, unnest(fs) AS f FROM m0)
SELECT episode_id, CAST(s AS INTEGER) AS step, CAST(q AS DOUBLE) AS q, {R('f')} AS forecast FROM m, (SELECT unnest(range(1, {FH + 1})) AS s)""")
def udf2_quantiles(t: Tables):
    return rounded(Fc.baseline_quantiles(numbered(t), FH, (0.1, 0.5, 0.9)), "forecast")


@query("udf3_per_patient_transform", """
SELECT user_id AS p_num, event_id, round((value / 5.0173 - avg(value / 5.0173) OVER (PARTITION BY user_id, epoch_us(ts) // 864000000000)), 6) + 0.0 AS centred FROM events""")
def udf3(t: Tables):
    def centre(pdf):
        pdf["centred"] = (pdf["value"] - pdf["value"].mean()).round(6) + 0.0
        return pdf[["p_num", "event_id", "centred"]]

    src = t.events.select(F.col("user_id").alias("p_num"), "event_id", F.col("ts").alias("datetime"), (F.col("value") / 5.0173).alias("value"))
    return Fc.apply_per_patient(src, centre, "p_num bigint, event_id bigint, centred double", block_seconds=10 * 86_400)


@query("udf3_whole_patient_transform", f"""
SELECT event_id, {R('value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS since_first FROM events""")
def udf3_whole(t: Tables):
    """A transformer that needs the whole series, behind the check of its size."""

    def since_first(pdf):
        first = pdf.sort_values(["datetime", "event_id"])["value"].iloc[0]
        pdf["since_first"] = (pdf["value"] - first).round(6) + 0.0
        return pdf[["event_id", "since_first"]]

    src = t.events.select(F.col("user_id").alias("p_num"), "event_id", F.col("ts").alias("datetime"), "value")
    return Fc.apply_per_patient(src, since_first, "event_id bigint, since_first double")


@query("udf3_fit_then_transform", f"""
SELECT event_id, {R('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS scaled FROM events WINDOW w AS (PARTITION BY user_id)""")
def udf3_fit(t: Tables):
    """Fitted by an aggregate, applied per time block: no task holds a patient."""
    src = t.events.select(F.col("user_id").alias("p_num"), "event_id", F.col("ts").alias("datetime"), "value")

    def scale(pdf):  # frames are many and small, where arrays cost less than columns
        import numpy as np
        import pandas as pd

        value, mean, std = (pdf[c].to_numpy() for c in ("value", "fit_mean", "fit_std"))
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = ((value - mean) / std).round(6) + 0.0
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "scaled": scaled}, copy=False)

    fitted = src.join(Fc.fit_patients(src, "value"), "p_num")
    return Fc.apply_per_patient(fitted, scale, "event_id bigint, scaled double", block_seconds=10 * 86_400)


@query("udf3_fallback_for_unseen", f"""
WITH f AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id <> 4 GROUP BY 1), a AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id <> 4)
SELECT event_id, f.m IS NOT NULL AS seen, {R('(value - coalesce(f.m, a.m)) / coalesce(f.s, a.s)')} AS scaled FROM events LEFT JOIN f USING (user_id), a""")
def udf3_fallback(t: Tables):
    e = t.events.select(F.col("user_id").alias("p_num"), "event_id", "value")
    known = e.where("p_num <> 4")
    pooled = known.agg(F.avg("value").alias("fit_mean"), F.stddev_pop("value").alias("fit_std"))
    out = Fc.transform_with_fallback(e, Fc.fit_patients(known, "value"), pooled, "value")
    return rounded(out.select("event_id", "seen", "scaled"), "scaled")


@query("prj21_forecast_validity", """
SELECT l_orderkey AS episode_id, count(*) AS n_values, count(*) FILTER (l_linenumber = 7) AS n_bad,
  CASE WHEN count(*) FILTER (l_linenumber = 7) = count(*) THEN 'all_bad' WHEN count(*) FILTER (l_linenumber = 7) > 0 THEN 'some_bad' ELSE 'ok' END AS state
FROM lineitem GROUP BY 1""")
def prj21(t: Tables):
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return Fc.check_forecasts(t.lineitem.select(F.col("l_orderkey").alias("episode_id"), value.alias("forecast")))


@query("join9_episode_forecasts", f"""
WITH {NUMBERED}, m AS (SELECT episode_id, p_num, arg_max(y, k) FILTER (k < {CTX}) AS f FROM e GROUP BY ALL)
SELECT e.episode_id, CAST(k - {CTX - 1} AS INTEGER) AS step, {R('f')} AS forecast, {R('y')} AS actual FROM e JOIN m USING (episode_id) WHERE k >= {CTX} AND f > 6""")
def join9(t: Tables):
    eps = numbered(t)
    # the model answers high contexts only; the other episodes drop out
    answered = Fc.baseline(eps.where(F.element_at("context", -1) > 6), FH)
    return rounded(Fc.pair(answered, Fc.actuals(eps)).drop("q"), "forecast", "actual")


@query("join9_missing_forecasts", f"WITH {NUMBERED} SELECT episode_id FROM e WHERE k < {CTX} GROUP BY episode_id HAVING arg_max(y, k) <= 6")
def join9_missing(t: Tables):
    eps = numbered(t)
    return Fc.missing_forecasts(eps, Fc.baseline(eps.where(F.element_at("context", -1) > 6), FH))


_TWO = f"""{PT}, ea AS (SELECT p_num, episode, sqrt(avg((forecast - actual) ** 2)) AS rmse FROM pt WHERE actual > 5 GROUP BY ALL),
eb AS (SELECT p_num, episode, sqrt(avg((forecast / 2 - actual) ** 2)) AS rmse FROM pt WHERE actual < 40 GROUP BY ALL)"""


@query("join10_compare_runs", f"""
WITH {_TWO} SELECT p_num, episode, {R('ea.rmse')} AS "before", {R('eb.rmse')} AS "after", {R('eb.rmse - ea.rmse')} AS delta FROM ea JOIN eb USING (p_num, episode)""")
def join10(t: Tables):
    p = point(t)
    a = M.regression(p.where("actual > 5"), ["p_num", "episode"])
    b = M.regression(p.where("actual < 40").withColumn("forecast", F.col("forecast") / 2), ["p_num", "episode"])
    return rounded(M.compare_runs(a, b, ["p_num", "episode"]), "before", "after", "delta")


@query("join11_results_equal", f"""
WITH {PT}, a AS (SELECT * FROM pt WHERE step <> 7), b AS (SELECT run, episode, step, CASE WHEN run = '5-LOW' THEN forecast + 0.5 ELSE forecast END AS forecast FROM pt WHERE run <> '1-URGENT'),
j AS (SELECT coalesce(a.episode, b.episode) AS episode, a.forecast AS fa, b.forecast AS fb FROM a FULL JOIN b ON a.episode = b.episode AND a.step = b.step),
s AS (SELECT episode, count(fa) AS n_a, count(fb) AS n_b, max(abs(fa - fb)) AS d, sqrt(avg((fa - fb) ** 2)) AS m FROM j GROUP BY episode)
SELECT episode, n_a, n_b, {R('d')} AS max_abs_diff, {R('m')} AS rmse,
  CASE WHEN n_a = 0 THEN 'only_b' WHEN n_b = 0 THEN 'only_a' WHEN n_a = n_b AND d <= 1e-6 THEN 'equal' ELSE 'different' END AS state FROM s""")
def join11(t: Tables):
    p = point(t)
    b = p.where("run <> '1-URGENT'").withColumn("forecast", F.when(F.col("run") == "5-LOW", F.col("forecast") + 0.5).otherwise(F.col("forecast")))
    return rounded(M.results_equal(p.where("step <> 7"), b), "max_abs_diff", "rmse")


# --- whole evaluations --------------------------------------------------------------------------

_Q9 = ", ".join(f"quantile_cont(y, {q})" for q in LEVELS)
_P9 = f"{list(LEVELS)}"
_PROB = ("wql", "brier", "coverage_50", "sharpness_50", "coverage_80", "sharpness_80")
_ALL = ("rmse", "discontinuity", *_PROB, *COLUMNS)

# st: one row per step with its nine quantiles; pe: one row per episode; dl: its shape columns
_STEPS = f"""{NUMBERED},
fx AS (SELECT episode_id, [{_Q9}] AS v, arg_max(y, k) AS last FROM e WHERE k < {CTX} GROUP BY ALL),
ev AS (SELECT p_num, episode_id, y, v, last, k, {_P9} AS q, len(list_filter(v, lambda x: x < {THR})) AS m FROM e JOIN fx USING (episode_id) WHERE k >= {CTX}),
st AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN y >= v[i] THEN q[i] * (y - v[i]) ELSE (q[i] - 1) * (y - v[i]) END)) / 9 AS loss,
  CASE WHEN m = 0 THEN q[1] WHEN m = 9 THEN q[9] ELSE q[m] + CASE WHEN v[m + 1] > v[m] THEN ({THR} - v[m]) / (v[m + 1] - v[m]) ELSE 0 END * (q[m + 1] - q[m]) END AS ph,
  v[2] + 0.5 * (v[3] - v[2]) AS lo_50, v[7] + 0.5 * (v[8] - v[7]) AS hi_50, v[1] AS lo_80, v[9] AS hi_80 FROM ev)"""
_INTERVALS = ", ".join(f"avg(CASE WHEN y BETWEEN lo_{s} AND hi_{s} THEN 1.0 ELSE 0.0 END) AS coverage_{s}, avg(hi_{s} - lo_{s}) AS sharpness_{s}" for s in (50, 80))
_EVAL = f"""{_STEPS},
pe AS (SELECT p_num, episode_id, sqrt(avg((v[5] - y) ** 2)) AS rmse, any_value(abs(last - v[5])) AS discontinuity, avg(loss) AS wql, avg((ph - CASE WHEN y < {THR} THEN 1 ELSE 0 END) ** 2) AS brier,
  {_INTERVALS} FROM st GROUP BY ALL)"""
_SHAPES = f"""x AS (SELECT episode_id, list(y ORDER BY k) AS a, list(v[5] ORDER BY k) AS p FROM ev GROUP BY episode_id),
{dilate_sql('x', 'episode_id', FH)}"""


def nocturnal_evaluation(t: Tables) -> dict[str, DataFrame]:
    """Nine levels, Brier score and shape metrics, of the baseline that answers with arrays."""
    from .evaluation import evaluate_nocturnal

    return evaluate_nocturnal(numbered(t), lambda eps: Fc.baseline_arrays(eps, FH, LEVELS), LEVELS, threshold=THR)


@query("eva17_nocturnal_per_episode", f"""
WITH {_EVAL}, {_SHAPES}
SELECT p_num, episode_id, {', '.join(f'{R(c)} AS {c}' for c in _ALL)} FROM pe JOIN dl USING (episode_id)""")
def eva17(t: Tables):
    return rounded(nocturnal_evaluation(t)["per_episode"].select("p_num", "episode_id", *_ALL), *_ALL)


@query("eva17_nocturnal_complete", f"""
WITH {_EVAL}, {_SHAPES}
SELECT p_num, episode_id, {', '.join(f'{R(c)} AS {c}' for c in _ALL)} FROM pe JOIN dl USING (episode_id)""")
def eva17_complete(t: Tables):
    """The same from a forecaster with long rows, gathered into the episodes."""
    from .evaluation import evaluate_nocturnal

    model = lambda eps: Fc.arrays_of(eps, Fc.baseline_quantiles(eps, FH, LEVELS), LEVELS)
    out = evaluate_nocturnal(numbered(t), model, LEVELS, threshold=THR)["per_episode"]
    return rounded(out.select("p_num", "episode_id", *_ALL), *_ALL)


@query("eva17_nocturnal_per_patient", f"""
WITH {_EVAL}, m AS (SELECT p_num, count(DISTINCT episode_id) AS episodes, avg((v[5] - y) ** 2) AS mse, avg(abs(v[5] - y)) AS mae, avg(abs(v[5] - y) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape FROM st GROUP BY p_num),
mw AS (SELECT p_num, avg(wql) AS wql, avg(brier) AS brier FROM pe GROUP BY p_num)
SELECT p_num, episodes, {R('mse', 4)} AS mse, {R('sqrt(mse)')} AS rmse, {R('mae')} AS mae, {R('mape', 4)} AS mape, {R('wql')} AS wql, {R('brier')} AS brier FROM m JOIN mw USING (p_num)""")
def eva17_patient(t: Tables):
    out = nocturnal_evaluation(t)["per_patient"].select("p_num", "episodes", "mse", "rmse", "mae", "mape", "wql", "brier")
    return rounded(rounded(out, "mse", "mape", places=4), "rmse", "mae", "wql", "brier")


@query("eva17_nocturnal_overall", f"""
WITH {_EVAL}, {_SHAPES}, c AS (SELECT i, abs(avg(CASE WHEN y <= v[i] THEN 1.0 ELSE 0.0 END) - any_value(q[i])) AS d FROM (SELECT *, unnest(range(1, 10)) AS i FROM st) GROUP BY i)
SELECT (SELECT count(*) FROM pe) AS total_episodes, {R('(SELECT sqrt(avg((v[5] - y) ** 2)) FROM st)')} AS overall_rmse, {R('(SELECT avg(discontinuity) FROM pe)')} AS mean_discontinuity,
  {', '.join(f'{R(f"(SELECT avg({c}) FROM pe)")} AS overall_{c}' for c in _PROB)}, {', '.join(f'{R(f"(SELECT avg({c}) FROM dl)")} AS overall_{c}' for c in COLUMNS)},
  {R('(SELECT avg(d) FROM c)')} AS overall_mace""")
def eva17_overall(t: Tables):
    cols = ["overall_rmse", "mean_discontinuity", *[f"overall_{c}" for c in (*_PROB, *COLUMNS)], "overall_mace"]
    return rounded(nocturnal_evaluation(t)["overall"].select("total_episodes", *cols), *cols)


@query("eva17_nocturnal_by_step", f"""
WITH {_STEPS}, b AS (SELECT k, {_INTERVALS} FROM st GROUP BY k)
SELECT CAST(k - {CTX - 1} AS INTEGER) AS step, {', '.join(f'{R(c)} AS {c}' for c in _PROB[2:])} FROM b""")
def eva17_step(t: Tables):
    return rounded(nocturnal_evaluation(t)["by_step"], *_PROB[2:])


@query("eva18_sliding_evaluation", f"""
WITH ser AS (SELECT user_id AS p_num, epoch_us(ts) // 1000000 AS t, value / 5.0173 AS bg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
m AS (SELECT p_num, max(pos) + 1 AS n FROM ser GROUP BY p_num),
i AS (SELECT p_num, unnest(range(0, (n - {CTX + FH}) // {FH} + 1)) AS w FROM m WHERE n >= {CTX + FH}),
x AS (SELECT i.p_num, w, pos - w * {FH} AS k, bg FROM i JOIN ser USING (p_num) WHERE pos BETWEEN w * {FH} AND w * {FH} + {CTX + FH - 1}),
f AS (SELECT p_num, w, max(bg) FILTER (k = {CTX - 1}) AS f FROM x GROUP BY ALL),
pp AS (SELECT p_num, count(DISTINCT w) AS n, sqrt(avg((f - bg) ** 2)) AS rmse, avg(abs(f - bg)) AS mae, avg(abs(f - bg) / greatest(abs(bg), 2.220446049250313e-16)) * 100 AS mape
  FROM x JOIN f USING (p_num, w) WHERE k >= {CTX} GROUP BY p_num)
SELECT {R('sqrt(sum(rmse * rmse * n) / sum(n))')} AS rmse, {R('sum(mae * n) / sum(n)')} AS mae, {R('sum(mape * n) / sum(n)', 4)} AS mape, CAST(sum(n) AS BIGINT) AS n_episodes FROM pp""")
def eva18(t: Tables):
    from .catalog import RAW_KEYS, series
    from .evaluation import evaluate_sliding

    out = evaluate_sliding(series(t), CTX, FH, RAW_KEYS)["overall"]
    return rounded(rounded(out, "rmse", "mae"), "mape", places=4)
