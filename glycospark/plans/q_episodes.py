"""Midnight, sliding, day/night and packed episodes, and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import episodes as E, gaps as G, metrics as M, splits as S
from ..operators.profile import cohort_summary, gap_sensitivity, holdout_characteristics
from .catalog import GRID, GRID_KEYS, R, RAW_KEYS, STEP, Tables, epoch, grid, query, r, series

CTX, FH, GAP = 4, 3, 1
ROWS = CTX + FH


def text(col, places: int = 4):
    """Array of numbers as text, so that both engines compare it alike."""
    show = lambda v: F.when(v.isNull(), "-").otherwise(F.format_string(f"%.{places}f", F.round(v, places) + 0))
    return F.array_join(F.transform(col, show), " ")


def text_sql(expr: str, order: str = "k", places: int = 4) -> str:
    return f"string_agg(coalesce(printf('%.{places}f', round({expr}, {places}) + 0.0), '-'), ' ' ORDER BY {order})"


# Windows anchored at midnight: w has one row per window row, v one per window.
MIDNIGHT = f"""{GRID},
a AS (SELECT p_num, 86400 * unnest(range((lo + {CTX * STEP} + 86399) // 86400, (hi - {(FH - 1) * STEP}) // 86400 + 1)) AS anchor
      FROM (SELECT p_num, min(t) AS lo, max(t) AS hi FROM g GROUP BY p_num)),
w0 AS (SELECT a.p_num, a.anchor, (g.t - a.anchor) // {STEP} + {CTX} AS k, g.bg FROM a JOIN g ON g.p_num = a.p_num
       AND g.t >= a.anchor - {CTX * STEP} AND g.t < a.anchor + {FH * STEP}),
w1 AS (SELECT *, max(CASE WHEN bg IS NOT NULL THEN k END) OVER (PARTITION BY p_num, anchor ORDER BY k) AS ak,
       min(CASE WHEN bg IS NOT NULL THEN k END) OVER (PARTITION BY p_num, anchor ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bk FROM w0),
w AS (SELECT w1.p_num, w1.anchor, w1.k, w1.bg, CASE WHEN w1.bg IS NOT NULL THEN w1.bg WHEN bk - ak - 1 <= {GAP}
        THEN x.bg + (y.bg - x.bg) * (w1.k - ak) / (bk - ak) END AS y
      FROM w1 LEFT JOIN w0 x ON x.p_num = w1.p_num AND x.anchor = w1.anchor AND x.k = ak
        LEFT JOIN w0 y ON y.p_num = w1.p_num AND y.anchor = w1.anchor AND y.k = bk),
v AS (SELECT p_num, anchor, count(y) = {ROWS} AS usable, count(bg) < {ROWS} AND count(y) = {ROWS} AS interpolated FROM w GROUP BY ALL)"""

EPISODES = f"""{MIDNIGHT},
ep AS (SELECT w.p_num, w.anchor, w.k, w.y FROM w JOIN v USING (p_num, anchor) WHERE usable)"""


def midnight(t: Tables) -> DataFrame:
    return E.midnight_episodes(grid(t), CTX, FH, STEP, covariates=("food_g", "rate"), max_gap=GAP, gridded=True)


@query("epi1_midnight_episodes", f"""
WITH {MIDNIGHT}
SELECT p_num, anchor, {text_sql('y')} FILTER (k < {CTX}) AS context, {text_sql('y')} FILTER (k >= {CTX}) AS target
FROM w JOIN v USING (p_num, anchor) WHERE usable GROUP BY ALL""")
def epi1(t: Tables):
    return E.usable(midnight(t)).select("p_num", epoch("anchor").alias("anchor"), text("context").alias("context"), text("target").alias("target"))


# duplicates on the grid and stamps beside it; the last event of a stamp counts
_UNGRIDDED = f"""raw AS (SELECT user_id AS p_num, event_id, epoch_us(ts) // 1000000 // {STEP} * {STEP} AS slot, event_id % 4 = 0 AS beside, value / 5.0173 AS bg FROM events),
lim AS (SELECT p_num, min(slot) AS lo, max(slot) AS hi FROM raw GROUP BY p_num),
kept AS (SELECT p_num, slot, arg_max(bg, event_id) AS bg FROM raw WHERE NOT beside GROUP BY ALL),
g AS (SELECT x.p_num, x.t, bg FROM (SELECT p_num, unnest(range(lo, hi + 1, {STEP})) AS t FROM lim) x LEFT JOIN kept ON kept.p_num = x.p_num AND kept.slot = x.t)"""


@query("epi1_ungridded_episodes", f"""
WITH {MIDNIGHT.replace(GRID, _UNGRIDDED, 1)}
SELECT p_num, anchor, usable, CASE WHEN usable THEN {text_sql('y')} FILTER (k < {CTX}) END AS context, CASE WHEN usable THEN {text_sql('y')} FILTER (k >= {CTX}) END AS target
FROM w JOIN v USING (p_num, anchor) GROUP BY p_num, anchor, usable""")
def epi1_ungridded(t: Tables):
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / STEP) * STEP + F.when(F.col("event_id") % 4 == 0, 7).otherwise(0)
    stamp = F.timestamp_seconds(slot).cast("timestamp_ntz")
    src = t.events.select(F.col("user_id").alias("p_num"), stamp.alias("datetime"), (F.col("value") / 5.0173).alias("bg_mM"), "event_id")
    eps = E.midnight_episodes(src, CTX, FH, STEP, max_gap=GAP, order=F.col("event_id"))
    shown = {c: F.when(F.col("usable"), text(c)).alias(c) for c in ("context", "target")}
    return eps.select("p_num", epoch("anchor").alias("anchor"), "usable", *shown.values())


@query("epi1_skip_statistics", f"""
WITH {MIDNIGHT} SELECT p_num, count(*) AS total_anchors, count(*) FILTER (NOT usable) AS skipped_bg_nan, count(*) FILTER (interpolated) AS interpolated_episodes
FROM v GROUP BY p_num""")
def epi1_stats(t: Tables):
    return E.episode_stats(midnight(t))


_COV = f"""
c0 AS (SELECT a.p_num, a.anchor, (g.t - a.anchor) // {STEP} + {CTX} AS k, g.bg, CASE WHEN food > 0 THEN food END AS food FROM a JOIN g ON g.p_num = a.p_num
       AND g.t >= a.anchor - {CTX * STEP} AND g.t < a.anchor + {FH * STEP}),
c1 AS (SELECT *, coalesce(last_value(food IGNORE NULLS) OVER (PARTITION BY p_num, anchor, k < {CTX} ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS ff FROM c0),
ok AS (SELECT p_num, anchor FROM c0 GROUP BY ALL HAVING count(bg) = {ROWS} AND count(food) FILTER (k < {CTX}) >= {CTX} * 0.25)"""


@query("epi2_covariate_episodes", f"""
WITH {MIDNIGHT}, {_COV}
SELECT p_num, anchor, {text_sql('bg')} FILTER (k >= {CTX}) AS target, {text_sql('ff')} FILTER (k < {CTX}) AS context_food,
  {text_sql('ff')} FILTER (k >= {CTX}) AS future_food, {R(f'max(ff) FILTER (k = {CTX - 1})')} AS anchor_food
FROM c1 JOIN ok USING (p_num, anchor) GROUP BY ALL""")
def epi2(t: Tables):
    src = grid(t).withColumn("food_g", F.when(F.col("food_g") > 0, F.col("food_g")))
    out = E.covariate_episodes(src, CTX, FH, ["food_g"], STEP, min_coverage=0.25, keys=GRID_KEYS)
    return out.select("p_num", epoch("anchor").alias("anchor"), text("target").alias("target"), text("context_food_g").alias("context_food"),
                      text(F.col("future_cov")["food_g"]).alias("future_food"), r("anchor_food_g").alias("anchor_food"))


@query("epi3_patient_episodes", f"""
WITH {EPISODES} SELECT p_num, anchor, {R('avg(y)')} AS mean FROM ep WHERE p_num IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) GROUP BY ALL""")
def epi3(t: Tables):
    held = t.customer.where("c_nationkey < 8").select(F.col("c_custkey").alias("p_num"))
    eps = E.patient_episodes(grid(t), held, CTX, FH, step=STEP, max_gap=GAP, gridded=True)
    mean = F.aggregate(F.concat("context", "target"), F.lit(0.0), lambda a, x: a + x) / ROWS
    return eps.select("p_num", epoch("anchor").alias("anchor"), r(mean).alias("mean"))


def _windows_sql(stride: int, skip: bool, src: str = "g") -> str:
    return f"""
m AS (SELECT p_num, max(pos) + 1 AS n FROM {src} GROUP BY p_num),
i AS (SELECT p_num, unnest(range(0, (n - {ROWS}) // {stride} + 1)) AS window_no FROM m WHERE n >= {ROWS}),
x AS (SELECT i.p_num, window_no, pos - window_no * {stride} AS k, bg, t FROM i JOIN {src} USING (p_num)
      WHERE pos BETWEEN window_no * {stride} AND window_no * {stride} + {ROWS - 1}),
z AS (SELECT p_num, window_no, max(t) FILTER (k = {CTX}) AS anchor, {text_sql('bg')} FILTER (k < {CTX}) AS context,
      {text_sql('bg')} FILTER (k >= {CTX}) AS target FROM x GROUP BY ALL {f'HAVING count(bg) = {ROWS}' if skip else ''})"""


def _windows_out(df):
    return df.select("p_num", "window_no", epoch("anchor").alias("anchor"), text("context").alias("context"), text("target").alias("target"))


@query("epi4_sliding_windows", f"WITH {GRID}, {_windows_sql(FH, False)} SELECT * FROM z")
def epi4(t: Tables):
    return _windows_out(E.row_windows(grid(t), CTX, FH, keys=GRID_KEYS, pos="pos"))


@query("epi4_sliding_windows_raw", f"""
WITH ser AS (SELECT user_id AS p_num, epoch_us(ts) // 1000000 AS t, value / 5.0173 AS bg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
{_windows_sql(FH, False, 'ser')} SELECT * FROM z""")
def epi4_raw(t: Tables):
    return _windows_out(E.row_windows(series(t), CTX, FH, keys=RAW_KEYS))


@query("epi5_complete_windows", f"WITH {GRID}, {_windows_sql(2, True)} SELECT * FROM z")
def epi5(t: Tables):
    return _windows_out(E.row_windows(grid(t), CTX, FH, 2, keys=GRID_KEYS, skip_nulls=True, pos="pos"))


@query("epi6_packed_blocks", f"""
WITH {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY t) - 1 AS i FROM g WHERE bg IS NOT NULL)
SELECT p_num, i // {ROWS} AS block_no, {text_sql('bg', 'i')} AS values_text FROM k GROUP BY ALL HAVING count(*) = {ROWS}""")
def epi6(t: Tables):
    out = E.packed_blocks(grid(t), ROWS, keys=GRID_KEYS)
    return out.select("p_num", "block_no", text("values").alias("values_text"))


@query("epi7_day_night_pairs", """
WITH e AS (SELECT user_id AS p_num, ts, event_id, value / 5.0173 AS bg, CAST(ts AS DATE) AS d, hour(ts) AS h FROM events),
c AS (SELECT p_num, d AS episode_date, string_agg(printf('%.4f', bg), ' ' ORDER BY ts, event_id) AS context FROM e WHERE h >= 6 GROUP BY ALL),
f AS (SELECT p_num, d - 1 AS episode_date, string_agg(printf('%.4f', bg), ' ' ORDER BY ts, event_id) AS target FROM e WHERE h < 6 GROUP BY ALL)
SELECT p_num, CAST(episode_date AS VARCHAR) AS episode_date, context, target FROM c JOIN f USING (p_num, episode_date)""")
def epi7(t: Tables):
    out = E.day_night_pairs(series(t), order=("event_id",))
    return out.select("p_num", F.col("episode_date").cast("string").alias("episode_date"), text("context").alias("context"), text("target").alias("target"))


@query("epi7_day_night_rows", """
WITH e AS (SELECT user_id AS p_num, event_id, CAST(ts AS DATE) AS d, hour(ts) AS h FROM events)
SELECT p_num, event_id, CAST(d AS VARCHAR) AS episode_date, 'context' AS role FROM e WHERE h >= 20
UNION ALL SELECT p_num, event_id, CAST(d - 1 AS VARCHAR), 'context' FROM e WHERE h < 2
UNION ALL SELECT p_num, event_id, CAST(d AS VARCHAR), 'forecast' FROM e WHERE h >= 2 AND h < 8""")
def epi7_rows(t: Tables):
    out = E.day_night_rows(series(t), (20, 2), (2, 8))
    return out.select("p_num", "event_id", F.col("episode_date").cast("string").alias("episode_date"), "role")


@query("epi8_training_pairs", f"""
WITH {GRID},
e AS (SELECT user_id AS p_num, ts, event_id, value / 5.0173 AS bg, CAST(ts AS DATE) AS d, hour(ts) AS h FROM events),
c AS (SELECT p_num, d, count(*) AS nc FROM e WHERE h >= 6 GROUP BY ALL),
f AS (SELECT p_num, d - 1 AS d, count(*) AS nt FROM e WHERE h < 6 GROUP BY ALL),
good AS (SELECT p_num, d FROM c JOIN f USING (p_num, d) WHERE nc >= 3 AND nt >= 2),
rs AS (SELECT p_num, epoch_us(ts) // 1000000 AS t, bg, row_number() OVER (PARTITION BY p_num ORDER BY ts, event_id) - 1 AS pos FROM e
  WHERE p_num NOT IN (SELECT p_num FROM good)),
m AS (SELECT p_num, max(pos) + 1 AS n FROM rs GROUP BY p_num),
i AS (SELECT p_num, unnest(range(0, (n - 6) // 2 + 1)) AS wn FROM m WHERE n >= 6),
x AS (SELECT i.p_num, rs.t FROM i JOIN rs ON rs.p_num = i.p_num AND rs.pos = wn * 2 + 4),
u AS (SELECT p_num, 'day_night' AS kind, CAST(epoch(d) AS BIGINT) AS start FROM good UNION ALL SELECT p_num, 'rolling', t FROM x)
SELECT p_num, kind, start FROM u""")
def epi8(t: Tables):
    out = E.training_pairs(series(t), 3, 2, 4, keys=RAW_KEYS)
    return out.select("p_num", "kind", epoch("start").alias("start"))


def numbered(t: Tables) -> DataFrame:
    return E.episode_ids(E.usable(midnight(t)))


NUMBERED = f"""{EPISODES},
no AS (SELECT p_num, anchor, p_num || '::ep' || lpad(CAST(row_number() OVER (PARTITION BY p_num ORDER BY anchor) - 1 AS VARCHAR), 3, '0') AS episode_id
       FROM (SELECT DISTINCT p_num, anchor FROM ep)),
e AS (SELECT ep.*, episode_id FROM ep JOIN no USING (p_num, anchor))"""


@query("epi9_known_future", f"""
WITH {NUMBERED} SELECT episode_id, CAST(k - {CTX} AS INTEGER) AS k, g.t, {R('food')} AS food_g
FROM e JOIN g ON g.p_num = e.p_num AND g.t = e.anchor + (k - {CTX}) * {STEP} WHERE k >= {CTX}""")
def epi9(t: Tables):
    out = E.known_future(numbered(t), ["food_g"], STEP)
    return out.select("episode_id", "k", epoch(), r("food_g").alias("food_g"))


@query("epi10_panel", f"""
WITH {NUMBERED} SELECT episode_id, CAST(k - {CTX - 3} AS INTEGER) AS k, anchor + (k - {CTX}) * {STEP} AS t, {R('y')} AS bg_mM FROM e WHERE k BETWEEN {CTX - 3} AND {CTX - 1}""")
def epi10(t: Tables):
    return E.panel(numbered(t), STEP, 3).select("episode_id", "k", epoch(), r("bg_mM").alias("bg_mM"))


@query("epi11_episode_export", f"""
WITH {EPISODES} SELECT p_num, anchor, CASE WHEN k < {CTX} THEN 'context' ELSE 'forecast' END AS segment, CAST(k - {CTX} AS INTEGER) AS step,
  {R(f'(k - {CTX}) * {STEP} / 3600.0')} AS hours_from_anchor, {R('y')} AS bg_mM FROM ep""")
def epi11(t: Tables):
    out = E.export_episodes(E.usable(midnight(t)), STEP)
    return out.select("p_num", epoch("anchor").alias("anchor"), "segment", "step", (r("hours_from_anchor") + 0).alias("hours_from_anchor"), r("bg_mM").alias("bg_mM"))


@query("epi12_episode_hypo", f"WITH {EPISODES} SELECT p_num, anchor, min(y) FILTER (k >= {CTX}) < 3.9 AS has_hypo FROM ep GROUP BY ALL")
def epi12(t: Tables):
    return E.usable(midnight(t)).select("p_num", epoch("anchor").alias("anchor"), E.has_hypo(F.col("target")).alias("has_hypo"))


@query("epi13_episode_split_type", f"""
WITH {EPISODES} SELECT p_num, CASE WHEN p_num IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) THEN 'patient' ELSE 'temporal' END AS split_type,
  count(DISTINCT anchor) AS n FROM ep GROUP BY ALL""")
def epi13(t: Tables):
    held = t.customer.where("c_nationkey < 8").select(F.col("c_custkey").alias("p_num"))
    return E.label_split_type(E.usable(midnight(t)), held).groupBy("p_num", "split_type").agg(F.count("*").alias("n"))


@query("epi14_wide_export", f"""
WITH {NUMBERED}, ids AS (SELECT DISTINCT episode_id FROM e)
SELECT CAST(k AS INTEGER) AS step, {R("max(y) FILTER (episode_id = '1::ep000')")} AS ep_a, {R("max(y) FILTER (episode_id = '2::ep000')")} AS ep_b
FROM e WHERE episode_id IN ('1::ep000', '2::ep000') GROUP BY k""")
def epi14(t: Tables):
    out = E.wide_export(numbered(t), ["1::ep000", "2::ep000"], ROWS)
    return out.select("step", r("1::ep000").alias("ep_a"), r("2::ep000").alias("ep_b"))


@query("spl14_stratified_episodes", f"""
WITH {NUMBERED} SELECT episode_id FROM (SELECT episode_id, row_number() OVER (PARTITION BY p_num ORDER BY md5('42|' || episode_id), episode_id) AS rk
FROM (SELECT DISTINCT p_num, episode_id FROM e)) WHERE rk <= 2""")
def spl14(t: Tables):
    return S.sample_episodes(numbered(t), 2).select("episode_id")


@query("join15_covariate_lookup", f"""
WITH {EPISODES} SELECT ep.p_num, anchor, k - {CTX} AS step, {R('rate')} AS rate FROM ep LEFT JOIN g ON g.p_num = ep.p_num AND g.t = ep.anchor + (k - {CTX}) * {STEP} WHERE k < {CTX}""")
def join15(t: Tables):
    g = grid(t)
    rows = E.export_episodes(E.usable(E.midnight_episodes(g, CTX, FH, STEP, max_gap=GAP, gridded=True)), STEP).where("segment = 'context'")
    stamp = F.timestamp_seconds(F.unix_seconds(F.col("anchor").cast("timestamp")) + F.col("step") * STEP).cast("timestamp_ntz")
    out = E.attach_covariate(rows.withColumn("datetime", stamp), g, ["rate"])
    return out.select("p_num", epoch("anchor").alias("anchor"), F.col("step").cast("long").alias("step"), r("rate").alias("rate"))


_COHORT = "CASE WHEN p_num IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) THEN 'patient_holdout' WHEN {t} >= 1705968000 THEN 'temporal_holdout' ELSE 'train' END"


def _cohorts(t: Tables) -> DataFrame:
    held = t.customer.where("c_nationkey < 8").select(F.col("c_custkey").alias("p_num"), F.lit(True).alias("_h"))
    late = F.unix_seconds(F.col("datetime").cast("timestamp")) >= 1_705_968_000
    label = F.when(F.col("_h"), "patient_holdout").when(late, "temporal_holdout").otherwise("train")
    return grid(t).join(held, "p_num", "left").withColumn("cohort", label).select("p_num", "datetime", "bg_mM", "cohort")


COHORT_SQL = f"""
WITH {GRID}, cg AS (SELECT *, {_COHORT.format(t='t')} AS cohort FROM g),
base AS (SELECT cohort, count(DISTINCT p_num) AS n_patients, count(bg) AS n_rows, {R('avg(bg)')} AS mean_bg, {R('stddev_samp(bg)')} AS std_bg FROM cg GROUP BY cohort),
a AS (SELECT p_num, cohort, 86400 * unnest(range((lo + {CTX * STEP} + 86399) // 86400, (hi - {(FH - 1) * STEP}) // 86400 + 1)) AS anchor
      FROM (SELECT p_num, cohort, min(t) AS lo, max(t) AS hi FROM cg GROUP BY ALL)),
w0 AS (SELECT a.p_num, a.cohort, a.anchor, (cg.t - a.anchor) // {STEP} + {CTX} AS k, cg.bg FROM a JOIN cg ON cg.p_num = a.p_num AND cg.cohort = a.cohort
       AND cg.t >= a.anchor - {CTX * STEP} AND cg.t < a.anchor + {FH * STEP}),
w1 AS (SELECT *, max(CASE WHEN bg IS NOT NULL THEN k END) OVER (PARTITION BY p_num, cohort, anchor ORDER BY k) AS ak,
       min(CASE WHEN bg IS NOT NULL THEN k END) OVER (PARTITION BY p_num, cohort, anchor ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bk FROM w0),
w AS (SELECT w1.*, CASE WHEN w1.bg IS NOT NULL THEN w1.bg WHEN bk - ak - 1 <= {GAP} THEN x.bg + (y.bg - x.bg) * (w1.k - ak) / (bk - ak) END AS y
      FROM w1 LEFT JOIN w0 x ON x.p_num = w1.p_num AND x.cohort = w1.cohort AND x.anchor = w1.anchor AND x.k = ak
        LEFT JOIN w0 y ON y.p_num = w1.p_num AND y.cohort = w1.cohort AND y.anchor = w1.anchor AND y.k = bk),
lows AS (SELECT p_num, cohort, anchor, min(y) FILTER (k >= {CTX}) AS lo FROM w GROUP BY ALL HAVING count(y) = {ROWS}),
e AS (SELECT cohort, count(*) AS n, count(*) FILTER (lo < 3.9) AS h, avg(lo) AS ml FROM lows GROUP BY cohort)
SELECT cohort, n_patients, n_rows, mean_bg, std_bg, coalesce(n, 0) AS n_episodes, coalesce(h, 0) AS n_episodes_with_hypo, {R('ml')} AS mean_min_bg,
  {R('h * 1.0 / n')} AS hypo_rate FROM base LEFT JOIN e USING (cohort)"""


@query("agg9_cohort_summary", COHORT_SQL.replace(_COHORT.format(t="t"), "'all'"))
def agg9(t: Tables):
    df = grid(t).select("p_num", "datetime", "bg_mM").withColumn("cohort", F.lit("all"))
    return _rounded(cohort_summary(df, "cohort", CTX, FH, STEP, max_gap=GAP, gridded=True))


@query("agg10_three_way_cohorts", COHORT_SQL)
def agg10(t: Tables):
    return _rounded(cohort_summary(_cohorts(t), "cohort", CTX, FH, STEP, max_gap=GAP, gridded=True))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c) for c in ("mean_bg", "std_bg", "mean_min_bg", "hypo_rate")})


def _cap_sql(cap: int) -> str:
    return EPISODES.replace(f"bk - ak - 1 <= {GAP}", f"bk - ak - 1 <= {cap}")


@query("agg15_gap_sensitivity", f"""
SELECT p_num, n_theoretical, coalesce(a.n, 0) AS n_cap_0, coalesce(b.n, 0) AS n_cap_2 FROM (
  WITH {GRID} SELECT p_num, greatest(0, (max(t) - {(FH - 1) * STEP}) // 86400 - (min(t) + {CTX * STEP} + 86399) // 86400 + 1) AS n_theoretical FROM g GROUP BY p_num)
LEFT JOIN (WITH {_cap_sql(0)} SELECT p_num, count(DISTINCT anchor) AS n FROM ep GROUP BY p_num) a USING (p_num)
LEFT JOIN (WITH {_cap_sql(2)} SELECT p_num, count(DISTINCT anchor) AS n FROM ep GROUP BY p_num) b USING (p_num)""")
def agg15(t: Tables):
    return gap_sensitivity(grid(t).select("p_num", "datetime", "bg_mM"), CTX, FH, STEP, (0, 2))


@query("agg16_holdout_characteristics", f"""
WITH {EPISODES}, l AS (SELECT p_num, anchor, min(y) FILTER (k >= {CTX}) AS lo FROM ep GROUP BY ALL)
SELECT CASE WHEN p_num IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) THEN 'patient' ELSE 'temporal' END AS split_type,
  count(DISTINCT p_num) AS n_patients, count(*) AS n_episodes, count(*) FILTER (lo < 3.9) AS n_hypo, {R('avg(CASE WHEN lo < 3.9 THEN 1.0 ELSE 0.0 END)')} AS hypo_rate
FROM l GROUP BY 1""")
def agg16(t: Tables):
    held = t.customer.where("c_nationkey < 8").select(F.col("c_custkey").alias("p_num"))
    eps = E.label_split_type(E.usable(midnight(t)), held)
    return holdout_characteristics(eps, ["split_type"]).withColumn("hypo_rate", r("hypo_rate"))


# --- flagship: grid, fill, windows, forecast, score ------------------------------------


@query("flagship_patient_scores", f"""
WITH {GRID},
w AS (SELECT *, max(CASE WHEN bg IS NOT NULL THEN pos END) OVER (PARTITION BY p_num ORDER BY t) AS ap,
    min(CASE WHEN bg IS NOT NULL THEN pos END) OVER (PARTITION BY p_num ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp FROM g),
f AS (SELECT w.p_num, w.t, w.pos, CASE WHEN w.bg IS NOT NULL THEN w.bg WHEN bp - ap - 1 <= 2 THEN a.bg + (b.bg - a.bg) * (w.pos - ap) / (bp - ap) END AS bg
  FROM w LEFT JOIN g a ON a.p_num = w.p_num AND a.pos = w.ap LEFT JOIN g b ON b.p_num = w.p_num AND b.pos = w.bp),
{_windows_sql(FH, True, 'f').split('z AS')[0].rstrip().rstrip(',')},
good AS (SELECT p_num, window_no FROM x GROUP BY ALL HAVING count(bg) = {ROWS}),
pr AS (SELECT p_num, window_no, max(bg) FILTER (k = {CTX - 1}) AS forecast FROM x JOIN good USING (p_num, window_no) GROUP BY ALL)
SELECT p_num, count(DISTINCT window_no) AS n_episodes, {R('sqrt(avg((forecast - bg) ** 2))')} AS rmse, {R('avg(abs(forecast - bg))')} AS mae,
  {R('avg(abs(forecast - bg) / greatest(abs(bg), 2.220446049250313e-16)) * 100', 4)} AS mape
FROM x JOIN pr USING (p_num, window_no) WHERE k >= {CTX} GROUP BY p_num""")
def flagship(t: Tables):
    filled = G.interpolate_small_gaps(grid(t), 2, STEP, keys=GRID_KEYS)
    windows = E.row_windows(filled, CTX, FH, keys=GRID_KEYS, skip_nulls=True, pos="pos")
    # forecast and target stay in the episode row, so no join is needed to score them
    steps = windows.select("p_num", "window_no", F.element_at("context", -1).alias("forecast"), F.explode("target").alias("actual"))
    out = steps.groupBy("p_num").agg((F.count("*") / FH).cast("long").alias("n_episodes"), *M.regression_aggs())
    return out.select("p_num", "n_episodes", r("rmse").alias("rmse"), r("mae").alias("mae"), r("mape", 4).alias("mape"))
