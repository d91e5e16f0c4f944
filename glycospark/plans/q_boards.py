"""Leaderboards over run tables.

A run is an order: the priority names the model, the customer's region the data
set, the status the mode, and the price gives the metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import leaderboard as L
from .catalog import R, Tables, query, r
from .q_metrics import PT, point, rounded

# run folder data of an order: covariates, config folder, checkpoint
MODELS = ("naive_baseline/Naive", "statistical/Theta", "tide", "chronos2", "moirai")
REGIONS = ("aleppo_2017", "brown_2019", "lynch_2022", "tamborlane_2008", "other_2000")
COVS = (["iob", "hour_sin"], ["IOB", "cob"], ["hour_sin"], ["carbs"], [])

_M = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
_D = "[" + ", ".join(f"'{d}'" for d in REGIONS) + "]"
_C = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in cs) + "]" + ("::VARCHAR[]" if not cs else "") for cs in COVS) + "]"

RUNS = f"""runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'runs/' || o_orderkey AS run_path, {_M}[CAST(left(o_orderpriority, 1) AS INTEGER)] AS model,
    {_D}[n_regionkey + 1] AS dataset, CASE o_orderstatus WHEN 'O' THEN 'zeroshot' WHEN 'F' THEN 'finetuned' END AS mode,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'ckpt/long_run/step_' || (o_custkey % 7 * 100) END AS checkpoint, o_orderdate AS timestamp,
    CASE WHEN o_custkey % 2 = 0 THEN '512ctx_96fh' ELSE '256ctx_72fh' END AS ctx_fh, CASE WHEN o_custkey % 2 = 0 THEN 96 ELSE 72 END AS forecast_length,
    CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_totalprice / 100003 END AS rmse, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 1009 END AS wql,
    {_C}[o_orderkey % 5 + 1] AS covariate_cols, CASE WHEN o_orderkey % 4 = 0 THEN 'holdout_5pct' ELSE 'holdout_10pct' END AS config_dir
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""

LATEST = f"""{RUNS},
lt AS (SELECT * REPLACE (coalesce(mode, '') AS mode, coalesce(checkpoint, '') AS checkpoint) FROM runs
  QUALIFY row_number() OVER (PARTITION BY model, dataset, coalesce(mode, ''), coalesce(checkpoint, ''), ctx_fh ORDER BY timestamp DESC, run_id DESC) = 1)"""

BUCKET = """CASE WHEN mode = 'zeroshot' THEN 'zero_shot' WHEN list_has_any(lc, ['iob', 'ia', 'insulin_availability']) AND list_has_any(lc, ['cob', 'carb_availability', 'carbs']) THEN 'iob_cob'
  WHEN list_has_any(lc, ['iob', 'ia', 'insulin_availability']) THEN 'iob' ELSE 'bg_only' END"""
BUCKETED = f"""{LATEST},
bk AS (SELECT *, {BUCKET} AS cov_bucket, array_to_string(list_sort(covariate_cols), ',') AS cov_variant FROM (SELECT *, list_transform(covariate_cols, lambda c: lower(c)) AS lc FROM lt))"""

_BEST = "rmse, wql IS NULL, wql, timestamp DESC, run_id"
BEST = f"""{BUCKETED},
best AS (SELECT model, dataset, cov_bucket, first(run_id ORDER BY {_BEST}) AS run_id, first(rmse ORDER BY {_BEST}) AS rmse,
  first(wql ORDER BY {_BEST}) FILTER (wql IS NOT NULL) AS wql, first(cov_variant ORDER BY {_BEST}) AS cov_variant
  FROM bk WHERE rmse IS NOT NULL GROUP BY ALL)"""


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def runs(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey")
    o, cust = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey")), F.col("o_custkey")
    covs = F.element_at(F.array(*[F.array(*map(F.lit, cs)).cast("array<string>") for cs in COVS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string")).alias("run_path"),
        _pick(MODELS, F.substring("o_orderpriority", 1, 1).cast("int")).alias("model"),
        _pick(REGIONS, F.col("n_regionkey") + 1).alias("dataset"),
        F.when(F.col("o_orderstatus") == "O", "zeroshot").when(F.col("o_orderstatus") == "F", "finetuned").alias("mode"),
        F.when(cust % 3 != 0, F.concat(F.lit("ckpt/long_run/step_"), (cust % 7 * 100).cast("string"))).alias("checkpoint"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(cust % 2 == 0, "512ctx_96fh").otherwise("256ctx_72fh").alias("ctx_fh"),
        F.when(cust % 2 == 0, 96).otherwise(72).alias("forecast_length"),
        F.when(cust % 11 != 0, F.col("o_totalprice") / 100003).alias("rmse"),
        F.when(cust % 5 != 0, F.col("c_acctbal") / 1009).alias("wql"),
        covs.alias("covariate_cols"),
        F.when(F.col("o_orderkey") % 4 == 0, "holdout_5pct").otherwise("holdout_10pct").alias("config_dir"),
    )


def configs(t: Tables) -> DataFrame:
    return runs(t).select("run_path", "covariate_cols", "config_dir")


def plain(t: Tables) -> DataFrame:
    return runs(t).drop("covariate_cols", "config_dir")


def bucketed(t: Tables) -> DataFrame:
    return L.attach_buckets(L.latest_runs(plain(t)), configs(t))


def best(t: Tables) -> DataFrame:
    return L.pick_best(bucketed(t))


@query("ldb1_run_table", f"WITH {RUNS} SELECT run_id, model, dataset, {R('rmse')} AS rmse FROM runs")
def ldb1(t: Tables):
    return L.summarise(runs(t)).select("run_id", "model", "dataset", r("rmse").alias("rmse"))


@query("ldb2_latest_runs", f"WITH {LATEST} SELECT run_id, model, dataset, mode, checkpoint, ctx_fh FROM lt")
def ldb2(t: Tables):
    return L.latest_runs(runs(t)).select("run_id", "model", "dataset", "mode", "checkpoint", "ctx_fh")


@query("ldb3_covariate_buckets", f"WITH {BUCKETED} SELECT run_id, cov_bucket, cov_variant FROM bk")
def ldb3(t: Tables):
    return bucketed(t).select("run_id", "cov_bucket", "cov_variant")


@query("ldb4_config_dir", f"WITH {RUNS} SELECT run_id, config_dir FROM runs WHERE config_dir = 'holdout_10pct'")
def ldb4(t: Tables):
    return L.filter_config_dir(L.attach_config_dir(plain(t), configs(t)), "holdout_10pct").select("run_id", "config_dir")


_CLASS = "CASE model WHEN 'naive_baseline/Naive' THEN 'naive' WHEN 'statistical/Theta' THEN 'statistical' WHEN 'tide' THEN 'deep_learning' ELSE 'foundation' END"
_WIDE = ", ".join(f"{R(f'max({m}) FILTER (dataset = {chr(39)}{d}{chr(39)})')} AS {d}__{m}" for d in L.DATASETS for m in ("rmse", "wql"))


@query("ldb5_wide_pivot", f"WITH {BEST} SELECT {_CLASS} AS model_class, model, cov_bucket, {_WIDE} FROM best WHERE dataset <> 'other_2000' GROUP BY ALL")
def ldb5(t: Tables):
    wide = L.pivot_wide(L.attach_properties(best(t), L.model_properties(t.spark)), metrics=("rmse", "wql"))
    return rounded(wide, *[c for c in wide.columns if "__" in c])


_VALID = "valid(dataset, cov_bucket) AS (VALUES ('aleppo_2017', 'iob_cob'), ('aleppo_2017', 'iob'), ('brown_2019', 'iob'), ('lynch_2022', 'iob'))"


@query("ldb6_misplaced", f"""
WITH {BEST}, {_VALID} SELECT model, dataset, cov_bucket, cov_variant, {_CLASS} AS model_class FROM best
WHERE cov_bucket NOT IN ('zero_shot', 'bg_only') AND (dataset, cov_bucket) NOT IN (SELECT (dataset, cov_bucket) FROM valid)""")
def ldb6(t: Tables):
    classed = L.attach_properties(best(t), L.model_properties(t.spark))
    return L.misplaced_combinations(classed, L.valid_buckets(t.spark)).select("model", "dataset", "cov_bucket", "cov_variant", "model_class")


@query("ldb7_model_properties", f"""
WITH {RUNS}, x AS (SELECT run_id, CASE WHEN o > 0 THEN model || '/large' ELSE model END AS model, model AS m0, o FROM (SELECT *, CAST(run_id AS BIGINT) % 2 AS o FROM runs))
SELECT run_id, model, CASE WHEN m0 IN ('naive_baseline/Naive', 'statistical/Theta') AND o > 0 THEN 'deep_learning' ELSE {_CLASS.replace('CASE model', 'CASE m0')} END AS model_class,
  m0 IN ('chronos2', 'moirai') AS supports_past_covariates FROM x""")
def ldb7(t: Tables):
    odd = F.col("run_id").cast("long") % 2 > 0
    src = runs(t).select("run_id", F.when(odd, F.concat("model", F.lit("/large"))).otherwise(F.col("model")).alias("model"))
    return L.attach_properties(src, L.model_properties(t.spark)).select("run_id", "model", "model_class", "supports_past_covariates")


_ONLY96 = BEST.replace("FROM runs\n  QUALIFY", "FROM runs WHERE forecast_length = 96\n  QUALIFY")


@query("ldb8_grand_summary_best", f"WITH {_ONLY96} SELECT model, dataset, cov_bucket, run_id, {R('rmse')} AS rmse, {R('wql')} AS wql FROM best")
def ldb8(t: Tables):
    out = L.grand_summary(plain(t), L.model_properties(t.spark), L.valid_buckets(t.spark), configs(t), metrics=("rmse", "wql"))
    return rounded(out["best_runs_long"].select("model", "dataset", "cov_bucket", "run_id", "rmse", "wql"), "rmse", "wql")


_PROPS = ", ".join(f"('{m}', {str(p[1]).lower()}, {str(p[2]).lower()}, {str(p[3]).lower()})" for m, p in L.MODELS.items())
_EXPECT = f"""pr(model, zs, ft, pc) AS (VALUES {_PROPS}), ds AS (SELECT unnest({_D.replace(", 'other_2000'", "")}) AS dataset), {_VALID},
ex AS (SELECT model, dataset, 'zero_shot' AS cov_bucket FROM pr, ds WHERE zs UNION SELECT model, dataset, 'bg_only' FROM pr, ds WHERE ft
  UNION SELECT model, dataset, cov_bucket FROM pr JOIN valid ON ft AND pc)"""


@query("ldb8_grand_summary_missing", f"""
WITH {_ONLY96}, {_EXPECT} SELECT * FROM ex EXCEPT SELECT model, dataset, cov_bucket FROM best""")
def ldb8_missing(t: Tables):
    return L.grand_summary(plain(t), L.model_properties(t.spark), L.valid_buckets(t.spark), configs(t), metrics=("rmse", "wql"))["missing_combinations"]


@query("set4_expected_combinations", f"""
WITH {RUNS}, {_EXPECT}, n AS (SELECT model, dataset, count(*) AS n_runs FROM runs GROUP BY ALL)
SELECT model, dataset, cov_bucket, coalesce(n_runs, 0) AS n_runs FROM ex LEFT JOIN n USING (model, dataset)""")
def set4(t: Tables):
    expected = L.expected_combinations(L.model_properties(t.spark), L.valid_buckets(t.spark))
    n = runs(t).groupBy("model", "dataset").agg(F.count("*").alias("n_runs"))
    return expected.join(n, ["model", "dataset"], "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))


@query("join14_missing_combinations", f"WITH {BEST}, {_EXPECT} SELECT * FROM ex EXCEPT SELECT model, dataset, cov_bucket FROM best")
def join14(t: Tables):
    return L.missing_combinations(L.expected_combinations(L.model_properties(t.spark), L.valid_buckets(t.spark)), best(t))


@query("top2_best_per_group", f"WITH {BEST} SELECT model, dataset, cov_bucket, run_id, {R('rmse')} AS rmse, {R('wql')} AS wql, cov_variant FROM best")
def top2(t: Tables):
    return rounded(best(t).select("model", "dataset", "cov_bucket", "run_id", "rmse", "wql", "cov_variant"), "rmse", "wql")


@query("top2_best_row", f"""
WITH {BUCKETED} SELECT model, dataset, cov_bucket, run_id, {R('wql')} AS wql FROM bk WHERE rmse IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY model, dataset, cov_bucket ORDER BY {_BEST}) = 1""")
def top2_row(t: Tables):
    return rounded(L.pick_best(bucketed(t), column_wise=False).select("model", "dataset", "cov_bucket", "run_id", "wql"), "wql")


def _argmin_sql(groups: str, where: str = "", metric: str = "rmse") -> str:
    return f"""WITH {RUNS} SELECT {groups}, run_id, {R('rmse')} AS rmse FROM runs WHERE {metric} IS NOT NULL {where}
QUALIFY row_number() OVER (PARTITION BY {groups} ORDER BY {metric}, run_id) = 1"""


@query("top3_best_by_model_dataset", _argmin_sql("model, dataset"))
def top3(t: Tables):
    return rounded(L.best_by_metric(runs(t), ["model", "dataset"]).select("model", "dataset", "run_id", "rmse"), "rmse")


@query("top3_best_by_model", _argmin_sql("model", metric="wql"))
def top3_model(t: Tables):
    return rounded(L.best_by_metric(runs(t), ["model"], "wql").select("model", "run_id", "rmse"), "rmse")


@query("top6_best_by_mode", _argmin_sql("model, mode", "AND dataset = 'brown_2019' AND forecast_length = 96"))
def top6(t: Tables):
    pool = runs(t).where("dataset = 'brown_2019' and forecast_length = 96")
    return rounded(L.best_by_metric(pool, ["model", "mode"]).select("model", "mode", "run_id", "rmse"), "rmse")


_EP = f"{PT}, er AS (SELECT run, p_num, CAST(episode AS VARCHAR) AS episode_id, round(sqrt(avg((forecast - actual) ** 2)), 9) AS rmse FROM pt GROUP BY ALL)"


def _episode_rmse(t: Tables) -> DataFrame:
    e = F.pow(F.col("forecast") - F.col("actual"), 2)
    return point(t).groupBy("run", "p_num", F.col("episode").cast("string").alias("episode_id")).agg(F.round(F.sqrt(F.avg(e)), 9).alias("rmse"))


@query("top4_best_and_worst_episodes", f"""
WITH {_EP} (SELECT episode_id, {R('rmse')} AS rmse, 'best' AS rank_group FROM er ORDER BY er.rmse, episode_id LIMIT 5)
UNION ALL (SELECT episode_id, {R('rmse')}, 'worst' FROM er ORDER BY er.rmse DESC, episode_id LIMIT 5)""")
def top4(t: Tables):
    return rounded(L.best_and_worst(_episode_rmse(t), 5).select("episode_id", "rmse", "rank_group"), "rmse")


@query("top5_percentile_episode", f"""
WITH {_EP}, k AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY rmse, episode_id) - 1 AS rn, count(*) OVER (PARTITION BY p_num) AS n FROM er)
SELECT p_num, episode_id, {R('rmse')} AS rmse FROM k WHERE rn = round_even(0.9 * (n - 1), 0)""")
def top5(t: Tables):
    return rounded(L.percentile_episode(_episode_rmse(t), 90).select("p_num", "episode_id", "rmse"), "rmse")


@query("top7_best_from_forecasts", f"""
WITH {PT}, s AS (SELECT step, run, sqrt(avg((forecast - actual) ** 2)) AS rmse FROM pt WHERE run <> '1-URGENT' GROUP BY ALL)
SELECT step, arg_min(run, (rmse, run)) AS run, {R('min(rmse)')} AS rmse FROM s GROUP BY step""")
def top7(t: Tables):
    leaky = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("run")).distinct()
    return rounded(L.best_from_forecasts(point(t), ["step"], exclude=leaky), "rmse")


@query("top8_first_usable_run", f"""
WITH {RUNS} SELECT model, dataset, run_id, {R('rmse')} AS rmse FROM runs WHERE rmse IS NOT NULL AND CAST(run_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
QUALIFY row_number() OVER (PARTITION BY model, dataset ORDER BY runs.rmse, run_id) = 1""")
def top8(t: Tables):
    usable = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("run_id"))
    return rounded(L.best_available(runs(t), usable, ["model", "dataset"]).select("model", "dataset", "run_id", "rmse"), "rmse")


@query("top9_best_bucket", f"""
WITH {BUCKETED}, m AS (SELECT model, dataset, cov_bucket, round(avg(wql), 9) AS m FROM bk GROUP BY ALL HAVING avg(wql) IS NOT NULL),
t AS (SELECT model, dataset, arg_min(cov_bucket, (-m, cov_bucket)) AS cov_bucket FROM m GROUP BY ALL)
SELECT run_id, model, dataset, cov_bucket FROM bk JOIN t USING (model, dataset, cov_bucket)""")
def top9(t: Tables):
    return L.best_bucket(bucketed(t), metric="wql").select("run_id", "model", "dataset", "cov_bucket")


_SPLIT = f"""{RUNS}, {PT},
br AS (SELECT model, dataset, run_id FROM runs WHERE rmse IS NOT NULL AND CAST(run_id AS BIGINT) IN (SELECT episode FROM pt)
  QUALIFY row_number() OVER (PARTITION BY model, dataset ORDER BY runs.rmse, run_id) = 1),
se AS (SELECT episode, p_num, step, (forecast - actual) ** 2 AS se, CASE WHEN step <= 3 THEN 'patient' ELSE 'temporal' END AS split_type FROM pt)"""


@query("ldb9_best_split_breakdown", f"""
WITH {_SPLIT} SELECT model, dataset, run_id, s.split_type, count(se) AS n_episodes, {R('sqrt(avg(se))')} AS rmse
FROM br CROSS JOIN (VALUES ('patient'), ('temporal')) s(split_type) LEFT JOIN se ON se.episode = CAST(br.run_id AS BIGINT) AND se.split_type = s.split_type GROUP BY ALL""")
def ldb9(t: Tables):
    from ..operators.metrics import by_split

    e = F.pow(F.col("forecast") - F.col("actual"), 2)
    rows = point(t).select(F.col("episode").cast("string").alias("run_id"), e.alias("se"), F.when(F.col("step") <= 3, "patient").otherwise("temporal").alias("split_type"))
    top = L.best_available(runs(t), rows.select("run_id"), ["model", "dataset"]).select("model", "dataset", "run_id")
    return rounded(by_split(rows.join(top, "run_id"), ["model", "dataset", "run_id"], [F.sqrt(F.avg("se")).alias("rmse")]), "rmse")


@query("ldb9_best_classification", f"""
WITH {RUNS}, b AS (SELECT model, dataset, coalesce(mode, '') AS mode, wql > 4 AS y, round(rmse, 6) AS s FROM runs WHERE rmse IS NOT NULL AND wql IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY model, dataset, mode ORDER BY s) + (count(*) OVER (PARTITION BY model, dataset, mode, s) - 1) / 2.0 AS rk FROM b),
a AS (SELECT model, dataset, mode, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn, sum(rk) FILTER (y) AS rs FROM k GROUP BY ALL),
u AS (SELECT *, (rs - np * (np + 1) / 2.0) / (np * nn) AS auroc FROM a WHERE np > 0 AND nn > 0)
SELECT model, dataset, mode, {R('auroc')} AS auroc FROM u QUALIFY row_number() OVER (PARTITION BY model, dataset ORDER BY round(auroc, 9) DESC, mode) = 1""")
def ldb9_classification(t: Tables):
    from ..operators.classify import classification

    src = runs(t).where("rmse is not null and wql is not null").select(
        "model", "dataset", F.coalesce("mode", F.lit("")).alias("mode"), (F.col("wql") > 4).alias("y"), F.round("rmse", 6).alias("s"))
    scored = classification(src, ["model", "dataset", "mode"], "s", "y").where("auroc is not null")
    top = scored.groupBy("model", "dataset").agg(F.min_by(F.struct("mode", "auroc"), F.struct(-F.round("auroc", 9), "mode")).alias("_r"))
    return rounded(top.select("model", "dataset", "_r.*"), "auroc")


@query("ldb10_step_sweep", f"""
WITH {RUNS} SELECT run_id, CAST(CASE WHEN regexp_extract(coalesce(checkpoint, ''), 'step_([0-9]+)', 1) <> '' THEN CAST(regexp_extract(checkpoint, 'step_([0-9]+)', 1) AS INTEGER)
  WHEN mode = 'zeroshot' THEN 0 ELSE 50000 END AS INTEGER) AS train_step, CASE WHEN contains(checkpoint, 'long_run') THEN 'long' WHEN contains(checkpoint, 'short') THEN 'short' ELSE 'other' END AS series FROM runs""")
def ldb10(t: Tables):
    return L.step_sweep(runs(t), {"long_run": "long", "short": "short"}, 50_000).select("run_id", "train_step", "series")


@query("ldb10_zero_shot_attached", f"""
WITH {RUNS}, s AS (
  SELECT run_id, dataset, timestamp, mode, CASE WHEN mode = 'zeroshot' THEN 0 WHEN regexp_extract(coalesce(checkpoint, ''), 'step_([0-9]+)', 1) <> ''
      THEN CAST(regexp_extract(checkpoint, 'step_([0-9]+)', 1) AS INTEGER) ELSE 50000 END AS train_step,
    CASE WHEN contains(checkpoint, 'step_1') THEN 'one' WHEN contains(checkpoint, 'step_2') THEN 'two' ELSE 'other' END AS series FROM runs),
x AS (SELECT * EXCLUDE (series, mode), unnest(CASE WHEN mode = 'zeroshot' THEN ['one', 'two'] ELSE [series] END) AS series FROM s)
SELECT CAST(train_step AS INTEGER) AS train_step, series, dataset, run_id FROM x
QUALIFY row_number() OVER (PARTITION BY train_step, series, dataset ORDER BY timestamp DESC, run_id DESC) = 1""")
def ldb10_attached(t: Tables):
    return L.sweep_table(runs(t), {"step_1": "one", "step_2": "two"}, 50_000).select("train_step", "series", "dataset", "run_id")
