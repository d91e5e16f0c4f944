"""Holdouts, validation splits and seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C, splits as S
from ..operators.blocks import DAY
from ..operators.profile import column_matrix, dataset_share
from .catalog import RAW_KEYS, SER, Tables, query, r, series

TEMPORAL = S.TemporalHoldout(0.2, 45, 12)
PATIENTS = S.PatientHoldout(holdout_patients=(1, 4, 7), min_train_patients=2)
SAMPLED = S.PatientHoldout(holdout_percentage=0.2, min_holdout_patients=2, seed=7)
DAY_US = DAY * 1_000_000

_PLAN = """
n AS (SELECT *, row_number() OVER (PARTITION BY p_num ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY p_num) AS n FROM ser),
h AS (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS h0 FROM n),
plan AS (SELECT *, CASE WHEN n - h0 < 45 THEN 'skipped_train' WHEN h0 < 12 AND n - 12 < 45 THEN 'skipped_adjusted'
  WHEN h0 < 12 THEN 'adjusted' ELSE 'ok' END AS split_reason, CASE WHEN h0 < 12 THEN 12 ELSE h0 END AS n_holdout FROM h)"""


@query("spl1_temporal_holdout", f"""
WITH {SER}, {_PLAN}
SELECT p_num, event_id, CASE WHEN rn > n - n_holdout THEN 'holdout' ELSE 'train' END AS split FROM plan WHERE split_reason IN ('ok', 'adjusted')""")
def spl1(t: Tables):
    return S.temporal_split(series(t), TEMPORAL, RAW_KEYS).select("p_num", "event_id", "split")


@query("spl1_split_reasons", f"""
WITH {SER}, {_PLAN} SELECT DISTINCT p_num, n AS n_rows, CAST(n_holdout AS BIGINT) AS n_holdout, split_reason FROM plan""")
def spl1_reasons(t: Tables):
    counts = series(t).groupBy("p_num").agg(F.count("*").alias("n_rows"))
    return S.temporal_plan(counts, TEMPORAL)


@query("spl2_patient_holdout_list", "SELECT event_id, user_id AS p_num, CASE WHEN user_id IN (1, 4, 7) THEN 'holdout' ELSE 'train' END AS split FROM events")
def spl2_list(t: Tables):
    return S.patient_split(series(t), PATIENTS).select("event_id", "p_num", "split")


_RANKED = """ids AS (SELECT DISTINCT user_id AS p_num FROM events),
ranked AS (SELECT p_num, row_number() OVER (ORDER BY md5('{seed}|' || p_num), p_num) AS place, count(*) OVER () AS n FROM ids)"""


@query("spl2_patient_holdout_sampled", f"""
WITH {_RANKED.format(seed=7)}
SELECT event_id, p_num, CASE WHEN place <= greatest(2, floor(n * 0.2)) THEN 'holdout' ELSE 'train' END AS split
FROM events JOIN ranked ON p_num = user_id""")
def spl2_sampled(t: Tables):
    return S.patient_split(series(t), SAMPLED).select("event_id", "p_num", "split")


_HYBRID = f"""
WITH {SER}, {_PLAN}, y AS (
  SELECT p_num, event_id, CASE WHEN p_num IN (1, 4, 7) THEN 'patient' WHEN rn > n - n_holdout THEN 'temporal' ELSE 'train' END AS split_type
  FROM plan WHERE p_num IN (1, 4, 7) OR split_reason IN ('ok', 'adjusted'))
SELECT p_num, event_id, split_type, CASE WHEN split_type = 'train' THEN 'train' ELSE 'holdout' END AS split FROM y"""


@query("spl3_hybrid_holdout", _HYBRID)
def spl3(t: Tables):
    return S.hybrid_split(series(t), PATIENTS, TEMPORAL, RAW_KEYS).select("p_num", "event_id", "split_type", "split")


@query("spl4_split_dispatch", f"SELECT p_num, split, count(*) AS n FROM ({_HYBRID}) GROUP BY ALL")
def spl4(t: Tables):
    cfg = S.HoldoutConfig("events", "hybrid", TEMPORAL, PATIENTS)
    src = series(t).withColumn("source_id", F.col("p_num")).withColumn("p_num", F.when(F.col("msg_type") != "error", F.col("p_num")))
    return S.split(src, cfg, RAW_KEYS, "source_id").groupBy("p_num", "split").agg(F.count("*").alias("n"))


@query("prj19_fill_patient_id", """
SELECT user_id AS p_num, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_filled FROM events GROUP BY 1""")
def prj19(t: Tables):
    src = series(t).withColumn("source_id", F.col("p_num")).withColumn("p_num", F.when(F.col("msg_type") != "error", F.col("p_num")))
    return S.fill_patient_id(src, "source_id").groupBy("p_num").agg(F.count("*").alias("n_rows"), F.count_if("id_filled").alias("n_filled"))


@query("spl5_holdout_list", f"WITH {_RANKED.format(seed=42)} SELECT p_num FROM ranked WHERE place <= greatest(1, floor(n * 0.1))")
def spl5(t: Tables):
    return S.holdout_patients(series(t), S.PatientHoldout(holdout_percentage=0.1))


@query("spl6_validate_split", f"""
WITH y AS ({_HYBRID}), e AS (SELECT y.*, epoch_us(ts) AS us FROM y JOIN events USING (event_id)),
p AS (SELECT p_num, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'holdout') AS ho,
  max(us) FILTER (split = 'train') AS lt, min(us) FILTER (split = 'holdout') AS fh FROM e GROUP BY p_num)
SELECT CAST(sum(tr) AS BIGINT) AS train_rows, CAST(sum(ho) AS BIGINT) AS holdout_rows, count(*) FILTER (tr > 0) AS train_patients,
  count(*) FILTER (ho > 0) AS holdout_patients, count(*) FILTER (tr > 0 AND ho > 0) AS shared_patients,
  count(*) FILTER (tr > 0 AND ho > 0 AND lt >= fh) AS order_violations, sum(tr) >= 100 AS train_large_enough, sum(ho) >= 20 AS holdout_large_enough FROM p""")
def spl6(t: Tables):
    return S.validate_split(S.hybrid_split(series(t), PATIENTS, TEMPORAL, RAW_KEYS))


@query("spl7_train_only", f"SELECT p_num, event_id FROM ({_HYBRID}) WHERE split = 'train'")
def spl7(t: Tables):
    return S.part(S.hybrid_split(series(t), PATIENTS, TEMPORAL, RAW_KEYS), "train").select("p_num", "event_id")


@query("set5_patient_overlap", f"""
SELECT DISTINCT p_num FROM ({_HYBRID}) WHERE split = 'train' INTERSECT SELECT p_num FROM ({_HYBRID}) WHERE split = 'holdout'""")
def set5(t: Tables):
    s = S.hybrid_split(series(t), PATIENTS, TEMPORAL, RAW_KEYS)
    return S.overlap(S.part(s, "train"), S.part(s, "holdout"))


@query("set6_combined_data", f"SELECT p_num, split_type, count(*) AS n FROM ({_HYBRID}) GROUP BY ALL")
def set6(t: Tables):
    return S.part(S.hybrid_split(series(t), PATIENTS, TEMPORAL, RAW_KEYS)).groupBy("p_num", "split_type").agg(F.count("*").alias("n"))


@query("join7_semi_anti", """
SELECT event_id, 'held' AS side FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)
UNION ALL SELECT event_id, 'kept' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def join7(t: Tables):
    held = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    semi = t.events.join(held, "user_id", "left_semi").select("event_id", F.lit("held").alias("side"))
    return semi.unionByName(t.events.join(held, "user_id", "left_anti").select("event_id", F.lit("kept").alias("side")))


_BOUNDARY = """
b AS (SELECT p_num, min(us) AS a, max(us) AS z, max(us) FILTER (hour(ts) = 6) AS e, count(*) AS n_rows FROM ser GROUP BY p_num)"""


def _day_split_sql(k: str) -> str:
    return f"""
WITH {SER}, {_BOUNDARY},
k AS (SELECT *, {k} AS k FROM b), ok AS (SELECT *, e - k * {DAY_US} AS s FROM k WHERE e IS NOT NULL AND e - k * {DAY_US} >= a AND z - a >= {DAY_US}),
x AS (SELECT ser.*, s, e FROM ser JOIN ok USING (p_num)),
c AS (SELECT p_num, max((us, event_id)) AS cut FROM x WHERE us <= s GROUP BY p_num)
SELECT p_num, event_id, CASE WHEN us >= s THEN 'validation' ELSE 'train' END AS split FROM x JOIN c USING (p_num)
WHERE (us >= s AND us <= e) OR (us <= s AND (us, event_id) < cut)"""


@query("spl8_day_boundary_split", _day_split_sql("8"))
def spl8(t: Tables):
    s = series(t)
    return S.day_boundary_split(s, S.day_boundary_plan(s, 8), RAW_KEYS).select("p_num", "event_id", "split")


@query("spl8_split_metadata", f"""
WITH {SER}, {_BOUNDARY} SELECT p_num, n_rows, (z - a) // {DAY_US} AS span_days, e AS validation_end, e - 8 * {DAY_US} AS validation_start,
  CASE WHEN e IS NULL THEN 'no_boundary' WHEN z - a < {DAY_US} THEN 'too_short' WHEN e - 8 * {DAY_US} < a THEN 'too_few_days' END AS problem FROM b""")
def spl8_meta(t: Tables):
    return S.day_boundary_plan(series(t), 8).select("p_num", "n_rows", "span_days", "validation_end", "validation_start", "problem")


@query("spl9_percentage_split", _day_split_sql(
    f"(z - a) // {DAY_US} - greatest(1, least(CAST(floor(((z - a) // {DAY_US}) * 0.8) AS BIGINT), (z - a) // {DAY_US} - 1))"))
def spl9(t: Tables):
    return S.percentage_split(series(t), 0.8, keys=RAW_KEYS).select("p_num", "event_id", "split")


@query("spl10_three_way_split", f"""
WITH {SER}, b AS (SELECT p_num, min(us) AS a, max(us) AS z FROM ser GROUP BY p_num HAVING max(us) - 10 * {DAY_US} - min(us) >= 5 * {DAY_US})
SELECT p_num, event_id, CASE WHEN us >= z - 4 * {DAY_US} THEN 'test' WHEN us >= z - 10 * {DAY_US} THEN 'validation' ELSE 'finetune' END AS split
FROM ser JOIN b USING (p_num)""")
def spl10(t: Tables):
    return S.three_way_split(series(t), 6, 4, 5).select("p_num", "event_id", "split")


@query("spl11_left_out_patient", "SELECT event_id, user_id AS p_num FROM events WHERE user_id = 4")
def spl11(t: Tables):
    return S.verify_left_out(S.patient_split(series(t), PATIENTS), 4).select("event_id", "p_num")


@query("spl12_train_val_patients", f"""
WITH {_RANKED.format(seed=3)} SELECT p_num, CASE WHEN place <= least(floor(n * 0.25), n - 1) THEN 'validation' ELSE 'train' END AS part FROM ranked""")
def spl12(t: Tables):
    return S.train_val_patients(series(t), 0.25, 3)


@query("spl13_patient_sample", f"WITH {_RANKED.format(seed=42)} SELECT p_num FROM ranked WHERE place <= 5")
def spl13(t: Tables):
    return S.sample_patients(series(t), 5)


@query("set3_combine_datasets", """
SELECT user_id AS p_num, event_id AS row_id, value AS bg_mM, 'events' AS source_dataset FROM events
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'orders' FROM orders""")
def set3(t: Tables):
    return C.combine_datasets(_frames(t))


def _frames(t: Tables):
    e = t.events.select(F.col("user_id").alias("p_num"), F.col("event_id").alias("row_id"), F.col("value").alias("bg_mM"), "event_type")
    o = t.orders.select(F.col("o_custkey").alias("p_num"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("bg_mM"), "o_orderstatus")
    return {"events": e, "orders": o}


@query("agg11_dataset_share", """
SELECT source_dataset, n_rows, n_patients, round(n_rows * 100.0 / sum(n_rows) OVER (), 6) AS pct FROM (
  SELECT 'events' AS source_dataset, count(*) AS n_rows, count(DISTINCT user_id) AS n_patients FROM events
  UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey) FROM orders)""")
def agg11(t: Tables):
    return dataset_share(C.combine_datasets(_frames(t))).withColumn("pct", r("pct"))


@query("agg12_column_matrix", """
WITH e AS (SELECT count(user_id) AS a, count(event_id) AS b, count(value) AS c, count(event_type) AS d FROM events),
o AS (SELECT count(o_custkey) AS a, count(o_orderkey) AS b, count(o_totalprice) AS c, count(o_orderstatus) AS d FROM orders)
SELECT 'p_num' AS "column", e.a AS events, o.a AS orders, true AS in_final FROM e, o UNION ALL SELECT 'row_id', e.b, o.b, true FROM e, o
UNION ALL SELECT 'bg_mM', e.c, o.c, true FROM e, o UNION ALL SELECT 'event_type', e.d, 0, false FROM e, o
UNION ALL SELECT 'o_orderstatus', 0, o.d, false FROM e, o""")
def agg12(t: Tables):
    return column_matrix(_frames(t))
