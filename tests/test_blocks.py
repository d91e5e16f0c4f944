import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from glycospark.operators import blocks as B


def _random(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    secs = np.sort(rng.choice(np.arange(0, 40 * 86400), n, replace=False))
    v = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 100, n).astype(float))
    pdf = pd.DataFrame({"p_num": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(secs, "s"), "v": v})
    df = spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf.sort_values(["p_num", "datetime"]), df


def test_scan_carries_over_blocks(spark):
    pdf, df = _random(spark)
    k = B.Keys(block=2 * 86400)
    v = F.col("v")
    out = B.scan(df, k, s=B.Carry("sum", v), l=B.Carry("last", v), p=B.Carry("prev", v), x=B.Carry("next", v), t=B.Carry("total", v),
                 f=B.Carry("first", v), z=B.Carry("final", v)).toPandas().sort_values(["p_num", "datetime"])
    g = pdf.groupby("p_num")["v"]
    same = lambda a, b: np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float))
    same(out.s, pdf.v.fillna(0).groupby(pdf.p_num).cumsum())
    same(out.l, g.ffill())
    same(out.p, g.ffill().groupby(pdf.p_num).shift())
    same(out.x, g.bfill().groupby(pdf.p_num).shift(-1))
    same(out.t, g.transform("sum"))
    same(out.f, g.transform("first"))
    same(out.z, g.transform("last"))


def test_row_numbers(spark):
    pdf, df = _random(spark)
    out = B.number_rows(df, B.Keys(block=86400))
    assert values(out, "rn") == list(pdf.groupby("p_num").cumcount() + 1)


def test_halo_copies_and_owns_each_row_once(spark):
    _, df = _random(spark)
    k = B.Keys(block=86400)
    assert B.own(B.halo(df, k, 7200, 7200)).count() == df.count()
    assert B.halo(df, k, 7200, 7200).count() > df.count()


def test_exact_quantiles_on_a_hot_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b"], 5000, p=[0.9, 0.1]), "v": rng.integers(0, 700, 5000) / 7})
    out = B.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}, 100).toPandas().set_index("g")
    for g, want in pdf.groupby("g")["v"]:
        np.testing.assert_allclose(out.loc[g, ["a", "m", "z"]].astype(float), want.quantile([0.1, 0.5, 0.99]))


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    out = B.hash_rank(df, "h", "id").orderBy("place").toPandas()
    assert list(out.place) == list(range(1, 1001))
    assert list(out.h) == sorted(out.h)


def test_spread_range_opens_in_chunks(spark):
    df = spark.createDataFrame([("a", 0, 9000), ("b", 600, 600)], "p_num string, lo bigint, hi bigint")
    out = B.spread_range(df, ["p_num"], "lo", "hi", 300, "slot", chunk=7)
    rows = out.where("p_num = 'a'").orderBy("pos").select("pos", "slot").collect()
    assert [tuple(r) for r in rows] == [(i, 300 * i) for i in range(31)]
    assert out.where("p_num = 'b'").count() == 1


def test_text_rank_is_the_sorted_position(spark):
    rng = np.random.default_rng(9)
    names = sorted({"".join(rng.choice(list("aB0_é"), rng.integers(1, 16))) for _ in range(400)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = B.text_rank(df, "name", "rank").orderBy("rank").toPandas()
    assert list(out["rank"]) == list(range(len(names)))
    assert list(out["name"]) == names


@pytest.mark.parametrize("limit", [10**6, 3000, 200, 70])
def test_selection_is_exact_at_every_size(spark, limit):
    """Groups below and above the limit; ties, few values, rounds of cells."""
    rng = np.random.default_rng(limit)
    data = {
        "big": rng.standard_normal(30_000), "skewed": np.exp(4 * rng.standard_normal(9_000)), "tied": rng.integers(0, 5, 12_000).astype(float),
        "half": np.r_[np.zeros(4_000), rng.random(4_000)], "small": rng.random(90), "two": np.array([3.0, 1.0]), "one": np.array([7.0]),
    }
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    wanted = {"lo": 0.0, "a": 0.1, "m": 0.5, "z": 0.99, "hi": 1.0}
    got = {r.g: r for r in B.exact_quantiles(df, ["g"], "x", wanted, limit).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, name)
    whole = B.exact_quantiles(df, [], "x", {"m": 0.5}, limit).collect()
    assert [r.m for r in whole] == [pytest.approx(np.median(np.concatenate(list(data.values()))))]


def test_no_group_is_handed_to_one_task(spark, monkeypatch):
    """Beyond the limit no sort sees more values of a group than the limit."""
    seen = []
    picked = B._picked
    monkeypatch.setattr(B, "_picked", lambda counts, keys, wanted: seen.append(counts.groupBy(*keys).count().agg({"count": "max"}).first()[0]) or picked(counts, keys, wanted))
    df = spark.range(40_000).selectExpr("'a' AS g", "cast(hash(id) AS double) AS x")
    got = B.exact_quantiles(df, ["g"], "x", {"m": 0.5, "z": 0.9}, 500).first()
    x = sorted(r.x for r in df.collect())
    assert got.m == pytest.approx(np.quantile(x, 0.5)) and got.z == pytest.approx(np.quantile(x, 0.9))
    assert max(s or 0 for s in seen) <= 500
