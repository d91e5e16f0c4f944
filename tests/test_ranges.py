"""Raw series whose rows crowd: blocks of like row count give the same results as blocks of time."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from glycospark.operators import align as A, blocks as B, features as X, gaps as G, splits as S
from glycospark.operators.blocks import Keys

TIME = Keys(tie=("i",), block=3600)
RANGES = Keys(tie=("i",), block=3600, rows=40)


@pytest.fixture(scope="module")
def crowded(spark):
    """Patient a has most rows, nearly all of them within two hours; b is sparse, c has one row."""
    rng = np.random.default_rng(3)
    stamps = [("a", s) for s in rng.integers(0, 7200, 700)] + [("a", s) for s in rng.integers(0, 5 * 86_400, 60)]
    stamps += [("b", s) for s in rng.integers(0, 9 * 86_400, 80)] + [("c", 50)]
    rows = [
        (p, pd.Timestamp("2024-01-01 04:50") + pd.Timedelta(seconds=int(s)), i, float(rng.random() * 10) if rng.random() < 0.8 else None, int(rng.integers(0, 86_400)), None if rng.random() < 0.1 else int(rng.integers(0, 1440)))
        for i, (p, s) in enumerate(stamps)
    ]
    return spark.createDataFrame([(p, t.to_pydatetime(), *r) for p, t, *r in rows], "p_num string, datetime timestamp_ntz, i long, bg_mM double, second_of_day long, minute_of_day int")


OPERATORS = {
    "differences": lambda d, k: G.wrap_differences(d, k),
    "absolute time": lambda d, k: G.absolute_time(d, k, 100),
    "rollover": lambda d, k: G.rollover_dates(d, k, 100),
    "breaks": lambda d, k: G.split_on_breaks(d, 1, 2, k, F.col("i")),
    "day counter": lambda d, k: G.day_counter(d, k),
    "features": lambda d, k: X.cgm_features(d, k),
    "holdout": lambda d, k: S.temporal_split(d, S.TemporalHoldout(0.2, 10, 2), k),
    "closest": lambda d, k: A.attach_closest(d.where("i % 3 = 0").select("p_num", "datetime", "i", "bg_mM"), d.where("i % 3 = 1").select("p_num", "datetime", F.col("i").alias("m"), F.col("second_of_day").alias("v")), replace(k, tie=("m",))),
    "all carries": lambda d, k: B.scan(
        d, k, s=B.Carry("sum", F.col("bg_mM")), t=B.Carry("total", F.lit(1)), a=B.Carry("last", F.col("bg_mM")), p=B.Carry("prev", F.col("bg_mM")), n=B.Carry("next", F.col("bg_mM")), f=B.Carry("first", F.col("bg_mM")), e=B.Carry("final", F.col("bg_mM"))
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ranges_give_what_time_blocks_give(crowded, name):
    run = lambda keys: sorted(repr(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r)) for r in OPERATORS[name](crowded, keys).collect())
    got = run(RANGES)
    assert got == run(TIME) and len(got) > 100


@pytest.mark.parametrize("back, ahead", [(0, 0), (600, 0), (0, 900), (4000, 4000), (200_000, 100_000)])
def test_halo_of_ranges_is_exact(crowded, back, ahead):
    """Counts in a time window around each row, as a window over the whole patient gives them."""
    d = crowded.withColumn("s", F.unix_seconds(F.col("datetime").cast("timestamp")))
    near = B.halo(d, RANGES, back, ahead)
    got = B.own(near.withColumn("n", F.count("*").over(Window.partitionBy("p_num", B.BLOCK).orderBy("s").rangeBetween(-back, ahead))))
    want = d.withColumn("n", F.count("*").over(Window.partitionBy("p_num").orderBy("s").rangeBetween(-back, ahead)))
    rows = lambda x: sorted((r.i, r.n) for r in x.collect())
    assert rows(got) == rows(want)


def test_a_crowded_day_is_spread(crowded):
    timed, by_ranges = B.cut(crowded, TIME)
    assert not by_ranges and timed.groupBy("p_num", B.BLOCK).count().agg(F.max("count")).first()[0] > 300
    ranged, by_ranges = B.cut(crowded, RANGES)
    sizes = [r["count"] for r in ranged.groupBy("p_num", B.BLOCK).count().collect()]
    assert by_ranges and max(sizes) <= RANGES.rows and sum(sizes) == crowded.count()
    # blocks of a patient follow each other in time
    spans = ranged.groupBy("p_num", B.BLOCK).agg(F.min(F.struct("datetime", "i")).alias("lo"), F.max(F.struct("datetime", "i")).alias("hi")).orderBy("p_num", B.BLOCK).collect()
    assert all(a.p_num != b.p_num or a.hi < b.lo for a, b in zip(spans, spans[1:]))
    assert B.cut(crowded, Keys(tie=("i",), block=3600, rows=5000))[1] is False
    assert B.cut(crowded.limit(0), RANGES)[1] is False
