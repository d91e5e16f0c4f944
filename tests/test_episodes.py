import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glycospark.operators import episodes as E
from test_gaps import fill


def midnight_rule(pdf, ctx, fh, step_min, cap):
    """Window by window on one pandas series."""
    s = pdf.set_index("datetime")["bg_mM"]
    s = s[~s.index.duplicated(keep="last")].sort_index()
    f = f"{step_min}min"
    s = s.reindex(pd.date_range(s.index.min().floor(f), s.index.max().floor(f), freq=f))
    out, d = {}, pd.Timedelta(minutes=step_min)
    for a in pd.date_range(s.index.min().normalize(), s.index.max(), freq="D"):
        if a - ctx * d < s.index.min() or a + (fh - 1) * d > s.index.max():
            continue
        w = s.reindex(pd.date_range(a - ctx * d, periods=ctx + fh, freq=f))
        v = fill([None if x != x else x for x in w], cap)
        out[a] = None if any(x is None for x in v) else v
    return out


@pytest.mark.parametrize("cap,missing", [(0, 0.02), (2, 0.1), (11, 0.4)])
def test_midnight_episodes_match_rule(spark, cap, missing):
    rng = np.random.default_rng(cap)
    stamps = pd.date_range("2024-01-01 03:00", periods=24 * 4 * 9, freq="15min")
    keep = rng.random(len(stamps)) > missing
    pdf = pd.DataFrame({"datetime": stamps[keep], "bg_mM": rng.random(keep.sum()) * 10})
    extra = pd.DataFrame({"datetime": [stamps[40], stamps[41] + pd.Timedelta(minutes=3)], "bg_mM": [99.0, 77.0]})  # duplicate, off grid
    pdf = pd.concat([pdf, extra], ignore_index=True)
    df = spark.createDataFrame(pdf.assign(p_num="a", seq=range(len(pdf)))).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    out = E.midnight_episodes(df, 20, 12, 900, max_gap=cap, order=F.col("seq")).toPandas()
    want = midnight_rule(pdf, 20, 12, 15, cap)
    assert set(out.anchor) == set(want)
    for _, r in out.iterrows():
        w = want[r.anchor]
        assert r.usable == (w is not None)
        if w is not None:
            np.testing.assert_allclose(list(r.context) + list(r.target), w)


def test_five_constant_days(frame):
    eps = E.usable(E.midnight_episodes(frame(bg_mM=[6.0] * 288 * 5), 144, 72)).orderBy("anchor").collect()
    assert [str(e.anchor) for e in eps] == [f"2024-01-0{d} 00:00:00" for d in (2, 3, 4, 5)]
    assert all(len(e.context) == 144 and len(e.target) == 72 for e in eps)
    with pytest.raises(ValueError, match="no target"):
        E.midnight_episodes(frame(bg_mM=[1.0]), 2, 2, target="nope")


def test_day_night_pairs_default_hours(frame):
    df = frame(bg_mM=[5.5 + 0.1 * i for i in range(288 * 3)])
    pairs = E.day_night_pairs(df).orderBy("episode_date").collect()
    assert [str(p.episode_date) for p in pairs] == ["2024-01-01", "2024-01-02"]
    assert all(len(p.context) == 216 and len(p.target) == 72 for p in pairs)
    with pytest.raises(ValueError, match="hours"):
        E.day_night_rows(df, (6, 25))


def test_sliding_windows_by_position(frame):
    eps = E.row_windows(frame(bg_mM=[float(i) for i in range(11)]), 3, 2).orderBy("window_no").collect()
    assert [(e.context, e.target) for e in eps] == [([2.0 * w + i for i in range(3)], [2.0 * w + 3, 2.0 * w + 4]) for w in range(4)]


def test_packed_blocks_drop_nulls(frame):
    out = E.packed_blocks(frame(bg_mM=[1.0, None, 2.0, 3.0, 4.0, None, 5.0]), 2).orderBy("block_no").collect()
    assert [r["values"] for r in out] == [[1.0, 2.0], [3.0, 4.0]]
