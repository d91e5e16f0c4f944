import numpy as np
import pandas as pd
import pytest
from conftest import values

from glycospark.operators import gaps as G
from glycospark.operators.blocks import Keys

HOUR = Keys(block=3600)


def fill(v, cap):
    """The same rule, written for one short list."""
    v, known = list(v), [i for i, x in enumerate(v) if x is not None]
    for a, b in zip(known, known[1:]):
        if 0 < b - a - 1 <= cap:
            for i in range(a + 1, b):
                v[i] = v[a] + (v[b] - v[a]) * (i - a) / (b - a)
    return v


def test_small_gap_is_filled(frame):
    out = G.interpolate_small_gaps(frame(bg_mM=[4.0, None, None, None, 8.0]), 3, 300)
    assert values(out, "bg_mM") == [4.0, 5.0, 6.0, 7.0, 8.0]


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_interpolation_matches_rule_on_random_series(frame, cap):
    rng = np.random.default_rng(cap)
    v = [None if rng.random() < 0.45 else float(rng.integers(0, 50)) for _ in range(200)]
    out = G.interpolate_small_gaps(frame(bg_mM=v), cap, 300, keys=HOUR)
    for got, want in zip(values(out, "bg_mM"), fill(v, cap)):
        assert (got is None and want is None) or got == pytest.approx(want)


def test_segments_of_mixed_gaps(frame):
    df = frame(bg_mM=[1.0, None, 3.0] + [None] * 5 + [9.0])
    out = G.segment(df, 300, 10, 1, keys=HOUR)
    assert values(out, "bg_mM") == [1.0, 2.0, 3.0, 9.0]
    assert values(out, "segment_id") == ["a_seg_0"] * 3 + ["a_seg_1"]
    assert values(G.segment(df, 300, 10, 2, keys=HOUR), "segment_no") == [0, 0, 0]


def test_statistics_of_mixed_gaps(frame):
    s = G.gap_stats(frame(bg_mM=[1.0, None, 3.0] + [None] * 5 + [9.0]), 300, 10, 2, keys=HOUR).first()
    assert (s.total_nan_before, s.total_nan_after_interp, s.num_gaps_interpolated, s.num_gaps_segmented) == (6, 5, 1, 1)
    assert (s.num_segments_created, s.num_segments_discarded, s.rows_retained, s.rows_discarded) == (1, 1, 3, 6)


def test_null_runs_and_longest(frame):
    df = frame(bg_mM=[None, 1.0, None, None, None, 5.0, None, 7.0])
    runs = sorted(tuple(r) for r in G.null_runs(df, keys=HOUR).select("run_start", "run_end", "run_length").collect())
    assert runs == [(0, 1, 1), (2, 5, 3), (6, 7, 1)]
    assert G.longest_null_run(df, keys=HOUR).first().longest_run == 3


def test_time_breaks_cut_and_drop_short(frame):
    stamps = list(pd.date_range("2024-01-01", periods=4, freq="5min")) + list(pd.date_range("2024-01-01 01:00", periods=2, freq="5min"))
    df = frame(datetime=[str(s) for s in stamps], bg_mM=[1.0] * 6)
    assert values(G.split_on_breaks(df, 300, 3, HOUR), "segment_no") == [0, 0, 0, 0]


@pytest.mark.parametrize("cap,days", [(1, 1), (3, 2), (24, 3)])
def test_gappy_days(frame, cap, days):
    v = [1.0] * 24 + [None] * 3 + [1.0] * 21 + [None] * 10 + [1.0] * 14
    out = G.drop_gappy_days(frame(step_min=60, bg_mM=v), cap)
    assert out.count() == 24 * days


def test_clock_repair(frame):
    df = frame(second_of_day=[86000.0, 100.0, 200.0, 50.0]).withColumn("second_of_day", G.F.col("second_of_day").cast("long"))
    out = G.absolute_time(df, HOUR, 0)
    assert values(out, "time_diff") == [0, 500, 100, 86250]
    assert values(out, "epoch") == [86000, 86500, 86600, 172850]
