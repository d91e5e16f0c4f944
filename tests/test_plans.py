"""Physical plans with broadcasts off: what is grouped by (patient, block) must be spread by both."""

import os
import re

import pytest

import __spark_entry__ as entry
from glycospark.session import RUNTIME_CONF
from glycospark.sources import raw as R
from glycospark.sinks import writers as W

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "agg2_regularize_own_interval epi3_patient_episodes epi8_training_pairs join5_asof_forward join5_asof_nearest phy3_as_of_without_food prj23_same_resolution "
    "set5_patient_overlap set6_combined_data spl3_hybrid_holdout spl4_split_dispatch spl6_validate_split spl7_train_only spl8_day_boundary_split spl9_percentage_split "
    "win7_segments win25_sleep_score"
).split()
QUERIES = entry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def keys_of(line):
    """Grouping keys of a window or a final aggregate."""
    found = re.search(r"Window \[.*?\], \[([^\]]*)\]", line) if " Window " in line else re.search(r"Aggregate\(keys=\[([^\]]*)\]", line)
    if not found or re.search(r"functions=\[(partial_|merge_|\])", line):
        return set()
    return {re.sub(r"#\d+L?", "", k).strip() for k in found[1].split(",") if k.strip()}


def spread_of(line):
    found = re.search(r"Exchange hashpartitioning\((.*?), \d+\)", line)
    return found and {re.sub(r"#\d+L?", "", k).strip() for k in re.split(r", (?![^(]*\))", found[1])}


@pytest.mark.parametrize("name", NAMES)
def test_blocks_are_spread(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for n, line in enumerate(plan):
        keys = keys_of(line)
        if "p_num" not in keys or len(keys) < 2:
            continue
        depth = re.search(r"[A-Za-z]", line).start()
        for below in plan[n + 1 :]:
            if re.search(r"[A-Za-z]", below).start() <= depth:
                break
            spread = spread_of(below)
            if spread is not None:
                assert spread != {"p_num"}, f"{line.strip()[:200]}\non\n{below.strip()[:200]}"
                break


def test_settings_are_made(spark):
    for key, value in RUNTIME_CONF.items():
        assert spark.conf.get(key) == value


def test_patient_list_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(f"app_{i}", i) for i in range(20)], "p_num string, v long")
    W.append_partitioned(rows, str(tmp_path / "t"), 3)
    df = R.processed_parquet(spark, str(tmp_path / "t"), ["p_num", "v"], ["app_4", "app_18"], validate=False, size=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*partition#\d+ IN \(1,6\)", plan)
    assert sorted(r.v for r in df.collect()) == [4, 18]
