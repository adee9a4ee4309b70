"""Registered queries against their SQL on DuckDB. PULSEFRAME_FULL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import connect, run

SF = "/root/testdata/sf0.001"
CORE = [
    "j1_a1_timeline", "t1_timeline_page", "t8_ad_hoc_secured", "j17_nested_runs", "x6_experiment_cards", "w1_rr_features", "w2_causal_rr", "w3_bursts",
    "j4_episode_rhythm", "j5_point_rhythm", "a8_global_report", "w5_auroc_ap", "a12_calibration_report", "a25_max_f1", "a25_cost", "a20_paired_bootstrap",
    "a30_feature_statistics", "a28_w4_concentration", "x1_index", "x1_rejects_u2", "x2_bm25", "j10_x3_vector_knn", "j11_x4_hybrid_search", "g7_direct_morphology",
    "w10_g13_beat_windows", "h1_stratified_group_folds", "h8_stratified_sample", "h11_group_weighted_draws", "u4_conflicting_labels", "q2_sample_checks",
    "s2_s3_catalog", "st5_causal_stream",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("PULSEFRAME_FULL") else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    result, _ = run(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
