"""Registered queries against DuckDB at the smallest scale (PLANTSPARK_ALL=1 runs all of them)."""

import os

import pytest
from check_oracles import compare, oracle_connection

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
DEFAULT = (
    "A7_unit_analytics A12_comprehensive A14_resample_filled U4_merge_new_wins I1_incremental_merge F13_scope W2_rolling_days W13_cooldown_events O5_interpolate "
    "J5_nearest_speed J7_neighbours X3_header_parts X16_recency_priority H12_gaps H19_tag_health P13_compensated_rows T1_sigma_runs T4_verified_candidates "
    "T13_tau_verified T24_breakouts T31_incident_report M1_baseline_tuning M4_feature_matrix B2_period_methods B7_injected_readings I7_stream_resample"
).split()
NAMES = sorted(ORACLES) if os.environ.get("PLANTSPARK_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    state, _, _, note = compare(spark, con, name, SMALL, QUERIES, ORACLES)
    assert state in ("ok", "EMPTY"), note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
