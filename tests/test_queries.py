"""Registered queries against their SQL twins (all of them with RIDEWAVE_ALL=1)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import check, engine

SF = "/root/testdata/sf0.01"
SAMPLE = """raw_validation_scan json_line_decode csv_line_decode exact_dedup ingest_ledger pseudonyms completed_labels label_reconciliation
bucket_counts_hourly horizon_buckets_month time_quality supportability profile_seasonal_weekday_hour weekly_profiles reducer_trim10 smoothed_level
calendar_lags rolling_features route_hour_dataset score_slices array_case_evaluation slice_metrics gate_failures fold_construction
flagship_forecast_score hour_shape_forecast statistical_sweep level_shifts hour_shape_shifts gap_bursts density_clusters scan_deviance
trip_enrolment nearest_stable_stop event_stop_mapping trip_windows schedule_coverage shift_calibration identity_alignment geometry_crosswalk
forecast_snapshot busiest_window planning_allocation network_components shortest_paths identifier_profile prepared_stop_targets
traffic_post_facts event_time_precision stream_dedup stream_ingest""".split()


@pytest.fixture(scope="module")
def con():
    return engine(SF)


NAMES = sorted(entry.oracle_sql()) if os.environ.get("RIDEWAVE_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    message, _, ok = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["route", "actual", "profile_score", "blend_score"]


def test_names_are_plain():
    for name in entry.queries():
        assert name.replace("_", "").isalnum()
