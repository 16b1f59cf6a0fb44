"""Queries against SQL on the same tables. ``PANELCAST_ALL=1`` runs every one of them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "a1_aggregate_to_state", "a6_iqr_bounds_raw_rows", "c9_fill_gaps_by_place", "c10_prepare_for_modeling", "c11_build_feature_set",
    "e11_ensemble_flow", "j5b_join_ocean_asof", "j6_spatial_lag", "m17_interval_validation", "q8_recursive_first_order",
    "r8_residual_histogram", "s12_validation_round_trip", "v6_select_top_models", "v10_tuning_recommendations", "w2_rolling_by_place",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
NAMES = list(entry.queries()) if os.environ.get("PANELCAST_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns > 0
    else:
        assert check.compare(got, duck.execute(sql).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
