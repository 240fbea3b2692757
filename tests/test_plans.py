"""Plans: what reaches the scan, and how often rows are shuffled."""

import os

import pytest

from tallyhawk.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e1_count_threshold", "f5_sequence3", "l28_chain_attack", "f1_anchored"])
def test_one_shuffle_for_matching(spark, name):
    assert plan(spark, name).count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark):
    told = plan(spark, "c1_bind_filter")
    assert "EqualTo(event_type,purchase)" in told and "GreaterThanOrEqual(value,50.0)" in told and "props" not in told.split("ReadSchema")[1].split(">")[0]
    told = plan(spark, "l27_scan_detect")
    assert "PushedFilters" in told


def test_top_n_cuts_before_its_shuffle(spark):
    assert plan(spark, "f12_top_scanners").count("WindowGroupLimit") == 2
