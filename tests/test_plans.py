"""The plans that Catalyst makes of the catalogue's queries: what is read, how tables meet, and that no Python runs."""

import pytest

from lakeweave.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_stays_in_the_jvm_and_joins_by_keys(spark, sf_dir, name):
    text = plan(catalogue.queries()[name](spark, sf_dir))
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_scans_read_what_is_asked(spark, sf_dir):
    text = plan(catalogue.queries()["apply_day"](spark, sf_dir))
    assert "o_orderpriority" not in text
    assert "ReadSchema: struct<o_orderkey" not in text and "ReadSchema: struct<o_custkey" in text
    text = plan(catalogue.queries()["latest_features_lookup"](spark, sf_dir))
    assert "EqualTo(o_custkey," in text and "TakeOrderedAndProject" in text  # the key reaches the scan
    text = plan(catalogue.queries()["direct_sum"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_as_of_join_is_an_equi_join(spark, sf_dir):
    text = plan(catalogue.queries()["fact_apply_asof"](spark, sf_dir))
    assert "BroadcastHashJoin" in text or "SortMergeJoin" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(catalogue.queries()["fact_apply_asof"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_shuffle_a_side_for_the_dimension(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalogue.queries()["scd2_second_day"](spark, sf_dir))
        assert text.count("Exchange hashpartitioning") == 2 and text.count("FullOuter") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
