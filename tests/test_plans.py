"""Shapes of plans: what is pushed down, pruned, or merged."""

from pyspark.sql import functions as F

from siskin import registry
from siskin.operators import relational as rel
from siskin.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run(spark, name):
    return plan(registry.queries()[name](spark, FOLDER))


def test_top_n_is_one_operator(spark):
    assert "TakeOrderedAndProject" in run(spark, "limit_topn")


def test_rank_filter_limits_groups_before_the_shuffle(spark):
    assert run(spark, "topn_per_group").count("WindowGroupLimit") == 2


def test_point_lookup_reaches_the_scan(spark):
    text = run(spark, "point_lookup")
    assert "EqualTo(o_orderkey,77)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_false_join_side_disappears(spark):
    text = run(spark, "lb_redundant_aggs_false_left_join")
    assert "Join" not in text and "d3" not in text


def test_cross_product_with_a_filter_is_an_equi_join(spark):
    text = run(spark, "filter_over_cross")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_broadcast_needs_a_small_side(spark):
    lines = table(spark, FOLDER, "lineitem")
    assert "broadcast" not in rel.small(lines, most=10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in rel.small(lines)._jdf.queryExecution().logical().toString().lower()


def test_range_join(spark):
    points = spark.range(100).select(F.col("id").alias("at"))
    ranges = spark.createDataFrame([(0, 5), (3, 4), (95, 300), (7, 7)], "low long, high long")
    got = rel.range_join(points, ranges, "at", "low", "high", 10)
    assert sorted((r["at"], r["low"]) for r in got.collect()) == sorted([(i, 0) for i in range(5)] + [(3, 3)] + [(i, 95) for i in range(95, 100)])
