"""Offsets, ranks, frames by time, and windows together with groups and arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siskin.plans.catalogue import query
from siskin.sources.tables import table


def rows():
    return F.count(F.lit(1))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("later"))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER w AS dense, ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS third, percent_rank() OVER w AS part, cume_dist() OVER w AS dist FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def win_dense_rank_ntile(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    whole = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(3).over(whole).cast("bigint").alias("third"), F.percent_rank().over(w).alias("part"), F.cume_dist().over(w).alias("dist"))


@query(
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, "
    "nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)
def win_first_last_nth(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(all_).alias("last"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_most FROM orders")
def win_moving_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", rows().over(w.rowsBetween(-2, 1)).alias("near"), F.max("o_totalprice").over(w.rowsBetween(1, 3)).alias("next_most"))


_HOUR = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, {_HOUR} AS last_hour FROM events")
def win_range_interval(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_HOUR).alias("last_hour"))


@query("SELECT c_nationkey, o_custkey, count(*) AS n, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS place, CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS of FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey")
def win_over_groups(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    counts = o.groupBy("o_custkey").agg(rows().alias("n"))
    by = Window.partitionBy("c_nationkey")
    named = counts.join(c, counts.o_custkey == c.c_custkey)
    return named.select("c_nationkey", "o_custkey", "n", F.rank().over(by.orderBy(F.desc("n"))).cast("bigint").alias("place"), F.sum("n").over(by).alias("of"))


@query("SELECT o_orderkey, 10 * row_number() OVER w - count(*) OVER (PARTITION BY o_custkey) AS score, o_orderkey - coalesce(lag(o_orderkey) OVER w, 0) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def win_in_arithmetic(spark, d):
    by = Window.partitionBy("o_custkey")
    w = by.orderBy("o_orderkey")
    score = 10 * F.row_number().over(w) - rows().over(by)
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"), (F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))).alias("gap"))
