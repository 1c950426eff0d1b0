"""Grouping sets, filtered aggregates, first and last values by an order, DISTINCT ON."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.plans.catalogue import query
from siskin.sources.tables import table


def rows():
    return F.count(F.lit(1))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def agg_grouping_sets(spark, d):
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    groups = table(spark, d, "lineitem").groupingSets([[flag, status], [number], []], flag, status, number)
    return groups.agg(rows().alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")).select("l_returnflag", "l_linestatus", "l_linenumber", "n", "quantity")


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INTEGER) AS all_statuses, CAST(grouping(o_orderpriority) AS INTEGER) AS all_priorities, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    o = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority")
    return o.agg(F.grouping("o_orderstatus").cast("int").alias("all_statuses"), F.grouping("o_orderpriority").cast("int").alias("all_priorities"), rows().alias("n"), F.max("o_totalprice").alias("most"))


@query("SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    # customers are counted by nation first: only 25 rows are joined and rolled up
    counts = c.groupBy("c_nationkey").agg(rows().alias("k"))
    named = counts.join(n, counts.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return named.rollup("r_name", "n_name").agg(F.sum("k").alias("customers"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_orderpriority <> '1-URGENT') AS most, CAST(sum(o_orderkey) FILTER (WHERE o_totalprice < 0) AS BIGINT) AS none FROM orders GROUP BY o_custkey")
def agg_filter_clause(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.expr("count(*) FILTER (WHERE o_orderstatus = 'F')").alias("done"), F.expr("max(o_totalprice) FILTER (WHERE o_orderpriority <> '1-URGENT')").alias("most"), F.expr("sum(o_orderkey) FILTER (WHERE o_totalprice < 0)").alias("none"))


@query("SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
def agg_first_last(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    # one row a key by a combined aggregate: a frequent key sends one row a task
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "best.o_orderkey", "best.o_totalprice")
