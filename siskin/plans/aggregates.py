"""Aggregation, distinct rows, and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources.tables import table

def rows():
    return F.count(F.lit(1))


@query("SELECT count(*) AS n, count(l_quantity) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(rows().alias("n"), F.count("l_quantity").alias("c"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("l_linenumber").alias("s"))


@query("SELECT count(*) AS n, count(l_linenumber) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_orderkey < 0")
def agg_global_empty(spark, d):
    l = table(spark, d, "lineitem").filter("l_orderkey < 0")
    return l.agg(rows().alias("n"), F.count("l_linenumber").alias("c"), F.sum("l_linenumber").alias("s"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY l_orderkey")
def agg_group_empty(spark, d):
    return table(spark, d, "lineitem").filter("l_orderkey < 0").groupBy("l_orderkey").agg(rows().alias("n"))


@query("SELECT n_regionkey + n_nationkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey + n_nationkey")
def agg_group_expr(spark, d):
    return table(spark, d, "nation").groupBy((F.col("n_regionkey") + F.col("n_nationkey")).alias("k")).agg(rows().alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n"), F.max("o_totalprice").alias("top")).filter("n > 12 AND top > 1000").select("o_custkey", "n")


@query("SELECT l_linenumber + 1 + count(*) AS a, max(l_linenumber) + max(l_suppkey) AS b FROM lineitem GROUP BY l_linenumber")
def agg_arith_over_aggs(spark, d):
    a = (F.col("l_linenumber") + 1 + F.col("n")).alias("a")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(rows().alias("n"), (F.max("l_linenumber") + F.max("l_suppkey")).alias("b")).select(a, "b")


@query("SELECT nullif(l_linenumber, 3) AS k, count(*) AS n, count(nullif(l_linenumber, 3)) AS c FROM lineitem GROUP BY nullif(l_linenumber, 3)")
def agg_null_group(spark, d):
    k = F.nullif(F.col("l_linenumber"), F.lit(3))
    return table(spark, d, "lineitem").groupBy(k.alias("k")).agg(rows().alias("n"), F.count(k).alias("c"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def distinct_over_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n")).select("n").distinct()


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def nested_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n")).groupBy("n").agg(rows().alias("customers"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, d):
    return rel.distinct_count_salted(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey")


@query("SELECT upper(max(n_name)) AS last FROM nation")
def function_over_agg(spark, d):
    return table(spark, d, "nation").agg(F.upper(F.max("n_name")).alias("last"))


@query("SELECT o_orderkey, o_custkey, CAST(sum(o_orderkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
def win_running_sum(spark, d):
    # prefix sums of key ranges and the sum of all ranges before: no task holds all rows
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 4096).alias("b"))
    totals = o.groupBy("b").agg(F.sum("o_orderkey").alias("t"))
    before = totals.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = o.withColumn("s", F.sum("o_orderkey").over(Window.partitionBy("b").orderBy("o_orderkey")))
    return inside.join(before, "b").select("o_orderkey", "o_custkey", (F.col("s") + F.col("before")).alias("running"))


@query("SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS lo, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS hi, count(n_name) OVER (PARTITION BY n_regionkey) AS c FROM nation")
def win_partition_total(spark, d):
    # aggregates by few keys, joined back: no task has all rows of a key
    n = table(spark, d, "nation")
    totals = n.groupBy(F.col("n_regionkey").alias("k")).agg(rows().alias("n"), F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"), F.count("n_name").alias("c"))
    return n.join(totals, n.n_regionkey.eqNullSafe(totals.k), "left").select("n_nationkey", "n", "lo", "hi", "c")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem")
def win_rank_ties(spark, d):
    r = F.rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("bigint").alias("r")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders")
def win_row_number(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).cast("bigint").alias("r")
    return table(spark, d, "orders").select("o_orderkey", r)


@query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS own, count(*) OVER (PARTITION BY o_orderstatus) AS alike FROM orders")
def win_mixed_partitions(spark, d):
    own = F.sum("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("own")
    o = rel.with_count(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus"], "alike")
    return o.select("o_orderkey", own, "alike")


@query("SELECT o_orderkey, CAST(sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM (SELECT o_orderkey, o_custkey, 1 AS o_shippriority FROM orders)")
def win_rows_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.lit(1)).over(w).alias("s"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 2")
def topn_per_group(spark, d):
    return rel.top_n_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, ["o_custkey"], F.desc("o_totalprice"))
