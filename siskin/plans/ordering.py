"""Sorting, limits, subqueries, shared subplans, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.operators import graph
from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources.tables import table


@query("SELECT o_orderkey, o_orderpriority, o_custkey FROM orders ORDER BY o_orderpriority DESC, o_custkey, o_orderkey")
def sort_multi_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").orderBy(F.desc("o_orderpriority"), "o_custkey", "o_orderkey")


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY nullif(n_regionkey, 2) ASC NULLS FIRST, n_nationkey")
def sort_nulls(spark, d):
    k = F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k")
    return table(spark, d, "nation").select("n_nationkey", k).orderBy(F.asc("k"), "n_nationkey")


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY nullif(n_regionkey, 2) DESC NULLS FIRST, n_nationkey DESC")
def sort_nulls_placed(spark, d):
    k = F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k")
    return table(spark, d, "nation").select("n_nationkey", k).orderBy(F.desc_nulls_first("k"), F.desc("n_nationkey"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem ORDER BY l_linenumber, l_orderkey + l_suppkey - l_orderkey DESC, l_orderkey, l_partkey, l_extendedprice")
def sort_expr_key(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    key = (F.col("l_orderkey") + F.col("l_suppkey") - F.col("l_orderkey")).desc()
    return l.orderBy("l_linenumber", key, "l_orderkey", "l_partkey", "l_extendedprice").drop("l_partkey", "l_extendedprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def limit_topn(spark, d):
    return rel.top_n(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 10, F.desc("c_acctbal"), "c_custkey")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) ORDER BY o_orderkey LIMIT 5")
def topn_of_topn(spark, d):
    first = rel.top_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, F.desc("o_totalprice"), "o_orderkey")
    return rel.top_n(first, 5, "o_orderkey")


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN customer ON o_custkey = c_custkey")
def topn_join(spark, d):
    o, c = rel.top_n(table(spark, d, "orders"), 20, F.desc("o_totalprice"), "o_orderkey"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
def limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(5)


@query("SELECT a.k2 AS k, a.n FROM (SELECT k + 1 AS k2, n FROM (SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 0) GROUP BY c_nationkey)) a WHERE a.n > 3")
def subquery_nested(spark, d):
    inner = table(spark, d, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return inner.select((F.col("k") + 1).alias("k"), "n").filter("n > 3")


@query("WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k AS a, b.k AS b, a.n FROM t a JOIN t b ON a.n = b.n AND a.k < b.k WHERE a.n > 16")
def cte_reuse(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 16")
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.n").alias("n"))


_EDGES = "SELECT n_nationkey AS src, (n_nationkey + n_regionkey + 1) % 25 AS dst, n_regionkey + 1 AS distance FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2) % 25, 3 FROM nation"


def _edges(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + F.col("n_regionkey") + 1) % 25).alias("dst"), (F.col("n_regionkey") + 1).alias("distance"))
    return a.unionAll(n.select("n_nationkey", (F.col("n_nationkey") * 2) % 25, F.lit(3)))


@query(f"WITH e AS ({_EDGES}) SELECT a.src, b.dst, min(a.distance + b.distance) AS distance FROM e a JOIN e b ON a.dst = b.src GROUP BY a.src, b.dst")
def graph_khop_nested(spark, d):
    e = _edges(spark, d)
    return graph.two_hops(e, e)


@query(
    f"WITH e AS ({_EDGES}), h1 AS (SELECT src, dst, min(distance) AS distance FROM e GROUP BY src, dst), "
    "h2 AS (SELECT src, dst, min(distance) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT a.src, b.dst, a.distance + b.distance FROM h1 a JOIN e b ON a.dst = b.src) GROUP BY src, dst), "
    "h3 AS (SELECT src, dst, min(distance) AS distance FROM (SELECT * FROM h2 UNION ALL SELECT a.src, b.dst, a.distance + b.distance FROM h2 a JOIN e b ON a.dst = b.src) GROUP BY src, dst) SELECT src, dst, distance FROM h3"
)
def graph_khop_iterative(spark, d):
    return graph.shortest_within(_edges(spark, d), 3)


_PATHS = "WITH RECURSIVE p(node, steps) AS (SELECT 1, 0 UNION ALL SELECT (p.node + n.n_regionkey + 1) % 25, p.steps + 1 FROM p JOIN nation n ON n.n_nationkey = p.node WHERE p.steps < 10) SELECT node, steps FROM p"


@query(_PATHS)
def recursive_paths(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql(_PATHS)
