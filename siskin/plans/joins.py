"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources.tables import table


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_single_key(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def join_inner_multi_key(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, (c.c_nationkey == s.s_nationkey) & (s.s_suppkey == c.c_custkey)).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < 700) o ON c_custkey = o_custkey")
def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderkey < 700")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey < 90) c RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, d):
    c, o = table(spark, d, "customer").filter("c_custkey < 90"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "right").select("c_custkey", "o_orderkey")


@query("SELECT n_nationkey, r_regionkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) r ON n_regionkey = r_regionkey")
def join_full(spark, d):
    n, r = table(spark, d, "nation").filter("n_regionkey < 3"), table(spark, d, "region").filter("r_regionkey > 1")
    return n.join(r, n.n_regionkey == r.r_regionkey, "full").select("n_nationkey", "r_regionkey")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey")
def join_theta_lt(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return rel.theta_join(n, r, n.n_nationkey < r.r_regionkey).select("n_nationkey", "r_regionkey")


@query("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 99) r ON n_nationkey < r_regionkey")
def join_left_theta_empty(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").filter("r_regionkey > 99")
    return rel.theta_join(n, r, n.n_nationkey < r.r_regionkey, "left").select("n_nationkey", "r_regionkey")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark, d):
    return rel.cross_join(table(spark, d, "region"), table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def join_three_way(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation").filter("n_regionkey = 2")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_name, o_orderkey, l_linenumber, s_name FROM (customer JOIN orders ON c_custkey = o_custkey) JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey) ON o_orderkey = l_orderkey WHERE c_nationkey = s_nationkey")
def join_bushy_four_way(spark, d):
    c, o, l, s = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier"))
    left = o.join(c, c.c_custkey == o.o_custkey).select("c_name", "c_nationkey", "o_orderkey")
    right = l.join(s, l.l_suppkey == s.s_suppkey).select("l_orderkey", "l_linenumber", "s_name", "s_nationkey")
    return left.join(right, (left.o_orderkey == right.l_orderkey) & (left.c_nationkey == right.s_nationkey)).select("c_name", "o_orderkey", "l_linenumber", "s_name")


@query("SELECT r_regionkey, n_nationkey, s_suppkey FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 8) n ON r_regionkey = n_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 20) s ON n_nationkey = s_nationkey")
def join_left_chain(spark, d):
    r, n, s = table(spark, d, "region"), table(spark, d, "nation").filter("n_nationkey < 8"), table(spark, d, "supplier").filter("s_suppkey < 20")
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").select("r_regionkey", "n_nationkey", "s_suppkey")


@query("SELECT c_custkey FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey")
def join_on_subquery_distinct(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000").select("o_custkey").distinct()
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey")


@query("SELECT a.k AS a, b.k AS b FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT DISTINCT nullif(n_regionkey, 1) AS k FROM nation) b ON a.k = b.k")
def join_null_keys(spark, d):
    k = table(spark, d, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k"))
    a, b = k.alias("a"), k.distinct().alias("b")
    return a.join(b, F.col("a.k") == F.col("b.k")).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON l_partkey = p_partkey")
def join_index_left(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size < 20")
    return l.join(p, l.l_partkey == p.p_partkey, "left").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT o_orderkey, c_custkey FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 0")
def filter_over_cross(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.crossJoin(c).filter((o.o_custkey == c.c_custkey) & (c.c_acctbal > 0)).select("o_orderkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderkey < 2000)")
def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderkey < 2000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
