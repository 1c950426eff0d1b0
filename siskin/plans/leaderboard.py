"""The flagship query and shapes that reward a good plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources.tables import table, virtual

def rows():
    return F.count(F.lit(1))


@query(
    "SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, max(l_quantity) AS most FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey "
    "WHERE l_quantity >= 10 AND c_nationkey < 10 GROUP BY c_mktsegment, o_orderpriority HAVING count(*) > 10 ORDER BY n DESC, c_mktsegment, o_orderpriority LIMIT 10"
)
def flagship(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey < 10").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    l = table(spark, d, "lineitem").filter("l_quantity >= 10").select("l_orderkey", "l_linenumber", "l_quantity")
    joined = l.join(o.join(c, o.o_custkey == c.c_custkey), l.l_orderkey == o.o_orderkey)
    groups = joined.groupBy("c_mktsegment", "o_orderpriority").agg(rows().alias("n"), F.sum("l_linenumber").alias("lines"), F.max("l_quantity").alias("most"))
    return rel.top_n(groups.filter("n > 10"), 10, F.desc("n"), "c_mktsegment", "o_orderpriority")


@query("SELECT count(*) AS n, max(o_totalprice) AS price, max(l_partkey) AS part, max(c_custkey) AS cust FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderkey >= 1000 AND o_orderkey < 5000 AND l_partkey >= 100 AND l_partkey < 500")
def lb_filtered_three_way_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey >= 1000 AND o_orderkey < 5000")
    l = table(spark, d, "lineitem").filter("l_partkey >= 100 AND l_partkey < 500")
    c = table(spark, d, "customer")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.agg(rows().alias("n"), F.max("o_totalprice").alias("price"), F.max("l_partkey").alias("part"), F.max("c_custkey").alias("cust"))


@query(
    "SELECT k, d1, d2 FROM (SELECT l_suppkey AS k, max(l_orderkey) AS d1, max(l_orderkey) + max(l_orderkey) + max(l_partkey) AS d2, min(l_orderkey) AS d3, max(l_partkey) + min(l_partkey) AS d4 "
    "FROM lineitem LEFT JOIN (SELECT r_regionkey FROM region WHERE 1 = 2) r ON l_suppkey < r_regionkey GROUP BY l_suppkey)"
)
def lb_redundant_aggs_false_left_join(spark, d):
    l, r = table(spark, d, "lineitem"), table(spark, d, "region").filter(F.lit(1) == F.lit(2)).select("r_regionkey")
    top, part = F.max("l_orderkey"), F.max("l_partkey")
    groups = l.join(r, l.l_suppkey < r.r_regionkey, "left").groupBy(F.col("l_suppkey").alias("k"))
    return groups.agg(top.alias("d1"), (top + top + part).alias("d2"), F.min("l_orderkey").alias("d3"), (part + F.min("l_partkey")).alias("d4")).select("k", "d1", "d2")


@query("SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = -1 - l_orderkey")
def lb_no_match_join(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == -1 - l.l_orderkey).select("o_orderkey", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3 ORDER BY o_orderkey, o_custkey LIMIT 10")
def lb_rank_topk(spark, d):
    ranked = rel.top_n_per_group(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 3, ["o_custkey"], "o_orderkey")
    return rel.top_n(ranked, 10, "o_orderkey", "o_custkey")


@query("SELECT x, y, z FROM (SELECT CAST(i // 10000 AS INTEGER) AS x, CAST(i % 10000 AS INTEGER) AS y, CAST(i AS INTEGER) AS z FROM (SELECT unnest(range(0, 1000000)) AS i)) WHERE x >= 90 AND y = 10")
def lb_composite_filter(spark, d):
    return virtual(spark, "__mock_t1").filter("x >= 90 AND y = 10")


_T4, _T5, _T6 = (
    f"(SELECT CAST((i + {by}) % 500000 AS INTEGER) AS x{k}, CAST(10 * ((i + {by}) % 500000) AS INTEGER) AS y{k} FROM (SELECT unnest(range(0, 1000000)) AS i))" for k, by in ((4, 0), (5, 30_000), (6, 60_000))
)


@query(
    f"SELECT count(*) AS n, max(x4) AS x4, max(y4) AS y4, max(x5) AS x5, max(y5) AS y5, max(x6) AS x6, max(y6) AS y6 FROM {_T4} a JOIN {_T5} b ON x4 = x5 JOIN {_T6} c ON y6 = y5 "
    "WHERE y4 >= 1000000 AND y4 < 1500000 AND x6 >= 100000 AND x6 < 150000"
)
def lb_virtual_three_way_join(spark, d):
    a, b, c = (virtual(spark, f"__mock_t{i}_1m").toDF(f"x{i}", f"y{i}") for i in (4, 5, 6))
    a, c = a.filter("y4 >= 1000000 AND y4 < 1500000"), c.filter("x6 < 150000 AND x6 >= 100000")
    joined = a.join(b, a.x4 == b.x5).join(c, c.y6 == b.y5)
    return joined.agg(rows().alias("n"), *(F.max(x).alias(x) for x in ("x4", "y4", "x5", "y5", "x6", "y6")))
