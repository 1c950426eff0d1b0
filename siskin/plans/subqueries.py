"""Set operations, subqueries in expressions, and the joins that SQL writes in other ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources.tables import sql, table


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


_ORDERED, _RICH = "SELECT o_custkey AS k FROM orders", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0"


@query(f"{_ORDERED} UNION {_RICH}")
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query(f"{_ORDERED} UNION ALL {_RICH}")
def set_union_all(spark, d):
    a, b = _keys(spark, d)
    return a.unionAll(b)


@query(f"{_ORDERED} INTERSECT {_RICH}")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query(f"{_RICH} EXCEPT {_ORDERED}")
def set_except(spark, d):
    a, b = _keys(spark, d)
    return b.subtract(a)


@query(f"{_ORDERED} EXCEPT ALL {_RICH}")
def set_except_all(spark, d):
    a, b = _keys(spark, d)
    return a.exceptAll(b)


@query(f"{_ORDERED} INTERSECT ALL ({_RICH} UNION ALL {_RICH})")
def set_intersect_all(spark, d):
    a, b = _keys(spark, d)
    return a.intersectAll(b.unionAll(b))


_SCALAR = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0.9 * (SELECT max(o_totalprice) FROM orders)"


@query(_SCALAR)
def subquery_scalar(spark, d):
    return sql(spark, d, _SCALAR)


_CORRELATED = "SELECT o_custkey, o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"


@query(_CORRELATED)
def subquery_correlated(spark, d):
    return sql(spark, d, _CORRELATED)


_SELECTED = "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer"


@query(_SELECTED)
def subquery_in_select(spark, d):
    return sql(spark, d, _SELECTED)


_EXISTS = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_quantity > 45) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"


@query(_EXISTS)
def subquery_exists(spark, d):
    return sql(spark, d, _EXISTS)


_NOT_IN = "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 9) FROM region) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)"


@query(_NOT_IN)
def subquery_not_in(spark, d):
    return sql(spark, d, _NOT_IN)


_USING = "SELECT k, c_name, o_orderkey FROM (SELECT c_custkey AS k, c_name FROM customer) JOIN (SELECT o_custkey AS k, o_orderkey FROM orders) USING (k)"


@query(_USING)
def join_using(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return c.join(o, "k").select("k", "c_name", "o_orderkey")


_NATURAL = "SELECT r_regionkey, r_name, n_name FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation)"


@query(_NATURAL)
def join_natural(spark, d):
    return sql(spark, d, _NATURAL)


_LATERAL = "SELECT n_name, t.n, t.most FROM nation, LATERAL (SELECT count(*) AS n, max(c_acctbal) AS most FROM customer WHERE c_nationkey = n_nationkey) t"


@query(_LATERAL)
def join_lateral(spark, d):
    return sql(spark, d, _LATERAL)


@query("SELECT s_suppkey, p_partkey FROM part JOIN supplier ON p_partkey >= 10 * s_suppkey AND p_partkey < 10 * s_suppkey + 25")
def join_range(spark, d):
    ranges = table(spark, d, "supplier").select("s_suppkey", (10 * F.col("s_suppkey")).alias("low"), (10 * F.col("s_suppkey") + 25).alias("high"))
    return rel.range_join(table(spark, d, "part").select("p_partkey"), ranges, "p_partkey", "low", "high", 25).select("s_suppkey", "p_partkey")


@query(
    "SELECT b.event_id, v.ts AS seen, v.event_id AS view FROM (SELECT * FROM events WHERE event_type <> 'view') b "
    "ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON b.user_id = v.user_id AND b.ts >= v.ts"
)
def join_asof(spark, d):
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view"))
    others = e.filter("event_type <> 'view'").select("event_id", "user_id", "ts")
    return rel.asof_join(others, views, ["user_id"], "ts", "seen", ["view"]).select("event_id", "seen", "view")
