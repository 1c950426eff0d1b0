"""Scans, projections, filters, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.functions import shown, strings, vectors
from siskin.operators import relational as rel
from siskin.plans.catalogue import query
from siskin.sources import tables
from siskin.sources.tables import table


@query("SELECT r_regionkey, r_name FROM region")
def scan_all_region(spark, d):
    return table(spark, d, "region").select("r_regionkey", "r_name")


@query("SELECT l_orderkey, l_linenumber + 10 - 3 AS moved, l_linenumber - l_linenumber AS zero FROM lineitem")
def project_arith(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", (n + 10 - 3).alias("moved"), (n - n).alias("zero"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE (c_nationkey < 5 AND c_acctbal > 1000) OR c_mktsegment = 'BUILDING'")
def filter_and_or(spark, d):
    c = table(spark, d, "customer")
    return c.filter(((c.c_nationkey < 5) & (c.c_acctbal > 1000)) | (c.c_mktsegment == "BUILDING")).select("c_custkey", "c_mktsegment")


_THREE = "(1, true, false), (2, true, NULL), (3, NULL, false), (4, NULL, NULL), (5, false, false), (6, true, true)"


@query(f"SELECT k, a AND b AS both, a OR b AS either, x + 1 AS more FROM (SELECT k, a, b, CASE WHEN a THEN 1 END AS x FROM (VALUES {_THREE}) t(k, a, b)) t")
def three_valued_logic(spark, d):
    rows = [(1, True, False), (2, True, None), (3, None, False), (4, None, None), (5, False, False), (6, True, True)]
    t = tables.values(spark, rows, "k int, a boolean, b boolean")
    return t.select("k", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (F.when(F.col("a"), 1) + 1).alias("more"))


@query(f"SELECT k FROM (VALUES {_THREE}) t(k, a, b) WHERE a OR b")
def filter_keeps_true(spark, d):
    rows = [(1, True, False), (2, True, None), (3, None, False), (4, None, None), (5, False, False), (6, True, True)]
    return tables.values(spark, rows, "k int, a boolean, b boolean").filter(F.col("a") | F.col("b")).select("k")


@query("SELECT n_nationkey, lower(n_name) AS low, upper(lower(n_name)) AS up FROM nation")
def case_functions(spark, d):
    n = table(spark, d, "nation")
    low = n.select("n_nationkey", strings.lower(n, "n_name").alias("low"))
    return low.select("*", strings.upper(low, "low").alias("up"))


@query("SELECT a, b, c FROM (VALUES (1, 'x', 1.5::DOUBLE), (2, NULL, 2.5::DOUBLE), (NULL, 'z', NULL)) t(a, b, c)")
def values_rows(spark, d):
    return tables.values(spark, [(1, "x", 1.5), (2, None, 2.5), (None, "z", None)], "a int, b string, c double")


@query("SELECT 1 + 2 AS three, 'a' AS letter")
def select_without_from(spark, d):
    return spark.range(1).select((F.lit(1) + F.lit(2)).alias("three"), F.lit("a").alias("letter"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return rel.point_lookup(table(spark, d, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 3 OR o_orderkey = 500 OR 901 = o_orderkey")
def or_point_lookup(spark, d):
    return rel.point_lookup(table(spark, d, "orders"), "o_orderkey", 3, 500, 901).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_suppkey")
def ordered_index_scan(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey >= 100 AND p_size = 10")
def range_and_eq_filter(spark, d):
    return table(spark, d, "part").filter((F.col("p_partkey") >= 100) & (F.col("p_size") == 10)).select("p_partkey", "p_size")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey = CAST('7' AS INTEGER) OR CAST('12' AS INTEGER) < n_nationkey")
def string_number_compare(spark, d):
    n = table(spark, d, "nation")
    return n.filter((n.n_nationkey == F.lit("7")) | (F.lit("12") < n.n_nationkey)).select("n_nationkey")


@query("SELECT n_nationkey = 3 AS eq, n_nationkey <> 3 AS ne, n_nationkey < 3 AS lt, n_nationkey <= 3 AS le, n_nationkey > 3 AS gt, n_nationkey >= 3 AS ge, n_nationkey FROM nation")
def all_comparisons(spark, d):
    c = F.col("n_nationkey")
    return table(spark, d, "nation").select((c == 3).alias("eq"), (c != 3).alias("ne"), (c < 3).alias("lt"), (c <= 3).alias("le"), (c > 3).alias("gt"), (c >= 3).alias("ge"), "n_nationkey")


@query("SELECT -n_nationkey AS minus, NOT (n_regionkey = 1) AS other FROM nation")
def unary_operators(spark, d):
    return table(spark, d, "nation").select((-F.col("n_nationkey")).alias("minus"), (~(F.col("n_regionkey") == 1)).alias("other"))


@query("SELECT p_partkey, [p_retailprice, CAST(p_size AS DOUBLE), 1.0::DOUBLE] AS v FROM part")
def vector_construct(spark, d):
    return table(spark, d, "part").select("p_partkey", vectors.vector(F.col("p_retailprice"), F.col("p_size"), 1.0, length=3).alias("v"))


@query("SELECT x AS \"colA\", 100 * x AS \"colB\" FROM (SELECT unnest(range(0, 100))::INTEGER AS x)")
def virtual_table_rows(spark, d):
    return tables.virtual(spark, "__mock_table_1")


@query("SELECT count(*) AS rows, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM (SELECT (i + 30000) % 500000 AS x, 10 * ((i + 30000) % 500000) AS y FROM (SELECT unnest(range(0, 1000000)) AS i))")
def virtual_table_sums(spark, d):
    return tables.virtual(spark, "__mock_t5_1m").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("SELECT n_nationkey * 3 AS times, n_nationkey // 4 AS div, n_nationkey % 4 AS mod, greatest(n_nationkey, n_regionkey) AS hi, least(n_nationkey, n_regionkey) AS lo, sqrt(n_nationkey * n_nationkey) AS root FROM nation")
def type_math(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    half = F.expr("cast(n_nationkey div 4 as int)").alias("div")
    return table(spark, d, "nation").select((n * 3).alias("times"), half, (n % 4).alias("mod"), F.greatest(n, r).alias("hi"), F.least(n, r).alias("lo"), F.sqrt(n * n).alias("root"))


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS later FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01'")
def timestamp_compare(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '1995-01-01'"))
    return o.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("later"))


_WORDS = "('true'), ('1'), ('t'), ('false'), ('0'), ('f'), (NULL)"


@query(f"SELECT w, CAST(w AS BOOLEAN) AS b, CAST(CAST(w AS BOOLEAN) AS INTEGER) AS i FROM (VALUES {_WORDS}) t(w)")
def boolean_casts(spark, d):
    t = tables.values(spark, [("true",), ("1",), ("t",), ("false",), ("0",), ("f",), (None,)], "w string")
    b = F.col("w").cast("boolean")
    return t.select("w", b.alias("b"), b.cast("int").alias("i"))


@query("SELECT count(*) AS n, min(a) >= 0 AND max(a) < 10 AND min(b) >= 0 AND max(b) < 1000 AS inside, count(DISTINCT a) AS kinds FROM (SELECT i % 10 AS a, i % 1000 AS b FROM (SELECT unnest(range(0, 5000)) AS i))")
def random_table(spark, d):
    a, b = F.col("a"), F.col("b")
    inside = (F.min(a) >= 0) & (F.max(a) < 10) & (F.min(b) >= 0) & (F.max(b) < 1000)
    return tables.random_rows(spark, 5000, {"a": 10, "b": 1000}, seed=3).agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), F.countDistinct(a).alias("kinds"))


_GENERATED = "SELECT '{0}' AS name, count(*) AS n, min({1}) AS lo, max({1}) AS hi FROM (SELECT CAST({2} AS INTEGER) AS {1} FROM (SELECT unnest(range(0, {3})) AS i))"


@query(" UNION ALL ".join(_GENERATED.format(*x) for x in (("empty_table", "k", "i", 0), ("test_simple_seq_1", "k", "i", 10), ("test_simple_seq_2", "k", "10 + i", 10), ("test_1", "k", "i", 1000), ("test_2", "k", "i % 10", 100))))
def generated_tables(spark, d):
    keys = (("empty_table", "colA"), ("test_simple_seq_1", "col1"), ("test_simple_seq_2", "col2"), ("test_1", "colA"), ("test_2", "colC"))
    parts = [tables.virtual(spark, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")) for t, c in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("SELECT n_nationkey || ' | ' || coalesce(CAST(nullif(n_regionkey, 1) AS VARCHAR), 'integer_null') || ' | ' || n_name AS line FROM nation")
def result_lines(spark, d):
    """Cells as the result writers show them, made by the executors."""
    return shown.lines(table(spark, d, "nation").select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(1)).alias("r"), "n_name"), " | ")
