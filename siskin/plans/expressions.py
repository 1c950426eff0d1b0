"""Conditions, patterns, hashes, JSON, maps, arrays and checked arithmetic in expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.plans.catalogue import query
from siskin.sources import tables
from siskin.sources.tables import sql, table

_CONDITIONS = (
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'some' ELSE 'much' END AS kind, coalesce(nullif(c_nationkey, 3), -1) AS nation, "
    "c_mktsegment LIKE '%I%G' AS pattern, c_nationkey IN (1, 2, 3) AS listed, nullif(c_nationkey, 3) IS NULL AS missing, CAST(c_acctbal AS BIGINT) IS NOT NULL AS given FROM customer"
)


@query(_CONDITIONS)
def conditions(spark, d):
    return sql(spark, d, _CONDITIONS)


@query("SELECT p_partkey, regexp_extract(p_name, '([a-z]+)[^a-z]*$', 1) AS last, regexp_replace(p_brand, '[0-9]', '#', 'g') AS brand, regexp_matches(p_type, '^[A-Z]+ ') AS words, length(p_name) AS size, substring(p_name, 2, 3) AS part, p_name || '/' || p_brand AS both FROM part")
def regex_and_strings(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", F.regexp_extract("p_name", "([a-z]+)[^a-z]*$", 1).alias("last"), F.regexp_replace("p_brand", "[0-9]", "#").alias("brand"), F.col("p_type").rlike("^[A-Z]+ ").alias("words"),
        F.char_length("p_name").cast("bigint").alias("size"), F.substring("p_name", 2, 3).alias("part"), F.concat("p_name", F.lit("/"), "p_brand").alias("both"),
    )


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, len(list(n_name)) AS size FROM nation GROUP BY n_regionkey")
def array_of_group(spark, d):
    names = F.sort_array(F.collect_list("n_name"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(names, ",").alias("names"), F.count("n_name").alias("size"))


@query("SELECT n_nationkey, n_regionkey AS value, 3 AS size FROM nation")
def map_lookup(spark, d):
    m = F.create_map(F.lit("a"), F.col("n_regionkey"), F.lit("b"), F.col("n_nationkey"), F.lit("c"), F.lit(None).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.element_at(m, "a").alias("value"), F.size(m).alias("size"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, o_orderdate + INTERVAL 1 DAY AS later, CAST(date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate)) AS INTEGER) AS days FROM orders")
def date_functions(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", at).cast("timestamp_ntz").alias("month"), F.year(at).alias("year"), (at + F.expr("INTERVAL 1 DAY")).alias("later"), F.date_diff(at, F.expr("DATE '1992-01-01'")).alias("days")
    )


# two integers, and what the checked operations give: NULL where the exact result is no integer
_PAIRS = [(2147483647, 1), (-2147483647, 5), (7, 0), (65536, 65536), (-9, 4), (None, 3), (0, 0)]
_SHOWN = ", ".join(f"({'NULL' if a is None else a}, {b})" for a, b in _PAIRS)
_FITS = "CASE WHEN {0} BETWEEN -2147483648 AND 2147483647 THEN CAST({0} AS INTEGER) END"


@query(
    f"SELECT a, b, {_FITS.format('a + b')} AS plus, {_FITS.format('a - b')} AS minus, {_FITS.format('a * b')} AS times, CASE WHEN b <> 0 THEN CAST(a AS DOUBLE) / b END AS over, CASE WHEN b <> 0 THEN a % b END AS rest "
    f"FROM (SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES {_SHOWN}) t(a, b))"
)
def checked_arithmetic(spark, d):
    """Overflow and division by zero as NULL; the plain operators raise, which the tests hold."""
    t = tables.values(spark, _PAIRS, "a int, b int")
    return t.select(
        F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.try_add("a", "b").alias("plus"), F.try_subtract("a", "b").alias("minus"), F.try_multiply("a", "b").alias("times"),
        F.try_divide(F.col("a").cast("double"), "b").alias("over"), F.try_mod("a", "b").cast("bigint").alias("rest"),
    )

