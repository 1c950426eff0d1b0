"""Inserts, updates, deletes and transactions, each shown by the table that results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siskin.engine import Engine, TransactionAborted
from siskin.plans.catalogue import query
from siskin.sources.tables import table


def _engine(spark, d) -> Engine:
    e = Engine(spark)
    e.sql("CREATE TABLE t(k int, v int, s varchar(32))")
    o = table(spark, d, "orders")
    e.insert("t", o.select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int"), "o_orderstatus"))
    return e


_T = "SELECT CAST(o_orderkey AS INTEGER) AS k, CAST(o_custkey AS INTEGER) AS v, o_orderstatus AS s FROM orders"


@query(f"SELECT * FROM ({_T}) UNION ALL SELECT -k - 1, v, s FROM ({_T}) WHERE v < 60 UNION ALL SELECT NULL, NULL, 'x'")
def insert_select(spark, d):
    e = _engine(spark, d)
    e.sql("INSERT INTO t SELECT -k - 1, v, s FROM t WHERE v < 60; INSERT INTO t VALUES (NULL, NULL, 'x')")
    return e.table("t")


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN v + 100 ELSE v END AS v, CASE WHEN k % 3 = 0 THEN 'new' ELSE s END AS s FROM ({_T})")
def update_where(spark, d):
    e = _engine(spark, d)
    e.sql("UPDATE t SET v = v + 100, s = 'new' WHERE k % 3 = 0")
    return e.table("t")


@query(f"SELECT k, v, s FROM ({_T}) WHERE NOT coalesce(v < 70 AND s = 'O', false)")
def delete_where(spark, d):
    e = _engine(spark, d)
    e.sql("DELETE FROM t WHERE v < 70 AND s = 'O'")
    return e.table("t")


@query("SELECT CAST(n_nationkey AS INTEGER) + 1 AS a, n_regionkey AS b FROM nation")
def update_pk_shift(spark, d):
    e = Engine(spark)
    e.sql("CREATE TABLE p(a int primary key, b int)")
    e.insert("p", table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    e.sql("UPDATE p SET a = a + 1")
    return e.table("p")


@query(f"SELECT (SELECT count(*) FROM ({_T})) AS inserted, (SELECT count(*) FROM ({_T}) WHERE k % 2 = 0) AS updated, (SELECT count(*) FROM ({_T}) WHERE k % 2 = 1) AS deleted")
def change_counts(spark, d):
    e = Engine(spark)
    e.sql("CREATE TABLE t(k int, v int, s varchar(32))")
    o = table(spark, d, "orders")
    n = e.insert("t", o.select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int"), "o_orderstatus"))
    u = e.sql("UPDATE t SET v = 0 WHERE k % 2 = 0").first()[0]
    x = e.sql("DELETE FROM t WHERE k % 2 = 1").first()[0]
    return spark.createDataFrame([(n, u, x)], "inserted long, updated long, deleted long")


@query("SELECT * FROM (VALUES ('a reads its snapshot', true), ('a conflict taints b', true), ('b is undone', true), ('a sees its own row', true), ('unseen write skew aborts', true)) t(fact, holds)")
def transaction_facts(spark, d):
    """Snapshots, first-writer conflicts, own writes and serializable validation."""
    e = Engine(spark)
    e.sql("CREATE TABLE m(k int, v int); INSERT INTO m VALUES (1, 10), (2, 20)")
    a, b = e.begin(), e.begin()
    e.update("m", {"v": "v + 1"}, "k = 1", a)
    own = e.table("m", a).filter("k = 1").first()["v"] == 11
    before = e.table("m", b).filter("k = 1").first()["v"] == 10
    try:
        e.update("m", {"v": "v + 5"}, "k = 1", b)
        tainted = False
    except TransactionAborted:
        tainted = b.state == "TAINTED"
    e.abort(b)
    e.commit(a)
    after = e.table("m").filter("k = 1").first()["v"] == 11
    x, y = e.begin("SERIALIZABLE"), e.begin("SERIALIZABLE")
    read_x, read_y = e.table("m", x, where="k = 2").first()["v"], e.table("m", y, where="k = 1").first()["v"]
    e.update("m", {"v": str(read_x)}, "k = 1", x)
    e.update("m", {"v": str(read_y)}, "k = 2", y)
    e.commit(x)
    try:
        e.commit(y)
        skew = False
    except TransactionAborted:
        skew = True
    facts = [("a reads its snapshot", before), ("a conflict taints b", tainted), ("b is undone", after), ("a sees its own row", own), ("unseen write skew aborts", skew)]
    return spark.createDataFrame(facts, "fact string, holds boolean")


@query(f"SELECT k, CASE WHEN k % 5 = 0 THEN v + 1000 ELSE v END AS v, s FROM ({_T}) WHERE k % 7 <> 0 OR k % 5 = 0 UNION ALL SELECT -1 - CAST(c_custkey AS INTEGER), CAST(c_nationkey AS INTEGER), 'c' FROM customer")
def merge_into(spark, d):
    e = _engine(spark, d)
    source = table(spark, d, "orders").filter("o_orderkey % 5 = 0 or o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("int").alias("a"), F.lit(1000).alias("b"), F.lit("o").alias("c"))
    source = source.unionAll(table(spark, d, "customer").select((-1 - F.col("c_custkey")).cast("int"), "c_nationkey", F.lit("c")))
    e.merge("t", source.alias("n"), "t.k = n.a", [("n.a % 5 = 0", {"v": "t.v + n.b"}), ("true", None)], ["n.a", "n.b", "n.c"])
    return e.table("t")


@query(f"SELECT s, count(*) AS n, CAST(sum(v * 2) AS BIGINT) AS doubled FROM ({_T}) WHERE v > 30 GROUP BY s")
def engine_view_and_function(spark, d):
    e = _engine(spark, d)
    e.sql("CREATE VIEW late AS SELECT * FROM t WHERE v > 30; CREATE FUNCTION doubled_value(x int) RETURNS int RETURN x * 2")
    return e.sql("SELECT s, count(*) AS n, sum(doubled_value(v)) AS doubled FROM late GROUP BY s")


@query(f"SELECT k, v + 1 AS more FROM ({_T})")
def registered_function(spark, d):
    e = _engine(spark, d)
    e.register("one_more", lambda x: x + 1, "int")
    return e.sql("SELECT k, one_more(v) AS more FROM t")


@query("SELECT * FROM (VALUES ('m', 'k:int, v:int'), ('i1', 'i1(k)'), ('i2', 'i2(k, v)'), ('level', 'SERIALIZABLE')) t(name, told)")
def engine_catalogue(spark, d):
    """What the commands show of tables, indexes and variables."""
    e = Engine(spark)
    e.sql("CREATE TABLE gone(a int); CREATE TABLE m(k int, v int); CREATE INDEX i1 ON m(k); CREATE INDEX i2 ON m USING hash (k, v); DROP TABLE gone; SET global_isolation_level = SERIALIZABLE")
    level = e.sql("SHOW global_isolation_level").select(F.lit("level").alias("name"), F.col("global_isolation_level").alias("told"))
    indexes = e.sql("\\di").select(F.substring_index("told", "(", 1).alias("name"), "told")
    return e.sql("\\dt").unionAll(indexes).unionAll(level)


_SQL = "SELECT a.s, count(*) AS n, max(b.v) AS top FROM (SELECT k, s FROM t WHERE k > 20) a INNER JOIN (SELECT k, v FROM t WHERE v IS NOT NULL) b ON a.k = b.k GROUP BY a.s HAVING count(*) > 1"


@query(f"WITH t AS ({_T}) {_SQL}")
def engine_sql_query(spark, d):
    return _engine(spark, d).sql(_SQL)


@query(f"WITH t AS ({_T}) SELECT k, rank() OVER (PARTITION BY s ORDER BY v) AS r FROM t UNION ALL SELECT 0, 0")
def engine_sql_window(spark, d):
    e = _engine(spark, d)
    ranks = e.sql("SELECT k, CAST(rank() OVER (PARTITION BY s ORDER BY v) AS bigint) AS r FROM t")
    return ranks.unionAll(e.sql("VALUES (0, CAST(0 AS bigint))"))
