"""Statements, errors and transactions of the engine."""

import pytest

from siskin.engine import Engine, EngineError, TransactionAborted


@pytest.fixture
def e(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t1(v1 int, v2 varchar(128), v3 int)")
    e.sql("INSERT INTO t1 VALUES (0, 'a', 10), (1, 'aa', 11), (2, NULL, 12)")
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_and_contents(e):
    assert e.sql("INSERT INTO t1 SELECT v1 + 10, v2, v3 FROM t1 WHERE v1 < 2").first()["insert_rows"] == 2
    assert e.sql("UPDATE t1 SET v3 = v3 + v1 WHERE v1 > 1").first()["update_rows"] == 3
    assert e.sql("DELETE FROM t1 WHERE v2 = 'a'").first()["delete_rows"] == 2
    assert rows(e.sql("SELECT * FROM t1")) == rows_of([(1, "aa", 11), (2, None, 14), (11, "aa", 22)])
    assert e.sql("DELETE FROM t1").first()[0] == 3
    assert e.sql("SELECT count(*) FROM t1").first()[0] == 0


def rows_of(x):
    return sorted(x, key=str)


def test_null_predicate_keeps_rows(e):
    assert e.sql("DELETE FROM t1 WHERE v2 <> 'zz'").first()[0] == 2
    assert rows(e.table("t1")) == [(2, None, 12)]


@pytest.mark.parametrize(
    "text",
    ["INSERT INTO t1 (v1) VALUES (1)", "INSERT INTO t1 VALUES (1, 'x')", "INSERT INTO t1 VALUES ('x', 'x', 1)", "UPDATE t1 SET nope = 1", "UPDATE t1 SET v1 = 1 FROM t1",
     "DROP TABLE nope", "CREATE TABLE t1(a int)", "CREATE TABLE t(a date)", "CREATE TABLE t(a varchar)", "CREATE TABLE t(a varchar(3) primary key)", "CREATE INDEX i ON t1(v2)",
     "CREATE INDEX i ON t1 USING btree (v1)", "COMMIT", "\\nope"],
)
def test_rejected(e, text):
    with pytest.raises(EngineError):
        e.sql(text)


def test_indexes_and_meta(e):
    e.sql("CREATE INDEX i1 ON t1(v1); CREATE INDEX i2 ON t1 USING hash (v1, v3)")
    assert [r["told"] for r in e.sql("\\di").collect()] == ["i1(v1)", "i2(v1, v3)"]
    assert "v2:string" in e.sql("\\dt").first()["told"]
    assert e.sql("\\help").count() == 4
    assert e.sql("\\dbgmvcc t1").count() == 2
    e.sql("SET force_optimizer_starter_rule = 'yes'")
    assert e.sql("SHOW force_optimizer_starter_rule").first()[0] == "yes"


def test_explain(e):
    assert "Project" in e.sql("EXPLAIN (o) SELECT v1 FROM t1 WHERE v1 > 0").first()["plan"]
    with pytest.raises(EngineError):
        e.sql("EXPLAIN (x) SELECT 1")


def test_vectors(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t(v vector(3), k integer); INSERT INTO t VALUES (ARRAY(1.0, 2.0, 3.0), 1)")
    assert e.table("t").first()["v"] == [1.0, 2.0, 3.0]


def test_primary_key(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE p(a int primary key, b int); INSERT INTO p VALUES (1, 1), (2, 2)")
    with pytest.raises(TransactionAborted):
        e.sql("INSERT INTO p VALUES (2, 5)")
    e.sql("UPDATE p SET a = a + 1")
    assert rows(e.table("p")) == [(2, 1), (3, 2)]
    e.sql("DELETE FROM p WHERE a = 2; INSERT INTO p VALUES (2, 9)")
    assert rows(e.table("p")) == [(2, 9), (3, 2)]


def test_snapshot_and_own_writes(e):
    t = e.begin()
    e.sql("INSERT INTO t1 VALUES (7, 'new', 1)")
    assert e.table("t1", t).count() == 3
    e.update("t1", {"v3": "0"}, "v1 = 0", t)
    assert e.table("t1", t).filter("v1 = 0").first()["v3"] == 0
    assert e.table("t1").filter("v1 = 0").first()["v3"] == 10
    e.commit(t)
    assert rows(e.table("t1").select("v1", "v3")) == [(0, 0), (1, 11), (2, 12), (7, 1)]


def test_first_writer_wins(e):
    a, b = e.begin(), e.begin()
    e.delete("t1", "v1 = 1", a)
    with pytest.raises(TransactionAborted):
        e.update("t1", {"v3": "1"}, "v1 >= 1", b)
    with pytest.raises(TransactionAborted):
        e.commit(b)
    e.abort(b)
    e.commit(a)
    assert e.table("t1").count() == 2


def test_statement_transactions(e):
    e.sql("BEGIN; DELETE FROM t1; ROLLBACK")
    assert e.table("t1").count() == 3
    e.sql("BEGIN; DELETE FROM t1 WHERE v1 = 0; COMMIT")
    assert e.table("t1").count() == 2


def test_serializable_reads(e):
    e.sql("SET global_isolation_level = serializable; BEGIN")
    e.sql("SELECT v1 FROM t1 WHERE v1 = 2").collect()
    e.sql("UPDATE t1 SET v3 = 5 WHERE v1 = 0")
    other = e.begin()
    e.update("t1", {"v3": "1"}, "v1 = 2", other)
    e.commit(other)
    with pytest.raises(TransactionAborted):
        e.sql("COMMIT")


def test_garbage(e):
    t = e.begin()
    e.sql("DELETE FROM t1 WHERE v1 = 0; DELETE FROM t1 WHERE v1 = 1")
    assert e.collect_garbage() == 1
    e.abort(t)
    assert e.collect_garbage() == 2
    assert e.table("t1").count() == 1


def test_a_read_through_the_table_is_validated(e):
    """Write skew: each reads what the other writes."""
    a, b = e.begin("SERIALIZABLE"), e.begin("SERIALIZABLE")
    e.table("t1", a, where="v1 = 1").collect()
    e.table("t1", b, where="v1 = 0").collect()
    e.update("t1", {"v3": "1"}, "v1 = 0", a)
    e.update("t1", {"v3": "1"}, "v1 = 1", b)
    e.commit(a)
    with pytest.raises(TransactionAborted):
        e.commit(b)
    assert b.state == "ABORTED" and e.table("t1").filter("v3 = 1").count() == 1


def test_many_commits_are_merged_and_collected(spark, monkeypatch):
    from siskin import engine

    monkeypatch.setattr(engine, "MERGE_AFTER", 2)
    e = Engine(spark)
    e.sql("CREATE TABLE t(k int primary key, v int); INSERT INTO t VALUES (1, 0), (2, 0), (3, 0)")
    reader = e.begin()
    for i in range(1, 6):
        e.sql(f"UPDATE t SET v = {i} WHERE k = {i % 3 + 1}")
    assert rows(e.table("t", reader)) == [(1, 0), (2, 0), (3, 0)]
    want = [(1, 3), (2, 4), (3, 5)]
    assert rows(e.table("t")) == want and [v.changes for v in e.tables["t"].versions][-1] <= 2
    assert e.collect_garbage() == 1  # the empty version before the reader's
    assert rows(e.table("t", reader)) == [(1, 0), (2, 0), (3, 0)] and rows(e.table("t")) == want
    e.abort(reader)
    assert e.collect_garbage() == 5 and rows(e.table("t")) == want
    e.sql("DELETE FROM t WHERE k = 2")
    assert rows(e.table("t")) == [(1, 3), (3, 5)]
    e.sql("DROP TABLE t; CREATE TABLE t(a int)")
    assert e.table("t").count() == 0


def test_views_functions_and_merge(e):
    e.sql("CREATE VIEW big AS SELECT v1, v3 FROM t1 WHERE v3 > 10; CREATE FUNCTION twice(x int) RETURNS int RETURN 2 * x")
    assert rows(e.sql("SELECT twice(v3) FROM big")) == [(22,), (24,)]
    e.register("plus_one", lambda s: s + 1, "int")
    assert rows(e.sql("SELECT plus_one(v3) FROM big")) == [(12,), (13,)]
    e.sql("CREATE TABLE s(k int, n int); INSERT INTO s VALUES (0, 5), (1, 6), (9, 7)")
    n = e.sql("MERGE INTO t1 AS t USING s ON t.v1 = s.k WHEN MATCHED AND s.n > 5 THEN DELETE WHEN MATCHED THEN UPDATE SET v3 = t.v3 + s.n WHEN NOT MATCHED THEN INSERT VALUES (s.k, 'new', s.n)")
    assert n.first()["merge_rows"] == 3
    assert rows(e.table("t1")) == rows_of([(0, "a", 15), (2, None, 12), (9, "new", 7)])
    e.sql("INSERT INTO s VALUES (0, 8)")
    with pytest.raises(EngineError):
        e.sql("MERGE INTO t1 USING s ON v1 = k WHEN MATCHED THEN UPDATE SET v3 = n")
    with pytest.raises(EngineError):
        e.sql("CREATE VIEW big AS SELECT 1")
    e.sql("DROP VIEW big; DROP TABLE IF EXISTS nothing")
    with pytest.raises(EngineError):
        e.sql("DROP VIEW big")


def test_arithmetic_errors(spark):
    for text in ("SELECT 2147483647 + 1", "SELECT 1 / 0", "SELECT 5 % 0", "SELECT CAST(3000000000 AS int)"):
        with pytest.raises(Exception, match="OVERFLOW|ZERO"):
            Engine(spark).sql(text).collect()
