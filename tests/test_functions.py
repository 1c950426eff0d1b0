"""Strict functions, sketches, sets, writers, virtual tables, streams."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siskin import streaming
from siskin.functions import shown, sketches, strings, vectors
from siskin.operators import graph
from siskin.sources import tables


def test_case_functions_are_strict(spark):
    df = spark.createDataFrame([("aB", 1)], "s string, n int")
    assert df.select(strings.upper(df, "s"), strings.lower(df, "s")).first()[:] == ("AB", "ab")
    for wrong in (("n",), ("s", "s"), ()):
        with pytest.raises(strings.ArgumentError):
            strings.upper(df, *wrong)


def test_vector_length(spark):
    with pytest.raises(ValueError):
        vectors.vector(1.0, 2.0, length=3)


@pytest.mark.parametrize("bits", [4, 8, 10])
def test_hll_bounds(spark, bits):
    n = 20 << bits
    regs = sketches.hll_registers(spark.range(n), "id", bits)
    got = sketches.hll_estimate(regs, bits).first()[0]
    assert 0.55 * n < got < 1.7 * n
    empty = sketches.hll_registers(spark.range(0), "id", bits)
    assert sketches.hll_estimate(empty, bits).first()[0] == 0


def test_hll_merge_is_idempotent(spark):
    r = sketches.hll_registers(spark.range(1000), "id", 6)
    assert sorted(map(tuple, sketches.hll_merge(r, r, r).collect())) == sorted(map(tuple, r.collect()))
    assert sketches.hll_presto_registers(spark.range(1000), "id", 4).filter("dense + 16 * overflow != rank").count() == 0


def test_count_min(spark):
    with pytest.raises(ValueError):
        sketches.CountMin(0, 1)
    words = spark.createDataFrame([(w,) for w in "a a a b b c".split()] + [(None,)], "w string")
    s = sketches.CountMin(50, 4).insert(words, "w")
    got = {r["w"]: r["estimate"] for r in s.count(words.filter("w is not null"), "w").collect()}
    assert got["a"] >= 3 and got["b"] >= 2 and got["c"] >= 1
    twice = s.merge(s)
    assert twice.top_k(1, words.filter("w is not null"), "w").first()["estimate"] >= 6
    assert s.clear().count(words.filter("w = 'a'"), "w").first()["estimate"] == 0
    with pytest.raises(ValueError):
        s.merge(sketches.CountMin(50, 3))


def test_count_min_exact_top_k(spark):
    words = spark.createDataFrame([(w,) for w in "aaaaabbbbccdefghijklmnop"] + [(None,)] * 4, "w string")
    for width, depth in ((1, 1), (2, 3), (50, 4)):
        s = sketches.CountMin(width, depth).insert(words, "w")
        assert [tuple(r) for r in s.exact_top_k(4, words, "w").collect()] == [("a", 5), ("b", 4), (None, 4), ("c", 2)]
        # fewer values than asked for
        assert s.exact_top_k(99, words, "w").count() == 17
    assert sketches.CountMin(2, 3).insert(words.limit(0), "w").exact_top_k(4, words.limit(0), "w").isEmpty()


pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=6)


@settings(max_examples=5, deadline=None)
@given(pairs, pairs, st.lists(st.integers(0, 4), max_size=3))
def test_orset_merge_commutes(spark, a, b, gone):
    form = "elem int, uid int"
    x = sketches.ORSet(spark.createDataFrame(a, form))
    y = sketches.ORSet(spark.createDataFrame(b, form)).remove(spark.createDataFrame([(g,) for g in gone], "elem int"))
    values = lambda s: sorted(r[0] for r in s.elements().collect())
    want = sorted({e for e, u in set(a) | set(b) if not (e in gone and (e, u) in set(b))})
    assert values(x.merge(y)) == values(y.merge(x)) == values(x.merge(y).merge(y)) == want


def test_replicas_and_ordered_keys(spark):
    one = sketches.ORSet(spark.createDataFrame([("x", 1)], "elem string, uid int"))
    two = sketches.ORSet(spark.createDataFrame([("y", 2)], "elem string, uid int"))
    r = sketches.Replicas()
    assert r.save("n1", one) == 0 and r.save("n2", two) == 1
    assert r.sync(r.load(0)).contains("y")
    keys = sketches.OrderedSet(spark.createDataFrame([(3,), (1,), (3,)], "key int"))
    keys = keys.insert(spark.createDataFrame([(2,)], "key int")).erase(spark.createDataFrame([(1,)], "key int"))
    assert [k[0] for k in keys.ordered().collect()] == [2, 3] and keys.size() == 2 and not keys.contains(1)
    v1 = sketches.KeyValues(spark.createDataFrame([("ab", 1), ("abc", 2), ("b", 3)], "key string, value int"))
    v2 = v1.put(spark.createDataFrame([("ab", 9)], "key string, value int")).remove("b")
    assert (v1.get("ab"), v2.get("ab"), v2.get("b"), v1.starting_with("ab").count()) == (1, 9, None, 2)


@pytest.mark.parametrize("name", [n for n in tables.VIRTUAL if tables.VIRTUAL[n][0] <= 100_000])
def test_virtual_tables_have_their_rows(spark, name):
    assert tables.virtual(spark, name).count() == tables.VIRTUAL[name][0]


def test_virtual_formulas(spark):
    t4 = {r["colG"]: r for r in tables.virtual(spark, "__mock_table_4").limit(20).collect()}
    assert None in t4
    g = tables.virtual(spark, "__mock_graph")
    assert g.agg(F.count("distance")).first()[0] == 90
    assert tables.virtual(spark, "__mock_t10").join(tables.virtual(spark, "__mock_t11"), "x").count() == 0
    t9 = tables.virtual(spark, "__mock_t9").filter("x >= 998").groupBy("x").agg(F.min("y"))
    assert dict(map(tuple, t9.collect())) == {998: 5005001, 999: 5000000}
    shuffled = tables.virtual(spark, "__mock_t8", shuffle_seed=3)
    assert sorted(r[0] for r in shuffled.collect()) == list(range(10))


def test_graph_hops(spark):
    g = tables.virtual(spark, "__mock_graph").select("src", "dst", "distance")
    assert graph.two_hops(g, g).agg(F.count("distance"), F.sum("distance")).first()[:] == (100, 200)
    best = graph.shortest_within(g, 2)
    assert best.agg(F.count("distance"), F.sum("distance")).first()[:] == (100, 110)


def test_writers(spark):
    df = spark.createDataFrame([(1, None, 1.5, True, [1.0]), (None, "<b>", None, None, None)], "a int, s string, d double, t boolean, v array<double>")
    assert shown.text(df).splitlines() == ["1 varlen_null 1.500000 true [1.000000]", "integer_null <b> decimal_null boolean_null vector_null"]
    assert "&lt;b&gt;" in shown.as_html(df) and shown.grid(df).startswith("+")


def test_presto_registers_of_integers(spark):
    def told(bits, *values):
        r = sketches.hll_presto_registers(spark.createDataFrame([(v,) for v in values], "v long"), "v", bits)
        return {x["register"]: (x["dense"], x["overflow"]) for x in r.collect()}, int(sketches.hll_estimate(r, bits).first()[0])

    top = -(1 << 63)
    assert told(1, 262144) == ({0: (2, 1)}, 3)
    assert told(1, 262144, 0) == ({0: (15, 3)}, 3)
    registers, estimate = told(1, 262144, 0, -9151314442816847872, -1)
    assert registers == {0: (15, 3), 1: (8, 3)} and abs(estimate / 227086569448168320 - 1) < 1e-9
    registers, estimate = told(1, 0, top)
    assert registers == {0: (15, 3), 1: (15, 3)} and abs(estimate / 14647083729406857216 - 1) < 1e-9
    assert told(0, 65536)[0] == {0: (0, 1)} and told(0, 65536, top)[0] == {0: (15, 3)} and told(0, 0, top)[0] == {0: (0, 4)}
    empty = sketches.hll_presto_registers(spark.range(0), "id", 1)
    assert int(sketches.hll_estimate(empty, 1).first()[0]) == 0


def test_result_lines(spark):
    from siskin.functions import shown as writers

    df = spark.createDataFrame([(1, 1.5, None, True, [1.0]), (None, None, "x", None, None)], "a int, b double, c string, d boolean, e array<double>")
    assert [r[0] for r in writers.lines(df, "|").collect()] == [writers.text(df.filter("a = 1"), "|"), writers.text(df.filter("a is null"), "|")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming.counts(streaming.read(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, streaming.counts(events).collect()))
