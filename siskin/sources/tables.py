"""Sources: the Parquet tables of a data folder, and virtual tables computed from row numbers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_schemas: dict[tuple[str, str, int], T.StructType] = {}


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a Parquet table, read from a footer once for each time that it changed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, path, changed)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return _schemas[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters are pushed into its Parquet scan."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables of a data folder under their names, for queries in SQL."""
    for name in names or NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in SQL, without a WITH of its own, over tables of a data folder; no view outlives it."""
    named = {n: table(spark, sf_dir, n) for n in NAMES if re.search(rf"\b{n}\b", text)}
    return spark.sql("WITH " + ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in named) + " " + text, **named)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)


# -- virtual tables -----------------------------------------------------------------------

def _i() -> Column:
    """The row number, from 0."""
    return F.col("id")


def _div(n: int) -> Column:
    return F.expr(f"id div {n}")


def _int(c: Column) -> Column:
    return c.cast("int")


def _only(c: Column, when: Column) -> Column:
    """c where the condition holds, else NULL."""
    return F.when(when, c)


# fixed values: the symbols that stand in string columns
PILE, ANGEL = "\U0001f4a9", "\U0001f607"
# fixed values: days of the week, and rows of the staff tables
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
STAFF = {"2022": 11, "2023": 9, "2023_fall": 11, "2024": 10, "2024_fall": 8, "2025_spring": 8, "2025_fall": 8}


def _agg_input(block: int, piles: int) -> dict[str, Column]:
    return {
        "v1": _int((_i() + 2) % 10), "v2": _int(_i()), "v3": _int((_i() + 50) % 100), "v4": _int(_div(block)), "v5": F.lit(233),
        "v6": F.repeat(F.lit(PILE), _int(_i() % piles + 1)),
    }


def _shifted(by: int) -> dict[str, Column]:
    c = (_i() + by) % 500_000
    return {"x": _int(c), "y": _int(10 * c)}


def _graph() -> dict[str, Column]:
    src, dst = _i() % 10, _div(10)
    return {"src": _int(src), "dst": _int(dst), "src_label": _int(100 * src), "dst_label": _int(100 * dst), "distance": _only(F.lit(1), src != dst)}


def _schedule(*lectures: int) -> dict[str, Column]:
    return {"day_of_week": F.element_at(F.array(*map(F.lit, DAYS)), _int(_i() + 1)), "has_lecture": F.when(_i().isin(*lectures), 1).otherwise(0)}


def _staff(n: int) -> dict[str, Column]:
    # people are numbered here: their names are data of others
    return {"github_id": F.format_string("member%02d", _i() + 1), "office_hour": F.element_at(F.array(*map(F.lit, DAYS[:5])), _int(_i() % 5 + 1))}


def _half_steps() -> dict[str, Column]:
    half = _div(2)
    return {"x": _int(_div(10_000)), "y": _int(10_000_000 - (half + _div(10_000) % 2 * (half % 2)))}


VIRTUAL: dict[str, tuple[int, Callable[[], dict[str, Column]]]] = {
    "__mock_table_1": (100, lambda: {"colA": _int(_i()), "colB": _int(100 * _i())}),
    "__mock_table_2": (100, lambda: {"colC": F.concat(_i().cast("string"), F.lit(f"-{PILE}")), "colD": F.repeat(F.lit(ANGEL), _int(_i() % 8))}),
    "__mock_table_3": (100, lambda: {"colE": _only(_int(_i()), _i() % 2 == 0), "colF": F.concat(_i().cast("string"), F.lit(f"-{PILE}"))}),
    "__mock_table_4": (100, lambda: {"colG": _only(_int(_i() % 5), _i() % 5 != 0), "colH": _only(F.repeat(F.lit(PILE), _int(_i() % 3 + 1)), _i() % 10 != 0)}),
    **{f"__mock_table_tas_{term}": (n, lambda n=n: _staff(n)) for term, n in STAFF.items()},
    "__mock_table_schedule_2022": (7, lambda: _schedule(1, 3)),
    "__mock_table_schedule": (7, lambda: _schedule(0, 2)),
    "__mock_agg_input_small": (1_000, lambda: _agg_input(100, 8)),
    "__mock_agg_input_big": (10_000, lambda: _agg_input(1_000, 16)),
    "__mock_external_merge_sort_input": (100_000, lambda: {"v1": _int(_i()), "v2": _int((_i() + 1777) % 15_000), "v3": _int((_i() + 3) % 111)}),
    "__mock_graph": (100, _graph),
    "__mock_table_123": (3, lambda: {"number": _int(_i() + 1)}),
    "__mock_t1": (1_000_000, lambda: {"x": _int(_div(10_000)), "y": _int(_i() % 10_000), "z": _int(_i())}),
    "__mock_t4_1m": (1_000_000, lambda: _shifted(0)),
    "__mock_t5_1m": (1_000_000, lambda: _shifted(30_000)),
    "__mock_t6_1m": (1_000_000, lambda: _shifted(60_000)),
    "__mock_t7": (1_000_000, lambda: {"v": _int(_i() % 20), "v1": _int(_i()), "v2": _int(_i())}),
    "__mock_t8": (10, lambda: {"v4": _int(_i())}),
    "__mock_t9": (10_000_000, _half_steps),
    "__mock_t10": (10_000, lambda: {"x": _int(_i()), "y": _int(10 * _i())}),
    "__mock_t11": (1_000_000, lambda: {"x": _int(-(_i() % 1000) - 1), "y": _int(10 * _i())}),
    "empty_table": (0, lambda: {"colA": _int(_i())}),
    "test_simple_seq_1": (10, lambda: {"col1": _int(_i())}),
    "test_simple_seq_2": (10, lambda: {"col1": _int(_i()), "col2": _int(10 + _i())}),
    "test_1": (1_000, lambda: {"colA": _int(_i()), **{f"col{c}": _uniform(i, top) for i, (c, top) in enumerate((("B", 10), ("C", 10_000), ("D", 100_000)))}}),
    "test_2": (100, lambda: {"colA": _int(_i()), "colB": _uniform(7, 1_000), "colC": _int(_i() % 10)}),
}


def _uniform(seed: int, top: int) -> Column:
    """Uniform below top, repeated every 128 rows."""
    return _int(F.pmod(F.xxhash64(_i() % 128, F.lit(seed)), F.lit(top)))


def virtual(spark: SparkSession, name: str, shuffle_seed: int | None = None) -> DataFrame:
    """A virtual table: row formulas over spark.range. A seed gives its rows in random order."""
    rows, columns = VIRTUAL[name]
    out = spark.range(rows)
    if shuffle_seed is not None:
        out = out.orderBy(F.rand(shuffle_seed))
    return out.select(*(c.alias(n) for n, c in columns().items()))


def random_rows(spark: SparkSession, rows: int, tops: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows with an integer column below each top, from a seed."""
    return spark.range(rows).select(*(F.floor(F.rand(seed + i) * top).cast("int").alias(c) for i, (c, top) in enumerate(tops.items())))
