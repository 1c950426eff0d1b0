"""Relational operators as thin DataFrame programs; Catalyst picks the physical strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A join side of at most so many bytes, by the optimizer's estimate, is sent to all executors.
BROADCAST_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows it; else df, joined by shuffle."""
    return F.broadcast(df) if size_of(df) <= most else df


def point_lookup(df: DataFrame, column: str, *keys) -> DataFrame:
    """Rows whose column is one of the keys; the filter reaches the scan's row groups."""
    return df.filter(F.col(column).isin(*keys))


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs; the right side is sent whole only if its size allows it."""
    return left.crossJoin(small(right))


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition. A non-equi join needs its right side small enough to send."""
    return left.join(small(right), condition, how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of a point and a range that holds it (low <= at < high), by equal buckets of the axis.

    Both sides are dealt by bucket, so neither has to fit into one task.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(r, "_b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, carried: list[str], width: float = 86_400.0) -> DataFrame:
    """Every row of left with the latest row of right (right_at and carried) of the same keys that is not later.

    Both columns of time are timestamps; rows of right that share keys and time must be one.
    Rows are dealt by keys and by stretches of `width` seconds, so a frequent key is split;
    what a stretch inherits comes from the last rows of the stretches before it.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width * 1e6))
    found = F.struct(right_at, *carried)
    none = F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType)
    both = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), none.alias("_found")).withColumn("_slot", slot("_at"))
    other = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), found.alias("_found")).withColumn("_slot", slot("_at"))
    both = both.unionByName(other, allowMissingColumns=True)
    last = other.groupBy(*by, "_slot").agg(F.max_by("_found", "_at").alias("_last"))
    # a row a key and stretch that has any: what was last before it
    slots = left.select(*by, slot(at).alias("_slot")).distinct().join(last, [*by, "_slot"], "full")
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    inside = Window.partitionBy(*by, "_slot").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_found", F.last("_found", ignorenulls=True).over(inside)).filter("_side = 1")
    out = out.join(slots, [*by, "_slot"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    return out.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in (right_at, *carried)))


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in order: each partition keeps n, the driver merges them."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, n: int, groups: list[str], *order: Column | str, ties: bool = True) -> DataFrame:
    """The first n rows of each group; with ties all rows of rank n or less.

    Spark filters ranks before the shuffle as well, so a large group sends few rows.
    """
    rank = (F.rank if ties else F.row_number)().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def with_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the number of rows that share its keys (NULLs too): counted with partial sums, so a frequent key is no task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    renamed = counts.select(name, *(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(renamed, same, "left").drop(*(f"_{k}" for k in keys))


def distinct_count_salted(df: DataFrame, group: str, column: str, salts: int = 32) -> DataFrame:
    """Distinct values a group, first within salted parts: a group with most rows is split."""
    parts = df.select(group, column).distinct().withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(salts)))
    return parts.groupBy(group, "_salt").agg(F.count(column).alias("_n")).groupBy(group).agg(F.sum("_n").alias("n"))
