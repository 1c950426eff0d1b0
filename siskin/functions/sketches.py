"""Sketches and mergeable sets as DataFrame programs.

Registers and counters are ordinary rows, so they are built by partial aggregation,
merged by union and aggregated again, and stored like any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: the constant of the cardinality estimate
HLL_SCALE = 0.79402


def _top_bits(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")


def _leading_one(h: Column, bits: int) -> Column:
    """Place of the first one among the bits below the register's, from 1."""
    rest = F.shiftleft(h, bits) if bits else h
    text = F.lpad(F.bin(rest), 64, "0")
    place = F.instr(text, "1")
    return F.when(place == 0, 64 - bits + 1).otherwise(F.least(place, F.lit(64 - bits + 1))).cast("int")


def hll_registers(df: DataFrame, column: str, bits: int = 10) -> DataFrame:
    """(register, rank): the largest place of a leading one in each register."""
    bits = max(bits, 0)
    h = F.xxhash64(column)
    hashed = df.filter(F.col(column).isNotNull()).select(_top_bits(h, bits).alias("register"), _leading_one(h, bits).alias("rank"))
    return hashed.groupBy("register").agg(F.max("rank").alias("rank"))


def hll_presto_registers(df: DataFrame, column: str, bits: int = 10) -> DataFrame:
    """(register, rank, dense, overflow): rank is the number of trailing zeros, kept in 4 + 3 bits.

    A 64-bit integer (or a shorter one) is its own hash; other values are hashed.
    """
    bits = max(bits, 0)
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    h = F.col(column).cast("bigint") if whole else F.xxhash64(column)
    reversed_ = F.reverse(F.lpad(F.bin(h), 64, "0"))
    zeros = F.least(F.when(F.instr(reversed_, "1") == 0, 64 - bits).otherwise(F.instr(reversed_, "1") - 1), F.lit(64 - bits))
    out = df.filter(F.col(column).isNotNull()).select(_top_bits(h, bits).alias("register"), zeros.cast("int").alias("rank")).groupBy("register").agg(F.max("rank").alias("rank"))
    return out.withColumns({"dense": F.col("rank").bitwiseAND(F.lit(15)), "overflow": F.shiftright("rank", 4)})


def hll_merge(*registers: DataFrame) -> DataFrame:
    out = registers[0]
    for other in registers[1:]:
        out = out.unionByName(other)
    return out.groupBy("register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, bits: int = 10) -> DataFrame:
    """One row, estimate (decimal, as it may pass 64 bits): the floor of the scaled harmonic mean; registers without a row count as 0."""
    if bits < 0:
        return registers.agg(F.lit(0).cast("decimal(20,0)").alias("estimate"))
    m = 1 << bits
    total = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)) + (F.lit(m) - F.count(F.lit(1)))
    return registers.agg(F.when(F.count(F.lit(1)) == 0, 0).otherwise(F.lit(HLL_SCALE * m * m) / total).cast("decimal(38,6)").alias("e")).select(F.floor("e").cast("decimal(20,0)").alias("estimate"))


class CountMin:
    """Counters (row, bucket, n) of a Count-Min sketch of the given width and depth."""

    def __init__(self, width: int, depth: int, counters: DataFrame | None = None):
        if width < 1 or depth < 1:
            raise ValueError("width and depth must be positive")
        self.width, self.depth, self.counters = width, depth, counters

    def _cells(self, df: DataFrame, column: str) -> DataFrame:
        rows = F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1))).alias("row")
        return df.select("*", rows).withColumn("bucket", F.pmod(F.xxhash64("row", column), F.lit(self.width)))

    def insert(self, df: DataFrame, column: str) -> CountMin:
        """A sketch of this one's items and df's; NULLs are not counted."""
        once = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        new = self._cells(once, column).groupBy("row", "bucket").agg(F.sum("n").alias("n"))
        return self.merge(CountMin(self.width, self.depth, new))

    def merge(self, other: CountMin) -> CountMin:
        if (self.width, self.depth) != (other.width, other.depth):
            raise ValueError("sketches of different sizes do not merge")
        if self.counters is None or other.counters is None:
            return CountMin(self.width, self.depth, other.counters if self.counters is None else self.counters)
        both = self.counters.unionByName(other.counters)
        return CountMin(self.width, self.depth, both.groupBy("row", "bucket").agg(F.sum("n").alias("n")))

    def clear(self) -> CountMin:
        return CountMin(self.width, self.depth)

    def count(self, candidates: DataFrame, column: str) -> DataFrame:
        """Distinct candidates with estimate, never below their true count."""
        asked = self._cells(candidates.select(column).distinct(), column)
        if self.counters is None:
            return asked.groupBy(column).agg(F.lit(0).cast("bigint").alias("estimate"))
        # counters are width x depth rows at most, whatever was inserted
        found = asked.join(F.broadcast(self.counters), ["row", "bucket"], "left")
        return found.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("estimate"))

    def top_k(self, k: int, candidates: DataFrame, column: str) -> DataFrame:
        return self.count(candidates, column).orderBy(F.desc("estimate"), column).limit(k)

    def exact_top_k(self, k: int, df: DataFrame, column: str) -> DataFrame:
        """The k most frequent values of df, NULL among them, with their counts as estimate. The sketch must hold all of df.

        No estimate is below its count, so a value estimated under the least count of the first k
        by estimate is not among the k. All others are counted in df.
        """
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("estimate"))
        held = self.count(df.filter(F.col(column).isNotNull()), column)
        first = held.orderBy(F.desc("estimate"), column).limit(k).select(column)
        least = counts.join(F.broadcast(first), column, "left_semi").agg(F.min("estimate").alias("least"))
        kept = held.join(F.broadcast(least), F.col("estimate") >= F.col("least")).select(column)
        # NULLs are not in a sketch
        found = counts.join(kept, column, "left_semi").unionByName(counts.filter(F.col(column).isNull()))
        return found.orderBy(F.desc("estimate"), F.asc_nulls_last(column)).limit(k)


class ORSet:
    """An add-wins set: rows added under unique ids, and the (element, id) pairs removed since."""

    def __init__(self, adds: DataFrame, removed: DataFrame | None = None):
        self.adds = adds.select("elem", "uid").distinct()
        self.removed = self.adds.limit(0) if removed is None else removed.select("elem", "uid").distinct()

    def add(self, rows: DataFrame) -> ORSet:
        return ORSet(self.adds.unionByName(rows.select("elem", "uid")), self.removed)

    def remove(self, elements: DataFrame) -> ORSet:
        """Remove what this replica has seen of the elements; later or unseen additions stay."""
        seen = self.adds.join(elements.select("elem").distinct(), "elem", "left_semi")
        return ORSet(self.adds, self.removed.unionByName(seen))

    def merge(self, other: ORSet) -> ORSet:
        return ORSet(self.adds.unionByName(other.adds), self.removed.unionByName(other.removed))

    def elements(self) -> DataFrame:
        return self.adds.join(self.removed, ["elem", "uid"], "left_anti").select("elem").distinct()

    def contains(self, element) -> bool:
        return not self.elements().filter(F.col("elem") == element).isEmpty()


class Replicas:
    """Versioned saves of one set by several nodes, and their synchronisation."""

    def __init__(self):
        self.saved: list[tuple[str, ORSet]] = []

    def save(self, node: str, state: ORSet) -> int:
        self.saved.append((node, state))
        return len(self.saved) - 1

    def load(self, version: int) -> ORSet:
        return self.saved[version][1]

    def sync(self, state: ORSet) -> ORSet:
        """The state merged with each node's latest save."""
        for _, other in dict(self.saved).items():
            state = state.merge(other)
        return state


class OrderedSet:
    """Unique keys in order."""

    def __init__(self, keys: DataFrame):
        self.keys = keys.toDF("key").distinct()

    def insert(self, keys: DataFrame) -> OrderedSet:
        return OrderedSet(self.keys.union(keys.toDF("key")))

    def erase(self, keys: DataFrame) -> OrderedSet:
        return OrderedSet(self.keys.join(keys.toDF("key"), "key", "left_anti"))

    def contains(self, key) -> bool:
        return not self.keys.filter(F.col("key") == key).isEmpty()

    def size(self) -> int:
        return self.keys.count()

    def ordered(self) -> DataFrame:
        return self.keys.orderBy("key")

    def clear(self) -> OrderedSet:
        return OrderedSet(self.keys.limit(0))


class KeyValues:
    """A persistent map by string key: put and remove give new versions, old ones stay as they are."""

    def __init__(self, entries: DataFrame):
        self.entries = entries.select("key", "value")

    def get(self, key: str):
        row = self.entries.filter(F.col("key") == key).first()
        return row["value"] if row else None

    def put(self, entries: DataFrame) -> KeyValues:
        new = entries.select("key", "value")
        return KeyValues(self.entries.join(new, "key", "left_anti").unionByName(new))

    def remove(self, *keys: str) -> KeyValues:
        return KeyValues(self.entries.filter(~F.col("key").isin(*keys)))

    def starting_with(self, prefix: str) -> DataFrame:
        return self.entries.filter(F.col("key").startswith(prefix))
