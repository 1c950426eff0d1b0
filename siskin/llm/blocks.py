"""Shared plumbing of the training-data operators.

Texts travel as Arrow columns and are worked on in small slices, so a Python worker
holds a few megabytes of intermediate arrays however large its partition is.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or sent with --py-files; the extra path entry
    then names nothing and does no harm.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *([have] if have else [])])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a default is set only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that operators wrote to the shared folder; results that read them must be stored by then."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, spark: SparkSession, *by: str, codec: str = "zstd") -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(spark).rstrip('/')}/siskin-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects its garbage; between large steps it is asked to.
    The driver's heap shrinks by that, too.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of df's input files as the optimizer estimates them; where it cannot, of its texts."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if told < 1 << 53:
        return told
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def spark_hash(*columns: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit integers as Spark computes it, one column after another."""
    # fixed values: the primes of the hash function
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = (h + p5 + np.uint64(8)) ^ (turned(c.view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def numbered(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on seed alone."""
    start = np.uint64((seed * _GOLD) & (2**64 - 1))
    return mixed(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grown(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 2**64))
            have = np.concatenate([have, have * step])
        return have

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grown(self.up, self.base, n)
            self.down = self._grown(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


class Spans:
    """64-bit polynomial hashes of any spans of a symbol sequence."""

    #: One base for all seeds; a seed has its own numbers for the symbols.
    _powers = Powers(int(numbered(1, 1)[0]))
    _tables: dict[int, np.ndarray] = {}

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        """symbols: bytes, or unsigned 64-bit numbers that are already well mixed."""
        up, self.down = self._powers.of(len(symbols) + 1)
        if symbols.dtype == np.uint8:
            if seed not in self._tables:
                self._tables[seed] = numbered(256, seed + 1000)
            terms = self._tables[seed][symbols]
            terms *= up[: len(symbols)]
        else:
            terms = symbols * up[: len(symbols)]
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(x + (ends - starts).astype(np.uint64) * np.uint64(_GOLD))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each row's bounds in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    if data is None or not at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches to about `most` bytes of text; yields rows, their bytes, their bounds."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1))
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, at: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts, split at ASCII white space.

    Returns the lower-cased bytes, each word's start, end and 64-bit hash, and each
    row's bounds among the words.
    """
    low = _LOWER[data]
    space = _SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1] if len(low) else space
    after = np.concatenate([space[1:], [True]]) | edge[1:] if len(low) else space
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    named = Spans(low, seed).hash(starts, ends)
    return low, starts, ends, named, np.searchsorted(starts, at)


def held_out(column: str, remainder: int):
    """crc32(doc_id as text) mod 5 is the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def with_columns(docs: DataFrame, added: str, make, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """docs with the columns of the DDL string `added`, made slice by slice from its texts.

    make() is called once per task and returns f(rows, bytes, bounds) -> list of arrays.
    Columns of docs whose names clash (in any case) with an added one are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    clash = {f.name.lower() for f in new}
    kept = [f for f in docs.schema if f.name.lower() not in clash]
    schema = StructType(kept + list(new))
    wanted = [f.name for f in kept] + ([] if any(f.name == text for f in kept) else [text])
    n, arrow = len(kept), to_arrow_schema(schema)

    def run(batches):
        f = make()
        for rows, data, at in slices(batches, text, most):
            arrays = [rows.column(i) for i in range(n)] + [pa.array(x) for x in f(rows, data, at)]
            yield pa.RecordBatch.from_arrays([x if x.type == t.type else x.cast(t.type) for x, t in zip(arrays, arrow, strict=True)], names=[t.name for t in arrow])
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return docs.select(*wanted).mapInArrow(run, schema)


def with_unique(rows: DataFrame, told: DataFrame, key: str, often: str, total: int | None = None) -> DataFrame:
    """rows left-joined with told, which has a key once and in `often` how many rows have it.

    Keys of more than a two-thousandth of all rows, of which there are less than 2,000, are
    sent to all tasks; the others are joined by a shuffle that no key makes uneven. total is
    the number of rows or more, where the caller knows it.
    """
    if total is None:
        total = told.agg(F.sum(often)).first()[0] or 0
    hot = told.filter(F.col(often) > total // 2000 + 1000).select(F.col(key).alias("hot_key"), *(F.col(c).alias(f"hot_{c}") for c in told.columns if c != key))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    added = [c for c in told.columns if c != key and c not in rows.columns]
    often_met = dealt.filter("hot_key is not null").select(*rows.columns, *(F.col(f"hot_{c}").alias(c) for c in added))
    rest = dealt.filter("hot_key is null").select(*rows.columns).join(told.select(key, *added), key, "left").select(*rows.columns, *added)
    return often_met.unionAll(rest)


def unused(df: DataFrame, name: str) -> str:
    """A column name that begins with `name` and is none of df's, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name += "_"
    return name


def texts_of(rows: pa.RecordBatch, text: str = "text") -> list[str]:
    return ["" if x is None else x for x in rows.column(rows.schema.get_field_index(text)).to_pylist()]
