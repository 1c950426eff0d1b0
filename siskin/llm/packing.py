"""Best-fit-decreasing packing of tokenized documents into windows of fixed size.

Documents longer than a window are first cut into full windows and a rest. All pieces
are then placed from the longest to the shortest, each into the tightest open window.
Only the number of pieces of each length matters for that, so the plan is made from a
histogram of at most `window` rows: a segment tree indexed by remaining capacity finds
the tightest open windows, and equal pieces are placed many at a time. The plan is a
few ranges of ranks for each length, and a piece finds its place by its rank among the
pieces of its length. Ranks come from counts by length and hash bucket, so neither a
common length nor the whole input meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siskin.llm import blocks, bpe

#: Pieces of one length in one hash bucket, about, that are ranked together.
PIECES_PER_BUCKET = 50_000


class Capacities:
    """Open windows by remaining capacity, under a segment tree of which capacities have any."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = np.zeros(2 * self.size, bool)
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, capacity: int, first: int, n: int) -> None:
        """n windows numbered from first have this capacity left."""
        if not n or not capacity:
            return
        self.open.setdefault(capacity, []).append((first, n))
        at = capacity + self.size
        while at and not self.tree[at]:
            self.tree[at] = True
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` that an open window has, or 0."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:  # up to the first subtree on the right that has any, then down to its left
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return 0

    def take(self, capacity: int, n: int) -> tuple[int, int]:
        """Up to n windows of this capacity: the first one's number and how many."""
        runs = self.open[capacity]
        first, have = runs.pop()
        if have > n:
            runs.append((first + n, have - n))
            have = n
        if not runs:
            del self.open[capacity]
            at = capacity + self.size
            self.tree[at] = False
            at >>= 1
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = False
                at >>= 1
        return first, have


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first window, pieces a window, offset) of best-fit decreasing."""
    free, windows, out = Capacities(window), 0, []
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = free.tightest(length)
            each = (capacity or window) // length  # a window stays the tightest until it is too full
            wanted = max(1, left // each)
            if capacity:
                first, n = free.take(capacity, wanted)
            else:
                capacity, first, n = window, windows, wanted
                windows += n
            each = min(each, left)
            out.append((length, rank, n * each, first, each, window - capacity))
            free.put(capacity - each * length, first, n)
            rank += n * each
            left -= n * each
    return out


def pieces(docs: DataFrame, window: int = 2048, path: str | None = None, end_id: int = 1, text: str = "text") -> DataFrame:
    """docs with an array of pieces (start, length, ids_crc32) and doc_tokens: token ids, then end_id.

    Null texts count as empty: one piece with end_id alone.
    """
    path = path or bpe.default_path()
    blocks.ship(docs.sparkSession)

    def make():
        use = bpe.codec(path)

        def run(rows, data, at):
            ids, ends = use.encode(blocks.texts_of(rows, text))
            ended = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            raw = memoryview(ended.tobytes())
            sizes = np.diff(ends)
            n = -(-sizes // window)
            bounds = np.concatenate([[0], np.cumsum(n)])
            start = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)) * window
            length = np.minimum(window, np.repeat(sizes, n) - start)
            first = start + np.repeat(ends[:-1], n)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            parts = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["start", "length", "ids_crc32"])
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), sizes]

        return run

    return blocks.with_columns(docs, "pieces array<struct<start: long, length: long, ids_crc32: long>>, doc_tokens long", make, text)


def place(found: DataFrame, window: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """found with sequence_id and offset; every row is a piece of 1 to `window` tokens.

    Rows that agree in all of `order` and length may swap places. An empty table stays
    empty. Existing columns sequence_id and offset are replaced.
    """
    spark = found.sparkSession
    found = found.drop("sequence_id", "offset")
    total, most = found.agg(F.count(F.lit(1)), F.max(length)).first()
    if total and most > window:
        raise ValueError(f"a piece of {most} is longer than the window of {window}")
    buckets = max(16, total // PIECES_PER_BUCKET)
    # the given row travels as one value, so its columns' names meet none of those below
    hashed = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    keyed = found.select(F.struct(*found.columns).alias("given"), F.col(length).alias("length"), hashed.alias("bucket"))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most `window` lengths: the histogram is bounded
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = Window.partitionBy("length", "bucket").orderBy(*(f"given.{c}" for c in order))
    keyed = keyed.withColumn("row", F.row_number().over(ranked) - 1)
    keyed = keyed.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("row") + F.col("before"))
    # the plan has a few rows for each length, whatever the input: bounded, so it is broadcast
    schema = "p_length long, p_rank long, p_n long, p_window long, p_each long, p_offset long"
    steps = F.broadcast(spark.createDataFrame(rows, schema))
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_n"))
    nth = F.col("rank") - F.col("p_rank")
    sequence, offset = F.col("p_window") + F.expr("(rank - p_rank) div p_each"), F.col("p_offset") + nth % F.col("p_each") * F.col("length")
    return keyed.join(steps, fits).select("given.*", sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, window: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold `window` tokens at most and are padded to it. Null doc_id values and
    repeated rows are packed like others; null texts hold end_id alone.
    """
    spark = docs.sparkSession
    cut = pieces(docs.select("doc_id", "text"), window, path, end_id).select("doc_id", "doc_tokens", F.explode("pieces").alias("p"))
    cut = cut.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens")
    return place(blocks.written(cut, spark), window, order=("doc_id", "start", "ids_crc32", "doc_tokens"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as pack() gives them; columns beyond doc_id and text are not looked at."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
