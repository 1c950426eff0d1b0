"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles. Documents with equal sets form a
class at once; the join works on classes, named by a 64-bit hash of the set.

1. A pass over all documents counts shingles into a table of fixed size. The counts give
   one order for all shingles, rare first.
2. Two sets that agree by t share l shingles among the first n - ceil(t n) + l of each,
   for any l. Every class picks its own l, longer where the estimated postings of its
   prefix are long, and posts its prefix. Two classes must then share as many posted
   shingles as the smaller of their two l.
3. Shingles with the same members become one list. Each list links its members to its
   smallest one, and these few pairs are verified. Members that are connected by now
   need no more comparison.
4. In lists whose members are still apart, pairs of different components are compared:
   in short lists by size, by the shared part of their prefixes and the most that the
   rest can add, and last by their whole sets; in long lists by whole sets at once, for
   blocks of members against each other as matrix products.

Every pair that agrees is in some list, and is skipped only if it is connected already,
so components are exact. Hash collisions aside: with n classes their expected number is
n^2 / 2^65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks
from siskin.llm.links import components

WORDS, NEED = 5, 75
#: The table that orders shingles: 2^23 counts, 8 MB once they are classes.
ORDER_BITS, ORDER_SLICES = 23, 64
#: Longest extra prefix, and the gain in estimated cost that a longer one must bring.
MOST_MATCHES, GAIN = 8, 1.3
#: Lists of up to so many members are compared by a join, longer ones in blocks,
#: so many shingles at once.
SHORT_LIST, BLOCK, COLUMNS = 64, 1024, 4096
#: Posted shingles that a worker holds before it sends them.
HELD_POSTS = 1_000_000
#: Text, about, of the posts that are listed together.
BUCKET_BYTES = 16 << 20
#: Most classes that a bit table picks to be read again; more are picked by a join.
MOST_PICKED = 1 << 20

_K = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, _, h, bounds = blocks.words(data, at, seed=9)
    if len(h) >= WORDS:
        x = h[: len(h) - WORDS + 1]
        for j in range(1, WORDS):
            x = blocks.mixed(x * _K + h[j : len(h) - WORDS + 1 + j])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(x[a : b - WORDS + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            y = h[a : a + 1]
            for j in range(1, b - a):
                y = blocks.mixed(y * _K + h[a + j : a + j + 1])
            out.append(blocks.mixed(y + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def name_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(blocks.mixed(np.array([blocks.mixed(s ^ _K).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


class Order:
    """Shingles from rare to frequent, by a class of their slot's count and then by hash."""

    def __init__(self, counts: np.ndarray | Iterable[np.ndarray]):
        """counts: of every slot, as one array or as its slices, of which one is held at a time."""
        kinds, values, often = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in [counts] if isinstance(counts, np.ndarray) else counts:
            kinds.append(np.floor(2 * np.log2(np.maximum(part, 1))).astype(np.uint8))
            own, n = np.unique(part, return_counts=True)
            values, at = np.unique(np.concatenate([values, own.astype(np.uint64)]), return_inverse=True)
            often = np.bincount(at, np.concatenate([often, n]), len(values)).astype(np.int64)
        self.kinds = np.concatenate(kinds)
        #: What a slot's class costs beyond the slots' usual load, which is their median.
        middle = np.searchsorted(np.cumsum(often), [(len(self.kinds) - 1) // 2, len(self.kinds) // 2], "right")
        usual = float(values[middle].mean()) if len(values) else 0.0
        self.cost = np.maximum(0.0, 2.0 ** (np.arange(256) / 2) - 4 * usual - 4)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The posted shingles of a set, first in order first, and how many must be shared."""
        n = len(s)
        need = -(-NEED * n // 100)
        most = min(MOST_MATCHES, need)
        kinds = self.kinds[_slot(s)]
        longest = n - need + most
        # the set is sorted by hash: a stable sort by class gives the order
        first = np.argsort(kinds, kind="stable")[:longest]
        cost = np.cumsum(self.cost[kinds[first]])
        best, matches = cost[n - need], 1
        for m in range(2, most + 1):
            if cost[n - need + m - 1] / m * GAIN < best:
                best, matches = cost[n - need + m - 1] / m, m
        return s[first[: n - need + matches]], matches


def _described(docs: DataFrame) -> tuple[DataFrame, Order]:
    """(doc_id, key, n_shingles, name) of every document, written, and the order of shingles."""
    spark = docs.sparkSession

    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        for rows, data, at in blocks.slices(batches):
            sets = shingles(data, at)
            if sets:
                np.add.at(counts, _slot(np.concatenate(sets)), np.uint32(1))
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([name_of(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "key", "n_shingles", "name", "slice", "counts"],
            )
        width = len(counts) // ORDER_SLICES
        packed = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(ORDER_SLICES)]
        n = ORDER_SLICES
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())],
            ["doc_id", "key", "n_shingles", "name", "slice", "counts"],
        )

    rows = docs.select("text", "doc_id", F.xxhash64("doc_id").alias("key"))
    schema = "doc_id long, key long, n_shingles long, name long, slice int, counts binary"

    def reordered(batches):
        def moved():
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0)], ["doc_id", "key", "text"])

        yield from run(moved())

    both = blocks.written(rows.mapInArrow(reordered, schema), spark)

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << ORDER_BITS) // ORDER_SLICES, np.uint64)
        for x in table.column("counts"):
            got = np.frombuffer(zlib.decompress(x.as_py()), np.uint32 if len(table.column("wide")) and not table.column("wide")[0].as_py() else np.uint64)
            total += got
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([0], pa.int32()), "wide": pa.array([True]), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    # sums of fixed-size slices in two steps, so no task has all partitions' counts
    form = "slice int, part int, wide boolean, counts binary"
    parts = both.filter("slice is not null").select("slice", F.pmod(F.xxhash64("counts"), F.lit(8)).cast("int").alias("part"), F.lit(False).alias("wide"), "counts")
    parts = parts.groupBy("slice", "part").applyInArrow(summed, form)
    totals = parts.groupBy("slice").applyInArrow(summed, form)
    found = {r["slice"]: r["counts"] for r in totals.select("slice", "counts").collect()}  # 64 rows of fixed size
    none = zlib.compress(bytes(8 * ((1 << ORDER_BITS) // ORDER_SLICES)), 1)
    counts = (np.frombuffer(zlib.decompress(found.get(i, none)), np.uint64) for i in range(ORDER_SLICES))
    return both.filter("slice is null").select("doc_id", "key", "n_shingles", "name"), Order(counts)


def _lists(docs: DataFrame, order, size: int) -> DataFrame:
    """(list, first, least, least_n, members, name, n) for every list of two or more classes: its members."""
    spark = docs.sparkSession
    n_buckets = max(12, 2 * size // BUCKET_BYTES)

    def post(batches):
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()

        def sent():
            if not held:
                return
            tokens = np.concatenate([x[0] for x in held])
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[0]) for x in held])
            names = np.array([x[1] for x in held], np.int64)
            sizes = np.array([x[2] for x in held], np.int32)
            bucket = (tokens % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, tokens, owner = bucket[by], tokens[by], owner[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            buckets, packed = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                buckets.append(int(bucket[a]))
                packed.append(tokens[a:b].tobytes() + names[owner[a:b]].tobytes() + sizes[owner[a:b]].tobytes())
                if len(buckets) == 256 or b == cuts[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "posts"])
                    buckets, packed = [], []
            held.clear()
            seen.clear()

        n = 0
        for _rows, data, at in blocks.slices(batches):
            for s in shingles(data, at):
                if len(s):
                    name = name_of(s)
                    if name in seen:
                        continue
                    seen.add(name)
                    held.append((order.value.prefix(s)[0], name, len(s)))
                    n += len(held[-1][0])
            if n > HELD_POSTS:
                yield from sent()
                n = 0
        yield from sent()

    def listed(table: pa.Table) -> pa.Table:
        tokens, names, sizes = [], [], []
        for x in table.column("posts"):
            raw = x.as_buffer()
            k = raw.size // 20
            tokens.append(np.frombuffer(raw, np.uint64, k))
            names.append(np.frombuffer(raw, np.int64, k, 8 * k))
            sizes.append(np.frombuffer(raw, np.int32, k, 16 * k))
        token, name, size_ = np.concatenate(tokens), np.concatenate(names), np.concatenate(sizes)
        # shingles with one post are dropped before the full sort
        by = np.argsort(token, kind="stable")
        sorted_ = token[by]
        same = np.zeros(len(by) + 1, bool)
        same[1:-1] = sorted_[1:] == sorted_[:-1]
        by = by[same[:-1] | same[1:]]
        token, name, size_ = token[by], name[by], size_[by]
        by = np.lexsort((name, token))
        token, name, size_ = token[by], name[by], size_[by]
        if len(token):
            own = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])  # copies share a name
            token, name, size_ = token[own], name[own], size_[own]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        lens = np.diff(np.concatenate([starts, [len(token)]]))
        if len(starts):
            ident = blocks.mixed(np.add.reduceat(blocks.mixed(name.view(np.uint64)), starts) + lens.astype(np.uint64))
            _, first = np.unique(ident, return_index=True)  # starts are in order of token: the first has the smallest
            first = first[lens[first] > 1]
        else:
            ident, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counts = lens[first] if len(first) else np.zeros(0, np.int64)
        at = np.repeat(starts[first], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) if len(first) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(first)), counts)
        return pa.table(
            {
                "list": pa.array(ident[first][which].view(np.int64), pa.int64()),
                "first": pa.array((token[starts[first]] >> np.uint64(1)).astype(np.int64)[which], pa.int64()),
                "least": pa.array(name[starts[first]][which], pa.int64()),
                "least_n": pa.array(size_[starts[first]][which], pa.int32()),
                "members": pa.array(counts[which], pa.int64()),
                "name": pa.array(name[at], pa.int64()),
                "n": pa.array(size_[at], pa.int32()),
            }
        )

    form = "list long, first long, least long, least_n int, members long, name long, n int"
    posts = docs.select("text").mapInArrow(post, "bucket long, posts binary")
    found = posts.groupBy("bucket").applyInArrow(listed, form)
    merged = found.groupBy("list", "name").agg(F.min("first").alias("first"), F.first("least").alias("least"), F.first("least_n").alias("least_n"), F.first("members").alias("members"), F.first("n").alias("n"))
    out = blocks.written(merged, spark)
    blocks.tidy(spark)
    return out


def _picked(docs: DataFrame, classes: DataFrame, names: DataFrame, form: str, make) -> DataFrame:
    """Rows made from one document of each of the named classes.

    Documents are read again. Up to MOST_PICKED classes a bit table of 16 bits a class (2 MB
    at most) passes over nearly all others; more are picked by a join on the key. What the
    table lets through besides is never asked for, and what two tasks make of one class is
    the same.
    """
    spark = docs.sparkSession
    wanted = names.select("name").distinct()
    keys = blocks.written(classes.join(wanted, "name", "left_semi").select("key"), spark)
    n = keys.count()
    shift = 64 - max(12, (16 * n).bit_length())
    read = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    sent = None
    if n > MOST_PICKED:
        read = read.join(keys.distinct(), "key", "left_semi")
    else:
        table = keys.select(F.expr(f"shiftrightunsigned(key, {shift}) div 64").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {shift}) % 64 as int))").alias("b"))
        table = table.groupBy("w").agg(F.bit_or("b").alias("b"))
        bits = np.zeros(1 << (58 - shift), np.int64)
        got = table.collect()  # a row for each 64 bits at most
        bits[[r["w"] for r in got]] = [r["b"] for r in got]
        sent = spark.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        f, seen = make(), set()
        for b in batches:
            if sent:
                key = np.asarray(b.column(0)).view(np.uint64) >> np.uint64(shift)
                kept = sent.value[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)
                b = b.filter(pa.array(kept.astype(bool)))
            for _rows, data, at in blocks.slices(iter([b])):
                own = {name_of(s): s for s in shingles(data, at) if len(s)}
                own = [(name, s) for name, s in own.items() if name not in seen]
                seen.update(name for name, _ in own)
                yield f(own)

    out = blocks.written(read.mapInArrow(run, form), spark)
    blocks.tidy(spark)
    return out


def _prefixes(docs, classes, names, order):
    def make():
        def f(sets):
            rows = [(name, len(s), *order.value.prefix(s)) for name, s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64()))],
                ["name", "n", "matches", "prefix"],
            )

        return f

    return _picked(docs, classes, names, "name long, n int, matches int, prefix array<bigint>", make)


def _sets(docs, classes, names):
    def make():
        def f(sets):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1].view(np.int64) for x in sets], pa.list_(pa.int64()))], ["name", "shingles"])

        return f

    return _picked(docs, classes, names, "name long, shingles array<bigint>", make)


def _possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose prefixes share enough for the rest to make them agree."""
    side = lambda x: prefixes.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("matches").alias(f"m{x}"), F.col("prefix").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("pa", "pb"))
    # what lies beyond the prefix that ends first, at most
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    enough = (shared >= F.least("ma", "mb")) & ((100 + NEED) * (shared + rest) >= NEED * (F.col("na") + F.col("nb")))
    return both.filter(enough).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("name").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= NEED * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name")))


def _agreeing(docs, classes, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs that agree, by prefixes first and then by whole sets."""
    spark = docs.sparkSession
    possible = blocks.written(_possible(pairs, prefixes).distinct(), spark)
    blocks.tidy(spark)
    if possible.isEmpty():
        return possible
    out = blocks.written(_verified(possible, _sets(docs, classes, _names(possible))), spark)
    blocks.tidy(spark)
    return out


def _in_blocks(rows: DataFrame, order) -> DataFrame:
    """Agreeing pairs of different components in long lists, each from the list of its first posted shingle.

    Whole sets are compared, a block of members against another by a matrix product, so
    no pair that disagrees leaves its task.
    """

    def compare(table: pa.Table) -> pa.Table:
        part = np.asarray(table.column("part"))
        name, root = np.asarray(table.column("name")), np.asarray(table.column("root"))
        one = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        left = np.flatnonzero(part == table.column("x")[0].as_py())
        right = left if one else np.flatnonzero(part == table.column("y")[0].as_py())
        first = table.column("first")[0].as_py()
        sets = table.column("shingles").combine_chunks()
        at = np.asarray(sets.offsets).astype(np.int64)
        tokens = np.asarray(sets.values)[at[0] : at[-1]].view(np.uint64)
        at = at - at[0]
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        _, ids, often = np.unique(tokens, return_inverse=True, return_counts=True)
        number = np.cumsum(often > 1) - 1
        kept = often[ids] > 1
        ids, holder = number[ids[kept]], owner[kept]
        by = np.argsort(ids, kind="stable")
        ids, holder = ids[by], holder[by]
        total = int(number[-1]) + 1 if len(number) else 0
        shared = np.zeros((len(left), len(right)), np.float32)
        places = []
        for side in (left, right):
            place = np.full(len(n), -1)
            place[side] = np.arange(len(side))
            places.append(place)
        for low in range(0, total, COLUMNS):
            a, b = np.searchsorted(ids, [low, low + COLUMNS])
            sides = []
            for side, place in zip((left, right), places, strict=True):
                row = place[holder[a:b]]
                held = np.zeros((len(side), min(COLUMNS, total - low)), np.float32)
                held[row[row >= 0], ids[a:b][row >= 0] - low] = 1
                sides.append(held)
            shared += sides[0] @ sides[1].T
        whole = n[left][:, None] + n[right][None, :] - shared
        ok = (100 * shared >= NEED * whole) & (root[left][:, None] != root[right][None, :])
        if one:
            ok &= np.tri(len(left), k=-1, dtype=bool)
        pairs = []
        posted: dict[int, tuple[np.ndarray, int]] = {}
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, j in zip(*np.nonzero(ok), strict=True):
            a, b = int(left[i]), int(right[j])
            if top(int(root[a])) == top(int(root[b])):  # connected by pairs that go out already
                continue
            for x in (a, b):
                if x not in posted:
                    posted[x] = order.value.prefix(tokens[at[x] : at[x + 1]])
            common = np.intersect1d(posted[a][0], posted[b][0], assume_unique=True)
            if int(common[0] >> np.uint64(1)) == first:
                pairs.append((min(name[a], name[b]), max(name[a], name[b])))
                up[top(int(root[a]))] = top(int(root[b]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return rows.groupBy("list", "x", "y").applyInArrow(compare, "a long, b long")


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists with members of more than one component, each member with its component."""
    labelled = lists.join(roots, lists["name"] == roots["node"], "left").withColumn("root", F.coalesce("root", "name")).drop("node")
    open_ = labelled.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("members").alias("members")).filter("lo < hi")
    # long lists are dealt in parts, so none is one task's
    parts = F.ceil(F.col("members") / BLOCK)
    open_ = open_.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    dealt = labelled.withColumn("part", F.pmod(F.xxhash64("name", F.lit(5)), parts))
    return dealt.join(open_, ["list", "part"], "left_semi").drop("part")


def cluster(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z in lower case. Null,
    empty and blank texts have no shingle and link with nothing: their component is
    their own doc_id. Equal rows are in one component; null doc_id values do not count
    for the smallest id. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    blocks.ship(spark)
    docs = docs.select("doc_id", "text")
    size = blocks.input_bytes(docs)
    described, counted = _described(docs)
    order = spark.sparkContext.broadcast(counted)
    # copies are combined before any join by class
    classes = described.filter("n_shingles > 0").groupBy("name").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = blocks.written(classes, spark)
    lists = _lists(docs, order, size)
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * NEED
    # each list's members against its smallest
    star = lists.filter((F.col("name") != F.col("least")) & fits(F.col("n"), F.col("least_n"))).select(F.col("least").alias("a"), F.col("name").alias("b")).distinct()
    prefixes = _prefixes(docs, classes, lists, order)
    links = _agreeing(docs, classes, star, prefixes)
    roots = components(links)
    # what is still apart
    apart = blocks.written(_apart(lists, roots), spark)
    blocks.tidy(spark)
    x, y = (apart.filter(F.col("members") <= SHORT_LIST).select("list", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "root"))) for s in "ab")
    short = x.join(y, "list").filter((F.col("name_a") < F.col("name_b")) & (F.col("root_a") != F.col("root_b")) & fits(F.col("n_a"), F.col("n_b")))
    short = blocks.written(short.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct(), spark)
    blocks.tidy(spark)
    found = links.unionAll(_agreeing(docs, classes, short, prefixes))
    long_ = apart.filter(F.col("members") > SHORT_LIST)
    if not long_.isEmpty():
        long_ = long_.join(_sets(docs, classes, long_), "name").dropDuplicates(["list", "name"])
        n_parts = F.ceil(F.col("members") / BLOCK)
        long_ = long_.withColumn("part", F.pmod(F.xxhash64("name", F.lit(3)), n_parts))
        long_ = long_.withColumn("side", F.explode(F.sequence(F.lit(0).cast("bigint"), n_parts - 1)))
        long_ = long_.withColumns({"x": F.least("part", "side"), "y": F.greatest("part", "side")})
        found = found.unionAll(blocks.written(_in_blocks(long_, order), spark))
        blocks.tidy(spark)
    roots = components(found)
    # a class's smallest document, then a component's
    rooted = classes.join(roots, classes["name"] == roots["node"], "left").select("name", "least", "copies", F.coalesce("root", "name").alias("root"))
    rooted = blocks.written(rooted, spark)
    blocks.tidy(spark)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = blocks.with_unique(rooted, smallest, "root", "members").select("name", "copies", "component_id")
    named = blocks.written(named, spark)
    blocks.tidy(spark)
    out = blocks.with_unique(described, named, "name", "copies")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component, with the columns of docs; of equal rows one stays.

    Documents without words are in no component and stay.
    """
    kept_id, tag = blocks.unused(docs, "kept"), blocks.unused(docs, "tag")
    kept = cluster(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return out.withColumn(tag, F.xxhash64("text")).dropDuplicates(["doc_id", tag]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
