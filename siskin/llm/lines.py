"""Removal of repeated runs of lines: a suffix array over line-ID sequences by prefix doubling.

A line's ID is its hash; a document is its sequence of IDs. Level j sorts the suffixes by
their first 2^j lines: a position's rank there is the name of its pair of ranks on the
level before, its own and that 2^(j-1) lines on. Positions of one rank are an interval of
the suffix array with a common prefix of 2^j lines, and its first place in the corpus is
the earliest copy. Only positions whose two halves lie in intervals of several members
are ranked on the next level, and only documents with such positions take part; the
levels end when no interval has two members. A pair's name is a hash, so ranks need no
common numbering and no sort of the whole corpus: a rank's members meet in its bucket.

A line is deleted where it lies in a later copy of a run with `min_words` words in all.
For that the shortest runs with so many words that begin or end at a line suffice; where
such a run's length is no power of two, and its first and last powers lie in intervals,
its members are named by the whole run, which tells the intervals' exact common prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks
from siskin.llm.substrings import _FORM, _dealt, _first_of, _order, _part, _table, _unpack

#: Words of the shortest run that is deleted.
MIN_WORDS = 10
#: Text, about, of the documents that are edited together.
PART_BYTES = 8 << 20
#: Documents with a line that occurs elsewhere.
_SHARED = "rtrim('0', hex(any)) <> ''"
#: Names that a worker holds before it sends them.
HELD_NAMES = 1_000_000

_NAME = (("ident", np.uint64), ("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("length", np.uint32), ("flag", np.uint8))
_HIT = _NAME[1:]
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Of each document: its line IDs and their words; of each line, the lengths of the longest
#: run from there with an earlier copy and with any copy, and whether its last rank has several
#: members; and whether the document takes part in the next level.
_STATE = "part long, doc long, tag long, ids binary, words binary, length binary, any binary, alive binary, more boolean"


def ranks(ids: np.ndarray, level: int) -> np.ndarray:
    """The ranks of the runs of 2^level lines, each from the pair of ranks half a run apart."""
    for j in range(level):
        half = 1 << j
        ids = blocks.mixed(ids[:-half] * _PAIR + ids[half:]) if len(ids) > half else ids[:0]
    return ids


def _posts(held: list[dict], keys: int, parts: int):
    """Names by bucket; runs with an earlier copy at hand are hits at once (flag 1: a later copy)."""
    if not held:
        return
    t = {c: np.concatenate([h[c] for h in held]) for c, _ in _NAME if c != "flag"}
    held.clear()
    by, own = _first_of(t["ident"], t["doc"], t["tag"], t["start"])
    t = {c: x[by] for c, x in t.items()}
    hit = ~own & ~_twins(t, own)
    first = np.flatnonzero(own)
    t["flag"] = hit.astype(np.uint8)
    if len(first):  # the first of a name goes on, and says whether it has a copy here
        t["flag"][first] = np.maximum.reduceat(t["flag"], first)
    rows = _dealt(t, _NAME, (t["ident"] % np.uint64(keys)).astype(np.int64), 0, own)
    rows += _dealt(t, _HIT, -1 - _part(t["doc"], t["tag"], parts), 1, hit)
    for i in range(0, len(rows), 512):
        yield _table(rows[i : i + 512])


def _rows_of(batch):
    """Each row of a batch or table of states, its binary columns as arrays."""
    col = {n: batch.column(n) for n in batch.schema.names}
    for i in range(batch.num_rows):
        raw = lambda c, kind: np.frombuffer(col[c][i].as_buffer(), kind)  # noqa: B023, E731
        yield col["doc"][i].as_py(), col["tag"][i].as_py(), raw("ids", np.uint64), raw("words", np.uint32), raw("length", np.int32), raw("any", np.int32), raw("alive", np.uint8)


def _twins(t, own) -> np.ndarray:
    """Entries at the same place as the first of their name: equal rows of the table."""
    ahead = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0)) if len(own) else np.zeros(0, np.int64)
    return (t["doc"] == t["doc"][ahead]) & (t["tag"] == t["tag"][ahead]) & (t["start"] == t["start"][ahead])


def _covered(length: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Lines in a repeated run of enough words, given the run known at each position."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(len(length))
    good = (length > 0) & (sums[at + length] - sums[at] >= least)
    change = np.zeros(len(length) + 1, np.int64)
    np.add.at(change, at[good], 1)
    np.add.at(change, (at + length)[good], -1)
    return np.cumsum(change[:-1]) > 0


def shortest(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the shortest runs of at least `least` words that begin, and that end, at each line."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(n)
    end = np.searchsorted(sums, sums[:-1] + least)
    begun = end <= n
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ended = start >= 0
    both = np.stack([np.concatenate([at[begun], start[ended]]), np.concatenate([(end - at)[begun], (at + 1 - start)[ended]])])
    both = np.unique(both[:, both[1] > 0], axis=1)
    return both[0], both[1]


def _undecided(words: np.ndarray, length: np.ndarray, any_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest runs between two powers of lines, of which the ranks allow that they have a copy."""
    start, size = shortest(words, least)
    power = 1 << (np.frexp(size)[1] - 1)
    open_ = (power < size) & (any_[start] >= power) & (any_[start + size - power] >= power) & (length[start] < size)
    return start[open_], size[open_]


def _hits(names: DataFrame, parts: int) -> DataFrame:
    """(kind, key, packed): by part, the runs that have a copy, later ones with flag 1."""

    def copies(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return _table((1, -1 - k, p) for k, p in zip(table.column("key").to_pylist(), table.column("packed").to_pylist(), strict=True))
        t = _unpack(table.column("packed"), _NAME)
        by, own = _first_of(t["ident"], t["doc"], t["tag"], t["start"])
        t = {c: x[by] for c, x in t.items()}
        later = ~own & ~_twins(t, own)
        several = later | (t["flag"] > 0)
        if len(by):
            first = np.flatnonzero(own)
            several[first] = np.maximum.reduceat(several, first)
        t["flag"] = later.astype(np.uint8)
        return _table(_dealt(t, _HIT, _part(t["doc"], t["tag"], parts), 1, later | (own & several)))

    return names.groupBy("key").applyInArrow(copies, _FORM)


def _updated(state: DataFrame, hits: DataFrame, size: int = 0) -> DataFrame:
    """state with the longest runs of the hits; with a size, which is the level's, also what is alive there."""
    spark = state.sparkSession

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _unpack(left.column("packed"), _HIT)
        by = _order(t["doc"], t["tag"], t["start"], t["length"])
        t = {c: x[by] for c, x in t.items()}
        out: dict[str, list] = {"length": [], "any": [], "alive": [], "more": []}
        for doc, tag, ids, _, length, any_, _ in _rows_of(right):
            a, b = np.searchsorted(t["doc"], [doc, doc + 1]) if doc < 2**63 - 1 else (np.searchsorted(t["doc"], doc), len(by))
            a, b = a + np.searchsorted(t["tag"][a:b], [tag, tag + 1])
            length, any_, alive = length.copy(), any_.copy(), np.zeros(len(ids), np.uint8)
            start, run, later = t["start"][a:b], t["length"][a:b], t["flag"][a:b] > 0
            alive[start] = 1
            np.maximum.at(any_, start, run.astype(np.int32))
            np.maximum.at(length, start[later], run[later].astype(np.int32))
            out["length"].append(length.tobytes())
            out["any"].append(any_.tobytes())
            out["alive"].append(alive.tobytes())
            out["more"].append(bool(size and (alive[:-size] & alive[size:]).any()))
        same = {c: right.column(c) for c in ("part", "doc", "tag", "ids", "words")}
        return pa.table(same | {c: pa.array(x, pa.bool_() if c == "more" else pa.binary()) for c, x in out.items()})

    out = blocks.written(hits.groupBy("key").cogroup(state.groupBy("part")).applyInArrow(update, _STATE), spark)
    blocks.tidy(spark)
    return out


def _named(state: DataFrame, keys: int, parts: int, choose) -> DataFrame:
    """Names of the runs that choose(ids, words, length, any, alive) gives: (start, length, name)."""

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            for doc, tag, *about in _rows_of(batch):
                start, length, ident = choose(*about)
                k = len(start)
                if k:
                    held.append({"ident": ident, "doc": np.full(k, doc), "tag": np.full(k, tag, np.uint32), "start": start, "length": length})
                    n += k
                if n > HELD_NAMES:
                    for table in _posts(held, keys, parts):
                        yield from table.to_batches()
                    n = 0
        for table in _posts(held, keys, parts):
            yield from table.to_batches()

    return state.mapInArrow(emit, _FORM)


def _level(level: int):
    size = 1 << level

    def choose(ids, words, length, any_, alive):
        start = np.arange(len(ids)) if not level else np.flatnonzero(alive[: -(size // 2)] & alive[size // 2 :])
        start = start[start + size <= len(ids)]
        return start, np.full(len(start), size), ranks(ids, level)[start]

    return choose


def _between(least: int):
    def choose(ids, words, length, any_, alive):
        start, size = _undecided(words, length, any_, least)
        return start, size, blocks.Spans(ids, seed=41).hash(start, start + size)

    return choose


def _runs(state: DataFrame, keys: int, parts: int, least: int) -> DataFrame:
    """state with the longest repeated run from each line, of documents that have any."""
    level, done = 0, []
    while True:
        state = _updated(state, _hits(_named(state, keys, parts, _level(level)), parts), 1 << level)
        done.append(state.filter("not more").filter(_SHARED))
        state = state.filter("more")
        level += 1
        if state.isEmpty():
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionAll(other)
    return _updated(out, _hits(_named(out, keys, parts, _between(least)), parts))


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without its repeated lines, and n_lines and n_removed (long).

    Lines end at a line feed. A line goes if it lies in a run of whole lines with at
    least min_words words (runs of characters that are not white space) that also occurs
    at an earlier place: in a document of smaller doc_id, or before in the same one, an
    overlap included. Places are those of the input. The lines that stay are joined by
    line feeds again. Null texts stay null (n_lines 0), an empty text has one line. Null
    doc_id values come last; rows with one doc_id and different texts are different
    documents in a fixed order; equal rows are one, so neither comes before the other.
    Existing columns n_lines and n_removed are replaced, all others are kept.
    """
    spark = docs.sparkSession
    blocks.ship(spark)
    size = 2 * blocks.input_bytes(docs)
    keys = parts = max(12, size // PART_BYTES)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    doc, tag = blocks.unused(docs, "doc"), blocks.unused(docs, "tag")
    placed = docs.select(*kept, F.coalesce("doc_id", F.lit(2**63 - 1)).alias(doc), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias(tag))

    def describe(batches):
        for rows, data, at in blocks.slices(batches):
            feed = data == 10
            # a feed ends a line and opens the next, which may be empty or at the end of its text
            ends = np.flatnonzero(feed)
            row_of = np.searchsorted(at, ends, "right") - 1
            starts = np.concatenate([at[:-1], ends + 1])
            owner = np.concatenate([np.arange(len(at) - 1), row_of])
            by = np.lexsort((starts, owner))
            starts, owner = starts[by], owner[by]
            last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
            stops = np.where(last, at[1:][owner], np.concatenate([starts[1:] - 1, [0]]) if len(starts) else starts)
            ids = blocks.Spans(data, seed=42).hash(starts, stops)
            _, begun, _, _, _ = blocks.words(data, at)
            words = (np.searchsorted(begun, stops) - np.searchsorted(begun, starts)).astype(np.uint32)
            doc, tag = np.asarray(rows.column(1)).astype(np.int64), np.asarray(rows.column(2)).astype(np.uint32)
            bounds = np.searchsorted(owner, np.arange(len(at)))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            zero = cut(np.zeros(len(ids), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(_part(doc, tag, parts)), pa.array(doc), pa.array(tag.astype(np.int64)), cut(ids), cut(words), zero, zero, cut(np.ones(len(ids), np.uint8)), pa.array([True] * len(doc))], [f.split()[0] for f in _STATE.split(", ")])

    state = blocks.written(placed.filter(F.col("text").isNotNull()).select("text", doc, tag).mapInArrow(describe, _STATE), spark)
    state = _runs(state, keys, parts, min_words)
    its_doc, its_tag, stays, lost = (blocks.unused(placed, n) for n in ("its_doc", "its_tag", "stays", "lost"))

    def gone(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                length, words = np.frombuffer(b.column(3)[i].as_buffer(), np.int32), np.frombuffer(b.column(2)[i].as_buffer(), np.uint32)
                out.append(~_covered(length, words, min_words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.bool_())), pa.array([int((~x).sum()) for x in out], pa.int64())], [its_doc, its_tag, stays, lost])

    dropped = state.select("doc", "tag", "words", "length").mapInArrow(gone, f"{its_doc} long, {its_tag} long, {stays} array<boolean>, {lost} long")
    # only documents that lose lines; equal rows have one list
    dropped = dropped.filter(F.col(lost) > 0).dropDuplicates([its_doc, its_tag])
    out = placed.join(dropped, (F.col(doc) == F.col(its_doc)) & (F.col(tag) == F.col(its_tag)), "left")
    lines = F.split("text", "\n", -1)
    slim = F.array_join(F.filter(lines, lambda x, i: F.get(stays, i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(slim)
    return out.select(
        *(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("n_removed"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, with the columns of docs; one that loses all its words goes.

    Nulls, empty texts, ties and repeated rows are as in remove(). n_chars, where docs has
    it, is counted anew for texts that lose a line. Columns named n_lines and n_removed pass
    through as they are.
    """
    held = {c: blocks.unused(docs, f"held_{i}") for i, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_removed")}
    out = remove(docs.withColumnsRenamed(held))
    text = F.col("text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    out = out.filter((F.col("n_removed") == 0) | text.rlike(r"\S"))
    return out.select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, i, len(regexp_extract_all(lines[i], '[^ \\t\\n\\x0B\\f\\r]+')) AS words
  FROM docs, UNNEST(range(1, len(lines) + 1)) AS u(i)
),
run AS (
  SELECT d.doc_id, a.i, b.i AS j, sha256(array_to_string(d.lines[a.i:b.i], chr(10))) AS run
  FROM docs d JOIN line a ON a.doc_id = d.doc_id JOIN line b ON b.doc_id = d.doc_id AND b.i >= a.i
),
counted AS (
  SELECT r.doc_id, r.i, r.j, first_value(r.doc_id) OVER w AS first_doc, first_value(r.i) OVER w AS first_i
  FROM run r WINDOW w AS (PARTITION BY r.run, r.j - r.i ORDER BY r.doc_id, r.i)
),
long_enough AS (
  SELECT c.doc_id, c.i, c.j FROM counted c JOIN line l ON l.doc_id = c.doc_id AND l.i BETWEEN c.i AND c.j
  WHERE (c.first_doc, c.first_i) <> (c.doc_id, c.i)
  GROUP BY c.doc_id, c.i, c.j HAVING sum(l.words) >= {MIN_WORDS}
),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM long_enough r JOIN line l ON l.doc_id = r.doc_id AND l.i BETWEEN r.i AND r.j)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN d.lines[l.i] END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM docs d JOIN line l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id, d.lines
"""
