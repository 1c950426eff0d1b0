"""Exact removal of repeated 100-byte strings by bucket-pointer refinement.

Every 100-byte window of a text holds one chosen q-gram: the smallest q-gram hash of the
window, the rightmost of equal ones. Equal windows choose the same q-gram at the same
place, so the chosen q-grams are the first buckets of a suffix sort, about one position
in 35, and windows in different buckets differ. Windows next to each other with one
chosen q-gram form a run.

1. Runs of equal text are found by the identifier of their whole text: all windows of a
   run that came before are repeats. A bucket of which only one run is left is done.
2. Buckets that hold several runs are refined. Each position's bucket is that of its
   25-byte gram; windows are sorted by the bucket at their start, and those alone go.
   The others are sorted by that bucket and the one 25 bytes on; the pairs are numbered
   anew, at the window's start and 50 bytes on alike, and those alone go. The last sort is
   by the new number at the start and the new number 50 bytes on: a pair's number serves
   every window that begins with it or has it at its later offset, and twice two grams are
   the whole window, so no text is compared.

Names of grams are hashes of the bytes they stand for, so every task gives a gram the
same name. Only runs travel, never windows of unrepeated text. A bucket with many runs is
told apart in the tasks of step 1, among which its runs are spread by their texts; its
windows are then dealt by their names, equal ones within a task combined, so no task has
all of a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks

#: Bytes of a repeated string, and of the q-grams of the initial buckets.
LENGTH, Q = 100, 32
#: Windows of a long text that are worked on at once.
STRETCH = 1 << 20
#: Runs that a worker holds before it sends them.
HELD_RUNS = 1_000_000
#: Bytes of the grams whose buckets are refined, a quarter of a window.
GRAM = LENGTH // 4
#: Runs of one bucket, about, from which its windows are dealt by name, not by bucket.
HOT_BUCKET = 20_000
HOT_AT_ONCE = 4096
#: Text, about, of the documents that are edited together.
PART_BYTES = 8 << 20

_AROUND = LENGTH - Q + 1
_LOW = np.uint64(0xFFFFFFFF)


def runs(data: np.ndarray, at: np.ndarray, most: int = STRETCH) -> dict[str, np.ndarray]:
    """Runs of windows with one chosen q-gram: row, first window, windows, bucket, identifier.

    A long text is worked on in stretches of windows. A run that a stretch cuts in two has
    other identifiers than whole; its windows are then compared one by one.
    """
    parts = []
    for low in range(0, len(data), most):
        part = data[low : low + most + LENGTH - 1]
        if len(part) >= LENGTH:
            parts.append(_runs(part, np.clip(at - low, 0, len(part)), low))
    first, windows, bucket, ident = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64)]
    row = np.searchsorted(at, first, "right") - 1
    return {"row": row, "start": first - at[row], "windows": windows, "bucket": bucket, "ident": ident}


def _runs(data: np.ndarray, at: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    total = len(data)
    spans = blocks.Spans(data, seed=31)
    grams = blocks.mixed((spans.sums[Q:] - spans.sums[:-Q]) * spans.down[: total - Q + 1])
    # one number: hash above, position counted down below, so equal hashes give the rightmost
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while 2 * width <= _AROUND:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _AROUND:
        least = np.minimum(least[: len(least) - (_AROUND - width)], least[_AROUND - width :])
    change = np.zeros(total + 1, np.int32)
    long_ = np.diff(at) >= LENGTH
    np.add.at(change, at[:-1][long_], 1)
    np.add.at(change, at[1:][long_] - LENGTH + 1, -1)
    p = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)
    chosen = (_LOW - (least[p] & _LOW)).astype(np.int64)
    new = np.ones(len(p) + 1, bool)
    new[1:-1] = (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)
    cuts = np.flatnonzero(new)
    first, last = p[cuts[:-1]], p[cuts[1:] - 1]
    return first + low, last - first + 1, grams[chosen[cuts[:-1]]], spans.hash(first, last + LENGTH)


#: Columns of runs as they travel: bucket, identifier, document, its tag, first window, windows.
_RUN = (("bucket", np.uint64), ("ident", np.uint64), ("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("windows", np.uint8))
_SPAN = _RUN[2:]
_FIRST = (_RUN[0], *_SPAN)
_HOT = (_RUN[0],)
#: Windows: the names of their four grams, and their place.
_WINDOW = (("g0", np.uint64), ("g1", np.uint64), ("g2", np.uint64), ("g3", np.uint64), ("doc", np.int64), ("tag", np.uint32), ("start", np.uint32))


def _pack(table: dict[str, np.ndarray], form, at) -> bytes:
    return b"".join(table[c][at].astype(kind).tobytes() for c, kind in form)


def _unpack(packed: list, form) -> dict[str, np.ndarray]:
    size = sum(np.dtype(kind).itemsize for _, kind in form)
    out: dict[str, list] = {c: [] for c, _ in form}
    for x in packed:
        raw = x.as_buffer()
        n, at = raw.size // size, 0
        for c, kind in form:
            out[c].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {c: np.concatenate(out[c]) if out[c] else np.zeros(0, kind) for c, kind in form}


def _dealt(table, form, key: np.ndarray, kind: int, chosen=None):
    """Rows (kind, key, packed) with the chosen entries of a table, one row a key."""
    at = np.arange(len(key)) if chosen is None else np.flatnonzero(chosen)
    at = at[np.argsort(key[at], kind="stable")]
    keys = key[at]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    return [(kind, int(keys[a]), _pack(table, form, at[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _table(rows) -> pa.Table:
    rows = list(rows)
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "key": pa.array([r[1] for r in rows], pa.int64()), "packed": pa.array([r[2] for r in rows], pa.binary())})


_FORM = "kind int, key long, packed binary"
#: Kinds of rows: runs by identifier, spans to remove by document, runs to compare by
#: document (cold and hot), runs by bucket, hot buckets, texts of runs by bucket, windows by name.
_RUNS, _REMOVE, _COMPARE, _COMPARE_HOT, _FIRSTS, _HOTS, _TEXTS, _WINDOWS = range(8)


def _part(doc: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    """A document's part, as pmod(xxhash64(doc, tag), parts) gives it."""
    return np.mod(blocks.spark_hash(doc, tag.astype(np.int64)), parts)


def _order(*keys: np.ndarray) -> np.ndarray:
    """Sort by the first key, then the next."""
    return np.lexsort(keys[::-1])


def _first_of(ident: np.ndarray, doc, tag, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by identifier and position, and which entries open a new identifier."""
    by = _order(ident, doc, tag, start)
    own = np.ones(len(by), bool)
    own[1:] = ident[by][1:] != ident[by][:-1]
    return by, own


def _same_place(t, at, other) -> np.ndarray:
    """Whether entries stand at the same place: equal rows of the table."""
    return (t["doc"][at] == t["doc"][other]) & (t["tag"][at] == t["tag"][other]) & (t["start"][at] == t["start"][other])


def _repeats(t, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with equal identifiers: which are the first, and which come later at another place."""
    by, own = _first_of(ident, t["doc"], t["tag"], t["start"])
    ahead = by[np.maximum.accumulate(np.where(own, np.arange(len(by)), 0))] if len(by) else by
    first, later = np.zeros(len(by), bool), np.zeros(len(by), bool)
    first[by[own]] = True
    later[by] = ~own & ~_same_place(t, by, ahead)
    return first, later


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Numbers of key tuples by a sort, equal ones alike."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    by = _order(*keys)
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _several(number: np.ndarray) -> np.ndarray:
    """Places of the numbers that occur more than once."""
    return np.flatnonzero(np.bincount(number)[number] > 1) if len(number) else np.zeros(0, np.int64)


def refined(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows that also start earlier, by refining buckets with those of later offsets."""
    take = lambda at: {c: x[at] for c, x in w.items()}
    w = take(_several(_numbered(w["g0"])))
    n = len(w["g0"])
    # pairs of grams at the start and at the later offset are numbered together
    pair = _numbered(np.concatenate([w["g0"], w["g2"]]), np.concatenate([w["g1"], w["g3"]]))
    w["begin"], w["rest"] = pair[:n], pair[n:]
    w = take(_several(_numbered(w["begin"])))
    whole = _numbered(w["begin"], w["rest"])
    at = _several(whole)
    w = take(at)
    _, later = _repeats(w, whole[at])
    return take(later)


def _spans(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring windows of a document as spans of at most 250."""
    by = _order(w["doc"], w["tag"], w["start"])
    w = {c: w[c][by] for c in ("doc", "tag", "start")}
    if not len(by):
        return w | {"windows": np.zeros(0, np.uint8)}
    new = np.ones(len(by), bool)
    new[1:] = (w["doc"][1:] != w["doc"][:-1]) | (w["tag"][1:] != w["tag"][:-1]) | (w["start"][1:] != w["start"][:-1] + 1)
    opened = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    new |= (np.arange(len(by)) - opened) % 250 == 0
    cuts = np.flatnonzero(np.concatenate([new, [True]]))
    return {c: w[c][cuts[:-1]] for c in ("doc", "tag", "start")} | {"windows": np.diff(cuts)}


def _windows(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All windows of runs whose texts begin at `begin`, each with the names of the grams at its four offsets."""
    spans = blocks.Spans(data, seed=33)
    grams = spans.hash(np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1)) if len(data) >= GRAM else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(windows)), windows)
    step = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    p = begin[at] + step
    return {f"g{i}": grams[p + i * GRAM] for i in range(4)} | {"doc": t["doc"][at], "tag": t["tag"][at], "start": (t["start"][at] + step).astype(np.uint32)}


def _name(w: dict[str, np.ndarray]) -> np.ndarray:
    out = w["g0"]
    for i in range(1, 4):
        out = blocks.mixed(out ^ (w[f"g{i}"] * np.uint64(0x9E3779B97F4A7C15)))
    return out


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay).

    Removed is each byte that is covered by a 100-byte string which also starts earlier:
    in a document of smaller doc_id, or before in the same one. Strings are compared as
    they are in the input. A null text counts as empty. Null doc_id values come last. Rows
    with one doc_id and different texts are different documents, in a fixed order; equal
    rows are one document, so neither comes before the other. An empty table stays empty.
    Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    blocks.ship(spark)
    size = 2 * blocks.input_bytes(docs)
    keys = parts = max(12, size // PART_BYTES)
    hot_here = max(2, HOT_BUCKET // keys)
    placed = docs.select(
        F.col(text).alias("text"), "doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tag")
    )
    by_key = lambda x: (x % np.uint64(keys)).astype(np.int64)
    by_part = lambda t: _part(t["doc"], t["tag"], parts)

    def post(batches):
        held: list[dict] = []
        n = 0

        def sent():
            if not held:
                return
            t = {c: np.concatenate([h[c] for h in held]) for c, _ in _RUN}
            # only the first of equal runs is posted; the others are repeats whatever lies elsewhere
            first, later = _repeats(t, t["ident"])
            rows = _dealt(t, _RUN, by_key(t["ident"]), _RUNS, first)
            rows += _dealt(t, _SPAN, by_part(t), _REMOVE, later)
            held.clear()
            for i in range(0, len(rows), 512):
                yield from _table(rows[i : i + 512]).to_batches()

        for rows, data, at in blocks.slices(batches, most=1 << 19):
            r = runs(data, at)
            row = r.pop("row")
            r["doc"] = np.asarray(rows.column(2)).astype(np.int64)[row]
            r["tag"] = np.asarray(rows.column(3)).astype(np.uint32)[row]
            held.append(r)
            n += len(row)
            if n > HELD_RUNS:
                yield from sent()
                n = 0
        yield from sent()

    def apart(table: pa.Table) -> pa.Table:
        """Of runs with equal identifiers the first, by its bucket; the others are repeats."""
        if table.column("kind")[0].as_py() == _REMOVE:
            return table.drop_columns(["group"])
        t = _unpack(table.column("packed"), _RUN)
        first, later = _repeats(t, t["ident"])
        # a bucket with many runs here has many everywhere: its runs need not meet
        _, group, n = np.unique(t["bucket"][first], return_inverse=True, return_counts=True)
        hot = np.zeros(len(first), bool)
        hot[np.flatnonzero(first)] = n[group] > hot_here
        told = {"bucket": np.unique(t["bucket"][hot])}
        rows = _dealt(t, _SPAN, by_part(t), _REMOVE, later) + _dealt(t, _FIRST, by_part(t), _COMPARE_HOT, hot)
        rows += _dealt(t, _FIRST, by_key(t["bucket"]), _FIRSTS, first & ~hot) + _dealt(told, _HOT, by_key(told["bucket"]), _HOTS)
        return _table(rows)

    # two kinds of keys share the shuffle: documents' keys are negative
    mapped = placed.mapInArrow(post, _FORM).withColumn("group", F.when(F.col("kind") == _REMOVE, -1 - F.col("key")).otherwise(F.col("key")))
    found = blocks.written(mapped.groupBy("group").applyInArrow(apart, _FORM), spark)

    def meeting(table: pa.Table) -> pa.Table:
        """Runs of buckets that hold several."""
        kinds = np.asarray(table.column("kind"))
        packed = table.column("packed")
        t = _unpack([packed[i] for i in np.flatnonzero(kinds == _FIRSTS)], _FIRST)
        known_hot = np.unique(_unpack([packed[i] for i in np.flatnonzero(kinds == _HOTS)], _HOT)["bucket"])
        _, group, n = np.unique(t["bucket"], return_inverse=True, return_counts=True)
        hot = np.isin(t["bucket"], known_hot)
        return _table(_dealt(t, _FIRST, by_part(t), _COMPARE, ~hot & (n[group] > 1)) + _dealt(t, _FIRST, by_part(t), _COMPARE_HOT, hot))

    met = found.filter(F.col("kind").isin(_FIRSTS, _HOTS)).groupBy("key").applyInArrow(meeting, _FORM)
    compare = found.filter(F.col("kind") == _COMPARE_HOT).unionAll(met)

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts of the runs to compare, or their windows where a bucket is hot."""
        if not left.num_rows or not right.num_rows:
            return _table([])
        kinds = np.asarray(left.column("kind"))
        data, at = blocks.utf8(right.column("text"))
        doc, tag = np.asarray(right.column("doc")).astype(np.int64), np.asarray(right.column("tag")).astype(np.uint32)
        out = []
        for kind in (_COMPARE, _COMPARE_HOT):
            t = _unpack([left.column("packed")[i] for i in np.flatnonzero(kinds == kind)], _FIRST)
            begin = at[:-1][_locate(doc, tag, t["doc"], t["tag"])] + t["start"]
            lens = t["windows"].astype(np.int64) + LENGTH - 1

            def taken(at_, begin=begin, lens=lens):
                n = lens[at_]
                return data[np.repeat(begin[at_] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

            if kind == _COMPARE:
                key = by_key(t["bucket"])
                by = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1], [True]])) if len(by) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at_ = by[a:b]
                    out.append((_TEXTS, int(key[by[a]]), len(at_).to_bytes(4, "little") + _pack(t, _FIRST, at_) + taken(at_).tobytes()))
            else:
                for i in range(0, len(lens), HOT_AT_ONCE):
                    at_ = np.arange(i, min(i + HOT_AT_ONCE, len(lens)))
                    first = np.concatenate([[0], np.cumsum(lens[at_])[:-1]])
                    w = _windows(taken(at_), first, t["windows"][at_].astype(np.int64), {c: t[c][at_] for c, _ in _FIRST})
                    name = _name(w)
                    own, later = _repeats(w, name)  # of equal windows here the first is sent
                    spans = _spans({c: w[c][later] for c in ("doc", "tag", "start")})
                    out += _dealt(w, _WINDOW, by_key(name), _WINDOWS, own) + _dealt(spans, _SPAN, by_part(spans), _REMOVE)
        return _table(out)

    def refine(table: pa.Table) -> pa.Table:
        """Windows of compared runs that also start earlier."""
        found_ = []
        for kind, raw in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True):
            if kind == _WINDOWS:
                found_.append(_unpack([pa.scalar(raw, pa.binary())], _WINDOW))
            else:
                n = int.from_bytes(raw[:4], "little")
                size_ = 4 + n * sum(np.dtype(k).itemsize for _, k in _FIRST)
                t = _unpack([pa.scalar(raw[4:size_], pa.binary())], _FIRST)
                lens = t["windows"].astype(np.int64) + LENGTH - 1
                found_.append(_windows(np.frombuffer(raw, np.uint8, offset=size_), np.concatenate([[0], np.cumsum(lens)[:-1]]), t["windows"].astype(np.int64), t))
        spans = _spans(refined({c: np.concatenate([x[c] for x in found_]) for c, _ in _WINDOW}))
        return _table(_dealt(spans, _SPAN, by_part(spans), _REMOVE))

    texts = placed.withColumn("key", F.pmod(F.xxhash64("doc", "tag"), F.lit(parts))).repartition(parts, "key")
    wanted = blocks.written(compare.groupBy("key").cogroup(texts.groupBy("key")).applyInArrow(fetch, _FORM), spark)
    again = wanted.filter(F.col("kind") != _REMOVE).groupBy("key").applyInArrow(refine, _FORM)
    removed = found.unionAll(wanted).filter(F.col("kind") == _REMOVE).unionAll(again)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents without what is to be removed."""
        t = _unpack(left.column("packed"), _SPAN)
        data, at = blocks.utf8(right.column("text"))
        doc, tag = np.asarray(right.column("doc")).astype(np.int64), np.asarray(right.column("tag")).astype(np.uint32)
        by = _order(t["doc"], t["tag"])
        d, g, s, n = t["doc"][by], t["tag"][by], t["start"][by].astype(np.int64), t["windows"][by].astype(np.int64)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        lo, hi = np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")
        for i in range(len(doc)):
            raw = data[at[i] : at[i + 1]]
            a, b = int(lo[i]), int(hi[i])
            a, b = a + int(np.searchsorted(g[a:b], tag[i], "left")), a + int(np.searchsorted(g[a:b], tag[i], "right"))
            kept, spans = raw, 0
            if b > a:
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, s[a:b], 1)
                np.add.at(change, s[a:b] + n[a:b] + LENGTH - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = raw[~gone]
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(spans)
            out["kept"].append(kept.tobytes())
        return pa.table({"doc_id": right.column("doc_id"), **{c: pa.array(x, pa.binary() if c == "kept" else pa.int64()) for c, x in out.items()}})

    return removed.groupBy("key").cogroup(texts.groupBy("key")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _locate(doc: np.ndarray, tag: np.ndarray, d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first place in (doc, tag) of each pair of (d, g), which occur there."""
    n = len(doc)
    number = _numbered(np.concatenate([doc, d]), np.concatenate([tag, g]))
    place = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    place[number[:n][::-1]] = np.arange(n)[::-1]
    return place[number[n:]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
