"""A hidden Markov language model over word classes, trained by Baum-Welch over partitions.

A frequent word is a class of its own; the others are in classes by their last letters.
How many words have their own class, and how many other classes there are, grows with the
square root of the number of distinct training words. The hidden states emit classes;
within a class a word has its smoothed share of the training tokens. The word counts
behind that are gathered from all training documents and grow with them.

1. Words of training documents are counted, by hash, into buckets of words.
2. Documents are dealt to chunks; a chunk asks the buckets for the counts of its words
   and writes, for each document, its base score, the part of the score that lies within
   classes, and its class sequence.
3. Expectation steps run over the class sequences of each partition (scaled forward and
   backward recursions, all documents of a batch side by side), and their counts are
   summed over partitions. The first model is seeded noise around the class frequencies;
   every step reads all training documents whole.
4. The forward recursion gives each document's exact likelihood.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks

STATES = 6
#: Frequent words with a class of their own (the end is one more), and classes of others:
#: at least, and for each unit of the square root of the number of distinct training words.
TOP, TOP_PER_ROOT = 4096, 16
RARE, RARE_PER_ROOT = 1024, 4
#: Kinds of word endings, which the classes of others are made of; one more stands for the end.
ENDINGS = 1 << 16
#: Most steps over all training documents, and the gain in log likelihood a token (in nats)
#: below which they end before that.
STEPS, LEAST_GAIN = 8, 1e-4
#: Tokens whose recursions run side by side, and tokens that are sorted by length at once.
BATCH_TOKENS, HELD_TOKENS = 300_000, 1_500_000
#: Text, about, of a chunk.
CHUNK_BYTES = 8 << 20
#: The end of a document, as a word.
END = np.uint64(0x656E64)

_PAIR = (("word", np.uint64), ("count", np.int64), ("cls", np.uint32))


# -- recursions -----------------------------------------------------------------------------


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start: by state. move: from state to state. emit: by state and class."""
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def random(states: int, classes: int, frequency: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = frequency[None, :] * rng.uniform(0.2, 1.8, (states, classes))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _side_by_side(sequences: list[np.ndarray]):
    """Sequences from the longest to the shortest, their symbols by time, rows at each time."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lens = np.array([len(sequences[i]) for i in order])
    alive = np.searchsorted(-lens, -np.arange(lens[0]), "left") if len(lens) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(alive)])
    flat = np.concatenate([sequences[i] for i in order])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    symbols = np.empty(len(flat), np.int64)
    symbols[offsets[step] + np.repeat(np.arange(len(lens)), lens)] = flat
    return order, symbols, offsets


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence's likelihood; sequences have a symbol at least."""
    order, symbols, offsets = _side_by_side(sequences)
    emitted = model.emit.T[symbols]
    total = np.zeros(len(sequences))
    a = model.start * emitted[: offsets[1]]
    for t in range(len(offsets) - 1):
        if t:
            n = offsets[t + 1] - offsets[t]
            a = (a[:n] @ model.move) * emitted[offsets[t] : offsets[t + 1]]
        c = a.sum(1)
        a /= c[:, None]
        total[: len(c)] += np.log(c)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of sequences, and their log likelihood.

    Scaled values are of single precision, sums over a batch of double.
    """
    _, symbols, offsets = _side_by_side(sequences)
    k, steps = len(model.start), len(offsets) - 1
    single = np.float32
    move, back = model.move.astype(single), np.ascontiguousarray(model.move.T, single)
    emitted = np.ascontiguousarray(model.emit.T, single)[symbols]
    alpha, scale = np.empty_like(emitted), np.empty((len(symbols), 1), single)
    before = None
    start, edges = model.start.astype(single)[None, :], offsets.tolist()
    for t in range(steps):
        lo, hi = edges[t], edges[t + 1]
        a = alpha[lo:hi]
        np.multiply(before[: hi - lo] @ move if t else start, emitted[lo:hi], out=a)
        c = scale[lo:hi]
        np.add.reduce(a, 1, keepdims=True, out=c)
        a /= c
        before = a
    emitted /= scale
    moves = np.zeros((k, k))
    gamma = alpha
    beta, n = None, 0
    for t in range(steps - 1, -1, -1):
        lo, hi = edges[t], edges[t + 1]
        if n:
            later = emitted[hi : hi + n]
            later *= beta
            moves += alpha[lo : lo + n].T @ later
            here = later @ back
            if hi - lo > n:
                here = np.concatenate([here, np.ones((hi - lo - n, k), single)])
            beta = here
            gamma[lo:hi] *= beta
        else:
            beta = np.ones((hi - lo, k), single)
        n = hi - lo
    first = gamma[: edges[1]].sum(0, dtype=float)
    emissions = np.stack([np.bincount(symbols, gamma[:, i], model.emit.shape[1]) for i in range(k)])
    return first, moves * model.move, emissions, float(np.log(scale, dtype=float).sum())


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], frequency: np.ndarray, weight: float = 20.0) -> Model:
    """The model that expected counts give, smoothed by the classes' frequencies."""
    start, move, emit = counts
    start = start + 1
    move = move + 0.1
    emit = emit + weight * frequency[None, :]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _batches(sequences: list[np.ndarray]):
    """Sequences of like length together, so many tokens at once."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    held, n = [], 0
    for i in order:
        held.append(i)
        n += len(sequences[i])
        if n > BATCH_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


# -- counting -------------------------------------------------------------------------------


def _pack(t, at) -> bytes:
    return b"".join(t[c][at].astype(kind).tobytes() for c, kind in _PAIR)


def _unpack(raws) -> dict[str, np.ndarray]:
    out: dict[str, list] = {c: [] for c, _ in _PAIR}
    for raw in raws:
        n, at = len(raw) // 20, 0
        for c, kind in _PAIR:
            out[c].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {c: np.concatenate(x) if x else np.zeros(0, kind) for (c, kind), x in zip(_PAIR, out.values(), strict=True)}


def _ending(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ending of words: their last two bytes."""
    last = low[ends - 1].astype(np.uint32)
    return last * 256 + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint32)


def _words(data, at):
    low, starts, ends, named, bounds = blocks.words(data, at, seed=8)
    own, first, inverse = np.unique(named, return_index=True, return_inverse=True)
    return own, _ending(low, starts[first], ends[first]), inverse, bounds


def _dealt(t, buckets: int):
    key = (t["word"] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1], [True]])) if len(by) else [0]
    return [(int(key[by[a]]), _pack(t, by[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _summed(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Pairs with the counts of each word added up; a word's ending is one wherever it is."""
    word, count, cls = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, kind) for c, kind in _PAIR)
    own, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    return {"word": own, "count": np.bincount(inverse, count, len(own)).astype(np.int64), "cls": cls[first]}


class Lexicon:
    """What all workers know of the words: sizes, the frequent words, the classes' tokens and words."""

    def __init__(self, tokens: int, words: int, top: np.ndarray, rare: int, in_class: np.ndarray, kinds: np.ndarray):
        """Classes: one a word of top, the end, and rare ones."""
        self.tokens, self.words = tokens, words
        self.top, self.rare = np.sort(top), rare
        self.in_class, self.kinds = in_class, kinds

    @property
    def end(self) -> int:
        return len(self.top)

    def of_ending(self, ending: np.ndarray) -> np.ndarray:
        return np.where(ending == ENDINGS, self.end, self.end + 1 + (ending.astype(np.int64) * 40503 >> 6) % self.rare)

    def classes(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        others = self.of_ending(ending)
        if not len(self.top):
            return others
        at = np.minimum(np.searchsorted(self.top, word), len(self.top) - 1)
        return np.where(self.top[at] == word, at, others)

    @property
    def frequency(self) -> np.ndarray:
        f = self.in_class + 0.5
        return f / f.sum()

    @property
    def kind(self) -> type:
        """The integers that classes are written as."""
        return np.uint16 if len(self.in_class) <= 1 << 16 else np.uint32


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, packed) with the training count and class of every word of training documents."""

    def count(batches):
        held, n = [], 0
        for rows, data, at in blocks.slices(batches):
            own, cls, inverse, _ = _words(data, at)
            held.append({"word": own, "count": np.bincount(inverse, minlength=len(own)), "cls": cls})
            held.append({"word": np.array([END]), "count": np.array([rows.num_rows]), "cls": np.array([ENDINGS], np.uint32)})
            n += len(own)
            if n > 2_000_000:
                held, n = [_summed(held)], 0
                if len(held[0]["word"]) > 1_500_000:
                    yield _rows(_dealt(held.pop(), buckets))
        if held:
            yield _rows(_dealt(_summed(held), buckets))

    def _rows(dealt):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in dealt], pa.int64()), pa.array([d[1] for d in dealt], pa.binary())], ["bucket", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        t = _summed([_unpack(table.column("packed").to_pylist())])
        return pa.table({"bucket": table.column("bucket")[:1], "packed": pa.array([_pack(t, slice(None))], pa.binary())})

    mapped = docs.filter(~F.col("held_out")).select("text").mapInArrow(count, "bucket long, packed binary")
    return blocks.written(mapped.groupBy("bucket").applyInArrow(merge, "bucket long, packed binary"), docs.sparkSession)


def _lexicon(counted: DataFrame) -> Lexicon:
    def sums(batches):
        tokens, kinds, sized = np.zeros(ENDINGS + 1, np.int64), np.zeros(ENDINGS + 1, np.int64), np.zeros(64, np.int64)
        for b in batches:
            t = _unpack(b.column(0).to_pylist())
            tokens += np.bincount(t["cls"], t["count"], ENDINGS + 1).astype(np.int64)
            kinds += np.bincount(t["cls"], minlength=ENDINGS + 1)
            sized += np.bincount(np.frexp(t["count"].astype(float))[1], minlength=64)
        # below the endings: how many words have a count of so many bits
        used = np.flatnonzero(kinds)
        cls = np.concatenate([np.arange(-64, 0), used])
        yield pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32)), pa.array(np.concatenate([np.zeros(64, np.int64), tokens[used]])), pa.array(np.concatenate([sized, kinds[used]]))], ["cls", "tokens", "kinds"])

    by_ending, kinds, sized = np.zeros(ENDINGS + 1), np.zeros(ENDINGS + 1), np.zeros(64)
    for r in counted.select("packed").mapInArrow(sums, "cls int, tokens long, kinds long").groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect():
        if r["cls"] < 0:
            sized[r["cls"] + 64] = r["kinds"]
        else:
            by_ending[r["cls"]], kinds[r["cls"]] = r["tokens"], r["kinds"]
    words = int(kinds.sum())
    most, rare = max(TOP, TOP_PER_ROOT * math.isqrt(words)), max(RARE, RARE_PER_ROOT * math.isqrt(words))
    # the most bits that enough words have: few more than `most` are left to be ordered
    enough = np.flatnonzero(np.cumsum(sized[::-1])[::-1] > most)
    least = 1 << max(0, int(enough[-1]) - 1) if len(enough) else 0

    def best(batches):
        for b in batches:
            t = _unpack(b.column(0).to_pylist())
            at = np.flatnonzero((t["count"] >= least) & (t["word"] != END))
            yield pa.RecordBatch.from_arrays([pa.array(t["word"][at].view(np.int64)), pa.array(t["count"][at]), pa.array(t["cls"][at].astype(np.int32))], ["word", "count", "cls"])

    top = counted.select("packed").mapInArrow(best, "word long, count long, cls int").orderBy(F.desc("count"), "word").limit(most).collect()
    lexicon = Lexicon(int(by_ending.sum()), words, np.array([r["word"] for r in top], np.int64).view(np.uint64), rare, np.zeros(0), np.zeros(0))
    cls, size = lexicon.of_ending(np.arange(ENDINGS + 1)), len(top) + 1 + rare
    lexicon.in_class, lexicon.kinds = np.bincount(cls, by_ending, size), np.bincount(cls, kinds, size)
    if top:  # a frequent word leaves the class of its ending
        word, count, ending = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top]), np.array([r["cls"] for r in top])
        np.subtract.at(lexicon.in_class, lexicon.of_ending(ending), count)
        np.subtract.at(lexicon.kinds, lexicon.of_ending(ending), 1)
        lexicon.in_class[np.searchsorted(lexicon.top, word)] = count
    return lexicon


def _encoded(docs: DataFrame, counted: DataFrame, lexicon, buckets: int, chunks: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, within (score within classes), classes."""
    form = "kind int, key long, back long, packed binary"
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(chunks, "chunk")

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        parts = []
        for _rows, data, at in blocks.slices(iter(table.select(["text"]).to_batches())):
            own, cls, _, _ = _words(data, at)
            parts.append({"word": own, "count": np.zeros(len(own), np.int64), "cls": cls})
        parts.append({"word": np.array([END]), "count": np.zeros(1, np.int64), "cls": np.array([ENDINGS], np.uint32)})
        rows = _dealt(_summed(parts), buckets)
        n = len(rows)
        return pa.table({"kind": pa.array([1] * n, pa.int32()), "key": pa.array([r[0] for r in rows], pa.int64()), "back": pa.array([chunk] * n, pa.int64()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        known, asked = {"word": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}, []
        for kind, back, raw in zip(table.column("kind").to_pylist(), table.column("back").to_pylist(), table.column("packed").to_pylist(), strict=True):
            if kind:
                asked.append((back, raw))
            else:
                known = _unpack([raw])
        out = []
        for back, raw in asked:
            t = _unpack([raw])
            if len(known["word"]):
                at = np.minimum(np.searchsorted(known["word"], t["word"]), len(known["word"]) - 1)
                t["count"] = np.where(known["word"][at] == t["word"], known["count"][at], 0)
            out.append((back, _pack(t, slice(None))))
        n = len(out)
        return pa.table({"kind": pa.array([2] * n, pa.int32()), "key": pa.array([r[0] for r in out], pa.int64()), "back": pa.nulls(n, pa.int64()), "packed": pa.array([r[1] for r in out], pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _summed([_unpack(left.column("packed").to_pylist())])
        lex = lexicon.value
        cls = lex.classes(known["word"], known["cls"])
        base = np.log10((known["count"] + 0.5) / (lex.tokens + 0.5 * (lex.words + 1)))
        inside = np.where(cls > lex.end, np.log10((known["count"] + 0.5) / (lex.in_class[cls] + 0.5 * (lex.kinds[cls] + 1))), 0.0)
        end = int(np.searchsorted(known["word"], END))
        out = []
        for rows, data, at in blocks.slices(iter(right.to_batches())):
            _, _, _, named, bounds = blocks.words(data, at, seed=8)
            place = np.searchsorted(known["word"], named)
            place = np.insert(place, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
            sums = [np.add.reduceat(x[place], bounds[:-1]) for x in (base, inside, (known["count"] > 0).astype(np.int64))]
            sequence = cls[place].astype(lex.kind)
            classes = [sequence[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            out.append(
                pa.table({"doc_id": rows.column(0), "held_out": rows.column(1), "n_tokens": np.diff(bounds), "n_known": sums[2], "base_score": sums[0], "within": sums[1], "classes": pa.array(classes, pa.binary())})
            )
        return pa.concat_tables(out)

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
    asked = dealt.groupBy("chunk").applyInArrow(ask, form)
    told = counted.select(F.lit(0).alias("kind"), F.col("bucket").alias("key"), F.lit(None).cast("long").alias("back"), "packed")
    answers = asked.unionAll(told).groupBy("key").applyInArrow(answer, form).select("key", "packed")
    scored = answers.groupBy("key").cogroup(dealt.groupBy("chunk")).applyInArrow(score, result)
    return blocks.written(scored, docs.sparkSession)


# -- training -------------------------------------------------------------------------------


def _held(batches, kind: type, column: int = 0):
    """Rows of batches until so many tokens are held: (batch, its sequences) lists."""
    held, n = [], 0
    for b in batches:
        raws = b.column(column)
        for i in range(b.num_rows):
            held.append((b, i, np.frombuffer(raws[i].as_buffer(), kind)))
            n += len(held[-1][2])
            if n > HELD_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def train(encoded: DataFrame, frequency: np.ndarray, states: int = STATES, steps: int = STEPS, kind: type = np.uint16) -> Model:
    """Baum-Welch over the class sequences of all rows that are not held out.

    It ends after `steps` steps, or when a step gained less than LEAST_GAIN nats a token.
    """
    spark = encoded.sparkSession
    training = encoded.filter(~F.col("held_out"))
    classes = len(frequency)
    model, before = Model.random(states, classes, frequency), -np.inf
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(model)

        def count(batches, sent=sent):
            k = len(sent.value.start)
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
            log = 0.0
            for held in _held(batches, kind):
                for part in _batches([h[2] for h in held]):
                    a, b, c, d = expected(sent.value, [held[i][2] for i in part])
                    start += a
                    move += b
                    emit += c
                    log += d
            packed = [np.concatenate([start[i : i + 1], move[i], emit[i], [log]]).tobytes() for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(np.random.default_rng().integers(0, 32, k), pa.int32()), pa.array(packed, pa.binary())], ["state", "part", "packed"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, float) for x in table.column("packed").to_pylist())
            return pa.table({"state": table.column("state")[:1], "part": pa.array([0], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})

        form = "state int, part int, packed binary"
        sums = training.select("classes").mapInArrow(count, form).groupBy("state", "part").applyInArrow(add, form).groupBy("state").applyInArrow(add, form)
        got = {r["state"]: np.frombuffer(r["packed"], float) for r in sums.collect()}  # one row a state, of fixed size
        if not got:
            break
        rows = np.stack([got[i] for i in range(states)])
        model = improved((rows[:, 0], rows[:, 1 : 1 + states], rows[:, 1 + states : -1]), frequency)
        tokens, log = rows[:, 1 + states : -1].sum(), rows[0, -1]  # a token's states sum to one
        if log - before < LEAST_GAIN * tokens:
            break
        before = log
    return model


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text, held_out; rows that are held out teach nothing. A null, empty or
    blank text is the end alone. Repeated rows and null doc_id values count like others.
    Without training documents the counts are zero and the model is the smoothing alone.
    """
    spark = docs.sparkSession
    blocks.ship(spark)
    size = 2 * blocks.input_bytes(docs)
    chunks = buckets = max(12, size // CHUNK_BYTES)
    docs = docs.select("doc_id", "held_out", "text")
    counted = _counted(docs, buckets)
    lexicon = _lexicon(counted)
    sent = spark.sparkContext.broadcast(lexicon)
    encoded = _encoded(docs, counted, sent, buckets, chunks)
    kind = lexicon.kind
    model = spark.sparkContext.broadcast(train(encoded, lexicon.frequency, kind=kind))

    def likelihood(batches):
        for held in _held(batches, kind, 6):
            logs = np.empty(len(held))
            for part in _batches([h[2] for h in held]):
                logs[part] = forward(model.value, [held[i][2] for i in part])
            done = 0
            while done < len(held):  # rows go out as they came in
                batch, i = held[done][0], held[done][1]
                n = 1
                while done + n < len(held) and held[done + n][0] is batch:
                    n += 1
                rows = batch.slice(i, n)
                within = np.asarray(rows.column(5))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(5)), pa.array(logs[done : done + n] / np.log(10) + within)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                done += n

    out = encoded.mapInArrow(likelihood, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", blocks.held_out("doc_id", 1).alias("held_out")))
