"""Language identification with bit-sliced Bloom filters over character n-grams.

Every slot of the filter holds one bit per language. A look-up takes the AND of a
gram's slots, so one pass returns the set of all languages that contain the gram.
A document's grams are counted per language, each count is corrected by that
language's false positive rate, and the largest corrected share decides.

A language contains a gram if the gram's share of the language's grams is at least
`min_share` and at least `near` times its share in any other language. There are at
most 1 / min_share such grams a language, which bounds the filter at any corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks

#: Gram lengths; a space stands for either end of a word.
ORDERS = (2, 3, 4)
#: Hash functions of the filter, and slots for each gram of the largest language.
HASHES, SLOTS_PER_GRAM = 3, 12
#: Distinct grams that a worker counts before it sends them.
HELD_GRAMS = 2_000_000
#: Bytes of text whose grams are worked on at once.
SLICE_BYTES = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)
    return _letters


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all grams of lower-cased texts, the row of each, and whether rows have letters."""
    low = [x.lower() for x in texts]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])]).astype(np.int64)
    chars = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[chars]
    # a run of other characters counts as one space; a space also stands before each row
    before = np.empty_like(letter)
    before[:1], before[1:] = False, letter[:-1]
    pos = np.flatnonzero(letter | before)
    symbol = np.where(letter[pos], chars[pos], 32).astype(np.uint64)
    row = np.searchsorted(at, pos, "right").astype(np.int32) - 1
    # the space that ended the last word also begins the next one, in the same row or not
    space = symbol == 32
    start = np.empty_like(space)
    start[:1], start[1:] = True, space[:-1]
    names, rows = [], []
    h = symbol
    ok = ~space
    mult = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, max(orders) + 1):
        if k > 1:
            h = h[:-1] * mult + symbol[k - 1 :]
            ok = ok[:-1] & (~space[k - 2 : len(space) - 1]) if k > 2 else ok[:-1]
        if k in orders:
            # inside a word, with the space after it allowed as the last symbol
            names.append(blocks.mixed(h[ok] + np.uint64(k)))
            rows.append(row[: len(ok)][ok])
        if k + 1 in orders:
            # the same gram after the start of a word
            first = ok & start[: len(ok)] & ~((symbol[k - 1 :] == 32) if k == 1 else np.zeros(len(ok), bool))
            led = h[first] + np.uint64(32 * int(mult) ** k % 2**64)
            names.append(blocks.mixed(led + np.uint64(k + 1)))
            rows.append(row[: len(ok)][first])
    has = np.zeros(len(texts), bool)
    has[row[~space]] = True
    return np.concatenate(names), np.concatenate(rows), has


def _slot(names: np.ndarray, i: int, size: int) -> np.ndarray:
    """The i-th hash of each name, below size, a power of two."""
    return (blocks.mixed(names + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    #: One word of bits for each 64 languages and slot.
    slots: np.ndarray
    #: False positive rate of each language.
    wrong: np.ndarray

    def languages(self, names: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of languages that contain each gram."""
        out = None
        for i in range(HASHES):
            got = self.slots[word][_slot(names, i, self.slots.shape[1])]
            out = got if out is None else out & got
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, `und` where it has no letter, and its corrected share."""
        names, rows, has = grams(texts)
        n, total = len(texts), len(self.langs)
        seen = np.bincount(rows, minlength=n).astype(float)
        hits = np.zeros((n, total))
        for word in range(self.slots.shape[0]):
            mask = self.languages(names, word)
            for low in range(64 * word, min(64 * word + 64, total), 8):
                width = min(8, total - low)
                part = (mask >> np.uint64(low - 64 * word)).astype(np.uint8) & np.uint8((1 << width) - 1)
                held = np.bincount((rows.astype(np.int64) << width) | part, minlength=n << width).reshape(n, 1 << width)
                hits[:, low : low + width] = held @ ((np.arange(1 << width)[:, None] >> np.arange(width)) & 1)
        share = (hits - seen[:, None] * self.wrong) / (np.maximum(seen, 1)[:, None] * (1 - self.wrong))
        if not total:
            return ["und"] * n, np.zeros(n)
        best = share.argmax(1)
        score = np.where(has, np.clip(share[np.arange(n), best], 0, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score


def build(counted: list[tuple[str, int, float]], near: float) -> Model:
    """counted: language, gram's name (64 bits, signed or not), the gram's share of the language."""
    langs = sorted({x[0] for x in counted})
    if not langs:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0))
    index = {x: i for i, x in enumerate(langs)}
    lang = np.array([index[x[0]] for x in counted], np.int64)
    name = np.array([x[1] % (1 << 64) for x in counted], np.uint64)
    share = np.array([x[2] for x in counted])
    own, group = np.unique(name, return_inverse=True)
    top = np.zeros(len(own))
    np.maximum.at(top, group, share)
    kept = share >= near * top[group]
    lang, name = lang[kept], name[kept]
    most = int(np.bincount(lang).max())
    size = 1 << max(6, (SLOTS_PER_GRAM * most - 1).bit_length())
    model = Model(langs, np.zeros(((len(langs) + 63) // 64, size), np.uint64), np.zeros(len(langs)))
    for i in range(HASHES):
        at = _slot(name, i, size)
        np.bitwise_or.at(model.slots, (lang // 64, at), np.uint64(1) << (lang % 64).astype(np.uint64))
    for i in range(len(langs)):
        filled = ((model.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        model.wrong[i] = filled**HASHES
    return model


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 1e-5, near: float = 0.25) -> Model:
    """Learn from all rows of labelled whose lang is not null.

    Null and empty texts add nothing; without any gram the model has no language.
    """
    spark = labelled.sparkSession
    blocks.ship(spark)

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def summed(parts):
            names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return names, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang_, parts in held.items():
                names, counts = summed(parts)
                for i in range(0, len(names), 1 << 16):
                    part = names[i : i + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(part), pa.string()), pa.array(part), pa.array(counts[i : i + (1 << 16)])], ["lang", "gram", "n"])
            held.clear()

        for rows, _, _ in blocks.slices(batches, "text", SLICE_BYTES):
            labels = np.array(rows.column(1).to_pylist(), object)
            texts = blocks.texts_of(rows)
            for one in dict.fromkeys(labels):
                got = np.unique(grams([texts[i] for i in np.flatnonzero(labels == one)])[0], return_counts=True)
                held.setdefault(one, []).append(got)
                n += len(got[0])
            if n > HELD_GRAMS:
                held.update({k: [summed(v)] for k, v in held.items()})
                n = sum(len(v[0][0]) for v in held.values())
                if n > HELD_GRAMS // 2:
                    yield from flush()
                    n = 0
        yield from flush()

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = blocks.written(counts, spark)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("of")).alias("share")).filter(F.col("share") >= min_share)
    return build([tuple(x) for x in shares.collect()], near)


def identify(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with lang_pred and score (0 to 1); `und` and 0 where a text is null or has no letter.

    Of languages with equal shares the first by name is taken. Existing columns of these
    names (label and score give others) are replaced. Repeated rows are kept.
    """
    spark = docs.sparkSession
    blocks.ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def make():
        def run(rows, data, at):
            langs, scores = sent.value.predict(blocks.texts_of(rows, text))
            return [pa.array(langs, pa.string()), scores]

        return run

    return blocks.with_columns(docs, f"{label} string, {score} double", make, text, SLICE_BYTES)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Documents whose language is known with a score of min_score at least, with the columns of docs.

    A null, empty or letterless text goes; repeated rows and other columns stay as they are.
    """
    model = train(docs.filter(~blocks.held_out("doc_id", 0)))
    label, score = blocks.unused(docs, "lang"), blocks.unused(docs, "score")
    kept = identify(docs, model, label=label, score=score).filter((F.col(label) != "und") & (F.col(score) >= min_score))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~blocks.held_out("doc_id", 0)))
    out = identify(docs.select("doc_id", blocks.held_out("doc_id", 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
