"""Winnowing fingerprints in Spark SQL functions alone.

A text's units are its runs of at most 32 non-space characters. In a longer run a unit is
a single character, or one character repeated (cut at 32), so units there depend on the
characters and not on the distance from the run's start. Every unit is hashed once; the
hash of `k` units in a row is rolled: a cyclic polynomial, in which each unit's hash is
rotated by its distance from the gram's end and all are joined by exclusive or. Grams of
2, 4, ... units come from two shorter ones side by side, so all grams of a text take
log2(k) passes. (A text of fewer units is one gram.) In every window of `w` grams the
smallest is selected, the rightmost of equal ones: the upper bits of a hash and the
position, counted down, share one number, so the minimum of a window is a plain minimum,
taken in log2(w) passes over shifted arrays. Texts that share w + k - 1 units in a row
share a selected hash; positions are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siskin.llm.blocks import input_bytes

#: Units a gram, and grams a window (a power of two).
K, W = 5, 8
#: Bits that hold a gram's position; an array has fewer elements than that.
POSITION_BITS = 31
_POSITIONS = (1 << POSITION_BITS) - 1
#: Most buckets of with_next; the list of their first rows is held by the driver. Beyond
#: MOST_BUCKETS * BUCKET_BYTES of text buckets grow, and are sorted with spilling.
MOST_BUCKETS = 20_000
#: Bytes of text, about, in one ordered bucket of with_next.
BUCKET_BYTES = 8 << 20


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, as the variable of a lambda over one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rotated(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n % 64 else x


def _beside(a: Column, m: int, b: Column, n: int) -> Column:
    """Hashes of m + n units from those of m and of the n after them; null where the text ends before."""
    return F.zip_with(a, F.slice(b, m + 1, 1 << 30), lambda x, y: _rotated(x, n).bitwiseXOR(y))


def rolled(units: Column, k: int = K) -> Column:
    """array<bigint> of the rolling hashes of every k of the units' hashes; of fewer units: of all."""

    def grow(done: Column | None, have: int, power: Column, m: int) -> Column:
        # done: grams of `have` units, the lower bits of k; power: grams of m units
        if k & m:
            done, have = (power, m) if done is None else (_beside(power, m, done, have), have + m)
        if have == k:
            return F.slice(done, F.lit(1), F.greatest(F.size(done) - (k - 1), F.lit(0)))
        step = lambda d: _let(_beside(power, m, power, m), lambda p: grow(d, have, p, 2 * m))
        return step(None) if done is None else _let(done, step)

    few = F.array(F.aggregate(units, F.lit(0).cast("bigint"), lambda h, x: _rotated(h, 1).bitwiseXOR(x)))
    return F.when(F.size(units) >= k, grow(None, 0, units, 1)).when(F.size(units) > 0, few).otherwise(F.array().cast("array<bigint>"))


def selected(text: str | Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash, position>> of a text's selected grams, by position; null and empty: none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    units = F.regexp_extract_all(text, F.lit(r"(?<!\S)\S{1,32}+(?!\S)|(\S)\1{0,31}+"), F.lit(0))

    def windows(least: Column, width: int) -> Column:
        if width == w:
            # the last w - 1 windows are cut short by the end; a text with fewer grams is one window
            return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(least) - (w - 1), F.least(F.size(least), F.lit(1)))))
        # beyond the shorter array there is null, which least() leaves out
        wider = F.zip_with(least, F.slice(least, width + 1, 1 << 30), lambda a, b: F.least(a, b))
        return _let(wider, lambda x: windows(x, 2 * width))

    def picked(grams: Column) -> Column:
        at = lambda x: (F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS))).cast("int")
        return F.transform(_let(F.transform(grams, _key), lambda x: windows(x, 1)), lambda x: F.struct(F.get(grams, at(x)).alias("hash"), at(x).alias("position")))

    return _let(F.transform(units, lambda u: F.xxhash64(u)), lambda u: _let(rolled(u, k), picked))


def _key(gram: Column, i: Column) -> Column:
    return gram.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR(F.lit(_POSITIONS) - i)


def shown(picked: str | Column) -> Column:
    """A fingerprint as text: hash in hexadecimal, @, position; in order of position."""
    return F.array_join(F.transform(picked, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["position"].cast("string"))), " ")


def hashes(picked: str | Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(picked, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with fingerprint, array<struct<hash, position>>; an existing column of that name is replaced."""
    return docs.withColumn("fingerprint", selected(text, k, w))


def _before(cuts: list[int], ident: Column) -> Column:
    """How many of the sorted cuts are at most ident, by binary search; null: none."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))

    def step(low, jump):
        inside = F.element_at(bounds, F.least(low + jump, F.lit(len(cuts)))) <= ident
        return F.when((low + jump <= len(cuts)) & inside, low + jump).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def with_next(rows: DataFrame, ident: str, order: list[Column], carried: dict[str, str], size: int) -> DataFrame:
    """rows with the columns `carried` (new name: column) of the row that follows in descending ident.

    The last row is followed by the first, and a single row by itself. Null idents come
    last; rows of one ident are in the given order. Rows are dealt to ordered buckets of
    idents (of about BUCKET_BYTES at `size` bytes), and a copy of each bucket's first row
    goes to the bucket before it: rows move once, and no task has all of them.
    """
    spark = rows.sparkSession
    n = min(MOST_BUCKETS, 1 + size // BUCKET_BYTES)
    ids = rows.select(F.col(ident).alias("_id"))
    at = [i / n for i in range(1, n)]
    cuts = sorted(set(ids.agg(F.percentile_approx("_id", at, 20 * n)).first()[0] or [])) if at else []
    bucket = lambda c: F.lit(len(cuts)) - _before(cuts, c)
    # one row a bucket, of which there are MOST_BUCKETS at most
    found = ids.groupBy(bucket(F.col("_id")).alias("_b")).agg(F.max("_id").alias("_h")).collect()
    heads = sorted((r["_b"], r["_h"]) for r in found)
    moved = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    copies = F.broadcast(spark.createDataFrame(moved, "_h long, _to int"))
    own = F.struct(bucket(F.col(ident)).alias("b"), F.lit(False).alias("copy"))
    also = F.struct(F.col("_to").alias("b"), F.lit(True).alias("copy"))
    dealt = rows.join(copies, F.col(ident).eqNullSafe(F.col("_h")), "left")
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, also)))).drop("_h", "_to")
    follows = Window.partitionBy("_at.b").orderBy("_at.copy", F.col(ident).desc_nulls_last(), *order)
    dealt = dealt.select("*", *(F.lead(c).over(follows).alias(name) for name, c in carried.items()))
    return dealt.filter(~F.col("_at.copy")).drop("_at")


def edited(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, its edited text's hash, both fingerprints, and likenesses.

    The edited text is the text without its last third, and as many code points from the
    start of the next document in descending doc_id.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = 2 * input_bytes(docs)
    rows = rows.withColumn("picked", selected("text"))
    rows = with_next(rows, "doc_id", [F.col("text")], {"next_text": "text", "next_picked": "picked"}, size)
    n = F.char_length("text")
    third = F.expr("char_length(text) div 3").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))).withColumn("n_chars", n.cast("long"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "picked", "next_picked", selected("edited").alias("edited_picked"))
    rows = rows.withColumns({"own": hashes("picked"), "its": hashes("edited_picked"), "other": hashes("next_picked")})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown("picked").alias("fingerprint"), shown("edited_picked").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("its")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
