"""Language ID, tokens, packing, fingerprints, media, personal data on small documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siskin.llm import blocks, bpe, jpeg, langid, packing, pii, winnow


def test_words_and_hashes(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    data, at = blocks.utf8(pa.array(texts))
    low, s, e, named, bounds = blocks.words(data, at)
    seen = {}
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        got = [bytes(low[a:b]).decode() for a, b in zip(s[bounds[i] : bounds[i + 1]], e[bounds[i] : bounds[i + 1]], strict=True)]
        assert got == want
        for w, h in zip(want, named[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


# -- language -----------------------------------------------------------------------------


def test_langid(docs, empty, clashing):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect() if r["source"] != "odd" and r["doc_id"] is not None}
    assert sum(r["lang_pred"] == r["lang"] for r in got.values()) >= 0.9 * len(got)
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).filter("source = 'odd'").collect()}
    assert {odd[60 + k]["lang_pred"] for k in (20, 21, 22, 23)} == {"und"} and odd[80]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(docs, langid.train(empty)).filter("lang_pred != 'und'").count() == 0
    out = langid.identify(clashing, model)
    assert out.columns.count("lang_pred") == 1 and out.filter("lang_pred = 'mine'").count() == 0 and "pieces" in out.columns


def test_filter_never_misses_and_corrects():
    rng = np.random.default_rng(1)
    names = rng.integers(-(1 << 63), 1 << 63, 3000)
    counted = [("ab"[i % 2], int(n), 0.001) for i, n in enumerate(names)]
    model = langid.build(counted, 0.25)
    for bit, lang in enumerate(model.langs):
        mine = np.array([n for l, n, _ in counted if l == lang], np.int64).view(np.uint64)
        assert (model.languages(mine) >> np.uint64(bit) & np.uint64(1)).all()
    others = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    rate = (model.languages(others) & np.uint64(1)).mean()
    assert abs(rate - model.wrong[0]) < 0.02


def brute_grams(text):
    """2- to 4-grams of lower-cased words, a space before and after each word."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for k in langid.ORDERS:
            out += [" " + word[: k - 1]] if len(word) >= k - 1 else []
            whole = word + " "
            out += [whole[i : i + k] for i in range(len(whole) - k + 1)]
            if len(word) == k - 2:
                out.append(" " + word + " ")
    return out


def test_op1_query_against_exact_sets(spark, stored, rows):
    """Predictions from plain dictionaries of the grams' strings, without hashes or a filter."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    counts = {}
    for doc_id, text, lang, *_ in rows:
        if text is not None and lang is not None and not held(doc_id):
            c = counts.setdefault(lang, {})
            for g in brute_grams(text):
                c[g] = c.get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {}
    for c in share.values():
        for g, x in c.items():
            top[g] = max(top.get(g, 0), x)
    sets = {lang: {g for g, x in c.items() if x >= 1e-5 and x >= 0.25 * top[g]} for lang, c in share.items()}
    got = {(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in langid.query(spark, stored).collect()}
    by_id = {r["doc_id"]: r for r in langid.query(spark, stored).collect()}
    assert len({g[:2] for g in got}) == len({r[0] for r in rows})
    for doc_id, text, *_ in rows:
        r = by_id[doc_id]
        assert r["held_out"] == held(doc_id)
        grams = brute_grams(text or "")
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        exact = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        assert abs(r["score"] - max(exact.values())) < 0.02, (doc_id, r, exact)
        assert exact[r["lang_pred"]] > max(exact.values()) - 0.02, (doc_id, r, exact)


def test_many_languages():
    counted = [(f"l{i:03}", 1000 * i + j, 0.01) for i in range(70) for j in range(40)]
    model = langid.build(counted, 0.25)
    assert model.slots.shape[0] == 2
    assert model.languages(np.array([1000 * 68 + 3], np.uint64), 1)[0] >> np.uint64(4) & np.uint64(1)


# -- tokens ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(docs, rows, library):
    got = {(r["doc_id"], r["source"]): r for r in bpe.decode(bpe.encode(docs)).collect()}
    for r in rows:
        want = library.encode(r[1] or "", add_special_tokens=False).ids
        out = got[r[0], r[3]]
        assert out["token_ids"] == want
        assert out["decoded"] == library.decode(want, skip_special_tokens=False)


def test_bpe_on_random_texts(library):
    rng = random.Random(2)
    codec = bpe.Codec(bpe.default_path(), kept=300)
    special = ["<|startoftext|>", "<|endoftext|>", "<|", "'s", "'ll", "''", "Σ", "İ", "é", "Ᲊ", "½", "\x1c", " "]
    texts = ["".join(rng.choice([*"abcdenorstuy' 1.!\n", *special, chr(rng.randint(0x21, 0x2FF))]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for i in range(0, len(texts), 250):
        part = texts[i : i + 250]
        ids, at = codec.encode(part)
        for j, t in enumerate(part):
            assert ids[at[j] : at[j + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("kept", [5, 10, 20, 40, 70, 100])
def test_bpe_with_a_full_cache_and_odd_characters(library, kept):
    """Words, special tokens and characters that the tables of Python lack, with a cache that starts anew all the time."""
    rng = random.Random(kept)
    codec = bpe.Codec(bpe.default_path(), kept=kept)
    odd = [chr(i) for i in (0x1C89, 0xA7CB, 0xA7DA, 0x10D40, 0x0378)]
    make = lambda: rng.choice(["the", "I'll", "naïve", "12ab", *odd, odd[0] + "x", "<|endoftext|>", str(rng.randint(0, 9999)), "".join(rng.choices("abcdefg", k=6))])
    for _ in range(30):
        texts = [" ".join(make() for _ in range(rng.randint(0, 30))) for _ in range(6)]
        ids, at = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op2_query_equals_the_library(spark, stored, rows, library):
    got = sorted(bpe.query(spark, stored).collect(), key=str)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    want = [(d, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for d, x in ids]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_edges(empty, clashing):
    assert bpe.encode(empty).count() == 0
    assert bpe.encode(clashing).schema["token_ids"].dataType.simpleString() == "array<int>"


# -- packing --------------------------------------------------------------------------------


def naive_fill(histogram, window):
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in bins if b >= length]
            bins.append((min(fits) if fits else window) - length)
            if fits:
                bins.remove(min(fits))
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        rng = random.Random(seed)
        window = rng.choice([10, 17, 64])
        histogram = {rng.randint(1, window): rng.randint(1, 25) for _ in range(rng.randint(1, 12))}
        filled = {}
        for length, _, n, first, each, offset in packing.plan(histogram, window):
            for k in range(n):
                filled.setdefault(first + k // each, []).append((offset + k % each * length, length))
        left = []
        for spans in filled.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
            left.append(window - sum(spans[-1]))
        assert sorted(left) == naive_fill(histogram, window)


def test_packed_documents(docs, rows, empty, library):
    out = packing.pack(docs, window=64).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        spans.sort()
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at <= 64
    for doc_id, text, *_ in rows:
        if doc_id == 88:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = sum(len(s) and sum(x[1] for x in s) for s in by_sequence.values())
    assert used > 0.97 * 64 * len(by_sequence)
    assert packing.pack(empty).count() == 0


def test_pieces_with_clashing_columns(spark, clashing):
    found = spark.createDataFrame([(i % 5, i, 1 + i % 9, "mine") for i in range(40)], "doc_id long, start long, length long, rank string").withColumns({c: F.lit("mine") for c in ("bucket", "before", "n", "row", "given", "p_n")})
    out = packing.place(found, 16)
    assert out.columns == [*found.columns, "sequence_id", "offset"] and out.filter("rank = 'mine' and before = 'mine' and row = 'mine'").count() == 40
    assert packing.pack(clashing).select("doc_id").distinct().count() == 8


def test_place_rejects_long_pieces(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0, 9)], "doc_id long, start long, length long"), 8)


# -- fingerprints -----------------------------------------------------------------------------


UNIT = re.compile(r"(?<!\S)\S{1,32}(?!\S)|(\S)\1{0,31}")


def turned(x, n):
    n %= 64
    return (x << n | x >> 64 - n) & (1 << 64) - 1 if n else x


def brute_fingerprint(text, unit_hash, k=winnow.K, w=winnow.W):
    """[(hash, position)] that winnowing selects, each gram's hash made alone."""
    u = [unit_hash[m[0]] for m in UNIT.finditer(text or "")]

    def gram(part):
        h = 0
        for i, x in enumerate(part):
            h ^= turned(x, len(part) - 1 - i)
        return h - (1 << 64) if h >> 63 else h

    g = [gram(u[i : i + k]) for i in range(len(u) - k + 1)] or ([gram(u)] if u else [])
    key = [(x >> winnow.POSITION_BITS, -i) for i, x in enumerate(g)]
    picked = [min(key[i : i + w]) for i in range(max(1, len(g) - w + 1))] if g else []
    return [(g[-i], -i) for _, i in dict.fromkeys(picked)]


def unit_hashes(spark, texts):
    units = sorted({m[0] for t in texts if t for m in UNIT.finditer(t)})
    return {r["u"]: r["h"] % (1 << 64) for r in spark.createDataFrame([(u,) for u in units], "u string").withColumn("h", F.xxhash64("u")).collect()}


@pytest.mark.parametrize(("k", "w"), [(winnow.K, winnow.W), (1, 2), (6, 4), (8, 16)])
def test_winnowing_against_brute_force(spark, docs, rows, k, w):
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    known = unit_hashes(spark, [r[1] for r in rows])
    got = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in winnow.fingerprint(texts, k=k, w=w).collect()}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            assert got[doc_id] == brute_fingerprint(text, known, k, w), doc_id


def test_winnowing_of_unspaced_text_follows_its_content(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "ABCDEFGHijklmnop0123456789+/")]
    texts = [t for r in runs for t in (r, r[:1] + "x" + r[1:], "short words first " + r[1500:])]
    passage = runs[0][700:712]  # w + k - 1 characters
    texts += ["乙" * 40 + passage + "甲" * 40, "some words, then " + "丙丁" * 30 + passage + "戊己" * 30, "a b c", "abc " * 6 + "d" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", winnow.hashes(winnow.selected("text")).alias("h")).collect()
    h = {r["doc_id"]: set(r["h"]) for r in rows}
    for first in (0, 3):
        assert len(h[first] & h[first + 1]) > 0.98 * len(h[first])
        assert len(h[first] & h[first + 2]) > 0.45 * len(h[first])
    assert h[6] & h[7] and h[6] & h[0]
    assert len(h[8]) == 1


def test_edited_texts(spark, docs, rows, empty, clashing):
    rows = [r for r in rows if r[0] != 88]
    docs = docs.filter("doc_id is null or doc_id != 88")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = {r["doc_id"]: r for r in winnow.edited(docs).collect()}
    after = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
    cut = lambda text: len(text) - len(text) // 3
    made = {r[0]: (r[1] or "")[: cut(r[1] or "")] + after[r[0]][: len(r[1] or "") // 3] for r in order}
    known = unit_hashes(spark, [*made.values(), *(r[1] for r in rows)])
    told = lambda text: brute_fingerprint(text, known)
    shown = lambda f: " ".join(f"{h % (1 << 64):X}@{i}" for h, i in f)

    def alike(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for doc_id, text, *_ in order:
        r, text = got[doc_id], text or ""
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(made[doc_id].encode()).hexdigest(), doc_id
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(told(text)), shown(told(made[doc_id])))
        assert r["near_edited"] == alike(told(text), told(made[doc_id])) and r["near_next"] == alike(told(text), told(after[doc_id]))
    assert winnow.edited(empty).count() == 0
    one = spark.createDataFrame([(5, "one text alone", "en", "", 1)], docs.schema)
    assert winnow.edited(one).first()["near_next"] == 1
    assert winnow.edited(clashing).count() == 8


def test_next_of_equal_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "c"), (None, "d"), (7, "a"), (7, "b")], "i long, t string")
    got = {r["t"]: r["n"] for r in winnow.with_next(rows, "i", [F.col("t")], {"n": "t"}, 100).collect()}
    assert got == {"a": "b", "b": "c", "c": "d", "d": "a"}


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 100)
    ids = spark.range(500).select((F.col("id") * F.col("id")).alias("i"))
    got = {r["i"]: r["n"] for r in winnow.with_next(ids, "i", [], {"n": "i"}, 2000).collect()}
    assert got == {i * i: (i - 1) ** 2 if i else 499**2 for i in range(500)}


# -- media ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 192, 193, 385, 7777, 384 * 4001])
def test_payloads_come_back(n):
    payload = jpeg.padded(bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)))
    read = jpeg.Decoder(jpeg.store(payload))
    assert jpeg.payload_of(read) == payload and read.scans == 8 and len(payload) % 192 == 0


def coded(values, sizes):
    return jpeg._packed(np.array(values, np.int64), np.array(sizes, np.int64))


def test_a_general_progressive_file():
    """Grey blocks with runs of zeros, a band scan, end-of-band runs and new values in a refinement."""
    dc, ac, more = [40, -24, 8], [{1: 6, 5: -3}, {}, {2: 1, 63: -2}], None
    out = [b"\xff\xd8", jpeg._marker(0xDB, bytes([0]) + bytes([2]) * 64)]
    out.append(jpeg._marker(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])))
    codes = bytes([0] * 7 + [200] + [0] * 8)
    symbols = bytes(range(200))
    out.append(jpeg._marker(0xC4, bytes([0x00]) + codes + symbols + bytes([0x10]) + codes + bytes([*range(16), 0x21, 0x11, 0x31, 0x12, 0xF0, 0x01, 0x02, 0x10, 0xE1]) + bytes(range(16, 191))))
    listed = bytes([*range(16), 0x21, 0x11, 0x31, 0x12, 0xF0, 0x01, 0x02, 0x10, 0xE1]) + bytes(range(16, 191))
    sym = {}
    for i, s in enumerate(listed):
        sym.setdefault(s, i)
    values, sizes, before = [], [], 0
    for v in dc:
        d, before = v - before, v
        size = abs(d).bit_length()
        values += [size, d if d >= 0 else d + (1 << size) - 1]
        sizes += [8, size]
    out.append(jpeg._scan_marker([(1, 0)], 0, 0, 0, 0, coded(values, sizes)))
    # first AC scan, 1..63, shifted right by one: block 0 has 3 at 1 and -1 at 5; then blocks 1 and 2 end in a run ... -1 at 63
    values, sizes = [], []

    def put(symbol, *bits):
        values.append(sym[symbol])
        sizes.append(8)
        for value, size in bits:
            values.append(value)
            sizes.append(size)

    put(0x02, (3, 2))  # 3 at 1
    put(0x31, (0, 1))  # three zeros, -1 at 5
    put(0x10, (0, 1))  # the rest of block 0 and block 1
    put(0xF0), put(0xF0), put(0xF0)  # 48 zeros: 1..48
    values.append(sym[0x01 | 0xE0] if 0xE1 in sym else 0), sizes.append(8)
    put_at = 0xE1 in sym
    if put_at:
        values.append(0), sizes.append(1)  # 14 zeros, -1 at 63
    out.append(jpeg._scan_marker([(1, 0)], 1, 63, 0, 1, coded(values, sizes)))
    # refinement: block 0: 3 -> 6 (bit 0), -1 -> -3 (bit 1); block 2: a new 1 at 2, then -1 -> -2 (bit 0)
    values, sizes = [], []
    put(0x10, (0, 1))  # end of band for blocks 0 and 1; corrections of block 0 follow
    values += [0, 1]
    sizes += [1, 1]
    put(0x11, (1, 1))  # one zero, then a new +1 at 2
    put(0x00)  # the rest of block 2: one correction
    values.append(0), sizes.append(1)
    out.append(jpeg._scan_marker([(1, 0)], 1, 63, 1, 0, coded(values, sizes)))
    read = jpeg.Decoder(b"".join([*out, b"\xff\xd9"]))
    want = np.zeros((3, 64), int)
    want[:, 0] = dc
    for i, x in enumerate(ac):
        for k, v in x.items():
            want[i, k] = v
    assert read.components[0].values.tolist() == want.tolist()
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    natural = np.zeros((3, 64))
    natural[:, jpeg.ZIGZAG] = want * 2
    exact = np.einsum("buv,ux,vy->bxy", natural.reshape(3, 8, 8), one, one) + 128
    tensor = read.tensor()
    assert tensor.shape == (8, 24, 3)
    assert np.abs(tensor[..., 0].reshape(8, 3, 8).transpose(1, 0, 2) - exact).max() <= 0.51


def test_media_columns(docs, rows, empty, clashing):
    own = jpeg.to_tensors(jpeg.to_media(clashing.withColumn("_made", F.lit("mine"))))
    assert own.filter("_made = 'mine' and length(tensor) > 0").count() == 8
    out = jpeg.to_tensors(jpeg.to_media(docs)).filter("doc_id = 4").first()
    assert len(out["tensor"]) == 3 * out["width"] * out["height"] and bytes(out["media"][:2]) == b"\xff\xd8"
    assert jpeg.to_media(empty).count() == 0
    broken = docs.select("doc_id").limit(1).withColumn("media", F.lit(b"\xff\xd8\xff\xda"))
    assert jpeg.to_tensors(broken).first()["tensor"] is None
    assert jpeg.to_media(clashing).schema["media"].dataType.simpleString() == "binary"


def test_op6_query_against_the_texts(spark, stored, rows):
    got = {}
    for r in jpeg.query(spark, stored).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        media = jpeg.store(payload)
        read = jpeg.Decoder(media)
        for r in got[doc_id]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), jpeg.features(read.tensor()))


def test_colour_and_upsampling():
    read = jpeg.Decoder(jpeg.store(b"\x80" * 384))
    t = read.tensor()
    y, cb, cr = (p.astype(int) for p in read.planes())
    up = lambda p: p.repeat(2, 0).repeat(2, 1) - 128
    want = np.clip(np.stack([y + 1.402 * up(cr), y - 0.344136 * up(cb) - 0.714136 * up(cr), y + 1.772 * up(cb)], 2), 0, 255)
    assert np.abs(t - want).max() <= 1


# -- personal data ----------------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_rules():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.@.-_%+0123456789 ().é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_trees_on_unseen_examples(model):
    x, y = pii.examples(3000, seed=99)
    p = model.trees.probability(x)
    for i, kind in enumerate(pii.KINDS):
        mine = x[:, i] == 1
        taken = p[mine] >= model.least[kind]
        assert y[mine][taken].mean() > 0.97 and taken[y[mine] == 1].mean() > 0.95


def test_added_and_kept_spans(model):
    text = "mail john.doe (at) example (dot) com or call (555) 123-4567 on 2024-01-05, order 12345678, me@x.org"
    base, spans = pii.find([text], model)[0]
    assert base == [("email", text.index("me@"), len(text))] and set(base) < set(spans)
    assert [k for k, *_ in spans] == ["email", "phone", "email"]
    clean = "It was the year 1984, page 12 of 300, at ten. Version 1.2.3 cost $14.99."
    assert pii.find([clean], model)[0] == ([], [])


AT = [a + at + b for a, b in ("()", "[]", "{}") for at in ("at", "AT", " at ", " AT ", "@", " @ ")] + [" (at) ", " {AT} ", " at ", " AT "]
DOT = [".", "(dot)", "[DOT]", "{ dot }", " (DOT) ", " [.] ", " dot ", " DOT "]


def test_every_hidden_form_is_proposed_without_digits(model):
    for at in AT:
        for dot in DOT:
            core = f"jane{at}example{dot}com"
            assert ("email", 3, 3 + len(core)) in list(pii.candidates(f"to {core}, she said")), core
    for core in ("jane (AT) example (DOT) com", "jane [AT] example.com", "jane{at}example.com", "jane AT example DOT com"):
        assert pii.find([f"write to {core}, she said"], model)[0][1] == [("email", 9, 9 + len(core))], core


def test_neighbouring_numbers_are_proposed_apart(model):
    numbers = ["555-123-4567", "555-987-6543", "(212) 555-0187", "555.444.1234"]
    row = " ".join(numbers)
    got = list(pii.candidates(row))
    for n in numbers:
        assert ("phone", row.index(n), row.index(n) + len(n)) in got
    assert len(set(got)) == len(got) and len(list(pii.candidates("1 " * 2000))) < 25 * 2000
    for text, number in (("call 555-123-4567 555-987-6543 now", "555-123-4567"), ("call 555-123-4567 555-987-6543 now", "555-987-6543"), ("call on 2024-01-05 555-123-4567 then", "555-123-4567")):
        spans = pii.find([text], model)[0][1]
        assert ("phone", text.index(number), text.index(number) + len(number)) in spans, (text, spans)
    text = "card 4012.8888.8888.1881 555-123-4567 now"
    assert ("card", 5, 24) in pii.find([text], model)[0][1]


def test_op7_query_against_the_rules(spark, tmp_path, model):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a@b.co ", "10.0.0.", "1", "255", "4012 8888 8888 1881", "+1 (830) 555-5433", " at ", "é", "x", " ", "-", "."]) for _ in range(30)) for _ in range(60)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.query(spark, str(tmp_path)).collect():
        base = brute_spans(texts[r["doc_id"]] or "")
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2])) and told(spans) == r["spans"]


def test_long_texts_take_time_in_proportion(model):
    import time

    line = "call (555) 123-4567 or write to a.b (at) host (dot) com, order 12345678\n"
    took = []
    for n in (1000, 8000):
        began = time.process_time()
        spans = pii.find([line * n], model)[0][1]
        took.append(time.process_time() - began)
        assert len(spans) == 2 * n
    assert took[1] < 16 * took[0]


def test_redaction(docs, empty, clashing, spark, model):
    some = spark.createDataFrame([(1, "to a@b.co and +1 (830) 555-5433."), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["pii_text"] for r in pii.redact(some, model).collect()}
    assert got == {1: "to <EMAIL> and <PHONE>.", 2: None, 3: ""}
    assert pii.redact(empty, model).count() == 0
    assert pii.redact(docs, model).filter("pii_text != text").count() == 0
    assert pii.redact(clashing, model).filter("pii_spans = 'mine'").count() == 0
