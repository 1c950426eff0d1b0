"""Substring and line removal, the Jaccard join, scoring and the pipeline against brute force."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siskin.llm import blocks, hmm, jaccard, lines, links, packing, substrings

LAST = 1 << 62
#: Classes of the small models below.
CLASSES = 5121


def order(rows):
    return sorted(rows, key=lambda r: (LAST if r[0] is None else r[0]))


# -- substrings -------------------------------------------------------------------------------


def brute_substrings(rows):
    seen, out = {}, {}
    for k, (doc_id, text, *_) in enumerate(order(rows)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen and seen[w] != (doc_id, text, i):
                gone[i : i + 100] = True
            seen.setdefault(w, (doc_id, text, i))
        kept = raw if not gone.any() else bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.setdefault(doc_id, []).append((len(raw), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_BUCKET", hot)
    got = collections.defaultdict(list)
    for r in substrings.remove(docs).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    want = brute_substrings(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[1] for v in want.values() for x in v) > 1000


def test_substrings_within_one_text(spark, empty):
    block = "".join(chr(97 + i * i % 26) for i in range(150))
    df = spark.createDataFrame([(1, "z" * 250, "", "", 0), (2, block + "-" + block, "", "", 0)], empty.schema)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substrings.remove(df).collect()}
    want = brute_substrings([(1, "z" * 250), (2, block + "-" + block)])
    assert got == {k: v[0][1:3] for k, v in want.items()}
    assert substrings.remove(empty).count() == 0


def test_substrings_edges(clashing, spark, rows):
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove(clashing).collect()}
    assert got == {k: v[0][3] for k, v in brute_substrings(rows[:8]).items()}


def test_refinement_finds_equal_windows():
    rng = np.random.default_rng(7)
    for _ in range(50):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[200:350] = data[20:170]
        t = {"doc": np.arange(2), "tag": np.zeros(2, np.uint32), "start": np.zeros(2, np.uint32)}
        w = substrings._windows(data, np.array([0, 200]), np.array([101, 101]), t)
        out = substrings.refined(w)
        seen, want = set(), []
        for d, p in zip([0] * 101 + [1] * 101, [*range(101), *range(101)], strict=True):
            x = data[200 * d + p : 200 * d + p + 100].tobytes()
            want += [(d, p)] if x in seen else []
            seen.add(x)
        assert sorted(zip(out["doc"].tolist(), out["start"].tolist(), strict=True)) == want


# -- lines ------------------------------------------------------------------------------------


def brute_lines(rows, least):
    first, texts = {}, {}
    for doc_id, text, *_ in order(rows):
        if text is not None:
            ls = text.split("\n")
            texts[doc_id, text] = ls
            for i, j in itertools.combinations(range(len(ls) + 1), 2):
                if j - i <= 40:
                    first.setdefault(tuple(ls[i:j]), (doc_id, text, i))
    out = {}
    for (doc_id, text), ls in texts.items():
        gone = set()
        for i, j in itertools.combinations(range(len(ls) + 1), 2):
            if j - i <= 40 and first[tuple(ls[i:j])] != (doc_id, text, i) and sum(len(x.split()) for x in ls[i:j]) >= least:
                gone |= set(range(i, j))
        out[doc_id, text] = (len(ls), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


@pytest.mark.parametrize("least", [1, 10, 25])
def test_lines(docs, rows, least):
    rows = [r for r in rows if r[0] != 84]
    got = lines.remove(docs.filter("doc_id is null or doc_id != 84").withColumn("before", F.col("text")), least).collect()
    want = brute_lines(rows, least)
    assert len(got) == len(rows)
    for r in got:
        if r["before"] is None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
        else:
            assert (r["n_lines"], r["n_removed"], r["text"]) == want[r["doc_id"], r["before"]], r["doc_id"]


def test_lines_between_powers(spark, empty):
    shorts = [f"a{i} b" for i in range(12)]
    texts = ["\n".join(shorts), "x\n" + "\n".join(shorts[2:9]) + "\ny", "\n".join(shorts[4:7]) + "\nz", "q\nq\nq\nq\nq\nq"]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], empty.schema)
    for least in (3, 5, 6, 10, 13):
        want = brute_lines(list(enumerate(texts)), least)
        got = {(r["doc_id"]): (r["n_lines"], r["n_removed"], r["text"]) for r in lines.remove(df, least).collect()}
        assert got == {k[0]: v for k, v in want.items()}, least


def test_lines_of_few_kinds(spark, empty):
    """Blank lines, lines of one to six words, and runs of all lengths that occur again and again."""
    import random

    rng = random.Random(8)
    kinds = ["", "", "a", "b", "c d e", "f g h i j k"]
    texts = ["\n".join(rng.choice(kinds[: rng.choice((2, 4, 6))]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], empty.schema)
    for least in (2, 7):
        want = brute_lines(list(enumerate(texts)), least)
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.remove(df, least).collect()}
        assert got == {k[0]: v for k, v in want.items()}, least


def test_long_equal_texts(spark, empty):
    """A copy of 20,000 lines goes but for its last line."""
    text = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    df = spark.createDataFrame([(1, text, "", "", 0), (2, text + "\nthe end", "", "", 0)], empty.schema)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.remove(df).collect()}
    assert got[1] == (0, text) and got[2] == (20_000, "the end")


def test_ranks_name_runs():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 3, 500).astype(np.uint64)
    for level in range(6):
        named = {}
        for i, x in enumerate(lines.ranks(ids, level).tolist()):
            assert named.setdefault(x, tuple(ids[i : i + (1 << level)])) == tuple(ids[i : i + (1 << level)])
        assert len(set(named.values())) == len(named)
    assert len(lines.ranks(ids[:3], 2)) == 0


def test_shortest_runs_decide():
    """Deleting by all repeated runs and by the shortest ones with enough words is the same."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        words = rng.choice([0, 0, 1, 2, 5], rng.integers(1, 14))
        least, n = int(rng.integers(1, 9)), len(words)
        repeated = np.zeros((n, n + 1), bool)
        for i in range(n):  # a part of a repeated run is repeated
            repeated[i, i + 1 : i + 1 + rng.integers(0, n - i + 1)] = True
        for i in range(n - 1):
            for j in range(i + 2, n + 1):
                if repeated[i, j]:
                    repeated[i + 1, i + 2 : j + 1] = True
        whole, few = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(n):
            for j in range(i + 1, n + 1):
                if repeated[i, j] and words[i:j].sum() >= least:
                    whole[i:j] = True
        for i, k in zip(*lines.shortest(words, least), strict=True):
            if repeated[i, i + k]:
                few[i : i + k] = True
        assert (whole == few).all()


def test_lines_edges(empty, clashing):
    assert lines.remove(empty).count() == 0
    named = clashing.withColumns({f"_{c}": F.lit("mine") for c in ("tag", "doc", "gone", "d", "t", "its_doc", "stays", "lost")})
    out = lines.remove(named)
    assert out.filter("_tag = 'mine' and _lost = 'mine' and _doc = 'mine'").count() == 8
    assert out.columns.count("n_lines") == 1 and out.filter("root = 'mine'").count() == 8


# -- Jaccard ----------------------------------------------------------------------------------


def sets_of(rows):
    out = {}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y, key=lambda k: LAST if k is None else k)] = min(x, y, key=lambda k: LAST if k is None else k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_components(docs, rows):
    want = brute_components(sets_of(rows))
    got = jaccard.cluster(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("short", [64, 1])
def test_a_large_group_of_near_copies(spark, empty, monkeypatch, short):
    """Near copies around the threshold, one common line and chains, through both ways of comparing."""
    import random

    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"e{rng.randint(0, 30)}"
        rows.append((i * 3, " ".join(w)))
    line = " ".join(f"l{i}" for i in range(20))
    rows += [(1000 + i, line + " " + " ".join(f"r{i}.{j}" for j in range(25))) for i in range(40)]
    want = brute_components(sets_of(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.cluster(df).collect()}
    assert got == want
    assert jaccard.cluster(empty).count() == 0


def test_prefixes_share_enough():
    rng = np.random.default_rng(3)
    o = jaccard.Order(rng.integers(1, 5000, 1 << jaccard.ORDER_BITS))
    for _ in range(200):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < 0.93]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, max(0, int(rng.integers(0, 1 + n // 12)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            (pa_, ma), (pb, mb) = o.prefix(a), o.prefix(b)
            shared = len(np.intersect1d(pa_, pb))
            assert shared >= min(ma, mb)
            assert 175 * (shared + max(len(a) - len(pa_), len(b) - len(pb))) >= 75 * (len(a) + len(b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, links.components(edges).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_order_from_slices():
    """One slice of counts is held at a time, and the order is that of the whole array."""
    counts = np.random.default_rng(5).integers(0, 3000, 1 << jaccard.ORDER_BITS).astype(np.uint64)
    slices = np.split(counts, jaccard.ORDER_SLICES)
    tracemalloc.start()
    o = jaccard.Order(x.copy() for x in slices)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # of 64 MB of counts
    assert (o.kinds == np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)).all()
    assert (o.cost == np.maximum(0.0, 2.0 ** (np.arange(256) / 2) - 4 * float(np.median(counts)) - 4)).all()
    for few in ([1, 2, 7, 9], [0, 0, 5, 9], [3, 3, 3, 3]):
        few = np.array(few, np.uint64)
        assert (jaccard.Order(iter(np.split(few, 2))).cost == np.maximum(0.0, 2.0 ** (np.arange(256) / 2) - 4 * float(np.median(few)) - 4)).all()


def test_components_give_memory_back(spark, monkeypatch):
    """Each round lets the driver drop what the round before left."""
    tidied, tidy = [], blocks.tidy
    monkeypatch.setattr(blocks, "tidy", lambda s: tidied.append(len(blocks._written)) or tidy(s))
    first = len(blocks._written)
    links.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).collect()
    written = len(blocks._written) - first - 1  # the links, then two tables a round
    assert written % 2 == 0 and len(tidied) == written // 2


# -- scoring ----------------------------------------------------------------------------------


@pytest.mark.parametrize("hub", [0, 4000])
def test_components_of_a_hub(spark, hub):
    """A node of thousands of links, smallest or largest, with short paths besides."""
    spokes = [x for x in range(1, 3500)]
    pairs = [(hub, x) for x in spokes] + [(5000, 5001), (5001, 5002), (6000, 6000)]
    got = dict(map(tuple, links.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    least = min(hub, 1)
    assert got == {x: least for x in [hub, *spokes]} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_recursions_against_all_paths():
    rng = np.random.default_rng(0)
    k, c = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    seqs = [rng.integers(0, c, n).astype(np.uint16) for n in (1, 4, 2, 6, 4)]
    got = hmm.forward(model, seqs)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    for s, log in zip(seqs, got, strict=True):
        total, paths = 0.0, []
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            total += p
            paths.append((path, p))
        assert log == pytest.approx(math.log(total))
        for path, p in paths:
            start[path[0]] += p / total
            for t, x in enumerate(path):
                emit[x, s[t]] += p / total
                if t:
                    move[path[t - 1], x] += p / total
    a, b, e, log = hmm.expected(model, seqs)
    assert np.allclose(a, start) and np.allclose(b, move) and np.allclose(e, emit) and log == pytest.approx(got.sum())


def test_steps_do_not_lose_likelihood():
    rng = np.random.default_rng(2)
    seqs = [np.where(rng.random(30) < 0.9, rng.integers(0, 5, 30) + 5 * (i % 2), 11).astype(np.uint16) for i in range(40)]
    freq = np.bincount(np.concatenate(seqs), minlength=CLASSES) + 0.5
    freq /= freq.sum()
    model, logs = hmm.Model.random(2, CLASSES, freq), []
    for _ in range(12):
        *counts, log = hmm.expected(model, seqs)
        logs.append(log)
        model = hmm.improved(tuple(counts), freq, weight=0.01)
    assert logs[-1] > logs[0] and all(b > a - 5 for a, b in zip(logs, logs[1:], strict=False))


def test_scores(docs, rows, empty):
    docs = docs.withColumn("held_out", blocks.held_out("doc_id", 1))
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for d, t, *_ in rows]
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6)) for d, ws in tokens)
    out = hmm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert hmm.score(docs.withColumns({c: F.lit("mine") for c in ("chunk", "bucket", "key", "packed", "classes", "within")})).count() == len(rows)
    untrained = hmm.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == len(rows) and all(r["n_known"] == 0 for r in untrained)


def test_scores_of_one_state_are_products_of_shares(docs, rows, monkeypatch):
    """With one state that emits classes by their frequency, a text's score follows from counts alone."""
    monkeypatch.setattr(hmm, "train", lambda encoded, frequency, **_: hmm.Model(np.ones(1), np.ones((1, 1)), frequency[None, :]))
    monkeypatch.setattr(hmm, "TOP", 20)
    monkeypatch.setattr(hmm, "TOP_PER_ROOT", 1)
    monkeypatch.setattr(hmm, "RARE", 7)
    monkeypatch.setattr(hmm, "RARE_PER_ROOT", 0)
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for d, t, *_ in rows]
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    least = max(20, math.isqrt(len(c)))
    counts = sorted((n for w, n in c.items() if w), reverse=True)
    assert len(counts) > least
    if counts[least - 1] == counts[least]:  # which of equally frequent words is taken is by hash: such are not judged
        bound = counts[least]
    else:
        bound = -1
    own = {w for w, n in c.items() if w and n > bound} if bound >= 0 else {w for w, n in c.items() if w and n >= counts[least - 1]}

    size = least + 1 + 7
    total = sum(c.values())
    out = {(r["doc_id"], r["n_tokens"]): r["score"] for r in hmm.score(docs.withColumn("held_out", blocks.held_out("doc_id", 1))).collect()}
    judged = 0
    for d, ws in tokens:
        if all(w is None or w in own for w in ws):
            want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * size)) for w in ws)
            assert out[d, len(ws)] == pytest.approx(want)
            judged += 1
    assert judged >= 3
    assert all(math.isfinite(x) and x < 0 for x in out.values())


def test_training_reads_whole_documents(spark):
    rng = np.random.default_rng(6)
    # the first 2000 tokens of each text are of one kind, the tails of two others
    seqs = [np.concatenate([rng.integers(0, 9, 2000), rng.integers(10, 19, 700) + 10 * (i % 2)]).astype(np.uint16) for i in range(12)]
    freq = np.bincount(np.concatenate(seqs), minlength=CLASSES) + 0.5
    freq /= freq.sum()
    rows = [(i, False, s.tobytes()) for i, s in enumerate(seqs)] + [(99, True, seqs[0][::-1].tobytes())]
    got = hmm.train(spark.createDataFrame(rows, "doc_id long, held_out boolean, classes binary"), freq)
    want, before, n = hmm.Model.random(hmm.STATES, CLASSES, freq), -math.inf, sum(map(len, seqs))
    for _ in range(hmm.STEPS):
        *counts, log = hmm.expected(want, seqs)
        want = hmm.improved(tuple(counts), freq)
        if log - before < hmm.LEAST_GAIN * n:
            break
        before = log
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, docs, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = docs.columns
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        names.append(name)
        if i + 1 < len(pipeline.STAGES):
            assert out.columns == before
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {80, 81, 82, 83} and {r[0] for r in rows if r[3] in ("s0", "s1", "s2", "s3")} <= ids
        if name == "near_duplicates":
            after_lines = sets_of([tuple(r) for r in spark.read.parquet(str(tmp_path / "1")).select("doc_id", "text").collect()])
            comps = brute_components(after_lines)
            assert ids == {k for k, (n, r) in comps.items() if k == r}
            assert kept.filter("doc_id = 88").count() <= 1
    assert names == ["language_id", "line_dedup", "near_duplicates", "pii", "packing"]
    whole = pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(kept)
    assert packing.pack(spark.read.parquet(str(tmp_path / "3"))).count() == kept.count()
    assert hashlib  # imported for fixtures that print digests


def test_stages_keep_the_columns_of_others(clashing):
    """Columns named like those that stages add pass through as they are, also in the stages' own names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    named = clashing.withColumns({n: F.lit("mine") for n in ("_tag", "_kept", "_doc", "_gone", "_d", "_spans", "_shown", "_lang", "_score", "held_0")})
    spark = clashing.sparkSession
    mine = [c for c in named.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, named, "")
        assert out.columns == named.columns, name
        assert out.filter(" or ".join(f"`{c}` <> 'mine' or `{c}` is null" for c in mine)).count() == 0, name
        assert out.count() > 0, name
    assert pipeline.STAGES[-1][1](spark, named, "").count() > 0


def test_an_empty_table_through_the_pipeline(spark, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    kept = empty
    for _, stage in pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.count() == 0
