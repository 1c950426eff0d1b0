"""Personal data: base rules, and candidates that boosted trees accept or reject.

Base spans come from four fixed rules and always stay. High-recall generators propose
further, overlapping spans: obfuscated addresses, phone numbers without a country code,
cards and addresses with unusual separators. Format and context features of every
candidate go through gradient-boosted trees; a calibrated threshold for each kind
selects, and of overlapping accepted spans the likeliest stays.

The trees are trained on the driver from labelled candidates that `examples` writes out
of format templates and look-alikes (dates, versions, prices, order numbers, digests).
Their number is a parameter; nothing of the corpus is used.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.llm import blocks

KINDS = ("email", "ip", "card", "phone")
#: Labelled examples the trees are trained on, and the share held back for calibration.
EXAMPLES, HELD_BACK = 18_000, 0.3
#: Candidates whose features are held at once.
JUDGED = 20_000

Span = tuple[str, int, int]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed start inside a run of digits fails at all its later digits too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed rules, by start, then by kind as listed."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- candidates ---------------------------------------------------------------------------

_NUMBERS = re.compile(r"[0-9]++(?:[ ().\-/]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_HIDDEN_AT = re.compile(r"\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?|\s(?:at|AT)\s")
_HIDDEN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{1,63}){1,4}")
_WIDE_AT = re.compile(r"[^\s@<>()\[\]{}\"',;:]{1,64}@[^\s@<>()\[\]{}\"',;:]{1,253}")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][ ().\-/]{1,2}$"), re.compile(r"[ ().\-/]{1,2}[0-9]")
_BRACKETED = re.compile(r"[(\[{]\s?(?:at|AT|@)\s?[)\]}]")
_LAST_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_HINTS = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|from|adress", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|iban|pay", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|ruf|appel|llam|\bph\b", re.I),
}
_AGAINST = re.compile(r"order|invoice|version|isbn|issn|ref|serial|number|\bno\b|#|token|hash|id\b|\$|€|=|page", re.I)
_DATE = re.compile(r"(?:19|20)\d\d[-/.](?:0?\d|1[0-2])[-/.]\d|[0-3]?\d[-/.][01]?\d[-/.](?:19|20)\d\d")
_GROUPS = re.compile(r"\d+")


def candidates(text: str) -> Iterator[Span]:
    """Proposed spans; every run of neighbouring groups of digits may be proposed, as several kinds."""
    if "@" in text:
        yield from (("email", m.start(), m.end() - (m[0][-1] in ".!?")) for m in _WIDE_AT.finditer(text))
    if "at" in text or "AT" in text or "@" in text:  # as every form of _HIDDEN_AT has
        for m in _HIDDEN_AT.finditer(text):
            before, after = _LAST_LOCAL.search(text, max(0, m.start() - 64), m.start()), _HIDDEN_HOST.match(text, m.end())
            if before and after:
                yield "email", before.start(), after.end()
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() < 7:
                continue
            groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
            for i, (start, _) in enumerate(groups):
                first = start - (text[start - 1 : start] in ("+", "("))
                digits, longest = 0, 0
                for n, (a, b) in enumerate(groups[i : i + 19], 1):  # a group has a digit at least
                    digits, longest = digits + b - a, max(longest, b - a)
                    if digits > 19:
                        break
                    if 7 <= digits <= 15:
                        yield "phone", first, b
                    if 12 <= digits:
                        yield "card", first, b
                    if n == 4 and 7 <= digits and longest <= 3:
                        yield "ip", first, b


FEATURES = 38


def features(text: str, span: Span) -> list[float]:
    """Format of the span and words around it, as numbers."""
    kind, start, end = span
    inside = text[start:end]
    before, after = text[max(0, start - 28) : start], text[end : end + 12]
    parts = _GROUPS.findall(inside)
    digits = "".join(parts)
    sizes = [len(p) for p in parts] or [0]
    left, right = before[-1:], after[:1]
    near = [bool(_HINTS[k].search(before)) for k in KINDS]
    host = inside.rpartition("@")[2] if "@" in inside else inside
    return [
        *(float(kind == k) for k in KINDS),
        len(inside), len(digits), len(parts), max(sizes), min(sizes), sizes[0], sizes[-1],
        inside.count(" "), inside.count("-"), inside.count("."), inside.count("/"),
        float("(" in inside and ")" in inside), float(inside[:1] == "+"), float(inside[:1] == "0"), float(inside[:2] == "00"),
        float(bool(digits) and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")),
        float(all(map(_small, parts)) if len(parts) == 4 else 0),
        float(left.isalnum() or left in ("_", "=", '"', "#", "$")), float(right.isalnum() or right in ("_", '"', "%")),
        float(left in (".", "-", "/") or right in ("-", "/")),
        *(float(x) for x in near),
        float(bool(_AGAINST.search(before))), float(bool(_AGAINST.search(before[-12:]))), float(bool(_DATE.search(inside))),
        float(len(set(inside) & set(" -./")) > 1), float(len(re.findall(r"(?:\.|dot)", host, re.I))),
        float(bool(re.search(r"[A-Za-z]{2,12}$", inside))), float(bool(_BRACKETED.search(inside))),
        float(bool(_DIGIT_BEFORE.search(before[-3:]))), float(bool(_DIGIT_AFTER.match(after))),
    ]


# -- trees --------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted regression trees of equal depth over binned features, with logistic loss."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(f):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), start)
    inner = (1 << depth) - 1
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            node, best = at - first, np.full(n, 1e-9)
            total_g, total_h = np.bincount(node, g, n), np.bincount(node, h, n)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * (len(e) + 1) + binned[:, j]
                left_g = np.bincount(key, g, n * (len(e) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                left_h = np.bincount(key, h, n * (len(e) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                gain = left_g**2 / (left_h + penalty) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + penalty) - (total_g**2 / (total_h + penalty))[:, None]
                k = gain.argmax(1)
                got = gain[np.arange(n), k]
                better = got > best
                best[better] = got[better]
                feature[first : first + n][better] = j
                cut[first : first + n][better] = e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Trees(*(np.stack(t) for t in zip(*trees, strict=True)), start)


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float) -> dict[str, float]:
    """Fit a logistic curve to margins held back; the least threshold of each kind that is precise enough."""
    m = trees.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]], [((y - p) * m).sum(), (y - p).sum()])
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    trees.slope, trees.offset = float(max(a, 1e-3)), float(b)
    p, out = trees.probability(x), {}
    for i, kind in enumerate(KINDS):
        mine = x[:, i] == 1
        order = np.argsort(-p[mine])
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        out[kind] = max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.0
    return out


# -- examples -----------------------------------------------------------------------------


def examples(n: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n candidates written by templates, positive and look-alike."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    low = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    byte = lambda: str(rng.randint(0, 255))
    filler = lambda: " ".join(low(2, 9) for _ in range(rng.randint(1, 5)))

    def card(sep: str) -> str:
        body = rng.choice("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        upper, outer, inner = rng.random() < 0.3, rng.choice(["", " "]), rng.choice(["", "", " "])
        word = lambda w: w.upper() if upper else w
        bracketed = lambda w: outer + rng.choice(["({})", "[{}]", "{{{}}}"]).format(inner + w + inner) + outer
        if rng.random() < 0.2:
            dot, at = f" {word('dot')} ", f" {word('at')} "
        else:
            dot, at = rng.choice([".", bracketed(word("dot")), bracketed("."), f" {word('dot')} "]), bracketed(rng.choice([word("at"), word("at"), "@"]))
        return low(2, 9) + rng.choice(["", ".", "_"]) + low(1, 8) + at + low(2, 9) + dot + rng.choice(["com", "org", "net", "de", "fr", "es", "co" + dot + "uk"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.choice(['49', '33', '34', '44'])} {num(3)} {num(7)}", f"0{num(2)} {num(4)} {num(4)}", f"1-{a}-{b}-{c}", f"0{num(3)}/{num(7)}"])

    words = {"email": ["mail", "e-mail:", "contact", "write to", "reach me at"], "ip": ["ip", "host", "from server", "login from"], "card": ["card", "visa", "credit card no", "pay with"], "phone": ["tel", "phone:", "call", "fax", "mobile"]}
    positive = {"email": email, "ip": lambda: rng.choice([". ", " .", "-"]).join(byte() for _ in range(4)) if rng.random() < 0.3 else ".".join(byte() for _ in range(4)), "card": lambda: card(rng.choice(["", " ", "-", ".", "  "])), "phone": phone}

    def negative(kind: str) -> str:
        return {
            "email": lambda: rng.choice([f"{low(2, 8)} at {low(3, 8)}. {low(2, 8)}", f"{low(2, 6)} at {low(3, 8)}.{low(2, 6)}", f"{low(1, 3)}@{num(2)}", f"@{low(3, 8)}", f"{low(2, 4)}@{low(3, 8)}", f"{num(1)}@{num(2)}.{num(2)}"]),
            "ip": lambda: rng.choice([f"{rng.randint(1990, 2030)}.{num(1)}.{num(2)}.{num(2)}", f"{num(1)}-{num(1)}-{num(2)}-{num(2)}", f"{rng.randint(256, 999)}.{byte()}.{byte()}.{byte()}", f"{num(2)}/{num(2)}/{num(2)}/{num(1)}", f"{num(1)} {num(2)} {num(3)} {num(3)}"]),
            "card": lambda: rng.choice([num(rng.randint(12, 19)), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(6)}-{num(6)}", f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(5)}.{num(12)}"]),
            "phone": lambda: rng.choice([f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2030)}", num(rng.randint(7, 15)), f"{num(4)}.{num(5)}", f"{num(3)} {num(3)} {num(3)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"{num(8)}-{num(4)}", f"{num(16)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}"]),
        }[kind]()

    beside = lambda: rng.choice([phone, phone, lambda: card(rng.choice([" ", "-"])), lambda: negative("phone"), lambda: num(rng.randint(1, 6))])()
    rows, labels = [], []
    while len(rows) < n:
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        core = positive[kind]() if good else negative(kind)
        lead = filler() + " "
        if rng.random() < 0.2:  # what is said of another number before says little of this one
            lead = rng.choice(["order", "invoice no", "ref", "id", "serial", "page"]) + " " + num(rng.randint(2, 9)) + rng.choice([", ", ". ", "\n"]) + lead
        if rng.random() < 0.4:
            lead += rng.choice(words[kind] if good or rng.random() < 0.2 else ["order", "invoice no", "version", "isbn", "ref", "id", "serial", "page", "token =", "$"]) + " "
        if not good and rng.random() < 0.15:
            lead += rng.choice(["#", "$", "v", "=", '"'])
        if rng.random() < 0.25:  # another number stands before it, or after it
            lead += beside() + rng.choice([" ", " ", ", "])
        tail = rng.choice([" ", ". ", ", ", "\n", "*** ", "!! "])
        if rng.random() < 0.25:
            tail = rng.choice([" ", " ", ", "]) + beside() + tail
        text = lead + core + tail + filler()
        a, b = len(lead), len(lead) + len(core)
        found = [c for c in candidates(text) if c[1] < b and c[2] > a]
        whole = [c for c in found if c[0] == kind and abs(c[1] - a) <= 1 and abs(c[2] - b) <= 1]
        for c in found:  # a part of a number, or one with its neighbour, is none
            rows.append(features(text, c))
            labels.append(float(good and c in whole[:1]))
    return np.array(rows[:n]), np.array(labels[:n])


@dataclass
class Model:
    trees: Trees
    least: dict[str, float]


def train(n: int = EXAMPLES, seed: int = 7, precision: float = 0.995) -> Model:
    x, y = examples(n, seed)
    held = np.random.default_rng(seed).random(len(y)) < HELD_BACK
    trees = boost(x[~held], y[~held])
    return Model(trees, calibrate(trees, x[held], y[held], precision))


# -- columns ------------------------------------------------------------------------------


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans of each text, and all its spans."""
    base: list[list[Span]] = []
    rows: list[list[float]] = []
    waiting: list[tuple[int, Span]] = []
    accepted: list[tuple[float, int, Span]] = []

    def judge() -> None:
        for p, (i, c) in zip(model.trees.probability(np.array(rows)).tolist() if rows else [], waiting, strict=True):
            if p >= model.least[c[0]]:
                accepted.append((p, i, c))
        rows.clear()
        waiting.clear()

    for i, text in enumerate(texts):
        mine = base_spans(text)
        base.append(mine)
        starts = sorted((s, e) for _, s, e in mine)
        reach = np.maximum.accumulate([e for _, e in starts]).tolist() if starts else []
        for c in candidates(text):
            k = bisect_right(starts, (c[2] - 1, 1 << 62))
            if not k or reach[k - 1] <= c[1]:  # it meets no base span
                rows.append(features(text, c))
                waiting.append((i, c))
                if len(rows) == JUDGED:
                    judge()
    judge()
    added: dict[int, list[Span]] = {}
    for _, i, c in sorted(accepted, key=lambda x: -x[0]):
        mine = added.setdefault(i, [])  # by start, and none overlaps another
        at = bisect_right(mine, c[1], key=lambda s: s[1])
        if (not at or mine[at - 1][2] <= c[1]) and (at == len(mine) or c[2] <= mine[at][1]):
            mine.insert(at, c)
    return [(b, sorted(b + added.get(i, []), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for i, b in enumerate(base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(docs: DataFrame, added: str, shape, model: Model | None, text: str) -> DataFrame:
    spark = docs.sparkSession
    blocks.ship(spark)
    sent = spark.sparkContext.broadcast(model or train())

    def make():
        def run(rows, data, at):
            texts = blocks.texts_of(rows, text)
            return [list(c) for c in zip(*(shape(t, b, a) for t, (b, a) in zip(texts, find(texts, sent.value), strict=True)), strict=True)]

        return run

    return blocks.with_columns(docs, added, make, text)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each stretch of overlapping spans replaced by the first one's kind, as <EMAIL>."""
    out, at = [], 0
    end = -1
    for kind, a, b in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = end = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None, text: str = "text", spans: str = "pii_spans", shown: str = "pii_text") -> DataFrame:
    """docs with pii_spans and pii_text; a null or empty text has no span and stays as it is.

    Existing columns of these names (spans and shown give others) are replaced; positions
    count code points. Of overlapping accepted candidates the likeliest stays, of equally
    likely ones the one proposed first. Repeated rows are kept.
    """
    out = _found(docs, f"{spans} string, {shown} string", lambda t, b, a: (joined(a), redacted(t, a) if a else t), model, text)
    return out.withColumn(shown, F.when(F.col(text).isNotNull(), F.col(shown)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data in text replaced, and the columns of docs otherwise as they are.

    Null and empty texts stay; n_chars, where docs has it, is counted anew for changed texts.
    """
    spans, shown = blocks.unused(docs, "spans"), blocks.unused(docs, "shown")
    out = redact(docs, spans=spans, shown=shown).withColumn("text", F.col(shown))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans) != "", F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def shape(text, base, spans):
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _found(docs, added, shape, None, "text").drop("text")
