"""Byte-pair encoding of words by a depth-first walk of the trie of distinct words.

A prefix's encoding is the encoding of a shorter prefix and one last token, so a trie
node needs to keep its last token only; words that share a prefix share its states.
The trie of a batch's new words is walked in sorted order: a word keeps the states of
the prefix it shares with the word before it and adds its own.

A token may follow another if merging their bytes gives just these two tokens again.
That is found by undoing merges from the latest to the earliest on both sides of the
seam: no merge over the seam may come earlier than the merge undone.

The text rules are those of a tokenizer file with NFC, white space to one space, lower
case, a split into contractions, letter runs, single numbers and runs of others, bytes
as symbols and a suffix at the end of each word. Special tokens in a text are found
as they are, before the text rules.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siskin.llm import blocks

#: Words whose encodings a worker keeps; it starts anew when they are full.
KEPT_WORDS = 400_000
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Indices of words from here on stand for special tokens.
_MARK = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255]
    symbols = dict.fromkeys(range(256), "")
    symbols |= {i: chr(i) for i in shown}
    for n, i in enumerate(i for i in range(256) if i not in set(shown)):
        symbols[i] = chr(256 + n)
    return [symbols[i] for i in range(256)]


class Codec:
    """Encoder and decoder for one tokenizer file, with the encodings of words seen lately."""

    def __init__(self, path: str, kept: int = KEPT_WORDS, texts: bool = True):
        """kept: words whose encodings are kept; texts: whether their decodings are as well."""
        self.texts = texts
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.path, self.kept, self.end = path, kept, model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        byte = {c: i for i, c in enumerate(_byte_symbols())}
        raw = lambda s: bytes(byte[c] for c in s)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.rank = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.pair: dict[int, int] = {}
        self.shown = [""] * n
        for token, i in vocab.items():
            self.shown[i] = token
        for token, i in self.special.items():
            self.shown[i] = token
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocab[a + b]
            self.rank[whole], self.left[whole], self.right[whole] = r, vocab[a], vocab[b]
            self.pair[vocab[a] << 20 | vocab[b]] = r
        self.follows: dict[int, bool] = {}
        self.self_made: dict[int, bool] = {}
        for token, i in vocab.items():
            if token in self.special or not self._made(i):
                continue
            if token.endswith(self.end) and token != self.end:
                self.final[raw(token[: -len(self.end)])] = i
            else:
                self.inner[raw(token)] = i
        self._automaton()
        self._classes = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))
            if kind[0] == "L":
                self._classes[i] = LETTER
            elif kind[0] == "N":
                self._classes[i] = NUMBER
            elif kind[0] == "Z" or 9 <= i <= 13 or i == 0x85:
                self._classes[i] = SPACE
            elif kind == "Cn":
                self._classes[i] = UNKNOWN
        self._symbols = blocks.numbered(0x110000, 77)
        self._library = None
        self._forget()

    # -- merges -------------------------------------------------------------------------

    def _seam(self, a: int, b: int, limit: int) -> bool:
        """No merge over the seam of a and b comes before both are whole, or before limit."""
        while True:
            m = self.pair.get(a << 20 | b)
            if m is not None and m < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:  # undone first, as it was made last
                limit, a = ra, self.right[a]
            elif rb < 0:
                return True
            else:  # of equal merges the left one was made first
                limit, b = rb + 1, self.left[b]

    def _made(self, token: int) -> bool:
        """The token's own bytes encode to the token."""
        todo = [token]
        while todo:
            t = todo[-1]
            if t in self.self_made:
                todo.pop()
            elif self.rank[t] < 0:
                self.self_made[todo.pop()] = True
            else:
                parts = (self.left[t], self.right[t])
                missing = [x for x in parts if x not in self.self_made]
                if missing:
                    todo += missing
                else:
                    self.self_made[t] = all(self.self_made[x] for x in parts) and self._seam(*parts, self.rank[t])
        return self.self_made[token]

    def _may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) > 500_000:
                self.follows.clear()
            got = self.follows[key] = self._seam(a, b, 1 << 30)
        return got

    # -- trie ---------------------------------------------------------------------------

    def _automaton(self) -> None:
        """All tokens that end at a byte, longest first, by one step a byte from state to state."""
        child: dict[int, int] = {}
        own_inner, own_final, depth = [-1], [-1], [0]
        for tokens, own in ((self.inner, own_inner), (self.final, own_final)):
            for token, i in tokens.items():
                at = 0
                for byte in token:
                    to = child.get(at << 8 | byte)
                    if to is None:
                        to = child[at << 8 | byte] = len(depth)
                        own_inner.append(-1)
                        own_final.append(-1)
                        depth.append(depth[at] + 1)
                    at = to
                own[at] = i
        self._step = child
        fail = [0] * len(depth)
        self._inner_ends: list[tuple] = [()] * len(depth)
        self._final_ends: list[tuple] = [()] * len(depth)
        for key, to in sorted(child.items(), key=lambda x: depth[x[1]]):
            at, byte = key >> 8, key & 255
            if at:
                f = fail[at]
                while f and f << 8 | byte not in child:
                    f = fail[f]
                fail[to] = child.get(f << 8 | byte, 0)
            for own, ends in ((own_inner, self._inner_ends), (own_final, self._final_ends)):
                below = ends[fail[to]]
                ends[to] = ((own[to], depth[to]), *below) if own[to] >= 0 else below
        self._fail, self._trie = fail, dict(child)

    def _next(self, state: int, byte: int) -> int:
        """Where the automaton goes; steps over fail links are noted as steps."""
        at, trie = state, self._trie
        while at and at << 8 | byte not in trie:
            at = self._fail[at]
        to = trie.get(at << 8 | byte, 0)
        if len(self._step) > len(trie) + 200_000:
            self._step = dict(trie)
        self._step[state << 8 | byte] = to
        return to

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words, by one walk of their trie."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        may, follows, ends, finals = self._may_follow, self.follows, self._inner_ends, self._final_ends
        # of each prefix on the path from the root: automaton state, last token, its length
        state, last, width = [0], [0], [0]
        before = b""
        for at in order:
            word = words[at]
            n = len(word)
            shared, most = 0, min(n - 1, len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :], width[shared + 1 :]
            step, now = self._step, state[shared]
            for i in range(shared + 1, n):
                byte = word[i - 1]
                to = step.get(now << 8 | byte)
                now = self._next(now, byte) if to is None else to
                for t, k in ends[now]:
                    if k == i:
                        break
                    got = follows.get(last[i - k] << 20 | t)
                    if got or got is None and may(last[i - k], t):
                        break
                else:
                    raise ValueError("a byte is missing in the vocabulary")
                state.append(now)
                last.append(t)
                width.append(k)
            to = step.get(now << 8 | word[n - 1])
            for t, k in finals[self._next(now, word[n - 1]) if to is None else to]:
                if k == n:
                    break
                got = follows.get(last[n - k] << 20 | t)
                if got or got is None and may(last[n - k], t):
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
            ids, i = [t], n - k
            while i:
                ids.append(last[i])
                i -= width[i]
            ids.reverse()
            out[at] = ids
            before = word
        return out

    # -- words seen -----------------------------------------------------------------------

    def _forget(self) -> None:
        bits = max(10, (2 * self.kept).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._vals = np.zeros(1 << bits, np.int32)
        self.ids = np.zeros(1 << 12, np.uint32)
        self.ptr = np.zeros(1 << 10, np.int64)
        self.known = 0
        self.text: list[str] = []

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        out = np.full(len(names), -1, np.int32)
        left = np.arange(len(names))
        slot = (names >> self._shift).astype(np.int64)
        while len(left):
            keys = self._keys[slot]
            hit = keys == names[left]
            out[left[hit]] = self._vals[slot[hit]]
            on = ~hit & (keys != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out

    def _add(self, names: np.ndarray, encoded: list[list[int]]) -> None:
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((x for e in encoded for x in e), np.uint32, int(lens.sum()))
        start = int(self.ptr[self.known])
        while len(self.ids) < start + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ptr) < self.known + len(names) + 1:
            self.ptr = np.concatenate([self.ptr, np.zeros_like(self.ptr)])
        self.ids[start : start + len(flat)] = flat
        self.ptr[self.known + 1 : self.known + len(names) + 1] = start + np.cumsum(lens)
        if self.texts:
            shown = self.shown
            self.text += [" ".join([shown[x] for x in e]) for e in encoded]
        left, slot = np.arange(len(names)), (names >> self._shift).astype(np.int64)
        while len(left):
            free = self._keys[slot] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self._keys[slot[take]] = names[left[take]]
            self._vals[slot[take]] = self.known + left[take]
            on = ~take
            left, slot = left[on], np.where(free[on], slot[on], (slot[on] + 1) & (len(self._keys) - 1))
        self.known += len(names)

    # -- texts ------------------------------------------------------------------------------

    def _library_words(self, text: str) -> list[str]:
        """Words of a text with characters newer than this Python's tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        low = self._library.normalizer.normalize_str(text)
        return [low[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(low)]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
        """Names of the words of texts without special tokens, each text's bounds among them, and the words.

        Words are told by an index: word(index) is the string.
        """
        low = [(x if unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x)).replace("Σ", "σ").lower() for x in texts]
        joined = "\n".join([*low, ""])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._classes[chars]
        odd: dict[int, list[str]] = {}
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])]).astype(np.int64)
        if (kinds == UNKNOWN).any():
            for i in np.unique(np.searchsorted(at, np.flatnonzero(kinds == UNKNOWN), "right") - 1):
                odd[int(i)] = self._library_words(texts[i])
                kinds[at[i] : at[i + 1]] = SPACE
        solid = kinds != SPACE
        edge = np.empty(len(kinds) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        starts, ends = np.flatnonzero(solid & edge[:-1]), np.flatnonzero(solid & edge[1:]) + 1
        quotes = np.flatnonzero(chars[starts] == 39)
        quotes = quotes[(ends[quotes] - starts[quotes] == 1) & (kinds[ends[quotes]] == LETTER)] if len(quotes) else quotes
        if len(quotes):
            gone = np.zeros(len(starts), bool)
            for q in quotes:  # the word after a lone quote gives up the letters of a contraction
                tail = joined[starts[q + 1] : min(ends[q + 1], starts[q + 1] + 2)]
                k = 1 if tail[:1] in ("s", "t") else 2 if tail in ("re", "ve", "ll") else 1 if tail[:1] in ("m", "d") else 0
                if k:
                    ends[q] += k
                    starts[q + 1] += k
                    gone[q + 1] = starts[q + 1] == ends[q + 1]
            starts, ends = starts[~gone], ends[~gone]
        names = blocks.Spans(self._symbols[chars], 78).hash(starts, ends) | np.uint64(1)
        bounds, index = np.searchsorted(starts, at), np.arange(len(starts))
        listed = [w for words in odd.values() for w in words]
        if odd:  # such a text has no word so far: its own go where it stands
            places = np.repeat([bounds[i] for i in odd], [len(w) for w in odd.values()])
            names = np.insert(names, places, self._listed(listed))
            index = np.insert(index, places, -1 - np.arange(len(listed)))
            sizes = np.diff(bounds)
            sizes[list(odd)] = [len(w) for w in odd.values()]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        return names, bounds, index, lambda i: joined[starts[i] : ends[i]] if i >= 0 else listed[-1 - i]

    def _listed(self, words: list[str]) -> np.ndarray:
        """Names of words."""
        if not words:
            return np.zeros(0, np.uint64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(x) for x in words])
        return blocks.Spans(self._symbols[chars], 78).hash(np.concatenate([[0], ends[:-1]]), ends) | np.uint64(1)

    def _numbers(self, names: np.ndarray, encoded) -> np.ndarray:
        """The number of each name; encoded(places) gives the ids of those that are new.

        Numbers hold until the next call, which may start anew.
        """
        out = self._find(names)
        new = np.flatnonzero(out < 0)
        if len(new):
            own, first = np.unique(names[new], return_index=True)
            if self.known and self.known + len(own) > self.kept:
                self._forget()
                return self._numbers(names, encoded)
            if 2 * (self.known + len(own)) > len(self._keys):  # one slice with more words than are kept
                self.kept = 2 * (self.known + len(own))
                self._forget()
                return self._numbers(names, encoded)
            self._add(own, encoded(new[first]))
            out[new] = self._find(names[new])
        return out

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts and each text's bounds among them; special tokens count as words."""
        owner, pieces = np.arange(len(texts)), texts
        if any(s in x for x in texts for s in self.special):
            cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            parts = [cut.split(x) for x in texts]
            owner, pieces = np.repeat(owner, [len(p) for p in parts]), [x for p in parts for x in p]
        marks = np.flatnonzero([x in self.special for x in pieces])
        names, bounds, index, word = self._words(["" if x in self.special else x for x in pieces])
        sizes = np.diff(bounds)
        if len(marks):
            ids = np.array([self.special[pieces[i]] for i in marks], np.int64)
            names = np.insert(names, bounds[marks], (np.uint64(0xABCD) << np.uint64(40)) + (ids.astype(np.uint64) << np.uint64(1)))
            index = np.insert(index, bounds[marks], _MARK + ids)
            sizes[marks] = 1

        def encoded(places: np.ndarray) -> list[list[int]]:
            told = index[places].tolist()
            plain = iter(self.encode_words([word(i).encode("utf-8", "surrogatepass") for i in told if i < _MARK]))
            return [[i - _MARK] if i >= _MARK else next(plain) for i in told]

        total = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        return self._numbers(names, encoded), np.concatenate([[0], np.cumsum(total)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts, one after another, and each text's bounds among them."""
        return self.tokens(*self.numbers(texts))

    def tokens(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.ptr[numbers]
        sizes = self.ptr[numbers + 1] - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[bounds]

    def decode(self, ids) -> str:
        """The tokens' strings, a space between."""
        return " ".join([self.shown[i] for i in ids])


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, texts: bool = False) -> Codec:
    """This worker's codec; it stays for later tasks."""
    if (path, texts) not in _codecs:
        _codecs[path, texts] = Codec(path, texts=texts)
    return _codecs[path, texts]


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with token_ids, array<int>; null texts count as empty and have no token.

    An existing column token_ids is replaced. Repeated rows are kept.
    """
    path = path or default_path()
    blocks.ship(docs.sparkSession)

    def make():
        use = codec(path)

        def run(rows, data, at):
            ids, bounds = use.encode(blocks.texts_of(rows, text))
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))]

        return run

    return blocks.with_columns(docs, "token_ids array<int>", make, text)


def decode(docs: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """docs with decoded, the tokens' strings with a space between (null ids: empty)."""
    path = path or default_path()
    blocks.ship(docs.sparkSession)
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(col):
        use = codec(path)
        return col.map(lambda x: "" if x is None else use.decode(x))

    return docs.withColumn("decoded", decoded(ids))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each text's encoding and of its decoding."""
    path = path or default_path()
    blocks.ship(docs.sparkSession)

    def make():
        use = codec(path, True)

        def run(rows, data, at):
            numbers, bounds = use.numbers(blocks.texts_of(rows))
            ids, ends = use.tokens(numbers, bounds)
            raw = memoryview(ids.astype("<u4").tobytes())
            shown = use.text
            sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            told = [hashlib.sha256(" ".join([shown[x] for x in numbers[a:b].tolist()]).encode()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return [np.diff(ends), sha, told]

        return run

    return blocks.with_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

