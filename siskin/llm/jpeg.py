"""Progressive JPEG in numpy: a decoder for media columns and a lossless payload writer.

The decoder accumulates the scans of a file, by spectral selection and successive
approximation, into one coefficient array a component, applies the inverse transform to
all blocks at once in exact integers, repeats chroma samples to full resolution and
returns an RGB tensor.

Samples of a JPEG are lossy, so a payload is stored in the format's own unit, quantized
coefficients, one byte each: byte b becomes the coefficient b if b > 127 else b - 255.
All of these lie in magnitude category 8, whose eight extra bits are the byte itself.
The file has 4:2:0 sampling and eight scans: DC values and each component's AC values
shifted right by one, then the last bits of all. Every AC symbol of such a scan is the
same (no zeros, category 7), so its code table has one code, of one bit.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siskin.llm import blocks

UNIT = 192


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of a scan."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
#: Fraction bits of the two-dimensional inverse transform; sums stay exact in a double.
SCALE = 20


def _inverse() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64) * (1 << SCALE))


INVERSE = _inverse()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    #: Blocks across and down, as non-interleaved scans count them, and as stored.
    wide: int = 0
    high: int = 0
    stored_wide: int = 0
    stored_high: int = 0
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


# -- reading ----------------------------------------------------------------------------


class _Bits:
    """The bits of one entropy-coded segment, after its stuffed zero bytes are gone."""

    def __init__(self, segment: bytes):
        self.raw = segment.replace(b"\xff\x00", b"\xff")
        self.at, self.end = 0, 8 * len(self.raw)
        self._expanded: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._expanded is None:
            self._expanded = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        return self._expanded

    def peek(self, n: int) -> int:
        i = self.at >> 3
        got = int.from_bytes(self.raw[i : i + 4].ljust(4, b"\xff"), "big")
        return got >> (32 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        got = self.peek(n)
        self.at += n
        return got

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return got


class _Codes:
    """A table of prefix codes: by the next 16 bits, the length and the symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length = np.zeros(1 << 16, np.uint8)
        self.symbol = np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                low = code << (16 - size)
                self.length[low : low + (1 << (16 - size))] = size
                self.symbol[low : low + (1 << (16 - size))] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = (int(np.argmax(counts)) + 1, symbols[0]) if k == 1 else None
        self._fast: tuple[list[int], list[int]] | None = None

    def read(self, bits: _Bits) -> int:
        if self._fast is None:
            self._fast = self.length.tolist(), self.symbol.tolist()
        i = bits.at >> 3
        word = int.from_bytes(bits.raw[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (bits.at & 7)) & 0xFFFF
        n = self._fast[0][word]
        if not n or bits.at + n > bits.end:
            raise ValueError("a code is not in the table")
        bits.at += n
        return self._fast[1][word]


@functools.lru_cache(64)
def _codes(counts: bytes, symbols: bytes) -> _Codes:
    """Files of one writer share their tables."""
    return _Codes(counts, symbols)


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Decoder:
    """Coefficients and pixels of one progressive (or baseline) JPEG of 8 bits a sample."""

    def __init__(self, raw: bytes):
        self.raw, self.comments = raw, []
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], _Codes] = {}
        self.restart = 0
        self.scans = 0
        self.components: list[Component] = []
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at + 4 <= len(raw):
            if raw[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = raw[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                self._tables(body)
            elif kind == 0xC4:
                self._code_tables(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body)
            elif kind == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                end = self._segment_end(at)
                self._scan(body, raw[at:end])
                at = end
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("this kind of JPEG is not supported")

    def _segment_end(self, at: int) -> int:
        while True:
            at = self.raw.find(b"\xff", at)
            if at < 0 or at + 1 >= len(self.raw):
                return len(self.raw)
            if self.raw[at + 1] and not 0xD0 <= self.raw[at + 1] <= 0xD7:
                return at
            at += 2

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            got = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
            self.quant[ident] = got.astype(np.int64)
            at += 1 + 64 * (1 + (wide > 0))

    def _code_tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            n = sum(body[at + 1 : at + 17])
            self.codes[body[at] >> 4, body[at] & 15] = _codes(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("only 8 bits a sample are supported")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.wide = -(-(-(-self.width * c.h // self.h)) // 8)
            c.high = -(-(-(-self.height * c.v // self.v)) // 8)
            c.stored_wide, c.stored_high = self.across * c.h, self.down * c.v
            c.values = np.zeros((c.stored_wide * c.stored_high, 64), np.int32)

    def _order(self, chosen: list[Component]) -> list[tuple[int, np.ndarray]]:
        """Component and block of each data unit of a scan, as (which component, block number)."""
        if len(chosen) == 1:
            c = chosen[0]
            return [(0, (np.arange(c.high)[:, None] * c.stored_wide + np.arange(c.wide)[None, :]).ravel())]
        out = []
        row, col = np.divmod(np.arange(self.across * self.down), self.across)
        for i, c in enumerate(chosen):
            for y in range(c.v):
                for x in range(c.h):
                    out.append((i, (row * c.v + y) * c.stored_wide + col * c.h + x))
        return out

    def _scan(self, head: bytes, raw: bytes) -> None:
        self.scans += 1
        chosen, tables = [], []
        for i in range(head[0]):
            chosen.append(next(c for c in self.components if c.ident == head[1 + 2 * i]))
            tables.append((head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15))
        first, last, approx = head[1 + 2 * head[0] : 4 + 2 * head[0]]
        high, low = approx >> 4, approx & 15
        units = self._order(chosen)
        n = len(units[0][1])
        parts, step = [raw], n
        if self.restart:
            import re

            parts, step = re.split(rb"\xff[\xd0-\xd7]", raw), self.restart
        for part, at in zip(parts, range(0, n, step), strict=False):
            bits, span = _Bits(part), range(at, min(n, at + step))
            if first == 0 and last == 0:
                (self._dc_more if high else self._dc)(bits, chosen, tables, units, span, low)
            elif first == 0:
                self._whole(bits, chosen, tables, units, span)
            else:
                (self._ac_more if high else self._ac)(bits, chosen[0], self.codes[1, tables[0][1]], units[0][1][span.start : span.stop], first, last, low)

    def _dc(self, bits, chosen, tables, units, span, low) -> None:
        codes = [self.codes[0, t[0]] for t in tables]
        before, found = [0] * len(chosen), [[] for _ in units]
        for _ in span:
            for j, (i, _blocks) in enumerate(units):
                size = codes[i].read(bits)
                before[i] += _extend(bits.take(size), size)
                found[j].append(before[i])
        for (i, blocks_), got in zip(units, found, strict=True):
            chosen[i].values[blocks_[span.start : span.stop], 0] = np.array(got, np.int32) << low

    def _dc_more(self, bits, chosen, tables, units, span, low) -> None:
        got = bits.many(len(span) * len(units)).reshape(len(span), len(units)).astype(np.int32)
        for j, (i, blocks_) in enumerate(units):
            chosen[i].values[blocks_[span.start : span.stop], 0] |= got[:, j] << low

    def _ac(self, bits, c: Component, codes: _Codes, at: np.ndarray, first: int, last: int, low: int) -> None:
        width = last - first + 1
        if codes.only and codes.only[1] >> 4 == 0 and codes.only[1] & 15:
            # with one code, for no zeros before and a size, all coefficients take the same bits
            code, size = codes.only[0], codes.only[1] & 15
            if code + size == 8 and not bits.at & 7:  # whole bytes
                value = np.frombuffer(bits.raw, np.uint8, len(at) * width, bits.at >> 3).astype(np.int32) & ((1 << size) - 1)
                bits.at += 8 * len(value)
            else:
                got = bits.many(len(at) * width * (code + size)).reshape(-1, code + size)[:, code:]
                value = got.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
            c.values[at, first : last + 1] = (value << low).reshape(len(at), width)
            return
        blocks_, i, run = at.tolist(), 0, 0
        values = c.values
        while i < len(blocks_):
            k, b = first, blocks_[i]
            while k <= last:
                symbol = codes.read(bits)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    k += zeros
                    values[b, k] = _extend(bits.take(size), size) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break
            i += 1 + run
            run = 0

    def _ac_more(self, bits, c: Component, codes: _Codes, at: np.ndarray, first: int, last: int, low: int) -> None:
        values, i, run = c.values, 0, 0
        one = 1 << low
        while i < len(at):
            if run:  # only corrections, for all blocks of the run at once
                part = values[at[i : i + run], first : last + 1]
                known = part != 0
                grow = bits.many(int(known.sum())).astype(np.int32) << low
                part[known] += np.where(part[known] > 0, grow, -grow)
                values[at[i : i + run], first : last + 1] = part
                i, run = i + run, 0
                continue
            b, k = int(at[i]), first
            block = values[b]
            while k <= last:
                symbol = codes.read(bits)
                zeros, size = symbol >> 4, symbol & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        if bits.take(1):
                            block[k] += one if block[k] > 0 else -one
                    elif zeros == 0:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
            if run:  # the rest of this block, then the others
                part = block[k : last + 1]
                known = np.flatnonzero(part)
                grow = bits.many(len(known)).astype(np.int32) << low
                part[known] += np.where(part[known] > 0, grow, -grow)
                run -= 1
            i += 1

    def _whole(self, bits, chosen, tables, units, span) -> None:
        """A baseline scan: all coefficients of each block together."""
        before = [0] * len(chosen)
        for s in span:
            for i, blocks_ in units:
                dc, ac = self.codes[0, tables[i][0]], self.codes[1, tables[i][1]]
                block = chosen[i].values[blocks_[s]]
                size = dc.read(bits)
                before[i] += _extend(bits.take(size), size)
                block[0], k = before[i], 1
                while k < 64:
                    symbol = ac.read(bits)
                    if not symbol:
                        break
                    k += symbol >> 4
                    if symbol & 15:
                        block[k] = _extend(bits.take(symbol & 15), symbol & 15)
                    k += 1

    # -- pixels -------------------------------------------------------------------------

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution."""
        out = []
        for c in self.components:
            natural = np.zeros((len(c.values), 64))
            natural[:, ZIGZAG] = c.values * self.quant[c.table]
            exact = (natural @ INVERSE).astype(np.int64)
            samples = np.clip(((exact + (1 << (SCALE - 1))) >> SCALE) + 128, 0, 255).astype(np.uint8)
            out.append(samples.reshape(c.stored_high, c.stored_wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.stored_high, 8 * c.stored_wide))
        return out

    def tensor(self) -> np.ndarray:
        """Height x width x 3 samples of red, green and blue (one component: three times)."""
        full = [p.repeat(self.v // c.v, 0).repeat(self.h // c.h, 1)[: self.height, : self.width].astype(np.int32) for p, c in zip(self.planes(), self.components, strict=True)]
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        half = 1 << 15
        out = np.empty((*y.shape, 3), np.uint8)  # the usual weights 1.402, 0.344136, 0.714136, 1.772 in 16 bits
        out[..., 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
        out[..., 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        return out


# -- writing ----------------------------------------------------------------------------


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan_marker(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, bits: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([first, last, high << 4 | low])
    return _marker(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values written one after another in so many bits each; ones fill the last byte."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    at = np.repeat(np.arange(len(sizes)), sizes)
    shift = ends[at] - 1 - np.arange(n)
    bits = (values[at] >> shift & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-n % 8, np.uint8)])).tobytes()


#: DC differences are at most 255 in size: nine categories, four bits each.
_DC_CODES = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
#: The one symbol of a first AC scan (category 7), in one bit.
_AC_CODES = bytes([1] + [0] * 15) + bytes([7])
#: Runs of up to 32,767 blocks without a new value, in four bits.
_RUN_CODES = bytes([0, 0, 0, 15] + [0] * 12) + bytes(i << 4 for i in range(15))


def store(payload: bytes) -> bytes:
    """A progressive JPEG, 4:2:0, whose coefficients are the payload's bytes.

    Blocks beyond the payload hold zero bytes; a comment keeps the payload's length.
    """
    units = max(1, -(-len(payload) // 384))
    down = -(-units // 4000)
    across = -(-units // down)
    n = across * down
    data = np.zeros(n * 384, np.int32)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = np.where(data > 127, data, data - 255).reshape(-1, 64)
    parts = [values[: 4 * n], values[4 * n : 5 * n], values[5 * n :]]
    out = [b"\xff\xd8", _marker(0xFE, b"payload %d" % len(payload)), _marker(0xDB, bytes([0]) + bytes([1]) * 64)]
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big")
    out.append(_marker(0xC2, frame + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_marker(0xC4, bytes([0x00]) + _DC_CODES + bytes([0x10]) + _AC_CODES + bytes([0x11]) + _RUN_CODES))
    # DC: four blocks of luminance and one of each chroma a unit, differences by component
    wide = 2 * across
    row, col = np.divmod(np.arange(n), across)
    luma = (np.array([0, 0, 1, 1])[None, :] + 2 * row[:, None]) * wide + np.array([0, 1, 0, 1])[None, :] + 2 * col[:, None]
    dc = np.concatenate([parts[0][luma, 0], parts[1][:, :1], parts[2][:, :1]], 1)
    high = dc >> 1
    diff = np.concatenate([np.diff(high[:, :4].ravel(), prepend=0).reshape(n, 4), np.diff(high[:, 4:], axis=0, prepend=0)], 1).ravel()
    size = np.frexp(np.abs(diff).astype(float))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    out.append(_scan_marker([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _packed(size << size | extra, size + 4)))
    for i, part in enumerate(parts):
        ac = part[:, 1:]
        magnitude = np.abs(ac) >> 1
        out.append(_scan_marker([(i + 1, 0)], 1, 63, 0, 1, np.where(ac > 0, magnitude, 127 - magnitude).astype(np.uint8).tobytes()))
    out.append(_scan_marker([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, np.packbits(np.concatenate([(dc & 1).ravel(), np.ones(-dc.size % 8, np.int32)]).astype(np.uint8)).tobytes()))
    for i, part in enumerate(parts):
        bits = []
        for a in range(0, len(part), 32767):
            last = (np.abs(part[a : a + 32767, 1:]) & 1).astype(np.uint8).ravel()
            run = min(32767, len(part) - a)
            k = run.bit_length() - 1
            word = k << k | run - (1 << k)
            bits += [np.array([word >> j & 1 for j in range(k + 3, -1, -1)], np.uint8), last]
        bits = np.concatenate(bits)
        out.append(_scan_marker([(i + 1, 1)], 1, 63, 1, 0, np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


def payload_of(decoded: Decoder) -> bytes:
    """The bytes that store() was given."""
    told = next(x for x in decoded.comments if x.startswith(b"payload "))
    values = np.concatenate([c.values for c in decoded.components]).ravel()
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()[: int(told[8:])]


def features(tensor: np.ndarray) -> str:
    """Size, mean of each channel and mean step between neighbours, in exact thousandths."""
    high, wide, _ = tensor.shape
    n = high * wide
    means = [int(tensor[..., i].sum(dtype=np.int64)) * 1000 // n for i in range(3)]
    green = tensor[..., 1].astype(np.int16)
    step = int(np.abs(np.diff(green, axis=1)).sum(dtype=np.int64)) * 1000 // max(1, high * (wide - 1))
    return f"{wide}x{high} rgb={means[0]},{means[1]},{means[2]} step={step}"


# -- columns ----------------------------------------------------------------------------


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media, the progressive JPEG of each text's payload, and payload_bytes.

    The payload is the text in UTF-8 (null: empty) and spaces up to a positive multiple
    of 192 bytes. Existing columns of these names are replaced.
    """
    blocks.ship(docs.sparkSession)

    def make():
        def run(rows, data, at):
            raw = [padded(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            return [pa.array([store(x) for x in raw], pa.binary()), [len(x) for x in raw]]

        return run

    return blocks.with_columns(docs, "media binary, payload_bytes long", make, text)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """media with width, height and tensor (RGB, row after row); nulls where a file is null or broken."""
    blocks.ship(media.sparkSession)
    from pyspark.sql import functions as F

    @F.pandas_udf("struct<width: int, height: int, tensor: binary>")
    def tensors(col):
        import pandas as pd

        out = []
        for raw in col:
            try:
                got = Decoder(bytes(raw)).tensor() if raw is not None else None
            except (ValueError, IndexError, KeyError, StopIteration):
                got = None
            out.append((None, None, None) if got is None else (got.shape[1], got.shape[0], got.tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "tensor"])

    kept = media.drop("width", "height", "tensor")
    made = blocks.unused(kept, "made")
    out = kept.withColumn(made, tensors(column))
    return out.select(*kept.columns, f"{made}.width", f"{made}.height", f"{made}.tensor")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blocks.ship(spark)

    def make():
        def run(rows, data, at):
            out = [[] for _ in range(7)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                media = store(padded(data[a:b].tobytes()))
                read = Decoder(media)
                back = payload_of(read)
                made = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(read.tensor()))
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            return out

        return run

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return blocks.with_columns(docs, added, make).drop("text")
