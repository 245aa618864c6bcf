"""Lossless WebP: a decoder for the whole format, an encoder, and media columns made with them.

Pixels are uint8 arrays [height, width, 4] in the order red, green, blue, alpha."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
HASH = 0x1E35A7BD
#: Offsets of the 120 short distance codes: the places before a pixel up to 7 rows up, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
NEAR_X, NEAR_Y = np.array(NEAR).T
#: Pixels coded or decoded at once by the array paths; a multiple of 8, so that runs end on whole bytes.
RUN = 1 << 18
#: Pixels of images that are coded together, and of those that are decoded together.
WRITTEN, READ = 1 << 17, 1 << 18
#: Bytes that the decoder looks up at once.
SPAN = 1 << 12
#: The 15 bits of each number in the other order.
TURNED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint32)


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the image ends too early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


    def window(self, n: int) -> int:
        """The next n bits, zeros past the end, without moving on."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + n // 8 + 2], "little") >> (self.at & 7)


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.bytes(), np.uint8), bitorder="little")[: self.size]

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = {s: n for s, n in lengths.items() if n}
        self.single = next(iter(self.lengths)) if len(self.lengths) == 1 else None
        symbols, sizes = np.array([*self.lengths], int), np.array([*self.lengths.values()], int)
        order = np.lexsort((symbols, sizes))
        self.symbols, self.sizes = symbols[order], sizes[order]
        self.most = 0 if self.single is not None else int(max(sizes, default=0))
        #: Bits of every symbol if all have as many.
        self.fixed = 0 if self.single is not None else self.most if len(set(self.lengths.values())) == 1 else None
        if self.single is None:
            room = np.left_shift(1, self.most - self.sizes)
            if not self.lengths or self.most > 15 or room.sum() != 1 << self.most:
                raise ValueError("a prefix code is not complete")
            self.numbers = (np.cumsum(room) - room) >> (self.most - self.sizes)
        else:
            self.numbers = np.zeros(1, int)
        self._entries: np.ndarray | None = None
        self._written: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def codes(self) -> dict[int, int]:
        return dict(zip(self.symbols.tolist(), self.numbers.tolist(), strict=True))

    def entries(self) -> np.ndarray:
        """By the next ``most`` bits: the symbol above 6 bits with its length."""
        if self._entries is None:
            each = self.symbols << 6 | self.sizes * (self.single is None)
            table = np.repeat(each, np.left_shift(1, self.most - self.sizes) if self.single is None else 1)
            self._entries = table[TURNED[: 1 << self.most] >> np.uint32(15 - self.most)]
        return self._entries

    def read(self, bits: Bits) -> int:
        e = int(self.entries()[bits.window(16) & (1 << self.most) - 1])
        bits.read(e & 63)
        return e >> 6

    def written(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """By symbol, below ``size``: its code as it lies in the stream, first bit lowest, and its length."""
        if size in self._written:
            return self._written[size]
        to, n = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        if self.single is None:
            to[self.symbols] = TURNED[self.numbers << (15 - self.sizes)]
            n[self.symbols] = self.sizes
        self._written[size] = to, n
        return to, n


@lru_cache(maxsize=4096)
def simple_code(first: int, second: int) -> Code:
    return Code({first: 1, second: 1})


@lru_cache(maxsize=256)
def code_of(lengths: bytes) -> Code:
    """Codes do not change, and copies of a text share theirs."""
    return Code(dict(enumerate(lengths)))


#: Stored codes met in this process by alphabet and first bits: their number of bits, the bits, the code.
_MET: dict[tuple[int, int], list[tuple[int, int, Code]]] = {}


def read_code(bits: Bits, alphabet: int) -> Code:
    """The next stored code. One that was met before is known by all of its bits and not parsed again."""
    if bits.window(1) & 1:
        return parse_code(bits, alphabet)
    window = bits.window(14 * alphabet + 64)
    met = _MET.setdefault((alphabet, window & (1 << 128) - 1), [])
    for n, stored_bits, code in met:
        if window & (1 << n) - 1 == stored_bits:
            bits.read(n)
            return code
    begin = bits.at
    code = parse_code(bits, alphabet)
    n = bits.at - begin
    if len(_MET) > 500:
        _MET.clear()
    met.append((n, window & (1 << n) - 1, code))
    return code


def parse_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return simple_code(first, bits.read(8) if two else first)
    stored_lengths = bytearray(19)
    for i in range(4 + bits.read(4)):
        stored_lengths[LENGTH_ORDER[i]] = bits.read(3)
    meta = code_of(bytes(stored_lengths))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # at most 7 bits and 7 more a length: a window over them all is one number that is shifted as it is read
    window, at = bits.window(14 * alphabet + 64), 0
    table, mask = meta.entries().tolist(), (1 << meta.most) - 1
    out = bytearray()
    last = 8
    while len(out) < alphabet and most:
        most -= 1
        e = table[window & mask]
        s, n = e >> 6, e & 63
        window >>= n
        at += n
        if s < 16:
            out.append(s)
            last = s or last
        else:
            n = (2, 3, 7)[s - 16]
            out += bytes((last if s == 16 else 0,)) * ((window & (1 << n) - 1) + (3, 3, 11)[s - 16])
            window >>= n
            at += n
    bits.read(at)
    if len(out) > alphabet:
        raise ValueError("too many code lengths")
    return code_of(bytes(out))


def prefix_value(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


class Coded(NamedTuple):
    """An entropy-coded image whose codes are read: for an image of several groups of codes, blocks of 2^block pixels a side have
    their group."""

    bits: Bits
    width: int
    total: int
    cache_bits: int
    codes: list[list[Code]]
    block: int
    group: list[int] | None


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB numbers."""
    return read_pixels(read_codes(bits, width, height, main))


def read_codes(bits: Bits, width: int, height: int, main: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, group = 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        group = (read_image(bits, across, -(-height >> block)) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(max(group) + 1 if group else 1)]
    return Coded(bits, width, width * height, cache_bits, codes, block, group)


def is_fixed(image: Coded) -> bool:
    """Whether the places of all bits are known: one group, no cache or references, codes of one length each."""
    green, *others = image.codes[0][:4]
    return image.group is None and not image.cache_bits and all(c.fixed is not None for c in (green, *others)) and max(green.lengths) < LITERALS


def read_pixels(image: Coded) -> np.ndarray:
    bits, width, total, cache_bits, codes, block, group = image
    if is_fixed(image):
        return read_fixed(bits, tuple(codes[0][:4]), total)
    if group is None:
        return read_tokens(bits, codes[0], width, total, cache_bits)
    across = -(-width >> block)
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, i, fed = 32 - cache_bits, 0, 0
    while i < total:
        g, r, b, a, d = codes[group[(i // width >> block) * across + (i % width >> block)]]
        s = g.read(bits)
        if s < LITERALS:
            red, blue = r.read(bits), b.read(bits)
            out[i] = a.read(bits) << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < LITERALS + LENGTHS:
            length = prefix_value(bits, s - LITERALS)
            far = distance(prefix_value(bits, d.read(bits)), width)
            if far > i or i + length > total:
                raise ValueError("a reference leaves the image")
            for _ in range(length):
                out[i] = out[i - far]
                i += 1
        else:
            while fed < i:
                cache[(HASH * out[fed] & 0xFFFFFFFF) >> shift] = out[fed]
                fed += 1
            out[i] = cache[s - LITERALS - LENGTHS]
            i += 1
    return np.array(out, np.uint32)


def distance(code: int, width: int) -> int:
    """Pixels back, from a distance code."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


def read_tokens(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image of one group of codes. What would stand at each bit is looked up for a span of bits at
    once; a walk from code to code then finds where one begins, and reads references on its way."""
    g, r, b, a, d = codes
    wide = g.most + r.most + b.most + a.most > 57
    mask = [(1 << c.most) - 1 for c in codes]
    tables = [c.entries() for c in codes]
    i, p = 0, bits.at
    read, copies = [], []
    while i < total:
        if p > bits.end:
            raise ValueError("the image ends too early")
        base = p & ~7
        data = bits.data[base >> 3 : (base >> 3) + SPAN + 16]
        # the 64 bits from each bit on, of which 57 are sure
        windows = np.ndarray((min(len(data), SPAN) + 1,), "<i8", data + bytes(16), 0, (1,))
        v = (windows[:, None] >> np.arange(8)).reshape(-1)
        first = tables[0].take(v & mask[0])
        size = first & 63
        v >>= size
        red = tables[1].take(v & mask[1])
        n = red & 63
        v >>= n
        size += n
        blue = tables[2].take(v & mask[2])
        n = blue & 63
        size += n
        if wide:
            at = np.arange(len(v)) + size
            far = np.ndarray((len(data) + 9,), "<i8", data + bytes(16), 0, (1,))
            v = far[np.minimum(at >> 3, len(far) - 1)] >> (at & 7)
        else:
            v >>= n
        alpha = tables[3].take(v & mask[3])
        size += alpha & 63
        other = np.flatnonzero(first >= LITERALS << 6)
        size[other] = np.where(first[other] < LITERALS + LENGTHS << 6, -1, first[other] & 63)
        go, starts = memoryview(size), []
        here, last = p - base, min(SPAN * 8, bits.end - base)
        while i < total and here <= last:
            n = go[here]
            if n >= 0:
                starts.append(here)
                here += n
                i += 1
            else:
                e = int(first[here])
                bits.at = base + here + (e & 63)
                length = prefix_value(bits, (e >> 6) - LITERALS)
                e = int(tables[4][bits.window(16) & int(mask[4])])
                bits.at += e & 63
                far = distance(prefix_value(bits, e >> 6), width)
                if far > i or i + length > total:
                    raise ValueError("a reference leaves the image")
                copies.append((i, length, far))
                here = bits.at - base
                i += length
        starts = np.array(starts, int)
        symbol = first[starts] >> 6
        value = alpha[starts] >> 6 << 24 | red[starts] >> 6 << 16 | symbol << 8 | blue[starts] >> 6
        read.append(np.where(symbol < LITERALS, value, symbol << 32))
        p = base + here
    if p > bits.end:
        raise ValueError("the image ends too early")
    bits.at = p
    values = np.concatenate(read)
    if not copies and not cache_bits:
        return values.astype(np.uint32)
    source, kept = np.arange(total), np.ones(total, bool)
    if copies:
        _, lengths, fars = (np.array(c) for c in zip(*copies, strict=True))
        for i, n, _ in copies:
            kept[i : i + n] = False
        source[~kept] -= np.repeat(fars, lengths)
    out = np.zeros(total, int)
    out[kept] = values
    return settled(out, source, 32 - cache_bits)


def settled(out: np.ndarray, source: np.ndarray, shift: np.ndarray | int, of: np.ndarray | int = 0) -> np.ndarray:
    """Pixels, from those that were read (places of the cache: their symbol above 32 bits) and the place before that each
    reference leads to. A place of the cache has the last pixel of its hash in its image (``of``)."""
    source = followed(source)
    hit = out >> 32 > 0
    if hit.any():
        key = (out.astype(np.uint32) * np.uint32(HASH)) >> np.asarray(shift, np.uint32)
        key[hit] = (out[hit] >> 32) - (LITERALS + LENGTHS)
        out[hit] = 0
        before = earlier(key[source] | np.asarray(of, np.uint64) << np.uint64(11))
        hit &= before >= 0
        source[hit] = before[hit]
        source = followed(source)
    return out[source].astype(np.uint32)


#: So few images are not read by turns.
FEW = 64


def goes_by_turns(image: Coded) -> bool:
    """Whether ``read_together`` can read it: one group of codes, at most 57 bits a pixel, and at least one."""
    codes = image.codes[0]
    return image.group is None and not is_fixed(image) and codes[0].single is None and sum(c.most for c in codes[:4]) <= 57


def extra_bits(code: np.ndarray) -> np.ndarray:
    return np.maximum(code - 2 >> 1, 0)


def table_of_turns(code: Code, channel: int) -> np.ndarray:
    """By the next bits: the symbol above 8 bits; 1 for a reference or 2 for a place in the cache; the bits of the symbol and of
    the number after it."""
    symbol, size = code.entries() >> 6, code.entries() & 63
    kind = np.zeros(len(symbol), int)
    if channel == 0:
        kind = 1 * (symbol >= LITERALS) + (symbol >= LITERALS + LENGTHS)
        size = size + np.where(kind == 1, extra_bits(symbol - LITERALS), 0)
    elif channel == 4:
        size = size + extra_bits(symbol)
    return (symbol << 8 | kind << 6 | size).astype(np.int32)


def read_together(images: list[Coded]) -> list[np.ndarray | None]:
    """The pixels of images (None: not readable), by turns: each turn looks up the next pixel, reference or place in the cache
    of every image that is not at its end."""
    n = len(images)
    lengths = np.array([len(x.bits.data) + 16 for x in images])
    begins = 8 * (np.cumsum(lengths) - lengths)
    # past the last one is room for the turns between two looks at what is at its end
    data = b"".join([x.bits.data + bytes(16) for x in images]) + bytes(512)
    windows = np.ndarray((len(data) - 7,), "<i8", data, 0, (1,))
    # the first table is of no bits
    tables, known, size, begin, mask = [np.zeros(1, np.int32)], {}, 1, np.zeros((6, n), int), np.zeros((6, n), int)
    for i, x in enumerate(images):
        for channel, c in enumerate(x.codes[0]):
            key = id(c), channel if channel in (0, 4) else 1
            if key not in known:
                known[key] = size
                tables.append(table_of_turns(c, channel))
                size += len(tables[-1])
            begin[channel, i], mask[channel, i] = known[key], (1 << c.most) - 1
    table = np.concatenate(tables)
    # what follows a green sample, a reference and a place in the cache: red, blue and alpha, a distance, nothing
    rows = np.array([[1, 4, 5], [2, 5, 5], [3, 5, 5]])
    p, ends = begins + [x.bits.at for x in images], begins + [x.bits.end for x in images]
    live, read, turn = np.arange(n), [], 0
    while len(live):
        if turn % 8 == 0:
            live = live[p[live] < ends[live]]
            here, m, number = p[live], len(live), np.arange(len(live))
            at, at_mask = begin[0, live], mask[0, live]
            then, then_mask = (x[:, live][rows].reshape(3, -1) for x in (begin, mask))
        v = windows[here >> 3] >> (here & 7)
        e = table.take(at + (v & at_mask))
        step = e & 63
        v >>= step
        found = [live, here, e]
        kind = (e >> 6 & 3) * m + number
        for k in range(3):
            e = table.take(then[k].take(kind) + (v & then_mask[k].take(kind)))
            found.append(e)
            bits = e & 63
            v >>= bits
            step += bits
        read.append(found)
        here = here + step
        turn += 1
        if turn % 8 == 0:
            p[live] = here
    image, *found = (np.concatenate(x) for x in zip(*read, strict=True))
    del read
    order = np.argsort(image.astype(np.min_scalar_type(n)), kind="stable")
    image, at, first, red, blue, alpha = (x[order] for x in (image, *found))

    def number_at(bit: np.ndarray, code: np.ndarray) -> np.ndarray:
        """``prefix_value`` for many, whose extra bits end before ``bit``."""
        extra = extra_bits(code)
        q = bit - extra
        return np.where(code < 4, code, (2 + (code & 1) << extra) + (windows[q >> 3] >> (q & 7) & (1 << extra) - 1)) + 1

    total, width = np.array([x.total for x in images]), np.array([x.width for x in images])
    symbol, took = first >> 8, np.ones(len(first), int)
    back = np.flatnonzero(first >> 6 & 3 == 1)
    after = at[back] + (first[back] & 63)
    took[back] = run = number_at(after, symbol[back] - LITERALS)
    counts = np.bincount(image, minlength=n)
    i = np.cumsum(took) - took
    i -= np.repeat(i[(np.cumsum(counts) - counts)[counts > 0]], counts[counts > 0])
    there = i < total[image]
    bad = np.bincount(image[there], took[there], n) != total
    beyond = at + (first & 63) + (red & 63) + (blue & 63) + (alpha & 63) > ends[image]
    bad[image[there & beyond]] = True
    # a reference is followed by its distance
    code = number_at(after + (red[back] & 63), red[back] >> 8)
    near = np.minimum(code, len(NEAR)) - 1
    far = np.where(code > len(NEAR), code - len(NEAR), np.maximum(NEAR_X[near] + NEAR_Y[near] * width[image[back]], 1))
    bad[image[back[there[back] & (far > i[back])]]] = True

    base = np.cumsum(total) - total
    out, of = np.zeros(int(total.sum()), int), np.repeat(np.arange(n), total)
    source = np.arange(len(out))
    there &= ~bad[image]
    one = np.flatnonzero(there & (first >> 6 & 3 != 1))
    value = alpha[one].astype(int) >> 8 << 24 | red[one] >> 8 << 16 | symbol[one] << 8 | blue[one] >> 8
    out[base[image[one]] + i[one]] = np.where(symbol[one] < LITERALS, value, symbol[one].astype(int) << 32)
    good = there[back]
    back, run = back[good], run[good]
    place = np.repeat(base[image[back]] + i[back] - np.cumsum(run) + run, run) + np.arange(int(run.sum()))
    source[place] -= np.repeat(far[good], run)
    pixels = settled(out, source, np.repeat(32 - np.maximum([x.cache_bits for x in images], 1), total), of)
    return [None if wrong else pixels[b : b + k] for wrong, b, k in zip(bad.tolist(), base.tolist(), total.tolist(), strict=True)]


def followed(source: np.ndarray) -> np.ndarray:
    """The end of each chain of places, all of which lead back."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def read_fixed(bits: Bits, codes: tuple[Code, ...], total: int) -> np.ndarray:
    """The pixels of an image whose four codes have each one length: places of all bits are known, so runs of pixels
    are read as arrays."""
    widths = [c.fixed for c in codes]
    each = sum(widths)
    if bits.at + each * total > bits.end:
        raise ValueError("the image ends too early")
    tables = [reversed_codes(tuple(c.codes.items()) if c.fixed else ((c.single, 0),), c.fixed)[1] for c in codes]
    out = np.empty(total, np.uint32)
    data = np.frombuffer(bits.data, np.uint8)
    for begin in range(0, total, RUN):
        n = min(RUN, total - begin)
        start = bits.at + begin * each
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :each] = np.unpackbits(data[start >> 3 : (start + n * each + 7) >> 3], bitorder="little")[start & 7 :][: n * each].reshape(n, each)
        code = np.packbits(wide.reshape(-1), bitorder="little").view("<u4")
        value, at = np.zeros(n, np.uint32), 0
        for t, w, to in zip(tables, widths, (8, 16, 0, 24), strict=True):
            value |= t[code >> np.uint32(at) & np.uint32((1 << w) - 1)] << np.uint32(to)
            at += w
        out[begin : begin + n] = value
    bits.at += each * total
    return out


@lru_cache(maxsize=256)
def reversed_codes(codes: tuple[tuple[int, int], ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables between symbols and codes of one length as they lie in the stream, first bit lowest."""
    to, back = np.zeros(256, np.uint32), np.zeros(1 << width, np.uint32)
    for s, code in codes:
        as_read = int(f"{code:0{width}b}"[::-1], 2) if width else 0
        to[s], back[as_read] = as_read, s
    return to, back


def channels(argb: np.ndarray) -> np.ndarray:
    """[..., 4] red, green, blue, alpha."""
    return np.stack([(argb >> np.uint32(k)).astype(np.uint8) for k in (16, 8, 0, 24)], axis=-1)


def packed(rgba: np.ndarray) -> np.ndarray:
    p = rgba.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def predicted(mode: int, left, top, right, corner) -> list[int]:
    """The prediction of a pixel from its neighbours (lists of 4 numbers)."""
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(max(a + t - c, 0), 255) for a, t, c in zip(left, top, corner, strict=True)]
    # halves are cut towards zero
    return [min(max(m + int((m - c) / 2), 0), 255) for m, c in zip(mean(left, top), corner, strict=True)]


def guesses(rgba: np.ndarray) -> np.ndarray:
    """The predictions of a known image by each mode, [14, height, width, 4]; the edges have theirs in every mode."""
    p = rgba.astype(np.int16)
    out = np.empty((14, *p.shape), np.int16)
    out[:, 0, 0], out[:, 0, 1:], out[:, 1:, 0] = (0, 0, 0, 255), p[0, :-1], p[:-1, 0]
    left, top, corner = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    # right of the last column stands the first pixel of this row
    right = np.concatenate([p[:-1, 2:], p[1:, :1]], axis=1)[:, : top.shape[1]]
    inner = out[:, 1:, 1:]
    mean = lambda a, b: (a + b) >> 1
    inner[0] = (0, 0, 0, 255)
    inner[1:5] = left, top, right, corner
    inner[5] = mean(mean(left, right), top)
    inner[6:10] = mean(left, corner), mean(left, top), mean(corner, top), mean(top, right)
    inner[10] = mean(mean(left, corner), mean(top, right))
    by_left, by_top = np.abs(top - corner).sum(-1), np.abs(left - corner).sum(-1)
    inner[11] = np.where((by_left < by_top)[..., None], left, top)
    inner[12] = np.clip(left + top - corner, 0, 255)
    m = mean(left, top)
    # halves are cut towards zero
    inner[13] = np.clip(m + np.sign(m - corner) * (np.abs(m - corner) >> 1), 0, 255)
    return out


def spread(blocks: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    """A value of each block for each of its pixels."""
    return np.repeat(np.repeat(blocks, 1 << bits, 0), 1 << bits, 1)[:h, :w]


def predictions(rgba: np.ndarray, modes: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    """Adds (invert) or takes off the prediction of each pixel; modes is [block row, block column]."""
    h, w, _ = rgba.shape
    modes = np.where(np.asarray(modes) > 13, 0, modes).astype(int)
    if not invert:
        of = spread(modes, bits, h, w)
        return (rgba - np.take_along_axis(guesses(rgba), of[None, :, :, None], 0)[0]).astype(np.uint8)
    given, out = rgba.astype(int).tolist(), []
    for y in range(h):
        row = []
        for x in range(w):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else row[x - 1]
            elif x == 0:
                p = out[y - 1][0]
            else:
                # right of the last column stands the first pixel of this row
                corner = out[y - 1][x + 1] if x + 1 < w else row[0]
                p = predicted(int(modes[y >> bits][x >> bits]), row[x - 1], out[y - 1][x], corner, out[y - 1][x - 1])
            row.append([(v + q) & 255 for v, q in zip(given[y][x], p, strict=True)])
        out.append(row)
    return np.array(out, np.uint8).reshape(h, w, 4)


def cross_colour(rgba: np.ndarray, elements: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    """elements is [block row, block column, 4]: red to blue, green to blue, green to red, -."""
    h, w, _ = rgba.shape
    e = spread(elements, bits, h, w).astype(np.int8).astype(int)
    p = rgba.astype(int)
    small = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(int)
    by = lambda t, c: (t * small(c)) >> 5
    sign = 1 if invert else -1
    red = p[..., 0] + sign * by(e[..., 2], p[..., 1])
    after = red if invert else p[..., 0]
    blue = p[..., 2] + sign * (by(e[..., 1], p[..., 1]) + by(e[..., 0], after))
    return np.stack([red & 255, p[..., 1], blue & 255, p[..., 3]], axis=-1).astype(np.uint8)


def with_green(rgba: np.ndarray) -> np.ndarray:
    return np.stack([rgba[..., 0] + rgba[..., 1], rgba[..., 1], rgba[..., 2] + rgba[..., 1], rgba[..., 3]], axis=-1)


def from_palette(rgba: np.ndarray, table: np.ndarray, bundle: int, width: int) -> np.ndarray:
    each = 8 >> bundle
    index = np.repeat(rgba[..., 1], 1 << bundle, axis=1)[:, :width]
    index = index >> (np.arange(width) % (1 << bundle) * each).astype(np.uint8) & np.uint8((1 << each) - 1)
    return np.vstack([table, np.zeros((256 - len(table), 4), np.uint8)])[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file. Raises ValueError on anything that is not one."""
    image = opened(data)
    return undone(image, read_pixels(image.coded))


def decode_all(files: Iterable[bytes | None]) -> Iterator[np.ndarray | None]:
    """``decode`` for each file, None for what is no lossless WebP image. Small images are read together, those of about one
    size in a group, so that all have turns to its end."""
    images = [opened_or_none(data) for data in files]
    turns = [k for k, x in enumerate(images) if x and goes_by_turns(x.coded) and weight_of(x.coded) <= READ // max(FEW, 1)]
    read = {}
    for group in dealt(sorted(turns, key=lambda k: images[k].coded.total), lambda k: weight_of(images[k].coded), READ):
        if len(group) >= FEW:
            read |= zip(group, read_together([images[k].coded for k in group]), strict=True)
    for k, x in enumerate(images):
        pixels = read.pop(k, None)
        try:
            yield None if x is None else undone(x, read_pixels(x.coded) if pixels is None else pixels)
        except (ValueError, IndexError):
            yield None


def weight_of(image: Coded) -> int:
    """Pixels, or what tables of large codes take as much room as."""
    return max(image.total, sum(1 << c.most for c in image.codes[0] if c.most > 13) // 8)


class Opened(NamedTuple):
    """A file up to the main image: its sides, the main image with its codes, and transforms."""

    width: int
    height: int
    coded: Coded
    undo: list


def opened_or_none(data: bytes | None) -> Opened | None:
    try:
        return None if data is None else opened(data)
    except (ValueError, IndexError):
        return None


def opened(data: bytes) -> Opened:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            across, down = -(-width >> block), -(-height >> block)
            undo.append((kind, width, block, channels(read_image(bits, across, down)).reshape(down, across, 4)))
        elif kind == SUBTRACT:
            undo.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(channels(read_image(bits, n, 1)), axis=0, dtype=np.uint8)
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, bundle, table))
            width = -(-width >> bundle)
    return Opened(full, height, read_codes(bits, width, height, True), undo)


def undone(image: Opened, argb: np.ndarray) -> np.ndarray:
    """The image from the pixels of its main image."""
    rgba = channels(argb).reshape(image.height, image.coded.width, 4)
    for kind, wide, block, extra in reversed(image.undo):
        if kind == PREDICTOR:
            rgba = predictions(rgba, extra[..., 1], block, True)
        elif kind == CROSS:
            rgba = cross_colour(rgba, extra, block, True)
        elif kind == SUBTRACT:
            rgba = with_green(rgba)
        else:
            rgba = from_palette(rgba, extra, block, wide)
    if rgba.shape != (image.height, image.width, 4):
        raise ValueError("sizes do not agree")
    return rgba


def lengths_of(counts: Counter | dict, most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most ``most`` bits: counts are flattened until it fits."""
    counts = {s: n for s, n in counts.items() if n}
    if len(counts) < 2:
        return dict.fromkeys(counts or [0], 1)
    while True:
        # the two rarest of leaves and of what was merged, which both ascend
        leaves = sorted((n, s) for s, n in counts.items())
        few, k = [n for n, _ in leaves], len(leaves)
        few += [1 << 62] * 2
        above, merged, a, b = [0] * (2 * k - 1), [], 0, 0
        for at in range(k, 2 * k - 1):
            total = 0
            for _ in range(2):
                if b == len(merged) or few[a] <= merged[b]:
                    total += few[a]
                    above[a] = at
                    a += 1
                else:
                    total += merged[b]
                    above[k + b] = at
                    b += 1
            merged.append(total)
        depth = [0] * (2 * k - 1)
        for i in range(2 * k - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth) <= most:
            return {s: depth[i] for i, (_, s) in enumerate(leaves)}
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def write_code(out: BitWriter, lengths: dict[int, int], alphabet: int) -> Code:
    used = sorted(lengths)
    if len(used) <= 2 and used[-1] < 256:
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(1, 1)
        for s in used:
            out.write(s, 8)
        return simple_code(used[0], used[-1])
    dense = bytearray(used[-1] + 1)
    for s, n in lengths.items():
        dense[s] = n
    out.write(*code_bits(bytes(dense)))
    return code_of(bytes(dense))


@lru_cache(maxsize=256)
def code_bits(lengths: bytes) -> tuple[int, int]:
    """The stored form of a code, as bits and their number: runs of zeros and repeats are one entry each."""
    entries: list[tuple[int, int, int]] = []
    for n, run in groupby(lengths):
        left = len(list(run))
        if n:
            entries.append((n, 0, 0))
            left -= 1
            while left >= 3:
                entries.append((16, min(left, 6) - 3, 2))
                left -= min(left, 6)
        else:
            while left >= 3:
                step = min(left, 138)
                entries.append((18, step - 11, 7) if step > 10 else (17, step - 3, 3))
                left -= step
        entries += [(n, 0, 0)] * left
    entries += [(0, 0, 0)] * (2 - len(entries))
    out = BitWriter()
    out.write(0, 1)
    meta = lengths_of(Counter(e[0] for e in entries), 7)
    out.write(15, 4)
    for s in LENGTH_ORDER:
        out.write(meta.get(s, 0), 3)
    out.write(1, 1)
    out.write(5, 3)
    out.write(len(entries) - 2, 12)
    to, sizes = (x.tolist() for x in Code(meta).written(19))
    for s, extra, n in entries:
        out.write(to[s] | extra << sizes[s], sizes[s] + n)
    return out.value, out.size


def prefix_of(value: int) -> tuple[int, int, int]:
    """The code, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def prefixes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix_of`` for many numbers."""
    v = values - 1
    top = np.maximum(np.frexp(v)[1].astype(int) - 1, 1)
    extra = top - 1
    return np.where(values <= 4, v, 2 * top + (v >> extra & 1)), np.where(values <= 4, 0, v & (1 << extra) - 1), np.where(values <= 4, 0, extra)


def earlier(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, of at most 35 bits, or -1."""
    ordered = np.sort(keys.astype(np.uint64) << PLACE | np.arange(len(keys), dtype=np.uint64))
    order, keys = (ordered & LOW).astype(int), ordered >> PLACE
    same = keys[1:] == keys[:-1]
    out = np.full(len(order), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


#: Bits of a place in an image, whose sides are at most 2^14, as numbers that are sorted hold it.
PLACE, LOW = np.uint64(28), np.uint64((1 << 28) - 1)


def n_log_n(n: np.ndarray) -> np.ndarray:
    """n * log2(n) in whole 256ths, so that sums are the same in every order."""
    return np.rint(n * np.log2(np.maximum(n, 1)) * 256) / 256


#: Those of small counts.
N_LOG_N = n_log_n(np.arange(1 << 14))


def cost_of(counts: np.ndarray) -> np.ndarray:
    """About the bits of each histogram (last axis): its entropy, and 5 bits for each symbol's length in the stored code."""
    each = N_LOG_N[counts] if counts.max() < len(N_LOG_N) else n_log_n(counts)
    return n_log_n(counts.sum(-1)) - each.sum(-1) + 5 * np.count_nonzero(counts, axis=-1)


def planes_of(argb: np.ndarray) -> np.ndarray:
    """The samples of each channel in the order of their codes: green, red, blue, alpha."""
    return np.stack([argb >> np.uint32(k) & np.uint32(255) for k in (8, 16, 0, 24)])


def histograms(planes: np.ndarray, of: np.ndarray | int = 0, n: int = 1) -> np.ndarray:
    """[image, plane, 256]; ``of`` has the image of each place."""
    out, row = np.empty((n, len(planes), 256), int), of * 256
    for k, plane in enumerate(planes):
        out[:, k] = np.bincount(row + plane.astype(int), minlength=256 * n).reshape(n, 256)
    return out


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """Short codes of distances in an image of this width."""
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR):
        out.setdefault(max(x + y * width, 1), k + 1)
    return out


def references_in(argb: np.ndarray, of: np.ndarray, ends: np.ndarray, bits_a_pixel: np.ndarray) -> np.ndarray:
    """Places, lengths and distances of back-references in images that stand one after the other: the last place of the
    same two pixels, where a copy of what follows there takes fewer bits than its pixels. Two pairs of pixels in one image that
    share 36 bits of a hash hide each other."""
    pair = argb[:-1].astype(np.uint64) << np.uint64(32) | argb[1:]
    order = (np.sort(pair * np.uint64(0x9E3779B97F4A7C15) & ~LOW | np.arange(len(pair), dtype=np.uint64)) & LOW).astype(int)
    first, second = order[:-1], order[1:]
    same = (pair[first] == pair[second]) & (of[first] == of[second]) & (of[second] == of[second + 1])
    before = np.full(len(argb), -1)
    before[second[same]] = first[same]
    places = np.flatnonzero(before >= 0)
    image = of[places]
    px, end, out = argb.tolist(), 0, []
    for i, found, stop, bits in zip(places.tolist(), before[places].tolist(), ends[image].tolist(), bits_a_pixel[image].tolist(), strict=True):
        if i < end:
            continue
        step, most = 2, min(4096, stop - i)
        while step < most and px[i + step] == px[found + step]:
            step += 1
        if step * bits > 10 + (i - found).bit_length():
            out.append((i, step, i - found))
            end = i + step
    return np.array(out, int).reshape(-1, 3).T


#: Bytes by how usual they are in European text, an order that only decides which codes are shared.
USUAL = list(dict.fromkeys([*b" etaoinshrdlucmfwypvbgkjqxz\n.,\0", 195, *(169, 168, 188, 164, 182, 159, 177, 179, 161, 173, 186, 167, 170, 160, 162, 174, 180, 187, 137, 128, 156), *b"TEAOINSHRDLUCMFWYPVBGKJQXZ0123456789", *range(256)]))

#: Bits that a code of an image's own must save against the best shared one: making, storing and reading it takes as long.
OWN = 4000


@lru_cache(maxsize=64)
def shared_codes(alphabet: int) -> tuple[list[tuple[tuple[int, int], tuple[np.ndarray, np.ndarray]]], np.ndarray, np.ndarray]:
    """Codes for the usual bytes, the first 16, 32, 64, 128 or all, for 280 symbols and more also for lengths and for places
    in a cache: stored forms with codes and lengths by symbol, bits of the stored forms, bits by symbol and code (a symbol that
    a code lacks: too many)."""
    out = []
    for bits in (4, 5, 6, 7, 8):
        weight = {b: int(1e6 / (i + 4) ** (1.1 if bits > 4 else 0.7)) + 1 for i, b in enumerate(USUAL[: 1 << bits])}
        if alphabet == DISTANCES:
            weight = dict.fromkeys(range(DISTANCES), 1) | dict.fromkeys(range(8, 22), 6)
        elif alphabet > LITERALS:
            total, cached = sum(weight.values()), alphabet - LITERALS - LENGTHS
            weight |= {LITERALS + i: total // (20 * (i + 1)) for i in range(LENGTHS)}
            weight |= dict.fromkeys(range(LITERALS + LENGTHS, alphabet), total // (5 * max(cached, 1)) + 1)
        form = BitWriter()
        out.append((write_code(form, lengths_of(weight), alphabet).written(alphabet), (form.value, form.size)))
    sizes = np.array([n for (_, n), _ in out], float)
    return [(form, by) for by, form in out], np.array([form[1] for _, form in out]), np.where(sizes > 0, sizes, 1e12).T


def codes_for(counts: np.ndarray, alphabet: int) -> list[tuple[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
    """The code for each of these histograms, a shared one where its own would not save enough: its stored form, and codes and
    lengths by symbol."""
    known, heads, each = shared_codes(alphabet)
    bits = counts @ each + heads
    best = bits.argmin(axis=1)
    own = (bits.min(axis=1) >= cost_of(counts) + OWN) | (np.count_nonzero(counts, axis=1) <= 2)
    codes = []
    for c, k, alone in zip(counts, best.tolist(), own.tolist(), strict=True):
        if alone:
            used, form = np.flatnonzero(c), BitWriter()
            code = write_code(form, lengths_of(dict(zip(used.tolist(), c[used].tolist(), strict=True))), alphabet)
            codes.append(((form.value, form.size), code.written(alphabet)))
        else:
            codes.append(known[k])
    return codes


def end_to_end(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (above 4 bits) with lengths of all tables, each different one once, and where each image's begins."""
    begins, parts, at = {}, [], 0
    for to, n in tables:
        if id(to) not in begins:
            begins[id(to)] = at
            parts.append(to << np.uint64(4) | n)
            at += len(to)
    return np.concatenate(parts), np.array([begins[id(to)] for to, _ in tables])


def write_images(outs: list[BitWriter], images: list[np.ndarray], widths: list[int], main: bool, cache_bits: int | None = 0, references: bool = False) -> None:
    """Prefix codes, and on demand back-references and a colour cache; with ``cache_bits`` of None the cache is as large
    as pays, if any. Images are as if each were written alone: they only share the calls."""
    flat = [x.reshape(-1, 4) for x in images]
    n, total = len(flat), np.array([len(x) for x in flat])
    of, argb = np.repeat(np.arange(n), total), packed(np.concatenate(flat))
    planes = planes_of(argb)
    bits_a_pixel = cost_of(histograms(planes, of, n)).sum(-1) / total if references or cache_bits is None else np.zeros(n)
    at, runs, fars = references_in(argb, of, np.cumsum(total), bits_a_pixel) if references else np.zeros((3, 0), int)
    inside = np.zeros(len(argb) + 1, int)
    inside[at] += 1
    inside[at + runs] -= 1
    kept = np.cumsum(inside[:-1]) == 0
    short = [near_codes(w) for w in widths]
    run_code, run_extra, run_bits = prefixes_of(runs)
    far_code, far_extra, far_bits = prefixes_of(np.array([short[i].get(far, far + len(NEAR)) for i, far in zip(of[at].tolist(), fars.tolist(), strict=True)], int))

    size = np.full(n, cache_bits or 0)
    if cache_bits is None:
        size = np.clip(np.frexp(np.bincount(of[kept], minlength=n))[1].astype(int) - 1, 1, 10)
    green, whole = planes[0].astype(int), kept
    if size.any():
        key = (argb * np.uint32(HASH)) >> (32 - size).astype(np.uint32)[of]
        before = earlier(of.astype(np.uint64) << np.uint64(11) | key)
        hit = kept & (before >= 0) & (argb[before] == argb)
        if cache_bits is None:
            # a pixel in the cache costs its place and about three bits more, and the code has to tell places
            size[np.bincount(of[hit], minlength=n) * (bits_a_pixel - size - 3) <= 32] = 0
            hit &= size[of] > 0
        green, whole = np.where(hit, key.astype(int) + (LITERALS + LENGTHS), green), kept & ~hit

    places = np.flatnonzero(kept)
    image, literal = of[places], np.flatnonzero(whole)
    first = LITERALS + LENGTHS + np.where(size > 0, 1 << size, 0)
    most = int(first.max())
    counts = np.bincount(np.concatenate([image * most + green[places], of[at] * most + run_code + LITERALS]), minlength=n * most).reshape(n, most)
    codes = [[None] * n]
    for alphabet in np.unique(first).tolist():
        some = np.flatnonzero(first == alphabet)
        for i, code in zip(some.tolist(), codes_for(counts[some, :alphabet], alphabet), strict=True):
            codes[0][i] = code
    others = histograms(planes[1:, literal], of[literal], n)
    codes += [codes_for(others[:, k], 256) for k in range(3)]
    codes.append(codes_for(np.bincount(of[at] * DISTANCES + far_code, minlength=n * DISTANCES).reshape(n, DISTANCES), DISTANCES))
    # each pixel or copy is one number of at most 60 bits
    (table, begin), *rest = [end_to_end([tables for _, tables in each]) for each in codes]
    value, length = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.uint64)

    def add(at: np.ndarray, bits: np.ndarray, n: np.ndarray) -> None:
        value[at] |= bits.astype(np.uint64) << length[at]
        length[at] += n.astype(np.uint64)

    def add_code(at: np.ndarray, entry: np.ndarray) -> None:
        add(at, entry >> np.uint64(4), entry & np.uint64(15))

    add_code(places, table[begin[image] + green[places]])
    for (others_table, others_begin), plane in zip(rest[:3], planes[1:], strict=True):
        add_code(literal, others_table[others_begin[of[literal]] + plane[literal]])
    if len(at):
        add_code(at, table[begin[of[at]] + run_code + LITERALS])
        add(at, run_extra, run_bits)
        add_code(at, rest[3][0][rest[3][1][of[at]] + far_code])
        add(at, far_extra, far_bits)
    kept[at] = True
    bodies = joined(value[kept], length[kept], np.bincount(of[kept], minlength=n))
    for i, (out, k, body) in enumerate(zip(outs, size.tolist(), bodies, strict=True)):
        out.write(1 | k << 1, 5) if k else out.write(0, 1)
        if main:
            out.write(0, 1)
        for each in codes:
            out.write(*each[i][0])
        out.write(*body)


def joined(value: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The numbers of each image, of at most 63 bits, one after the other, first bits lowest: all bits and how many."""
    last = np.cumsum(counts)
    ends = np.cumsum(size)
    bits = np.diff(ends[last - 1], prepend=np.uint64(0))
    # an image begins with a word of its own
    room = (bits >> np.uint64(6)) + np.uint64(2)
    begin = np.cumsum(room) - room
    at = ends - size + np.repeat((begin << np.uint64(6)) - (np.cumsum(bits) - bits), counts)
    word, low = at >> np.uint64(6), at & np.uint64(63)
    words = np.zeros(int(room.sum()), np.uint64)
    begins = np.flatnonzero(np.diff(word, prepend=np.uint64(1 << 63)))
    words[word[begins]] = np.bitwise_or.reduceat(value << low, begins)
    # what of a word's last number does not fit stands in the next one
    over = np.flatnonzero(low + size > 64)
    words[word[over] + np.uint64(1)] |= value[over] >> (np.uint64(64) - low[over])
    data = words.astype("<u8").tobytes()
    return [(int.from_bytes(data[8 * b : 8 * b + (n + 7) // 8], "little"), n) for b, n in zip(begin.tolist(), bits.tolist(), strict=True)]


@lru_cache(maxsize=256)
def symbols_for(used: bytes) -> tuple[int, np.ndarray]:
    """Bits of a code of one length for these bytes, and its symbols: the first 2^bits of the usual bytes, so that all
    images share a few codes, which readers then know. One byte alone needs no bits."""
    if len(used) == 1:
        return 0, np.array(list(used))
    width = next(w for w in range(1, 9) if set(used) <= set(USUAL[: 1 << w]))
    return width, np.sort(np.array(USUAL[: 1 << width]))


@lru_cache(maxsize=256)
def fixed_code(symbols: bytes, width: int, alphabet: int) -> tuple[int, int]:
    out = BitWriter()
    write_code(out, dict.fromkeys(np.frombuffer(symbols, np.int64).tolist(), width), alphabet)
    return out.value, out.size


def fixed_body(out: BitWriter, argb: np.ndarray) -> bytes:
    """Ends the stream with a main image in codes of one length a channel, written as arrays."""
    out.write(0, 2)
    planes = []
    for k, alphabet in ((8, LITERALS + LENGTHS), (16, 256), (0, 256), (24, 256)):
        plane = (argb >> np.uint32(k)).astype(np.uint8)
        seen = np.zeros(256, bool)
        seen[plane] = True
        used = np.flatnonzero(seen).astype(np.uint8)
        width, symbols = symbols_for(used.tobytes())
        out.write(*fixed_code(symbols.tobytes(), max(width, 1), alphabet))
        # canonical codes of one length count up with the symbols
        planes.append((plane, reversed_codes(tuple(zip(symbols.tolist(), range(len(symbols)), strict=True)), width)[0], width))
    write_code(out, {0: 1}, DISTANCES)
    each = sum(w for *_, w in planes)
    parts, head = [], out.bits()
    for begin in range(0, len(argb), RUN):
        n = min(RUN, len(argb) - begin)
        code, at = np.zeros(n, np.uint32), 0
        for plane, table, width in planes:
            code |= table[plane[begin : begin + n]] << np.uint32(at)
            at += width
        raw = np.unpackbits(code.view(np.uint8), bitorder="little").reshape(n, 32)[:, :each]
        flat = np.concatenate([head, raw.reshape(-1)])
        whole = len(flat) - len(flat) % 8 if begin + n < len(argb) else len(flat)
        parts.append(np.packbits(flat[:whole], bitorder="little").tobytes())
        head = flat[whole:]
    return b"".join(parts) or np.packbits(head, bitorder="little").tobytes()


def without_green(rgba: np.ndarray) -> np.ndarray:
    return np.stack([rgba[..., 0] - rgba[..., 1], rgba[..., 1], rgba[..., 2] - rgba[..., 1], rgba[..., 3]], axis=-1)


def sums_of_blocks(values: np.ndarray, bits: int) -> np.ndarray:
    """Sums over blocks of the last two axes."""
    h, w = values.shape[-2:]
    return np.add.reduceat(np.add.reduceat(values, np.arange(0, h, 1 << bits), axis=-2), np.arange(0, w, 1 << bits), axis=-1)


def modes_for(rgba: np.ndarray, bits: int) -> np.ndarray:
    """The mode of each block whose differences are the smallest."""
    least = []
    for guess in guesses(rgba):
        off = (rgba - guess).astype(np.uint8).astype(np.int16)
        least.append(sums_of_blocks(np.minimum(off, 256 - off).sum(-1, dtype=np.int64), bits))
    return np.argmin(least, axis=0)


def elements_for(rgba: np.ndarray, bits: int) -> np.ndarray:
    """Cross-colour elements of each block by least squares: green from red and blue, then red from blue."""
    p = rgba.astype(np.int8).astype(np.int64)

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both, own = sums_of_blocks(x * y, bits), sums_of_blocks(x * x, bits)
        return np.clip(np.round(32 * both / np.maximum(own, 1)), -128, 127).astype(np.int8)

    out = np.zeros((*sums_of_blocks(p[..., 0], bits).shape, 4), np.int8)
    out[..., 2], out[..., 1] = slope(p[..., 1], p[..., 0]), slope(p[..., 1], p[..., 2])
    rest = cross_colour(rgba, out.view(np.uint8), bits, False).astype(np.int8).astype(np.int64)
    out[..., 0] = slope(p[..., 0], rest[..., 2])
    return out.view(np.uint8)


#: Blocks of predictor modes and cross-colour elements have 2^4 pixels a side.
BLOCK = 4


KINDS = ("", "subtract", "predictor", "both", "palette")


def kinds_for(images: list[np.ndarray]) -> list[str]:
    """What costs least for each image, by its histograms: to stay as it is, less its green, as differences of neighbours
    (predictor), both, or as places in a palette."""
    flat = [x.reshape(-1, 4) for x in images]
    n, total = len(flat), np.array([len(x) for x in flat])
    of, argb = np.repeat(np.arange(n), total), packed(np.concatenate(flat))
    green, red, blue, alpha = planes = planes_of(argb)
    whole = np.concatenate([planes, np.stack([red - green, blue - green])]) & np.uint32(255)
    c = cost_of(np.concatenate([histograms(whole, of, n), histograms(steps_in(whole, of), of, n)], axis=1)).T
    asis, minus = c[0] + c[3], c[6] + c[9]
    # a block's mode and its elements are numbers of their own
    more = 4 * blocks_of(images) + 60
    # the colours of each image in their order, and how many pixels have each
    ordered = np.sort(of.astype(np.uint64) << np.uint64(32) | argb)
    at = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    colour, image, counts = ordered[at].astype(np.uint32), (ordered[at] >> np.uint64(32)).astype(int), np.diff(at, append=len(ordered))
    colours = np.bincount(image, minlength=n)
    # indices of small palettes share pixels, which only helps
    indices = n_log_n(total) - np.bincount(image, n_log_n(counts), n) + 5 * colours
    palette = indices + cost_of(histograms(steps_in(planes_of(colour), image), image, n)).sum(-1) + 40
    costs = [asis + c[1] + c[2], asis + c[4] + c[5], minus + c[7] + c[8] + more, minus + c[10] + c[11] + more, np.where(colours <= 256, palette, np.inf)]
    return [KINDS[k] for k in np.argmin(costs, axis=0).tolist()]


def steps_in(planes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Differences from the place before, from 0 at each image's first."""
    out = np.diff(planes, axis=1, prepend=np.uint32(0))
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    out[:, begins] = planes[:, begins]
    return out & np.uint32(255)


def blocks_of(images: list[np.ndarray]) -> np.ndarray:
    return np.array([-(-x.shape[0] >> BLOCK) * -(-x.shape[1] >> BLOCK) for x in images])


def transforms_for(rgba: np.ndarray, kind: str) -> tuple:
    """The transforms of an image of this kind. Elements of cross-colour join differences where that costs less."""
    if kind == "palette":
        return (("palette",),)
    out = (("subtract",),) if kind in ("subtract", "both") else ()
    if kind in ("predictor", "both"):
        if out:
            rgba = without_green(rgba)
        modes = modes_for(rgba, BLOCK)
        out += (("predictor", BLOCK, modes),)
        rgba = predictions(rgba, modes, BLOCK, False)
        elements = elements_for(rgba, BLOCK)
        before, after = (histograms(planes_of(packed(x).reshape(-1))[1:3]) for x in (rgba, cross_colour(rgba, elements, BLOCK, False)))
        if cost_of(after).sum() + 24 * int(blocks_of([rgba])[0]) + 60 < cost_of(before).sum():
            out += (("cross", BLOCK, elements),)
    return out


def encode(rgba: np.ndarray, transforms: tuple = (), cache_bits: int | None = 0, references: bool = False, arrays: bool = False) -> bytes:
    """A lossless WebP file.

    ``transforms`` are applied in order: ("subtract",), ("predictor", bits, modes), ("cross", bits, elements),
    ("palette",); a palette must be the last and needs at most 256 colours. ``arrays`` writes the main image by the fast
    path (codes of one length, no references or cache)."""
    out, rgba = transformed(rgba, transforms)
    if arrays:
        return file_of(fixed_body(out, packed(rgba).reshape(-1)))
    write_images([out], [rgba], [rgba.shape[1]], True, cache_bits, references)
    return file_of(out.bytes())


def transformed(rgba: np.ndarray, transforms: tuple) -> tuple[BitWriter, np.ndarray]:
    """The stream up to the main image, and the main image."""
    height, width, _ = rgba.shape
    if not (1 <= width <= 16384 and 1 <= height <= 16384):
        raise ValueError("a side is over 16,384 pixels")
    out = BitWriter()
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 4)
    for kind, *given in transforms:
        out.write(1, 1)
        if kind == "subtract":
            out.write(SUBTRACT, 2)
            rgba = without_green(rgba)
        elif kind == "palette":
            out.write(PALETTE, 2)
            table, index = np.unique(packed(rgba).reshape(-1), return_inverse=True)
            n = len(table)
            out.write(n - 1, 8)
            steps = channels(table)
            steps[1:] -= channels(table)[:-1]
            write_images([out], [steps], [n], False)
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            across = -(-width >> bundle)
            grid = np.zeros((height, across << bundle), np.uint8)
            grid[:, :width] = index.reshape(height, width)
            grid = grid.reshape(height, across, 1 << bundle) << (np.arange(1 << bundle) * (8 >> bundle)).astype(np.uint8)
            rgba = np.zeros((height, across, 4), np.uint8)
            rgba[..., 1], rgba[..., 3] = np.bitwise_or.reduce(grid, axis=2), 255
            width = across
        else:
            bits, extra = given
            extra = np.asarray(extra, np.uint8)
            out.write(PREDICTOR if kind == "predictor" else CROSS, 2)
            out.write(bits - 2, 3)
            image = extra if kind == "cross" else np.stack([np.zeros_like(extra), extra, np.zeros_like(extra), np.full_like(extra, 255)], axis=-1)
            write_images([out], [image], [image.shape[1]], False)
            rgba = predictions(rgba, extra, bits, False) if kind == "predictor" else cross_colour(rgba, extra, bits, False)
    out.write(0, 1)
    return out, rgba


def file_of(body: bytes) -> bytes:
    body = b"\x2f" + body
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def image_of(payload: bytes) -> np.ndarray:
    """A payload as 16 pixels a row (more where that is over the format's height), each byte a sample; what rows lack is zero."""
    n = len(payload) // 64
    wide = -(-n // 16384)
    rgba = np.zeros((-(-n // wide), 16 * wide, 4), np.uint8)
    rgba.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    return rgba


def stored(payload: bytes) -> bytes:
    """A payload as an image. Transforms, references and cache are those that cost least for the image."""
    return next(stored_all([payload]))


def stored_all(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """``stored`` for each payload, of which those of up to WRITTEN pixels share the calls."""
    for group in dealt(payloads, lambda p: len(p) // 4, WRITTEN):
        images = [image_of(p) for p in group]
        heads = [transformed(x, transforms_for(x, kind)) for x, kind in zip(images, kinds_for(images), strict=True)]
        write_images([out for out, _ in heads], [x for _, x in heads], [x.shape[1] for _, x in heads], True, None, True)
        yield from (file_of(out.bytes()) for out, _ in heads)


def dealt(items: Iterable, weight: Callable[..., int], most: int) -> Iterator[list]:
    """The items in their order, in groups of up to ``most`` by weight; one that is over it is alone."""
    group, room = [], most
    for x in items:
        w = weight(x)
        if group and w > room:
            yield group
            group, room = [], most
        group.append(x)
        room -= w
    if group:
        yield group


def feature_of(rgba: np.ndarray) -> str:
    """Width, height, and of each channel mean, spread and entropy in bits of its samples."""
    flat = rgba.reshape(-1, 4)
    parts = []
    for k in range(4):
        n = np.bincount(flat[:, k], minlength=256)
        p = n[n > 0] / len(flat)
        mean = float((n * np.arange(256)).sum() / len(flat))
        spread = float(np.sqrt(max((n * np.arange(256) ** 2).sum() / len(flat) - mean * mean, 0)))
        parts.append(f"{mean:.3f},{spread:.3f},{float(-(p * np.log2(p)).sum()) + 0:.3f}")
    return f"{rgba.shape[1]}x{rgba.shape[0]};" + ";".join(parts)


@F.pandas_udf(T.BinaryType())
def media_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The image of each text (null: as an empty text)."""
    for texts in batches:
        yield pd.Series([*stored_all(payload_of((t or "").encode("utf-8", "surrogatepass")) for t in texts)], dtype=object)


DIGEST = T.StructType()
for _name, _type in (("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType())):
    DIGEST.add(_name, _type)
PIXELS = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("pixels", T.BinaryType())


@F.pandas_udf(DIGEST)
def digest_of(media: pd.Series, pixels: pd.DataFrame, n_bytes: pd.Series) -> pd.DataFrame:
    """What is read back from each image: digests of file and payload, and features of the pixels."""
    rows = []
    for data, width, samples, n in zip(media, pixels["width"], pixels["pixels"], n_bytes, strict=True):
        if samples is None:
            raise ValueError("a stored image is not read back")
        rgba = np.frombuffer(samples, np.uint8).reshape(-1, int(width), 4)
        payload = samples[: len(payload_of(b"")) * max(1, -(-int(n) // 64))]
        rows.append((len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature_of(rgba)))
    return pd.DataFrame(rows, columns=DIGEST.names)


@F.pandas_udf(PIXELS)
def pixels_of(media: pd.Series) -> pd.DataFrame:
    """The pixel array of each image: sides and red, green, blue, alpha samples row by row; null for null or what is no
    lossless WebP image."""
    rows = [(p.shape[1], p.shape[0], p.tobytes()) if p is not None else (None, None, None) for p in decode_all(media)]
    return pd.DataFrame(rows, columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with each whole text stored as an image. Equal texts get equal images; a null text one of zeros."""
    if media in docs.columns:
        raise ValueError(f"column {media} exists")
    return docs.withColumn(media, media_of(F.col(text)))


def with_pixels(table: DataFrame, media: str = "media", pixels: str = "pixels") -> DataFrame:
    """``table`` with the decoded pixel array of a media column (see ``pixels_of``)."""
    return table.withColumn(pixels, pixels_of(F.col(media)))
