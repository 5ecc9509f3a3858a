"""Lossless WebP (VP8L): a decoder for the whole bit stream format and a writer for 8-bit sample images.

Decoder: prefix codes (simple, normal, single-symbol, grouped by an entropy image), length and distance back-references
with the format's short-distance map, the colour cache, and the inverse of all four transforms (predictor,
cross-colour, subtract-green, palette with bundled pixels). It gives ARGB pixel arrays. Images with one group of codes
are read in two steps: numpy looks up what a symbol would be at every bit of a stretch of the stream, and where it would
end; then the symbols that are there are found by going from end to end. Images with several groups, and small ones, are
read symbol by symbol.

Writer: bytes become the green samples of an image of rows of 64. It finds back-references to the last place of the same
four bytes, gives literals, lengths and distances prefix codes of their own frequencies, and chooses for each image what
comes out smallest: a palette with bundled pixels where sixteen or fewer byte values occur, the left or the upper
predictor, a colour cache. (Cross-colour takes from green what is left in red and blue, of which these images have none.)
Payloads of over IMAGE bytes are stored as several files, one after the other, in one value.

Defined cases: a null text is empty; an empty payload is stored as 64 zero bytes; texts of any length that one row of a
table holds can be stored; equal texts have equal files; a null doc_id and repeated rows pass; an empty table gives no
rows; other columns are ignored. decode() raises ValueError for streams that are broken or of another format.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

ROW, SIDE = 64, 1 << 14
#: Bytes of the largest image: rows of ROW, as many as an image can have.
IMAGE = ROW * SIDE
#: Bits of a stream that are looked up at once, and pixels from which that pays.
STRETCH, FEW = 1 << 18, 64
#: Texts of a batch that goes on.
TEXTS = 1000
#: Longest back-reference and farthest distance of the format, and multiplier of the colour cache's hash.
SHORTEST = 6
LONGEST, FARTHEST, HASH = 4096, (1 << 20) - 120, 0x1E35A7BD

# Fixed values of the format: the order of code-length code lengths.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

# Fixed values of the format: (x, y) of the 120 short distances.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads a byte string from the least significant bit."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out


def _mirror(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    k = np.arange(1 << bits, dtype=np.int32)
    return sum((k >> i & 1) << (bits - 1 - i) for i in range(bits)) if bits else k


MIRROR = _mirror(15)


class Code:
    """A canonical prefix code: symbol * 16 + length by the next `width` bits, first bit lowest."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.width = 0
        self.lookup: list[int] | None = None
        if self.only is not None:
            self.table = np.array([self.only << 4], np.int32)
            self.cached = self.only >= 280
            return
        self.cached = int(used[-1]) >= 280
        ls = lengths[used].astype(np.int32)
        if int((1 << (15 - ls)).sum()) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.width = int(ls.max())
        order = np.argsort(ls, kind="stable")
        ls = ls[order]
        ranked = np.repeat((used[order].astype(np.int32) << 4) + ls, 1 << (self.width - ls))
        self.table = ranked[MIRROR[: 1 << self.width] >> (15 - self.width)]

    def plain(self) -> list[int]:
        if self.lookup is None:
            self.lookup = self.table.tolist()
        return self.lookup

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        entry = self.plain()[bits.peek(self.width)]
        bits.read(entry & 15)
        return entry >> 4

    def at(self, words: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Entries at bit places, from the 32 bits at each byte."""
        if not self.width:
            return np.full(len(place), self.table[0], np.int32)
        return self.table[words[place >> 3] >> (place & 7).astype(np.uint32) & np.uint32((1 << self.width) - 1)]


@lru_cache(512)
def code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def short_words(lengths: tuple[int, ...]) -> list[int]:
    """Canonical words of a code of few symbols and at most seven bits, to be written from the lowest bit."""
    out, word = [0] * len(lengths), 0
    for n in range(1, 8):
        for s, own in enumerate(lengths):
            if own == n:
                out[s] = int(f"{word:0{n}b}"[::-1], 2)
                word += 1
        word <<= 1
    return out


@lru_cache(4096)
def short_code(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    """A code of few symbols as a list by its next bits, symbol * 16 + length, and the mask of those bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return [(used[0] if used else 0) << 4], 0
    if sum(1 << (7 - lengths[s]) for s in used) != 1 << 7:
        raise ValueError("not a complete prefix code")
    width = max(lengths)
    table, words = [0] * (1 << width), short_words(lengths)
    for s in used:
        for k in range(words[s], 1 << width, 1 << lengths[s]):
            table[k] = s << 4 | lengths[s]
    return table, (1 << width) - 1


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        for s in [bits.read(8 if wide else 1), *([bits.read(8)] if n == 2 else [])]:
            lengths[s] = 1
        return code_of(lengths.tobytes())
    inner, n = [0] * 19, bits.read(4) + 4
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7)
    bits.at += 3 * n
    for k in range(n):
        inner[CODE_LENGTH_ORDER[k]] = ahead >> 3 * k & 7
    table, mask = short_code(tuple(inner))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    if not mask and table[0] >> 4 < 16:
        lengths[: min(left, size)] = table[0] >> 4
        return code_of(lengths.tobytes())
    first, out = bits.at, []
    # fourteen bits a symbol at most: enough of the stream as one number
    ahead = int.from_bytes(bits.data[first >> 3 : (first >> 3) + 2 * min(left, size) + 8], "little") >> (first & 7)
    used = 0
    while at < size and left:
        left -= 1
        entry = table[ahead & mask]
        n = entry & 15
        s, ahead, used = entry >> 4, ahead >> n, used + n
        if s < 16:
            out.append(s)
            at += 1
            last = s or last
            continue
        n = 2 if s == 16 else 3 if s == 17 else 7
        k = (ahead & ((1 << n) - 1)) + (11 if s == 18 else 3)
        ahead, used = ahead >> n, used + n
        out += [last if s == 16 else 0] * k
        at += k
    bits.read(0)
    bits.at = first + used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    if at <= size:
        lengths[:at] = out
    if at > size:
        raise ValueError("too many code lengths")
    return code_of(lengths.tobytes())


def _extra(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: uint32 ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, tiles, across = 1, 0, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        tiles = read_image(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
        groups = int(tiles.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and main and total >= FEW:
        return _resolve(*_symbols(bits, codes[0], total), cache_bits, width)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift, at, filled = 32 - cache_bits, 0, 0

    def remember(upto: int) -> None:
        for p in range(filled, upto):
            cache[(HASH * out[p] & 0xFFFFFFFF) >> shift] = out[p]

    green, red, blue, alpha, dist = codes[0]
    while at < total:
        if tiles is not None:
            green, red, blue, alpha, dist = codes[int(tiles[(at // width >> block) * across + (at % width >> block)])]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _extra(bits, s - 256)
            d = _extra(bits, dist.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = SHORT_DISTANCES[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a reference leaves the image")
            for p in range(at, at + n):
                out[p] = out[p - d]
            at += n
        else:
            remember(at)
            filled = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _prefixed(symbol: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance symbols whose extra bits begin at `at`, and how many those are."""
    n = EXTRA[symbol]
    extra = words[at >> 3] >> (at & 7).astype(np.uint32) & MASKS[n]
    return BASE[symbol] + extra.astype(np.int32), n


#: Of the prefix symbols 0 to 39: extra bits, and the least value; and masks of so many bits.
EXTRA = np.array([max(0, (k - 2) >> 1) for k in range(40)], np.int32)
BASE = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)], np.int32)
MASKS = np.array([(1 << k) - 1 for k in range(20)], np.uint32)
_EIGHT = np.arange(8, dtype=np.uint32)


def _symbols(bits: Bits, codes: list[Code], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the last image of a stream: green symbols, the other channels of literals (one value if they never
    change), lengths and distance codes of references (1 and 0 elsewhere). `total`: its pixels."""
    raw = np.frombuffer(bits.data, np.uint8)
    end, found, pixels = 8 * len(raw), [], 0
    green, red, blue, alpha, dist = codes
    rest = sum((c.only or 0) << shift for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if not c.width)
    others = [(c, shift) for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.width]
    while pixels < total:
        if bits.at >= end and any(c.width for c in codes[:4]):
            raise ValueError("the stream ends early")
        first = bits.at >> 3
        part = np.concatenate([raw[first : first + (STRETCH >> 3) + 32], np.zeros(12, np.uint8)])
        words = np.ndarray(len(part) - 3, "<u4", part.tobytes(), 0, (1,))  # the 32 bits that begin at each byte
        n = min(STRETCH, 8 * (len(part) - 12))
        if green.width:
            entry = green.table.take((words[: n >> 3, None] >> _EIGHT & np.uint32((1 << green.width) - 1)).ravel(), mode="clip")  # all are within; this asks no more
        else:
            entry = np.full(n, green.table[0], np.int32)
        after = np.arange(n, dtype=np.int32) + (entry & 15)
        pixel = None
        if others:
            pixel = np.zeros(n, np.uint32)
            for code, shift in others:
                own = code.at(words, after)
                pixel |= (own >> 4).astype(np.uint32) << np.uint32(shift)
                after += own & 15
        refs = np.flatnonzero(entry >= 256 << 4)
        if green.cached:
            refs = refs[entry[refs] < 280 << 4]
        own = entry[refs]
        place = refs.astype(np.int32) + (own & 15)
        length, extra = _prefixed((own >> 4) - 256, place, words)
        place += extra
        own = dist.at(words, place)
        place += own & 15
        far, extra = _prefixed(own >> 4, place, words)
        after[refs] = place + extra
        if others:
            cached = np.flatnonzero(entry >= 280 << 4)
            after[cached] = cached + (entry[cached] & 15)
        p = bits.at & 7
        if after[p] == p:  # symbols without bits: a single colour
            starts = np.full(total - pixels, p, np.int32)
        else:
            once = np.empty(n + 1, np.int64)  # as wide as an index, which is not converted then
            np.minimum(after, n, out=once[:-1])
            once[-1] = n
            twice = once.take(once, mode="clip")
            found_at: list[int] = []
            four, note = memoryview(twice.take(twice, mode="clip")), found_at.append
            while p < n:  # every fourth symbol; those between them are one, two and three steps on
                note(p)
                p = four[p]
            starts = np.empty((len(found_at), 4), np.int32)
            starts[:, 0] = found_at
            starts[:, 1], starts[:, 2] = once[starts[:, 0]], twice[starts[:, 0]]
            starts[:, 3] = once[starts[:, 2]]
            starts = starts.ravel()
            while starts[-1] >= n:
                starts = starts[:-1]
            p = int(after[starts[-1]])
        here = starts
        symbol = entry[here] >> 4
        count, back = np.ones(len(here), np.int32), np.zeros(len(here), np.int32)
        met = np.flatnonzero((symbol >= 256) & (symbol < 280))
        if len(met):
            at = np.searchsorted(refs, here[met])
            count[met], back[met] = length[at], far[at]
        upto = pixels + np.cumsum(count, dtype=np.int64)
        last = int(np.searchsorted(upto, total))
        if last < len(here):
            p = int(after[here[last]])
            here, symbol, count, back = here[: last + 1], symbol[: last + 1], count[: last + 1], back[: last + 1]
        pixels = int(upto[len(here) - 1])
        found.append((symbol, np.full(1, rest, np.uint32) if pixel is None else pixel[here] | np.uint32(rest), count, back))
        bits.at = 8 * first + p
    if bits.at > end or pixels > total:
        raise ValueError("the stream ends early")
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """The distances that the short codes stand for."""
    return np.array([1, *(max(1, x + y * width) for x, y in SHORT_DISTANCES)], np.int32)


def _resolve(symbol: np.ndarray, others: np.ndarray, length: np.ndarray, far: np.ndarray, cache_bits: int, width: int) -> np.ndarray:
    """ARGB of all pixels from the symbols: references copy what came before, cache symbols take the last of a slot."""
    odd = np.flatnonzero(symbol >= 256)
    rest, unit, values = others[0], 1, symbol.astype(np.uint8)
    if cache_bits or len(others) == len(symbol) > 1:
        rest, unit, values = np.uint32(0), 4, values.astype(np.uint32) << np.uint32(8) | others
    if not len(odd):
        return values if unit == 4 else values.astype(np.uint32) << np.uint32(8) | rest
    far = far[odd]
    back = np.where(far > 120, far - 120, _near(width)[np.minimum(far, 120)])
    keep = np.ones(len(symbol), bool)
    keep[odd] = False
    plain = values[keep].tobytes()
    before = ((odd - np.arange(len(odd))) * unit).tolist()  # bytes of literals ahead of each
    lengths, backs = (length[odd] * unit).tolist(), (back * unit).tolist()
    out, at = bytearray(), 0
    if cache_bits:
        _with_cache(out, plain, before, lengths, backs, symbol[odd].tolist(), cache_bits)
        at = before[-1]
    else:
        for upto, n, d in zip(before, lengths, backs, strict=True):
            if at < upto:
                out += plain[at:upto]
                at = upto
            start = len(out) - d
            if start < 0:
                raise ValueError("a reference leaves the image")
            if d >= n:
                out += out[start : start + n]
            else:
                out += (out[start:] * (n // d + 1))[:n]
    out += plain[at:]
    if unit == 4:
        return np.frombuffer(bytes(out), np.uint32)
    return np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8) | rest


def _with_cache(out: bytearray, plain: bytes, before: list[int], lengths: list[int], backs: list[int], symbols: list[int], cache_bits: int) -> None:
    """References and cache symbols in turn, in pixels of four bytes; the cache is brought up to date when it is asked."""
    cache, shift, filled, at = [b"\0\0\0\0"] * (1 << cache_bits), 32 - cache_bits, 0, 0
    for upto, n, d, s in zip(before, lengths, backs, symbols, strict=True):
        out += plain[at:upto]
        at = upto
        if s >= 280:
            for p in range(filled, len(out), 4):
                own = bytes(out[p : p + 4])
                cache[(HASH * int.from_bytes(own, "little") & 0xFFFFFFFF) >> shift] = own
            filled = len(out)
            out += cache[s - 280]
            continue
        start = len(out) - d
        if start < 0:
            raise ValueError("a reference leaves the image")
        out += out[start : start + n] if d >= n else (out[start:] * (n // d + 1))[:n]


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) int: alpha, red, green, blue."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _pack(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _select(left: list[int], top: list[int], corner: list[int]) -> list[int]:
    """The neighbour nearer to left + top - corner, by the sum of absolute differences."""
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


def predict(mode: int, left: list[int], top: list[int], corner: list[int], beyond: list[int]) -> list[int]:
    """The predicted ARGB channels from the pixels to the left, above, above left and above right."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda x: min(255, max(0, x))
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return beyond
        case 4:
            return corner
        case 5:
            return mean(mean(left, beyond), top)
        case 6:
            return mean(left, corner)
        case 7:
            return mean(left, top)
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, beyond)
        case 10:
            return mean(mean(left, corner), mean(top, beyond))
        case 11:
            return _select(left, top, corner)
        case 12:
            return [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
        case 13:
            return [clip(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def undo_predictor(argb: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    modes = (modes >> 8 & 0xF).tolist()
    if set(modes) in ({1}, {2}):  # the left or the upper neighbour throughout: running sums
        whole = _channels(argb).reshape(height, width, 4)
        whole[0, 0, 0] += 255
        if modes[0] == 1:
            whole[:, 0] = np.cumsum(whole[:, 0], axis=0)
            return _pack(np.cumsum(whole, axis=1).reshape(-1, 4))
        whole[0] = np.cumsum(whole[0], axis=0)
        return _pack(np.cumsum(whole, axis=0).reshape(-1, 4))
    c = _channels(argb).tolist()
    for p, own in enumerate(c):
        y, x = divmod(p, width)
        if not p:
            guess = [255, 0, 0, 0]
        elif not y:
            guess = c[p - 1]
        elif not x:
            guess = c[p - width]
        else:
            guess = predict(modes[(y >> block) * across + (x >> block)], c[p - 1], c[p - width], c[p - width - 1], c[p - width + 1])
        c[p] = [(a + b) & 255 for a, b in zip(own, guess, strict=True)]
    return _pack(np.array(c, np.int64).reshape(-1, 4))


def undo_cross_colour(argb: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    signed = lambda x: (x + 128) % 256 - 128
    y, x = np.divmod(np.arange(width * height), width)
    f = _channels(factors)[(y >> block) * -(-width >> block) + (x >> block)]
    c = _channels(argb)
    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (signed(f[:, 3]) * green >> 5)) & 255
    c[:, 3] = (c[:, 3] + (signed(f[:, 2]) * green >> 5) + (signed(f[:, 1]) * signed(c[:, 1]) >> 5)) & 255
    return _pack(c)


def undo_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _pack(c)


def undo_palette(argb: np.ndarray, width: int, height: int, bundle: int, palette: np.ndarray) -> np.ndarray:
    """bundle: the power of two of pixels in one green sample."""
    index = (argb >> 8 & 0xFF).reshape(height, -1)
    if bundle:
        n, bits = 1 << bundle, 8 >> bundle
        index = (index[:, :, None] >> (bits * np.arange(n, dtype=np.uint32)) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].ravel()


def decode_all(data: bytes) -> np.ndarray:
    """The pixels of files of one width that stand one after the other."""
    out = []
    while data:
        size = 8 + int.from_bytes(data[4:8], "little")
        out.append(decode(data[:size]))
        data = data[size:]
    return np.concatenate(out)


def decode(data: bytes) -> np.ndarray:
    """The (height, width) uint32 ARGB pixels of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            sub = read_image(bits, -(-now >> block), -(-height >> block), False)
            undo.append((undo_predictor if kind == 0 else undo_cross_colour, (now, height, block, sub)))
        elif kind == 2:
            undo.append((undo_green, ()))
        else:
            n = bits.read(8) + 1
            palette = _pack(np.cumsum(_channels(read_image(bits, n, 1, False)), axis=0))
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (now, height, bundle, palette)))
            now = -(-now >> bundle)
    argb = read_image(bits, now, height, True)
    for step, how in reversed(undo):
        argb = step(argb, *how)
    return argb.reshape(height, width)


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a complete prefix code for these frequencies, none over the limit (one symbol: 1, unused ones: 0)."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    weight = [counts[i] for i in used]
    while True:
        heap = sorted([w << 13 | i for i, w in enumerate(weight)])  # weight and number in one
        parent, made, last = [0] * (2 * len(used) - 1), len(used), 2 * len(used) - 1
        pop, swap = heapq.heappop, heapq.heapreplace
        while made < last:
            a = pop(heap)
            b = heap[0]
            parent[a & 8191] = parent[b & 8191] = made
            swap(heap, ((a >> 13) + (b >> 13)) << 13 | made)
            made += 1
        depth = [0] * made
        for i in range(made - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            break
        weight = [(w >> 1) + 1 for w in weight]  # flatter until it fits
    for k, i in enumerate(used):
        out[i] = depth[k]
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code's words, to be written from the lowest bit."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    ls = lengths[used]
    order = np.argsort(ls, kind="stable")
    span = 1 << (15 - ls[order])
    out[used[order]] = MIRROR[np.cumsum(span) - span]  # the word at the head of fifteen bits, turned round
    return out


class Sink:
    """Bits in the order of the format: numbers and their widths, packed at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.widths: list[int] = []

    def put(self, value: int, width: int) -> None:
        self.values.append(value)
        self.widths.append(width)

    def array(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.flush()
        self.parts.append((values.astype(np.int64), widths.astype(np.int64)))

    def flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.widths, np.int64)))
            self.values, self.widths = [], []

    def one(self, symbol: int) -> None:
        """The code of a single symbol below 256, which then takes no bits."""
        self.put(5 | symbol << 3, 11)

    def code(self, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Writes a prefix code for these frequencies; gives words and lengths (a single symbol takes no bits)."""
        used = [i for i, c in enumerate(counts) if c] or [0]
        lengths = np.zeros(len(counts), np.int64)
        if len(used) <= 2 and used[-1] < 256:
            self.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
            for s in used:
                self.put(s, 8)
            if len(used) == 2:
                lengths[used] = 1
            words = np.zeros(len(counts), np.int64)
            words[used[-1]] = len(used) - 1
            return words, lengths
        lengths[:] = code_lengths(counts, 15)
        runs = _runs(lengths)
        inner_counts = [0] * 19
        for s, _, _ in runs:
            inner_counts[s] += 1
        plain = code_lengths(inner_counts, 7)
        words = short_words(tuple(plain))
        n = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if plain[s]) + 1)
        self.put((n - 4) << 1, 5)
        self.values += [plain[s] for s in CODE_LENGTH_ORDER[:n]]
        self.widths += [3] * n
        self.put(0, 1)
        single = sum(1 for c in inner_counts if c) == 1
        widths = [0] * 19 if single else plain
        self.values += [words[s] | extra << widths[s] for s, extra, _ in runs]
        self.widths += [widths[s] + bits for s, _, bits in runs]
        return code_words(lengths), lengths

    def bytes(self) -> bytes:
        """All numbers side by side: each one is put where it begins in 64-bit words and, where it goes over, in the next."""
        self.flush()
        values, widths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(widths)
        begin = ends - widths
        total = int(ends[-1])
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        own = (values * (widths > 0)).astype(np.uint64)
        out = np.zeros((total >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # numbers share a word with their neighbours
        out[word[first]] = np.bitwise_or.reduceat(own << shift, first)
        over = np.flatnonzero((begin & 63) > 64 - widths)
        out[word[over] + 1] |= own[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (total + 7) >> 3]


def _runs(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as symbols with extra bits: 16 repeats the last one, 17 and 18 are zeros."""
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]
    out, last = [], 8
    for a, b in zip(starts, ends, strict=True):
        value, n = int(lengths[a]), b - a
        if not value:
            while n >= 11:
                k = min(n, 138)
                out.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                out.append((17, n - 3, 3))
                n = 0
        else:
            if value != last:
                out.append((value, 0, 0))
                n -= 1
            last = value
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
        out += [(value, 0, 0)] * n
    return out


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = value - 1
    n = np.maximum(0, np.frexp(v.astype(np.float64))[1] - 2)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


#: What _prefix() gives for values below 2^14, which are most.
_PREFIXES = _prefix(np.arange(1, 1 << 14))


def _symbol_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distances from 1."""
    if len(value) and value.max() >= 1 << 14:
        return _prefix(value)
    return tuple(x[value - 1] for x in _PREFIXES)


def references(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references in 8-bit pixels: places, lengths, distances. Greedy, to the last place with the same SHORTEST."""
    n = len(pixels)
    none = np.zeros(0, np.int64)
    if n < 2 * SHORTEST:
        return none, none, none
    raw = pixels.tobytes()
    wide = np.ndarray(n - SHORTEST + 1, "<u8", raw + bytes(8), 0, (1,)) & np.uint64((1 << 8 * SHORTEST) - 1)
    m = len(wide)
    with np.errstate(over="ignore"):
        key = wide * np.uint64(0x9E3779B97F4A7C15) & ~np.uint64((1 << 20) - 1) | np.arange(m, dtype=np.uint64)  # 44 bits of a hash, the place
    key.sort()
    place = (key & np.uint64((1 << 20) - 1)).astype(np.int32)
    key >>= np.uint64(20)
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return none, none, none
    here, there = place[same + 1], place[same]
    alike = wide[here] == wide[there]
    last = np.full(m, -1, np.int32)
    last[here[alike]] = there[alike]
    following = np.where(last >= 0, np.arange(m, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(following[::-1])[::-1]  # the next place that has one
    # how far each goes on after SHORTEST, up to eight: equal low bytes of the next eight
    ahead = np.ndarray(n + 1, "<u8", raw + bytes(8), 0, (1,))
    behind = np.flatnonzero(last >= 0)
    unlike = ahead[behind + SHORTEST] ^ ahead[last[behind] + SHORTEST]
    longer = np.zeros(m, np.uint8)
    longer[behind] = np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)) >> 3
    back, go, more = memoryview(last), memoryview(np.ascontiguousarray(following)), memoryview(longer)
    starts, sizes, i, final = [], [], 0, m
    while i < final:
        i = go[i]
        if i == n:
            break
        j = back[i]
        if i - j > FARTHEST:
            i += 1
            continue
        k, most = more[i], n - i if n - i < LONGEST else LONGEST
        k += SHORTEST
        if k >= most:
            k = most
        elif k == SHORTEST + 8:
            while k + 16 <= most and raw[i + k : i + k + 16] == raw[j + k : j + k + 16]:  # a long one: by sixteens
                k += 16
            while k < most and raw[i + k] == raw[j + k]:
                k += 1
        starts.append(i)
        sizes.append(k)
        i += k
    if not starts:
        return none, none, none
    at = np.array(starts, np.int64)
    return at, np.array(sizes, np.int64), at - last[at]


def _bits_of(counts: np.ndarray) -> float:
    """What symbols of these frequencies take with an ideal code."""
    c = counts[counts > 0].astype(np.float64)
    if not len(c):
        return 0.0
    n = float(c.sum())
    return n * math.log2(n) - float(c @ np.log2(c))


def _cached(pixels: np.ndarray, literal: np.ndarray, bits: int, alpha: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places `literal` can be taken from a colour cache of 2^bits slots, and the slot of each pixel value."""
    colours = np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(alpha << 24)
    slot = ((colours * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.uint16)
    own = slot[pixels]
    order = np.argsort(own, kind="stable")
    hit = np.zeros(len(pixels), bool)
    ranked, values = own[order], pixels[order]
    hit[order[1:]] = (ranked[1:] == ranked[:-1]) & (values[1:] == values[:-1])
    return hit[literal], slot


#: Sizes of the colour cache that are tried, and bytes by which a predictor is taken into consideration.
CACHES, SAMPLE = (2, 1, 4), 1024


@lru_cache(64)
def _short_codes(width: int) -> np.ndarray:
    """The codes of all distances up to the last that has a short one: the first of these, or 120 more."""
    near: dict[int, int] = {}
    for code, (x, y) in enumerate(SHORT_DISTANCES, 1):
        near.setdefault(max(1, x + y * width), code)
    return np.array([near.get(d, d + 120) for d in range(max(near) + 1)], np.int64)


def _write_pixels(sink: Sink, pixels: np.ndarray, width: int, alpha: int) -> None:
    """The main image: green samples, every other channel constant."""
    at, length, back = references(pixels)
    edge = np.zeros(len(pixels) + 1, np.int8)
    edge[at] += 1
    edge[at + length] -= 1
    literal = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    value = pixels[literal]
    symbol, bits = value.astype(np.int64), 0
    best = plain = _bits_of(np.bincount(value, minlength=256))
    for b in CACHES:
        hit, slot = _cached(pixels, literal, b, alpha)
        own = slot[value].astype(np.int64)
        cost = _bits_of(np.bincount(np.where(hit, 256 + own, value), minlength=256 + (1 << b))) + 5 * (1 << b) + 4
        if cost < best:
            best, bits, symbol = cost, b, np.where(hit, 280 + own, value)
        if cost > 1.02 * plain:  # other sizes differ little
            break
    near = _short_codes(width)
    far = np.where(back < len(near), near[np.minimum(back, len(near) - 1)], back + 120)
    ls, le, ln = _symbol_of(length)
    ds, de, dn = _symbol_of(far)
    sink.put(1 | bits << 1 if bits else 0, 5 if bits else 1)
    sink.put(0, 1)
    counts = np.bincount(np.concatenate([symbol, 256 + ls]), minlength=280 + (1 << bits if bits else 0))
    words, widths = sink.code(counts.tolist())
    for only in (0, 0, alpha):
        sink.one(only)
    dist_words, dist_widths = sink.code(np.bincount(ds, minlength=40).tolist())
    # one entry for a literal, two for a reference (the length with its extra bits, the distance with its), in order
    count = np.zeros(len(pixels), np.int8)
    count[literal], count[at] = 1, 2
    place = np.cumsum(count, dtype=np.int64) - count
    total = len(literal) + 2 * len(at)
    values, sizes = np.zeros(total, np.int64), np.zeros(total, np.int64)
    there = place[literal]
    values[there], sizes[there] = words[symbol], widths[symbol]
    there = place[at]
    for k, (word, width_, extra, n) in enumerate(((words[256 + ls], widths[256 + ls], le, ln), (dist_words[ds], dist_widths[ds], de, dn))):
        values[there + k], sizes[there + k] = word | extra << width_, width_ + n
    sink.array(values, sizes)


def _simple_image(sink: Sink, green: int) -> None:
    """A sub-image of one colour."""
    sink.put(0, 1)
    for only in (green, 0, 0, 0, 0):
        sink.one(only)


def _file(payload: np.ndarray, height: int, mode: int) -> bytes:
    """One image; mode: 0 without a predictor, 1 with the left, 2 with the upper neighbour throughout."""
    sink = Sink()
    sink.put(ROW - 1, 14)
    sink.put(height - 1, 14)
    sink.put(0, 4)
    used = np.flatnonzero(_occurring(payload))
    bundle = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1 if len(used) <= 16 else 0
    pixels, width, alpha = payload, ROW, 255
    if bundle:
        sink.put(1 | 3 << 1, 3)
        sink.put(len(used) - 1, 8)
        steps = np.diff(used, prepend=0)
        sink.put(0, 1)
        words, widths = sink.code(np.bincount(steps, minlength=280).tolist())
        sink.one(0)
        sink.one(0)
        sink.code([int(k == 255 or (k == 0 and len(used) > 1)) for k in range(256)])
        sink.one(0)
        opaque = (np.arange(len(used)) == 0).astype(np.int64)  # entries are differences: the first one brings the alpha
        sink.array(np.stack([words[steps], opaque], axis=1).ravel(), np.stack([widths[steps], np.full(len(used), int(len(used) > 1))], axis=1).ravel())
        rank = np.zeros(256, np.uint8)
        rank[used] = np.arange(len(used))
        rows = rank[payload].reshape(-1, 1 << bundle)
        pixels = np.bitwise_or.reduce(rows << ((8 >> bundle) * np.arange(1 << bundle, dtype=np.uint8)), axis=1)
        width >>= bundle
    elif mode:
        sink.put(1, 3)
        sink.put(7, 3)
        _simple_image(sink, mode)
        pixels, alpha = _residues(payload, height, mode), 0
    sink.put(0, 1)
    _write_pixels(sink, pixels, width, alpha)
    body = b"\x2f" + sink.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


#: Samples that are counted as wide numbers, which takes eight times their memory.
SMALL = 1 << 16


def _occurring(samples: np.ndarray) -> np.ndarray:
    """Which of the 256 values occur."""
    if len(samples) <= SMALL:
        return np.bincount(samples, minlength=256) > 0
    out = np.zeros(256, bool)
    out[samples] = True
    return out


def _residues(payload: np.ndarray, height: int, mode: int) -> np.ndarray:
    """What the left (1) or upper (2) neighbour leaves; the first row has left, the first column upper neighbours only."""
    p = payload.reshape(height, ROW)
    out = p.copy()
    left, top = p[:, 1:] - p[:, :-1], p[1:] - p[:-1]
    out[0, 1:], out[1:, 0] = left[0], top[:, 0]
    if mode == 1:
        out[1:, 1:] = left[1:]
    else:
        out[1:, 1:] = top[:, 1:]
    return out.ravel()


def encode(payload: np.ndarray) -> bytes:
    """Files with the bytes (a positive multiple of 64 of them) as green samples, one for every IMAGE bytes."""
    out = []
    for at in range(0, len(payload), IMAGE):
        part = payload[at : at + IMAGE]
        height = len(part) // ROW
        tries, some = [0], part[: SAMPLE]
        plain = _bits_of(np.bincount(some, minlength=256))
        for mode in (1, 2):  # a predictor is tried where it makes the first samples alone simpler; the whole file's size decides
            if _bits_of(np.bincount(_residues(some, len(some) // ROW, mode), minlength=256)) < plain:
                tries.append(mode)
        out.append(min((_file(part, height, m) for m in tries), key=len))
    return b"".join(out)


#: Every other byte of a 64-bit word, and the factor that adds four such pairs up in the highest.
PAIRS, ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def features(samples: np.ndarray) -> str:
    """Size, sum, distinct samples, and a 64-bit average hash of an 8 x 8 grid, from 8-bit samples (height, width)."""
    h, w = samples.shape
    ys, xs = np.arange(9) * h // 8, np.arange(9) * w // 8
    if w == ROW:  # a cell is eight bytes wide: they are summed within 64-bit words
        word = np.frombuffer(samples.tobytes(), "<u8")
        word = (word & PAIRS) + (word >> np.uint64(8) & PAIRS)
        with np.errstate(over="ignore"):
            word = word * ONES >> np.uint64(48)
        cell = np.add.reduceat(word.astype(np.int64).reshape(h, 8), ys[:-1], axis=0)
        if h < 8:  # reduceat takes a row for a band of none
            cell[ys[:-1] == ys[1:]] = 0
    else:
        bands = np.stack([samples[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(ys[:-1], ys[1:], strict=True)])
        cell = np.stack([bands[:, a:b].sum(axis=1) for a, b in zip(xs[:-1], xs[1:], strict=True)], axis=1)
    total = int(cell.sum())
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    bright = (cell * h * w > total * area).ravel()
    return f"{w}x{h}/{total}/{np.count_nonzero(_occurring(samples.ravel()))}/{int(np.packbits(bright).view('>u8')[0]):016x}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            ids, size, media = [], [], []
            for i, text in zip(batch.column("doc_id").slice(at, TEXTS).to_pylist(), batch.column("text").slice(at, TEXTS), strict=True):
                raw = (text.as_py() or "").encode()
                ids.append(i)
                size.append(len(raw))
                media.append(encode(np.frombuffer(raw + bytes(-len(raw) % ROW if raw else ROW), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        got = []
        for value in batch.column("media"):
            media = value.as_py()
            samples = (decode_all(media) >> np.uint32(8)).astype(np.uint8)
            payload = samples.tobytes()
            got.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        columns = list(zip(*got, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each whole text as a lossless WebP file."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Decode the media column and digest payloads, files and pixels."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(table(spark, sf_dir, "documents")))
