"""Lossless WebP: a reader for the whole format, a writer, and documents stored as images.

The reader decodes prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. An image is an array of pixels
(alpha << 24 | red << 16 | green << 8 | blue). The length of a literal pixel's code is found for
every bit position at once, and only the walk from token to token is sequential; copies and cached
colours are then followed as pointers. The writer tries the same steps on every image and keeps
the smallest file.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .textkernel import as_bytes

# Fixed values of the format: the order of code-length code lengths, and the plane offsets of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Payload bytes of one image: 16384 rows of 16 pixels. A longer payload is several images in a row.
IMAGE_BYTES = 16384 * 64
#: Longest prefix code that the writer makes.
MAX_CODE = 12
#: Most pixels of one copy, and the farthest that one goes back.
MOST_COPIED, FARTHEST = 4096, (1 << 20) - 120
#: Pixels of a match after which, if no copy pays, none is looked for within it.
LONG = 16
#: Fewest and most bits of the writer's colour cache, and what it takes a copy (beside the bits of its numbers), a cached colour and a used symbol of a code to cost.
LEAST_CACHE, MOST_CACHE, COPY_BITS, CACHED_BITS, SYMBOL_BITS = 4, 10, 10, 8.0, 4.0
#: What further symbols of a code cost, and the share of an image's bits (one in so many) that copies or a cache must spare beyond that to be worth their time.
TABLE_BITS, WORTH = 48.0, 24
#: One code serves red, blue and alpha where that takes less than so many times the bits of three: it is read once.
SHARED = 1.03
#: Offsets that keep the counts of four channels apart.
_CHANNEL = np.arange(0, 1024, 256)

_reversal: dict[int, np.ndarray] = {}


def _reverse(bits: int) -> np.ndarray:
    if bits not in _reversal:
        out, x = np.zeros(1 << bits, np.int64), np.arange(1 << bits)
        for _ in range(bits):
            out, x = out << 1 | (x & 1), x >> 1
        _reversal[bits] = out
    return _reversal[bits]


class PrefixCode:
    """A canonical prefix code as a lookup table over the next bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = lengths.nonzero()[0]
        if len(used) <= 1:
            self.bits, self.symbols, self.sizes = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.uint8)
        else:
            n = lengths[used].astype(np.int64)
            order = np.argsort(n, kind="stable")
            self.bits = int(n[order[-1]])
            spread = np.repeat(used[order], 1 << (self.bits - n[order]))
            if len(spread) != 1 << self.bits:
                raise ValueError("incomplete or oversubscribed prefix code")
            self.symbols = spread.take(_reverse(self.bits))
            self.sizes = lengths.astype(np.uint8).take(self.symbols)
        self.mask = (1 << self.bits) - 1
        #: Sizes, with 128 more where the next bits are a copy or a place of the cache.
        self.marked = self.sizes.astype(np.int64)
        self.plain = not len(used) or used[-1] < 256
        if not self.plain:
            self.marked[self.symbols >= 256] += 128

    def read(self, bits: BitReader) -> int:
        at = bits.window[bits.at] & self.mask
        bits.at += int(self.sizes[at])
        return int(self.symbols[at])


def _small_code(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
    """A prefix code of few symbols: (symbol, size) of the next bits, and the mask of these."""
    used = sorted((n, k) for k, n in enumerate(lengths) if n)
    if len(used) <= 1:
        return [(used[0][1] if used else 0, 0)], 0
    bits = used[-1][0]
    table: list[tuple[int, int]] = [(0, 0)] * (1 << bits)
    turned, at = _reversed_list(bits), 0
    for n, k in used:
        if at >= 1 << bits:
            break
        table[turned[at] :: 1 << n] = [(k, n)] * (1 << (bits - n))
        at += 1 << (bits - n)
    if at != 1 << bits or sum(1 << (bits - n) for n, _ in used) != 1 << bits:
        raise ValueError("incomplete or oversubscribed prefix code")
    return table, (1 << bits) - 1


@functools.cache
def _reversed_list(bits: int) -> list[int]:
    return _reverse(bits).tolist()


class BitReader:
    """Bits from the least significant of each byte up; ``window`` has the next 16 from every position."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint32)
        wide = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        self.windows = (wide[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel()
        self.window = self.windows.data
        self.data, self.at, self.end = data, 0, len(data) * 8
        self.last: dict[int, tuple[int, int, PrefixCode]] = {}

    def span(self, at: int, n: int) -> int:
        """The n bits from a position on, zeros beyond the end."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out, got = 0, 0
        while n - got > 0:
            k = min(n - got, 15)
            out |= (self.window[self.at] & ((1 << k) - 1)) << got
            self.at += k
            got += k
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return out


def read_code(bits: BitReader, size: int, known: dict[bytes, PrefixCode]) -> PrefixCode:
    """Read one prefix code for an alphabet of ``size`` symbols; equal codes are built once.

    The same bits as those of the last code of that size say the same, so they are not read again.
    """
    begin = bits.at
    if size in bits.last:
        value, n, code = bits.last[size]
        if begin + n <= bits.end and bits.span(begin, n) == value:
            bits.at += n
            return code
    code = _read_code(bits, size, known)
    if bits.at <= bits.end:
        bits.last[size] = (bits.span(begin, bits.at - begin), bits.at - begin, code)
    return code


def _read_code(bits: BitReader, size: int, known: dict[bytes, PrefixCode]) -> PrefixCode:
    if bits.read(1):
        two, one = bits.read(1), np.zeros(max(size, 256), np.int64)
        one[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            one[bits.read(8)] = 1
        return PrefixCode(one)
    first, told = [0] * 19, 4 + bits.read(4)
    value = bits.span(bits.at, 3 * told)
    for k in LENGTH_ORDER[:told]:
        first[k] = value & 7
        value >>= 3
    bits.at += 3 * told
    (table, mask), left = _small_code(first), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    before, window, at = 8, bits.window, bits.at
    lengths: list[int] = []
    try:
        while len(lengths) < size and left:
            left -= 1
            n, size_of = table[window[at] & mask]
            at += size_of
            if n < 16:
                lengths.append(n)
                before = n or before
                continue
            value, low, extra = (before, 3, 2) if n == 16 else (0, 3, 3) if n == 17 else (0, 11, 7)
            lengths += [value] * (low + (window[at] & ((1 << extra) - 1)))
            at += extra
            if len(lengths) > size or at > bits.end:
                raise ValueError("code lengths run over")
    except IndexError:
        raise ValueError("the stream ends early") from None
    bits.at = at
    while lengths and not lengths[-1]:
        lengths.pop()
    key = bytes(lengths)
    if key not in known:
        known[key] = PrefixCode(np.frombuffer(key, np.uint8))
    return known[key]


def _value(symbol: int, bits: BitReader) -> int:
    """The number that a length or distance prefix stands for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _steps(w: np.ndarray, codes: list[PrefixCode], part: int = 1 << 16) -> bytes:
    """The bits of the literal pixel that begins at every position; 128 or more where the first symbol is none of a literal."""
    out = []
    for a in range(0, len(w), part):
        some = w[a : a + part + 64]
        after, sizes = np.arange(len(some)), {}
        for c in codes[:4]:
            if id(c) not in sizes:
                sizes[id(c)] = c.marked.take(some & np.uint16(c.mask))
            after += sizes[id(c)].take(after, mode="clip")
        after -= np.arange(len(some))
        out.append(after[:part].astype(np.uint8).tobytes())
    return b"".join(out)


def _tokens(bits: BitReader, codes: list[PrefixCode], n: int, width: int, cache_bits: int) -> np.ndarray:
    """n pixels of one set of codes. Literals are read by array operations, copies and places of the cache one by one."""
    # No token has more than 60 bits.
    w = bits.windows[bits.at : bits.at + 60 * n + 16]
    green, distance = codes[0], codes[4]
    step, at, k, base, top = _steps(w, codes), 0, 0, bits.at, len(w) - 1
    starts: list[int] = []
    cached: list[tuple[int, int]] = []  # pixel, place in the cache
    copied: list[tuple[int, int, int]] = []  # pixel, number, distance
    if green.plain:
        starts = [0] * n
        for k in range(n):
            starts[k] = at
            at += step[at]
            if at > top:
                raise ValueError("the stream ends early")
    else:
        window, symbols, lengths, mask = bits.window, green.symbols.data, green.sizes.data, green.mask
        while k < n:
            m = step[at]
            if m < 128:
                starts.append(at)
                at += m
                k += 1
            else:
                here = window[base + at] & mask
                s = symbols[here] - 256
                at += lengths[here]
                if s >= LENGTH_CODES:
                    cached.append((k, s - LENGTH_CODES))
                    k += 1
                else:
                    bits.at = base + at
                    made = _value(s, bits)
                    d = _value(distance.read(bits), bits)
                    if d > len(NEAR):
                        d -= len(NEAR)
                    else:
                        dx, dy = NEAR[d - 1]
                        d = max(1, dx + dy * width)
                    if d > k or k + made > n:
                        raise ValueError("a reference leaves the image")
                    copied.append((k, made, d))
                    at = bits.at - base
                    k += made
            if at > top:
                raise ValueError("the stream ends early")
    bits.at = base + at
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    p, channel = np.array(starts, np.int64), []
    for c in codes[:4]:
        here = w.take(p) & np.uint16(c.mask)
        channel.append(c.symbols.take(here).astype(np.uint32))
        p += c.sizes.take(here)
    literals = channel[3] << np.uint32(24) | channel[1] << np.uint32(16) | channel[0] << np.uint32(8) | channel[2]
    return _resolve(literals, n, cached, copied, cache_bits) if cached or copied else literals


def _resolve(literals: np.ndarray, n: int, cached: list[tuple[int, int]], copied: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray:
    """n pixels, of which some are places in the cache and some are copies.

    A copy has the value of the pixel that it came from, a cached colour that of the last pixel with
    the same place in the cache: pixels point at pixels, and pointers are followed all at once.
    """
    root = np.arange(n)
    literal = np.ones(n, bool)
    for k, made, d in copied:
        root[k : k + made] = root[k - d : k - d + made] if made <= d else np.resize(root[k - d : k], made)
        literal[k : k + made] = False
    where, place = np.array(cached, np.int64).reshape(-1, 2).T
    literal[where] = False
    values = np.zeros(n, np.uint32)
    values[literal] = literals
    if len(where):
        places, asks = np.zeros(n, np.uint16), np.zeros(n, bool)
        places[literal] = _cache_places(literals, cache_bits)
        places[where], asks[where] = place, True
        while True:
            there = places[root]
            order = np.argsort(there, kind="stable")
            there = there[order]
            new = np.concatenate(([True], there[1:] != there[:-1]))
            if not (new & asks[order]).any():
                break
            # No colour was put there yet: it holds 0, whose own place is the first.
            at = np.arange(n)
            last = np.maximum.accumulate(np.where(asks[order], -1, at))
            empty = order[asks[order] & (last < np.maximum.accumulate(np.where(new, at, 0)))]
            asks[empty], places[empty] = False, 0
        before = np.empty(n, np.int64)
        before[order[1:]] = order[:-1]
        root = np.where(asks, before, root)
    while True:
        further = root.take(root)
        if (further == root).all():
            return values.take(root)
        root = further


def _cache_places(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)


def _pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: the main one, or one that a transform needs."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("colour cache size")
    groups, tile_bits, tiles = 1, 0, None
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        tiles = (_pixels(bits, across, (height + (1 << tile_bits) - 1) >> tile_bits, False) >> np.uint32(8)).astype(np.int64) & 0xFFFF
        groups = int(tiles.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    known: dict[bytes, PrefixCode] = {}
    sets = [[read_code(bits, s, known) for s in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    n = width * height
    if groups == 1:
        return _tokens(bits, sets[0], n, width, cache_bits)
    out, cache = [0] * n, [0] * cache_size
    at, shift = 0, 32 - cache_bits
    while at < n:
        x, y = at % width, at // width
        green, red, blue, alpha, distance = sets[int(tiles[(y >> tile_bits) * across + (x >> tile_bits)]) if tiles is not None else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            made = 1
        elif s < 256 + LENGTH_CODES:
            made = _value(s - 256, bits)
            d = _value(distance.read(bits), bits)
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + made > n:
                raise ValueError("a reference leaves the image")
            for k in range(at, at + made):
                out[k] = out[k - d]
        else:
            out[at] = cache[s - 256 - LENGTH_CODES]
            made = 1
        if cache_bits:
            for k in range(at, at + made):
                cache[(CACHE_FACTOR * out[k] & 0xFFFFFFFF) >> shift] = out[k]
        at += made
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int32)


def _from_bytes(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4").reshape(channels.shape[:-1])


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """Predictions of many pixels, as bytes (blue, green, red, alpha) in the last axis."""
    mean = lambda a, b: (a & b) + ((a ^ b) >> 1)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7):
        return mean(left, top_left if mode == 6 else top)
    if mode in (8, 9):
        return mean(top, top_left if mode == 8 else top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        pixel = lambda a: a.view("<u4")

        def far(a: np.ndarray) -> np.ndarray:
            d = pixel(np.maximum(a, top_left) - np.minimum(a, top_left))
            d = (d & np.uint32(0x00FF00FF)) + (d >> np.uint32(8) & np.uint32(0x00FF00FF))
            return (d + (d >> np.uint32(16))) & np.uint32(0xFFFF)

        return np.where(far(top) < far(left), pixel(left), pixel(top)).view(np.uint8)
    if mode == 12:
        return np.clip(left.astype(np.int16) + top - top_left, 0, 255).astype(np.uint8)
    if mode == 13:
        half = mean(left, top).astype(np.int16)
        difference = half - top_left
        return np.clip(half + ((difference + (difference < 0)) >> 1), 0, 255).astype(np.uint8)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.uint8), left.shape)


def _neighbours(channels: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of every pixel (pixels x 4); zeros where there is none."""
    n = len(channels)
    wide = np.concatenate((np.zeros((width + 1, 4), np.uint8), channels))
    return wide[width : width + n], wide[1 : n + 1], wide[2 : n + 2], wide[:n]


def _edges(less: np.ndarray, channels: np.ndarray, width: int, first: np.ndarray) -> None:
    """What predictors leave (``less``) along the edges of images in a row, whose first lines are ``first``: there they are fixed."""
    given, out = channels.reshape(-1, width, 4), less.reshape(-1, width, 4)
    out[1:, 0] = given[1:, 0] - given[:-1, 0]
    out[first, 1:] = given[first, 1:] - given[first, :-1]
    out[first, 0] = given[first, 0] - np.array([0, 0, 0, 255], np.uint8)


def _unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add predictions. A pixel is one number: its bytes are added and averaged together."""
    height, width = pixels.shape
    given = pixels.ravel().tolist()
    out: list[int] = [0] * len(given)
    even, odd, seven = 0x00FF00FF, 0xFF00FF00, 0xFEFEFEFE
    shifts = (0, 8, 16, 24)

    def guess(mode: int, at: int) -> int:
        left, top = out[at - 1], out[at - width]
        if mode == 1:
            return left
        if mode == 2:
            return top
        if mode == 7:
            return (left & top) + (((left ^ top) & seven) >> 1)
        if mode == 0 or mode > 13:
            return 0xFF000000
        before = out[at - width - 1]
        if mode == 4:
            return before
        if mode == 6:
            return (left & before) + (((left ^ before) & seven) >> 1)
        if mode == 8:
            return (top & before) + (((top ^ before) & seven) >> 1)
        if mode in (3, 5, 9, 10):
            after = out[at - width + 1]
            if mode == 3:
                return after
            if mode == 9:
                return (top & after) + (((top ^ after) & seven) >> 1)
            if mode == 5:
                one, two = (left & after) + (((left ^ after) & seven) >> 1), top
            else:
                one, two = (left & before) + (((left ^ before) & seven) >> 1), (top & after) + (((top ^ after) & seven) >> 1)
            return (one & two) + (((one ^ two) & seven) >> 1)
        if mode == 11:
            to_left, to_top = 0, 0
            for s in shifts:
                b = before >> s & 255
                to_left += abs((top >> s & 255) - b)
                to_top += abs((left >> s & 255) - b)
            return left if to_left < to_top else top
        value = 0
        if mode == 13:
            left = (left & top) + (((left ^ top) & seven) >> 1)
        for s in shifts:
            a, b = left >> s & 255, before >> s & 255
            if mode == 12:
                v = a + (top >> s & 255) - b
            else:
                v = a + (((a - b) + (a < b)) >> 1)
            value |= (0 if v < 0 else 255 if v > 255 else v) << s
        return value

    at = 0
    for y in range(height):
        row = modes[y >> bits].tolist()
        for x in range(width):
            if y == 0:
                g = out[at - 1] if x else 0xFF000000
            elif x == 0:
                g = out[at - width]
            else:
                g = guess(row[x >> bits], at)
            v = given[at]
            out[at] = ((v & even) + (g & even)) & even | ((v & odd) + (g & odd)) & odd
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _predicted(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """What the predictors of the blocks (``modes``) leave of an image."""
    height, width = pixels.shape
    c = np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(-1, 4)
    around = _neighbours(c, width)
    each = modes[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].ravel()
    less = np.empty_like(c)
    for mode in np.unique(each).tolist():
        some = each == mode
        less[some] = (c - predict(mode, *around))[some]
    _edges(less, c, width, np.zeros(1, np.int64))
    return _from_bytes(less.reshape(height, width, 4))


def _cross(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Cross-colour: sign 1 inverts, -1 applies."""
    height, width = pixels.shape
    c = _bytes_of(pixels)
    m = _bytes_of(elements)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v.astype(np.int32) & 255 ^ 128) - 128
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    red = (c[..., 2] + sign * delta(m[..., 0], c[..., 1])) & 255
    seen = red if sign > 0 else c[..., 2]
    blue = (c[..., 0] + sign * (delta(m[..., 1], c[..., 1]) + delta(m[..., 2], seen))) & 255
    return _from_bytes(np.stack([blue, c[..., 1], red, c[..., 3]], -1))


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _bytes_of(pixels)
    c[..., 0] = (c[..., 0] + sign * c[..., 1]) & 255
    c[..., 2] = (c[..., 2] + sign * c[..., 1]) & 255
    return _from_bytes(c)


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels (height x width) of a lossless bit stream."""
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless stream")
    bits = BitReader(data[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms: list[tuple] = []
    seen, now = set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            across, down = (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            transforms.append((kind, size, _pixels(bits, across, down, False).reshape(down, across)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _from_bytes(np.cumsum(_bytes_of(_pixels(bits, n, 1, False)), 0) & 255)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packed, colours, now))
            now = (now + (1 << packed) - 1) >> packed
        else:
            transforms.append((kind,))
    pixels = _pixels(bits, now, height, True).reshape(height, now)
    for kind, *more in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, (more[1] >> np.uint32(8)) & np.uint32(15), more[0])
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, more[1], more[0], 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            packed, colours, wide = more
            x, depth = np.arange(wide), 8 >> packed
            index = (pixels[:, x >> packed] >> np.uint32(8)) & np.uint32(255)
            index = (index >> ((x & ((1 << packed) - 1)) * depth).astype(np.uint32)) & np.uint32((1 << depth) - 1)
            table = np.zeros(256, np.uint32)
            table[: len(colours)] = colours
            pixels = table[index]
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", data, 16)
    if len(data) < 20 + size:
        raise ValueError("the file ends early")
    return decode_stream(data[20 : 20 + size])


# --- writing


class BitWriter:
    """Bits from the least significant up; ``parts`` are (value, number of bits)."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += n


def _depths(weights: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits for two or more ascending weights."""
    n = len(weights)
    while True:
        # Sums are made in order of weight too, so the least two are at the heads of two queues.
        leaves, sums, parent, i, j = [*weights, 1 << 62], [1 << 62] * n, [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            if leaves[i] <= sums[j]:
                total, parent[i] = leaves[i], n + k
                i += 1
            else:
                total, parent[n + j] = sums[j], n + k
                j += 1
            if leaves[i] <= sums[j]:
                total, parent[i] = total + leaves[i], n + k
                i += 1
            else:
                total, parent[n + j] = total + sums[j], n + k
                j += 1
            sums[k] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            return depth[:n]
        weights = [(w >> 1) + 1 for w in weights]


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a single used symbol gets 1."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts.take(used)
    order = weight.argsort(kind="stable")
    out[used.take(order)] = _depths(weight.take(order).tolist(), most)
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits to write, their number) of each symbol; none where one symbol alone is used."""
    used = lengths.nonzero()[0]
    code = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return code, np.zeros(len(lengths), np.int64)
    n = lengths.take(used)
    order = n.argsort(kind="stable")
    n = n.take(order)
    bits = int(n[-1])
    width = 1 << (bits - n)
    code[used.take(order)] = _reverse(bits).take(width.cumsum() - width)
    return code, lengths


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """Write a prefix code."""
    used = lengths.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        out.put(1, 1)
        out.put(len(used) > 1, 1)
        out.put(1, 1)
        for s in used if len(used) else (0,):
            out.put(s, 8)
        return
    out.put(0, 1)
    tokens: list[tuple[int, str]] = []  # symbol, extra bits
    before = -1
    for k, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
        if k - before > 1:
            tokens += _zeros(k - before - 1)
        tokens.append(_LENGTH[n])
        before = k
    tokens += _zeros(len(lengths) - 1 - before)
    counts = [0] * 19
    for t in tokens:
        counts[t[0]] += 1
    some = sorted((c, k) for k, c in enumerate(counts) if c)
    first, said = [0] * 19, [""] * 19
    if len(some) == 1:
        first[some[0][1]] = 1
    else:
        for (_, k), n in zip(some, _depths([c for c, _ in some], 7), strict=True):
            first[k] = n
        at = 0
        for n, k in sorted((n, k) for k, n in enumerate(first) if n):
            said[k] = f"{at >> (7 - n):0{n}b}"[::-1]
            at += 1 << (7 - n)
    out.put(15, 4)
    out.put(sum(first[k] << 3 * i for i, k in enumerate(LENGTH_ORDER)), 57)
    out.put(0, 1)
    bits = "".join([extra + said[k] for k, extra in reversed(tokens)])
    out.put(int(bits or "0", 2), len(bits))


_LENGTH = [(n, "") for n in range(16)]


@functools.cache
def _zeros(n: int) -> list[tuple[int, str]]:
    """Symbols and extra bits that say n code lengths of zero."""
    out: list[tuple[int, str]] = []
    while n >= 3:
        run = min(n, 138)
        out.append((18, f"{run - 11:07b}") if run >= 11 else (17, f"{run - 3:03b}"))
        n -= run
    return out + [(0, "")] * n


@functools.cache
def _near(width: int) -> dict[int, int]:
    """The short code of every distance that has one."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(NEAR):
        out.setdefault(max(1, dx + dy * width), k + 1)
    return out


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    extra = top - 1
    return 2 * top + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _join(value: np.ndarray, size: np.ndarray, head: BitWriter) -> bytes:
    """The head's bits, then values of at most 60 bits each."""
    at = np.empty(len(size) + 1, np.int64)
    at[0] = head.n
    np.cumsum(size, out=at[1:])
    at[1:] += head.n
    words = np.zeros(int(at[-1]) // 64 + 2, np.uint64)
    if len(value):
        place, shift = at[:-1] >> 6, (at[:-1] & 63).astype(np.uint64)
        begin = np.concatenate(([0], (place[1:] != place[:-1]).nonzero()[0] + 1))
        first = place.take(begin)
        words[first] = np.add.reduceat(value << shift, begin)
        # What goes beyond a word is of its last value alone.
        last = np.append(begin[1:], len(value)) - 1
        by = shift.take(last)
        words[first + 1] += np.where(by > 0, value.take(last) >> (np.uint64(64) - by & np.uint64(63)), np.uint64(0))
    front = head.n // 64 + 1
    words[:front] |= np.frombuffer(head.value.to_bytes(front * 8, "little"), "<u8")
    return words.tobytes()[: (int(at[-1]) + 7) // 8]


def find_copies(pixels: np.ndarray, spent: np.ndarray, tries: int = 8, enough: int = 256) -> list[tuple[int, int, int]]:
    """(start, length, distance) of copies that need fewer bits than their pixels do (``spent``); none where they spare next to nothing.

    From left to right, at every pixel that begins with two pixels seen before, up to ``tries``
    earlier places are compared, nearest first, until a copy of ``enough`` pixels is found.
    """
    if len(pixels) < 3:
        return []
    pairs = pixels[:-1].astype(np.uint64) << np.uint64(32) | pixels[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.flatnonzero(np.diff(pairs[order]) == 0)
    if not len(again):
        return []
    before = np.full(len(pixels), -1)
    before[order[again + 1]] = order[again]
    seen, sums = before >= 0, np.append(0.0, spent.cumsum())
    least = TABLE_BITS + sums[-1] / WORTH
    # A copy lies within a run of such places and the pixel after: if all these runs spare too little, no copy is looked for.
    edge = np.flatnonzero(seen[1:] != seen[:-1]) + 1
    if seen[0]:
        edge = np.append(0, edge)
    runs = sums.take(edge[1::2] + 1) - sums.take(edge[0 : len(edge) // 2 * 2 : 2]) - (COPY_BITS + 3)
    if runs[runs > 0].sum() <= least:
        return []
    # Two pixels pay for a copy only if they are dear, or if more may follow.
    seen[:-1] &= seen[1:] | (spent[:-1] + spent[1:] > COPY_BITS + 8)
    places, before, n = seen.nonzero()[0].tolist(), before.tolist(), len(pixels)
    if not places:
        return []
    total, v = sums.tolist(), pixels.tolist()
    out, upto, spared = [], 0, 0.0
    for at in places:
        if at < upto:
            continue
        most, longest, gain, came, j = 0, 0, 0.0, 0, before[at]
        for _ in range(tries):
            if j < 0 or at - j > FARTHEST:
                break
            if at + most < n and v[j + most] == v[at + most]:
                k = 2
                while at + k < n and v[j + k] == v[at + k]:
                    k += 1
                # A symbol and extra bits for the length, and for the distance.
                longest = max(longest, k)
                saved = total[at + k] - total[at] - (COPY_BITS + k.bit_length() + (at - j).bit_length())
                if saved > gain:
                    most, gain, came = k, saved, at - j
                if k >= enough:
                    break
            j = before[j]
        if gain > 0:
            out.append((at, most, came))
            upto = at + most
            spared += gain
        elif longest >= LONG:  # pixels that cost next to nothing: what begins within them spares less still
            upto = at + longest - 1
    return out if spared > least else []


def _hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in a cache of so many bits, whether it then holds the colour) of every pixel."""
    places = _cache_places(pixels, cache_bits)
    order = np.argsort(places.astype(np.uint16), kind="stable")
    there, colour, hit = places[order], pixels[order], np.zeros(len(pixels), bool)
    hit[order[1:]] = (there[1:] == there[:-1]) & (colour[1:] == colour[:-1])
    return places, hit


def _choose_cache(pixels: np.ndarray, each: float) -> tuple[int, np.ndarray | None]:
    """(bits of the cache or 0, its hits): a cache of an eighth to a quarter as many places as pixels, where it spares enough of their bits (``each`` a pixel)."""
    cache_bits = min(MOST_CACHE, max(LEAST_CACHE, len(pixels).bit_length() - 3))
    hit = _hits(pixels, cache_bits)[1]
    return (cache_bits, hit) if np.count_nonzero(hit) * (each - CACHED_BITS) > TABLE_BITS + len(pixels) * each / WORTH else (0, None)


def _put_pixels(pixels: np.ndarray, width: int, head: BitWriter, main: bool, cache_bits: int | None = 0, copies: bool = False) -> bytes | None:
    """Write an entropy-coded image; the main one's bytes are returned with all that stands in ``head`` before.

    ``cache_bits`` None: as few bits as make the image smallest, or no cache.
    """
    flat = pixels.ravel().astype(np.uint32)
    raw = flat.astype("<u4").view(np.uint8).reshape(-1, 4)
    hit, each = None, 0.0
    if cache_bits is None or copies:
        each = _cost(np.bincount((raw + _CHANNEL).ravel(), minlength=1024).reshape(4, 256)).sum() / len(flat)
    if cache_bits is None:
        cache_bits, hit = _choose_cache(flat, each)
    elif cache_bits:
        hit = _hits(flat, cache_bits)[1]
    head.put(cache_bits > 0, 1)
    if cache_bits:
        head.put(cache_bits, 4)
    if main:
        head.put(0, 1)  # one set of codes
    jumps: list[tuple[int, int, int]] = []
    for at, n, d in find_copies(flat, np.full(len(flat), each) if hit is None else np.where(hit, min(each, CACHED_BITS), each)) if copies else ():
        jumps += [(at + k, min(MOST_COPIED, n - k), d) for k in range(0, n, MOST_COPIED)]
    # Of every pixel: its symbol in the first code, whether a token begins there, and whether it is a literal.
    green, begins, literal = raw[:, 1].astype(np.int64), np.ones(len(flat), bool), np.ones(len(flat), bool)
    if hit is not None:
        literal = ~hit
        green[hit] = 256 + LENGTH_CODES + _cache_places(flat[hit], cache_bits)
    lengths, distances = [], []
    near = _near(width)
    for at, n, d in jumps:
        begins[at + 1 : at + n] = False
        literal[at : at + n] = False
        lengths.append(_prefix(n))
        distances.append(_prefix(near.get(d, d + len(NEAR))))
        begins[at] = True
        green[at] = 256 + lengths[-1][0]
    where = literal.nonzero()[0]
    rest = raw.take(where, 0)
    counts = np.bincount((rest + _CHANNEL).ravel(), minlength=1024).reshape(4, 256)
    counts[1] = counts[0] + counts[2] + counts[3]
    blue_bits, pooled_bits, red_bits, alpha_bits = _cost(counts).tolist()
    if main and pooled_bits + 2 * SYMBOL_BITS * np.count_nonzero(counts[1]) < SHARED * (blue_bits + red_bits + alpha_bits):
        three = [code_lengths(counts[1])] * 3
    else:
        three = [code_lengths(counts[k]) for k in (2, 0, 3)]
    tokens = begins.nonzero()[0]
    green_size = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    sets = [code_lengths(np.bincount(green.take(tokens), minlength=green_size)), *three, code_lengths(np.bincount([d[0] for d in distances], minlength=DISTANCE_CODES))]
    written: list[tuple[np.ndarray, BitWriter, tuple[np.ndarray, np.ndarray]]] = []
    for k in sets:
        if not (written and written[-1][0] is k):
            mark = BitWriter()
            put_code(mark, k)
            written.append((k, mark, codes_of(k)))
        else:
            written.append(written[-1])
        head.put(written[-1][1].value, written[-1][1].n)
    code, n = written[0][2]
    value, size = code.take(green), n.take(green)
    more, bits = value.take(where), size.take(where)
    for channel, (_, _, (code, n)) in zip((2, 0, 3), written[1:4], strict=True):
        of = rest[:, channel]
        more |= code.take(of) << bits.astype(np.uint64)
        bits += n.take(of)
    value[where], size[where] = more, bits
    if jumps:
        far_code, far_size = (x.tolist() for x in written[4][2])
    for (at, _, _), (_, extra, n), (s, far, m) in zip(jumps, lengths, distances, strict=True):
        have = int(size[at])
        value[at] |= np.uint64(extra << have | far_code[s] << (have + n) | far << (have + n + far_size[s]))
        size[at] = have + n + far_size[s] + m
    value, size = value.take(tokens), size.take(tokens)
    if main:
        return _join(value, size, head)
    for v, n in zip(value.tolist(), size.tolist(), strict=True):
        head.put(v, n)
    return None


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), mode: int | np.ndarray = 11, cross: int | np.ndarray = 0, cache_bits: int | None = 0, copies: bool = False, block_bits: int = 2) -> bytes:
    """A WebP file of the pixels (height x width). ``transforms`` are applied in the order given.

    ``mode`` is the predictor and ``cross`` the colour-transform element, of all blocks or of each
    (down x across); ``cache_bits`` None takes the size of the cache that suits the pixels.
    """
    height, width = pixels.shape
    head = BitWriter()
    head.put(0x2F, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(1, 1)
    head.put(0, 3)
    down, across = (height + (1 << block_bits) - 1) >> block_bits, (width + (1 << block_bits) - 1) >> block_bits
    for kind in transforms:
        head.put(1, 1)
        head.put(kind, 2)
        if kind == PREDICTOR:
            head.put(block_bits - 2, 3)
            modes = np.broadcast_to(np.asarray(mode), (down, across))
            _put_pixels((modes << 8 | 0xFF000000).astype(np.uint32), across, head, False)
            pixels = _predicted(pixels, modes, block_bits)
        elif kind == CROSS_COLOUR:
            head.put(block_bits - 2, 3)
            elements = np.broadcast_to(np.asarray(cross, np.uint32), (down, across))
            _put_pixels(elements, across, head, False)
            pixels = _cross(pixels, elements, block_bits, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            head.put(len(colours) - 1, 8)
            steps = np.diff(_bytes_of(colours), axis=0, prepend=np.zeros((1, 4), np.int32)) & 255
            _put_pixels(_from_bytes(steps), len(colours), head, False)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            narrow = (width + (1 << packed) - 1) >> packed
            wide = np.zeros((height, narrow << packed), np.uint32)
            wide[:, :width] = index.reshape(height, width)
            depth = 8 >> packed
            parts = wide.reshape(height, narrow, 1 << packed) << (np.arange(1 << packed) * depth).astype(np.uint32)
            pixels, width = (np.bitwise_or.reduce(parts, 2) << np.uint32(8) | np.uint32(0xFF000000)).astype(np.uint32), narrow
            across = (width + (1 << block_bits) - 1) >> block_bits
    head.put(0, 1)
    data = _put_pixels(pixels, width, head, True, cache_bits, copies)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(data) % 2) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)


def payload_of(text: bytes) -> bytes:
    """The text's bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


#: Pixels a line of a payload's images, and their blocks' side (as a power of two).
LINE, BLOCK_BITS = 16, 4
#: Pixels of images that are planned together: their arrays then stay in the processor's cache.
TOGETHER = 1 << 15


_COUNTS = np.arange(1 << 14)
_TIMES_LOG = _COUNTS * np.log2(np.maximum(_COUNTS, 1))
_PRICE = SYMBOL_BITS * (_COUNTS > 0) - _TIMES_LOG


def _cost(counts: np.ndarray) -> np.ndarray:
    """Bits that the prefix code of each line, and so many of each symbol, need, about."""
    total = counts.sum(-1)
    if total.max() < len(_COUNTS):
        return _TIMES_LOG.take(total) + _PRICE.take(counts).sum(-1)
    return total * np.log2(np.maximum(total, 1)) + (SYMBOL_BITS * (counts > 0) - counts * np.log2(np.maximum(counts, 1))).sum(-1)


def _costs(channels: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The same of n images at once, four codes each; ``keys`` (lines x bytes of a line) are each image's and channel's first count."""
    counts = np.bincount((keys + channels.reshape(keys.shape)).ravel(), minlength=n * 1024).reshape(n, 4, 256)
    return _cost(counts).sum(1)


def _best_blocks(tried: list[int], left: np.ndarray, blocks: np.ndarray, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value of every block, what it leaves) of the values tried and what each leaves (values x lines x bytes), where the absolute sum is least; ``fixed`` lines do not count."""
    low, total = np.uint64(0x00FF00FF00FF00FF), []
    for less in left:
        # Bytes are added eight at a time: a block has 256 of at most 128 a place, which 16 bits hold.
        far = np.minimum(less, np.negative(less)).view(np.uint64)
        far = np.einsum("ij->i", (far & low) + (far >> np.uint64(8) & low))
        if fixed is not None:
            far[fixed] = 0
        total.append(np.add.reduceat(far, blocks).view(np.uint16).reshape(-1, 4).sum(1, dtype=np.int64))
    best = np.argmin(total, 0)
    lines = left.shape[1]
    return np.array(tried)[best], left[np.repeat(best, np.diff(blocks, append=lines)), np.arange(lines)]


#: Factors (in 32nds) that are tried for a block's colour transform.
FACTORS = (0, -32, -16, 16, 32)


def _cross_elements(channels: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element of every block, channels after them): red less green, then blue less green, then blue less red."""
    lines = len(channels)
    out, elements = channels.copy(), np.full(len(blocks), 0xFF000000, np.int64)
    for shift, seen, of in ((0, 1, 2), (8, 1, 0), (16, 2, 0)):
        by, what = channels[..., seen].view(np.int8).astype(np.int16), np.ascontiguousarray(out[..., of])
        left = np.empty((len(FACTORS), lines, LINE), np.uint8)
        for k, f in enumerate(FACTORS):
            np.subtract(what, (f * by >> 5).astype(np.uint8), out=left[k])
        factor, kept = _best_blocks(list(FACTORS), left, blocks)
        elements |= (factor & 255) << shift
        out[..., of] = kept
    return elements, out


def plans(images: list[np.ndarray]) -> list[tuple[float, tuple[int, ...], np.ndarray | int, np.ndarray | int]]:
    """(bits, transforms, predictors and colour elements of the blocks) that suit each image, by the entropy of what they leave.

    Tried are no transform, less green, predictors, colour transform, predictors with colour
    transform, and a palette. Bits are without copies and cached colours. All images are worked on
    together, LINE pixels a line.
    """
    height = np.array([len(i) for i in images])
    n, start = len(images), np.cumsum(height) - height
    owner = np.repeat(np.arange(n), height)
    lines = len(owner)
    c = np.concatenate(images).astype("<u4").view(np.uint8).reshape(-1, 4)
    within = np.arange(lines) - start[owner]
    blocks = np.flatnonzero(within % (1 << BLOCK_BITS) == 0)
    of = owner[blocks]
    plain = c.reshape(lines, LINE, 4)
    keys = owner[:, None] * 1024 + np.tile(_CHANNEL, LINE)
    cost = [_costs(plain, keys, n)]
    green = plain.copy()
    green[..., 0] -= plain[..., 1]
    green[..., 2] -= plain[..., 1]
    cost.append(_costs(green, keys, n))
    around = _neighbours(c, LINE)
    left = np.empty((14, len(c), 4), np.uint8)
    for m in range(14):
        np.subtract(c, predict(m, *around), out=left[m])
    modes, left = _best_blocks(list(range(14)), left.reshape(14, lines, -1), blocks, start)
    _edges(left, c, LINE, start)
    left = left.reshape(lines, LINE, 4)
    tables = np.bincount(of, minlength=n)
    cost.append(_costs(left, keys, n) + 32 + 4 * tables)
    one, after = _cross_elements(plain, blocks)
    cost.append(_costs(after, keys, n) + 64 + 12 * tables)
    both, after = _cross_elements(left, blocks)
    cost.append(_costs(after, keys, n) + 96 + 16 * tables)
    kinds = ((), (SUBTRACT_GREEN,), (PREDICTOR,), (CROSS_COLOUR,), (PREDICTOR, CROSS_COLOUR))
    best = np.argmin(cost, 0)
    ends = np.searchsorted(of, np.arange(n + 1))
    out = []
    for i, k in enumerate(best.tolist()):
        here = slice(ends[i], ends[i + 1])
        plan = (float(cost[k][i]), kinds[k], modes[here, None], (one if k == 3 else both)[here, None])
        bits = _palette_bits(images[i], plan[0])
        out.append((bits, (PALETTE,), 0, 0) if bits < plan[0] else plan)
    return out


def _palette_bits(pixels: np.ndarray, most: float) -> float:
    """Bits of an image with a palette, about; ``most`` where it has none, or surely needs more."""
    ordered = np.sort(pixels, None)
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    colours, n = ordered[begin], len(begin)
    if not 2 <= n <= 256 or SYMBOL_BITS * n > most:
        return most
    counts = np.diff(begin, append=pixels.size)
    if n <= 16:  # several places share a pixel
        packed = 3 if n <= 2 else 2 if n <= 4 else 1
        index = np.searchsorted(colours, pixels)
        counts = np.bincount((index.reshape(-1, LINE >> packed, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))).sum(2).ravel())
    steps = np.diff(colours.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0)
    return 64.0 + float(_cost(counts)) + float(_cost(np.bincount((steps + _CHANNEL).ravel(), minlength=1024).reshape(4, 256)).sum())


def _smallest(pixels: np.ndarray, plan: tuple[float, tuple[int, ...], np.ndarray | int, np.ndarray | int]) -> tuple[bytes, tuple[int, ...]]:
    """(file, its transforms): with copies and the cache that suits the pixels, and once more with the plan's transforms where these may make it smaller."""
    media, kinds = encode(pixels, cache_bits=None, copies=True), ()
    if plan[1] and plan[0] < 8 * len(media):
        other = encode(pixels, *plan[1:], None, True, BLOCK_BITS)
        if len(other) < len(media):
            return other, plan[1]
    return media, kinds


def chosen_transforms(pixels: np.ndarray) -> tuple[int, ...]:
    """The transforms that make these pixels smaller."""
    return _smallest(pixels, plans([pixels])[0])[1]


def encode_payload(payload: bytes) -> bytes:
    """A payload as WebP files in a row: 16 pixels a line, four bytes a pixel, written the way that makes them smallest."""
    return encode_payloads([payload])[0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """``encode_payload`` of each."""
    out: list[list[bytes]] = [[] for _ in payloads]
    images = [(k, np.frombuffer(p[i : i + IMAGE_BYTES], "<u4").astype(np.uint32).reshape(-1, LINE)) for k, p in enumerate(payloads) for i in range(0, len(p), IMAGE_BYTES)]
    at = 0
    while at < len(images):
        upto, held = at + 1, images[at][1].size
        while upto < len(images) and held + images[upto][1].size <= TOGETHER:
            held += images[upto][1].size
            upto += 1
        part = images[at:upto]
        for (k, pixels), plan in zip(part, plans([i[1] for i in part]), strict=True):
            out[k].append(_smallest(pixels, plan)[0])
        at = upto
    return [b"".join(o) for o in out]


def decode_payload(media: bytes) -> bytes:
    """The payload of ``encode_payload``."""
    at, out = 0, []
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        out.append(decode(media[at : at + 8 + size]).astype("<u4").tobytes())
        at += 8 + size
    return b"".join(out)


def image_features(payload: bytes) -> str:
    """Of all samples: lines, mean, deviation, entropy, distinct values, and the share of each eighth of the range."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    deviation = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(x)))
    eighths = ",".join(f"{n / len(x):.4f}" for n in counts.reshape(8, 32).sum(1))
    return f"lines={len(x) // 64};mean={mean:.4f};deviation={deviation:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};distinct={len(p)};eighths={eighths}"


def store_media(docs: DataFrame) -> DataFrame:
    """Write each text (null: empty) as a media column: (doc_id, n_bytes, media), read back from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                raw = [as_bytes(t) for t in part.column("text").to_pylist()]
                media = encode_payloads([payload_of(r) for r in raw])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "media")


def read_media(media: DataFrame, keep_pixels: bool = False) -> DataFrame:
    """Decode a media column: digests and features of every stored image, and with ``keep_pixels`` its samples.

    A null image has null digests and features; repeated rows are read each, images of any size
    whole; an empty table stays empty.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *map(T.StructField, names, kinds)] + [T.StructField("samples", T.BinaryType())] * keep_pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                rows = []
                for m in part.column("media").to_pylist():
                    if m is None:
                        rows.append([None] * (7 if keep_pixels else 6))
                        continue
                    p = decode_payload(m)
                    row = [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), image_features(p)]
                    rows.append([*row, p] if keep_pixels else row)
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *arrays], names=schema.names)

    return media.mapInArrow(run, schema)
