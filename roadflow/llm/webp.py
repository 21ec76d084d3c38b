"""Lossless WebP (VP8L): a decoder of the whole bit stream and an encoder that can use each of its tools.

Decoding: prefix codes (simple and normal), several code groups chosen by an entropy image, back-references, colour cache, and the
inverses of the predictor, cross-colour, subtract-green and palette transforms. An image is an array of rows x columns x 4
(red, green, blue, alpha). Where one code group and no colour cache are used, all bit positions are looked up at once with numpy
and only the chain of real symbol starts is followed one by one.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
MOST_SIDE = 1 << 14


class BadImage(ValueError):
    """The bytes are no lossless WebP image."""


# ------------------------------------------------------------------ decoding


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.pos = data + bytes(16), 0

    def read(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if p + n > 8 * (len(self.data) - 8):
            raise BadImage("the stream ends early")
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7)) & ((1 << n) - 1)


class _Code:
    """A prefix code as a table over its longest length: symbol * 16 + length; a code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        self._windows, self.seen = None, False
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4], np.int32)
            return
        self.bits = int(lengths.max())
        table = np.full(1 << self.bits, -1, np.int32)
        for s, n, code in canonical(lengths):
            table[code :: 1 << n] = s << 4 | n
        if (table < 0).any():
            raise BadImage("a prefix code is incomplete")
        self.table = table

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each 16 bits: how many of them whole symbols below 256 take (0: none), how many symbols these are, and which."""
        if self._windows is None:
            w = np.arange(1 << 16)
            most = 16 // max(1, int((self.table & 15).min()))
            taken, count, symbols, alive = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8), np.zeros((1 << 16, most), np.uint8), np.ones(1 << 16, bool)
            for k in range(most):
                e = self.table[(w >> taken) & ((1 << self.bits) - 1)]
                alive &= (taken + (e & 15) <= 16) & (e >> 4 < 256)
                symbols[alive, k] = e[alive] >> 4
                count[alive] += 1
                taken[alive] += e[alive] & 15
            self._windows = taken.astype(np.uint8), count, symbols
        return self._windows

    def read(self, bits: _Bits) -> int:
        p = bits.pos
        entry = int(self.table[(int.from_bytes(bits.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)) & ((1 << self.bits) - 1)])
        bits.pos = p + (entry & 15)
        return entry >> 4


_MOST_BITS = 15
_REVERSED = sum(((np.arange(1 << _MOST_BITS) >> k & 1) << (_MOST_BITS - 1 - k) for k in range(_MOST_BITS)), np.zeros(1 << _MOST_BITS, np.int64))


def canonical(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of all used symbols; raises if the code is over-full."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    # a code is the share of all 15-bit numbers that the codes before it begin
    ends = np.cumsum(1 << (_MOST_BITS - n))
    if len(ends) and ends[-1] > 1 << _MOST_BITS:
        raise BadImage("a prefix code is over-full")
    return list(zip(order.tolist(), n.tolist(), _REVERSED[ends - (1 << (_MOST_BITS - n))].tolist()))


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    lengths = np.zeros(alphabet, np.int32)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise BadImage("a symbol is out of range")
        lengths[symbols] = 1
        return _Code(lengths)
    of_lengths = np.zeros(19, np.int32)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, i, before = _Code(of_lengths), 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            i += 1
            before = s or before
            continue
        value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if i + n > alphabet:
            raise BadImage("a repeat passes the alphabet's end")
        lengths[i : i + n] = value
        i += n
    return _Code(lengths)


_known: list[tuple[tuple[int, ...], int, int, list[_Code]]] = []


def _read_group(bits: _Bits, alphabets: tuple[int, ...]) -> list[_Code]:
    """The codes of one group. The last few groups' bits are kept, since many images of one encoder start alike."""
    p = bits.pos
    for k, (sizes, n, head, codes) in enumerate(_known):
        if sizes == alphabets and (int.from_bytes(bits.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1) == head:
            bits.pos = p + n
            for c in codes:
                c.seen = True
            _known.insert(0, _known.pop(k))
            return codes
    codes = [_read_code(bits, a) for a in alphabets]
    n = bits.pos - p
    _known.insert(0, (alphabets, n, (int.from_bytes(bits.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1), codes))
    del _known[8:]
    return codes


def _far(code: int, width: int) -> int:
    """Pixels back for a distance code."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _value(prefix: int, bits: _Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as 32-bit ARGB numbers, before any transform is inverted."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    groups, of, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width // (1 << tile))
        of = _read_image(bits, across, -(-height // (1 << tile)), False)
        of = ((of >> 8) & 0xFFFF).reshape(-1, across)
        groups = int(of.max()) + 1
    alphabets = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [_read_group(bits, alphabets) for _ in range(groups)]
    if main and of is None and not cache_bits:
        return _read_at_once(bits, codes[0], width, width * height)
    out, total, n = np.zeros(width * height, np.uint32), width * height, 0
    cache, kept = [0] * (1 << cache_bits), 0
    while n < total:
        green, red, blue, alpha, distance = codes[int(of[n // width >> tile, n % width >> tile]) if of is not None else 0]
        s = green.read(bits)
        if s < 256:
            out[n] = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24
            n += 1
        elif s < 256 + LENGTH_CODES:
            length = _value(s - 256, bits)
            back = _far(_value(distance.read(bits), bits), width)
            if back > n or n + length > total:
                raise BadImage("a back-reference leaves the image")
            for _ in range(length):
                out[n] = out[n - back]
                n += 1
        else:
            while kept < n:
                c = int(out[kept])
                cache[(c * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = c
                kept += 1
            out[n] = cache[s - 256 - LENGTH_CODES]
            n += 1
        if bits.pos > 8 * (len(bits.data) - 8):
            raise BadImage("the stream ends early")
    return out


def _values_at(prefix: np.ndarray, at: np.ndarray, peek) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes whose extra bits start at these bits, and the bits after them."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    more = (peek(at) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), at + extra


_CHUNK = 1 << 16  # bytes of the stream whose bit positions are looked up at once


def _read_at_once(bits: _Bits, codes: list[_Code], width: int, total: int) -> np.ndarray:
    green, rest, distance = codes[0], codes[1:4], codes[4]
    fixed = [int(c.table[0]) >> 4 if not c.bits else None for c in rest]
    if not green.bits and None not in fixed and int(green.table[0]) >> 4 < 256:
        return np.full(total, fixed[0] << 16 | int(green.table[0]) >> 4 << 8 | fixed[1] | fixed[2] << 24, np.uint32)
    if None not in fixed and green.seen:  # codes that were met before are worth a table of all 16-bit windows
        return _read_one_channel(bits, green, distance, fixed[0] << 16 | fixed[1] | fixed[2] << 24, width, total)
    raw = np.frombuffer(bits.data, np.uint8)
    wide = np.ndarray((len(raw) - 7,), "<u8", bits.data, strides=(1,))
    peek = lambda p: wide[np.minimum(p >> 3, len(wide) - 1)] >> (p & 7).astype(np.uint64)  # noqa: E731  57 bits from each position on
    look = lambda c, w: c.table[(w & np.uint64((1 << c.bits) - 1)).astype(np.intp)]
    out, n, pos = np.empty(total, np.uint32), 0, bits.pos
    while n < total:
        base = pos >> 3
        if base >= len(raw) - 8:
            raise BadImage("the stream ends early")
        part = raw[base : base + _CHUNK + 2].astype(np.uint32)
        size = min(_CHUNK, len(part) - 2)
        w = (part[:size] | part[1 : size + 1] << np.uint32(8) | part[2 : size + 2] << np.uint32(16))[:, None] >> np.arange(8, dtype=np.uint32)
        entry = green.table[(w & np.uint32((1 << green.bits) - 1)).ravel()]
        step = (entry & 15).astype(np.int64)
        copies = entry >> 4 >= 256
        at = np.flatnonzero(copies)
        p = np.arange(8 * base, 8 * base + len(entry))
        for c in rest:
            if c.bits:
                step += np.where(copies, 0, look(c, peek(p + step)) & 15)
        if len(at):
            p = at + 8 * base
            prefix = (entry[at] >> 4) - 256
            extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
            step[at] += extra
            far = look(distance, peek(p + step[at]))
            step[at] += far & 15
            step[at] += np.where(far >> 4 < 4, 0, ((far >> 4) - 2) >> 1)
        chain, jump = [], step.astype(np.uint8).tobytes()
        add, p, end = chain.append, pos - 8 * base, 8 * size
        while p < end:
            add(p)
            p += jump[p]
        pos = 8 * base + p
        chain = np.array(chain, np.int64)
        symbol = entry[chain] >> 4
        colour = (np.maximum(symbol, 0) << 8).astype(np.uint32)
        q = chain + 8 * base + (entry[chain] & 15)
        for c, known, shift in zip(rest, fixed, (16, 0, 24)):
            if known is not None:
                colour |= np.uint32(known << shift)
            else:
                e = look(c, peek(q))
                colour |= (e >> 4).astype(np.uint32) << np.uint32(shift)
                q += e & 15
        done = 0
        at = np.flatnonzero(symbol >= 256)
        q = chain[at] + 8 * base + (entry[chain[at]] & 15)
        lengths, q = _values_at(symbol[at] - 256, q, peek)
        far = look(distance, peek(q))
        backs, _ = _values_at(far >> 4, q + (far & 15), peek)
        for i, length, back in zip(at.tolist(), lengths.tolist(), backs.tolist()):
            m = min(i - done, total - n)
            out[n : n + m] = colour[done : done + m]
            n += m
            done = i + 1
            if n == total:
                break
            back = _far(back, width)
            if back > n or n + length > total:
                raise BadImage("a back-reference leaves the image")
            out[n : n + length] = np.resize(out[n - back : n], length) if back < length else out[n - back : n - back + length]
            n += length
        m = min(len(chain) - done, total - n)
        if m > 0:
            out[n : n + m] = colour[done : done + m]
            n += m
    return out


def _read_one_channel(bits: _Bits, green: _Code, distance: _Code, rest: int, width: int, total: int) -> np.ndarray:
    """Where only green varies: windows of 16 bits, several symbols each, chained; a back-reference is read by itself."""
    taken, count, symbols = green.windows()
    raw = np.frombuffer(bits.data, np.uint8)
    out, n, pos = np.empty(total, np.uint8), 0, bits.pos
    while n < total:
        base = pos >> 3
        if base >= len(raw) - 8:
            raise BadImage("the stream ends early")
        part = raw[base : base + _CHUNK + 2].astype(np.uint32)
        size = min(_CHUNK, len(part) - 2)
        w = ((part[:size] | part[1 : size + 1] << np.uint32(8) | part[2 : size + 2] << np.uint32(16))[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel()
        jump = np.take(taken, w).tobytes()
        p, end = pos - 8 * base, 8 * size
        while p < end and n < total:
            chain = []
            add = chain.append
            while p < end:
                step = jump[p]
                if not step:
                    break
                add(p)
                p += step
            if chain:
                own = w[np.array(chain, np.int64)]
                got = symbols[own][np.arange(symbols.shape[1], dtype=np.uint8) < count[own][:, None]]
                m = min(len(got), total - n)
                out[n : n + m] = got[:m]
                n += m
            if p < end and n < total:
                bits.pos = 8 * base + p
                length = _value(green.read(bits) - 256, bits)
                back = _far(_value(distance.read(bits), bits), width)
                if back > n or n + length > total:
                    raise BadImage("a back-reference leaves the image")
                out[n : n + length] = np.resize(out[n - back : n], length) if back < length else out[n - back : n - back + length]
                n += length
                p = bits.pos - 8 * base
        pos = 8 * base + p
    return out.astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def _split(argb: np.ndarray) -> np.ndarray:
    """Red, green, blue, alpha of 32-bit numbers, as a last axis."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)[..., [2, 1, 0, 3]]


def _join(rgba: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rgba[..., [2, 1, 0, 3]]).view("<u4")[..., 0]


def _predicted(mode: int, left, top, top_left, top_right) -> list[int]:
    """The predicted pixel, by channel."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode == 11:
        from_left = sum(abs(t - c) for t, c in zip(top, top_left))
        from_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if from_left < from_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(mean(left, top), top_left)]
    return (
        lambda: left, lambda: top, lambda: top_right, lambda: top_left, lambda: mean(mean(left, top_right), top), lambda: mean(left, top_left), lambda: mean(left, top),
        lambda: mean(top_left, top), lambda: mean(top, top_right), lambda: mean(mean(left, top_left), mean(top, top_right)),
    )[mode - 1]()


def predict(rgba: np.ndarray, modes: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    """The predictor transform: residuals of pixels, or (inverse) pixels of residuals."""
    height, width = rgba.shape[:2]
    if not (modes - modes[0, 0]).any() and int(modes[0, 0]) in _BY_ROW:
        return _predict_rows(rgba, int(modes[0, 0]), inverse)
    given = rgba.reshape(-1, 4).tolist()
    done: list[list[int]] = []
    pixels = done if inverse else given
    for i, value in enumerate(given):
        y, x = divmod(i, width)
        if y == 0:
            p = pixels[i - 1] if x else [0, 0, 0, 255]
        elif x == 0:
            p = pixels[i - width]
        else:
            p = _predicted(int(modes[y >> tile, x >> tile]), pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1])
        done.append([(v + q if inverse else v - q) & 255 for v, q in zip(value, p)])
    return np.array(done, np.uint8).reshape(height, width, 4)


#: Modes that look at the left alone or at the row above alone: a row at a time.
_BY_ROW = (1, 2, 3, 4)


def _predict_rows(rgba: np.ndarray, mode: int, inverse: bool) -> np.ndarray:
    height, width = rgba.shape[:2]
    pixels = np.zeros_like(rgba) if inverse else rgba
    out = np.zeros_like(rgba)
    for y in range(height):
        guess = np.zeros((width, 4), np.uint8)
        if y and mode > 1:
            above = pixels[y - 1]
            if mode == 3:  # right of the last pixel of the row above comes the first of this row
                guess[1:-1] = above[2:]
            else:
                guess[1:] = above[1:] if mode == 2 else above[:-1]
            guess[0] = above[0]
        else:
            guess[0] = pixels[y - 1, 0] if y else (0, 0, 0, 255)
        if y == 0 or mode == 1:  # by the left: sums of residuals
            if inverse:
                row = rgba[y].copy()
                row[0] += guess[0]
                pixels[y] = np.cumsum(row, axis=0, dtype=np.uint8)
            else:
                out[y, 0] = rgba[y, 0] - guess[0]
                out[y, 1:] = rgba[y, 1:] - rgba[y, :-1]
        elif inverse:
            pixels[y] = rgba[y] + guess
            if mode == 3 and width > 1:
                pixels[y, -1] = rgba[y, -1] + pixels[y, 0]
        else:
            if mode == 3 and width > 1:
                guess[-1] = rgba[y, 0]
            out[y] = rgba[y] - guess
    return pixels if inverse else out


def cross_colour(rgba: np.ndarray, factors: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    """factors: for each tile green to red, green to blue, red to blue, as signed eighths of 4."""
    height, width = rgba.shape[:2]
    f = np.repeat(np.repeat(factors.astype(np.int8).astype(np.int32), 1 << tile, 0), 1 << tile, 1)[:height, :width]
    part = lambda factor, c: (factor * c.astype(np.int8).astype(np.int32)) >> 5
    red, green, blue = (rgba[..., k].astype(np.int32) for k in range(3))
    sign = 1 if inverse else -1
    new_red = (red + sign * part(f[..., 0], green)) & 255
    new_blue = (blue + sign * (part(f[..., 1], green) + part(f[..., 2], new_red if inverse else red))) & 255
    return np.stack([new_red, green, new_blue, rgba[..., 3]], -1).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The image in a RIFF container's VP8L chunk: rows x columns x (red, green, blue, alpha)."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadImage("not a lossless WebP container")
    size = struct.unpack("<I", data[16:20])[0]
    bits = _Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise BadImage("no signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise BadImage("unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform occurs twice")
        seen.add(kind)
        if kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_split(_read_image(bits, n, 1, False)).astype(np.uint32), axis=0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, across, pack, colours))
            across = -(-across // (1 << pack))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, 0, None))
        else:
            tile = bits.read(3) + 2
            data_width = -(-across // (1 << tile))
            undo.append((kind, across, tile, _split(_read_image(bits, data_width, -(-height // (1 << tile)), False)).reshape(-1, data_width, 4)))
    image = _split(_read_image(bits, across, height, True)).reshape(height, across, 4)
    for kind, before, size, extra in reversed(undo):
        if kind == PREDICTOR:
            image = predict(image, extra[..., 1] & 15, size, True)
        elif kind == CROSS_COLOUR:
            image = cross_colour(image, extra[..., [2, 1, 0]], size, True)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            index = image[..., 1]
            if size:
                width_bits = 8 >> size
                index = (index[..., None] >> (np.arange(1 << size, dtype=np.uint8) * width_bits)) & ((1 << width_bits) - 1)
                index = index.reshape(height, -1)[:, :before]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            image = table[index]
    return image


# ------------------------------------------------------------------ encoding

MOST_CODE_BITS = 12
#: The share of the bits that codes of an image's own have to save, for the time that writing and reading them takes.
OWN_SAVES = 0.4
MOST_COPY = 4096  # the format's longest; a copy's codes and extra bits fit 64 bits


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits, by flattening the counts until they fit."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int32)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    while True:
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        parent, new = {}, len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = {new - 1: 0}
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        got = [depth[i] for i in range(len(used))]
        if max(got) <= most:
            lengths[used] = got
            return lengths
        weight = (weight + 1) >> 1 if weight.max() > 1 else weight


class _Writer:
    """Fields of up to 33 bits, lowest bit first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _write_code(w: _Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code; returns each symbol's code and length as they are to be used (a single symbol takes no bits)."""
    used = np.flatnonzero(lengths).tolist()
    codes, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        if len(used) == 2:
            codes[used[1]] = 1
            sizes[used] = 1
        return codes, sizes
    tokens, done = [], 0
    for i, n in zip([*used, len(lengths)], [*lengths[used].tolist(), None]):
        gap = i - done
        while gap:
            run = min(gap, 138)
            if run >= 11:
                tokens.append((18, run - 11, 7))
            elif run >= 3:
                tokens.append((17, run - 3, 3))
            else:
                run = 1
                tokens.append((0, 0, 0))
            gap -= run
        if n is not None:
            tokens.append((n, 0, 0))
        done = i + 1
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    of_lengths = code_lengths(counts, 7)
    single = (counts > 0).sum() == 1
    n = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if of_lengths[s]) + 1
    w.put(0, 1)
    w.put(max(n, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(n, 4)]:
        w.put(int(of_lengths[s]), 3)
    w.put(0, 1)
    known = {s: (c, b) for s, b, c in canonical(of_lengths)}
    for s, extra, b in tokens:
        if not single:
            w.put(*known[s])
        w.put(extra, b)
    if len(used) > 1:
        for s, b, c in canonical(lengths):
            codes[s], sizes[s] = c, b
    return codes, sizes


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.asarray(value, np.int64) - 1
    top = np.zeros(v.shape, np.int64)
    big = v >= 2
    top[big] = np.frexp(v[big].astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, top - 1)
    prefix = np.where(v < 4, v, 2 * top + ((v >> np.maximum(extra, 0)) & 1))
    return prefix, extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


_PREFIXES = np.stack(_prefix_of(np.maximum(np.arange(1 << 13), 1)))


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of lengths or distance codes (from 1)."""
    return tuple(_PREFIXES[:, value]) if not len(value) or int(value.max()) < 1 << 13 else _prefix_of(value)


#: Pixels of which equal ones before are looked for, and the shortest copy.
CHAINED, LEAST_COPY = 8, 12


def _copies(argb: np.ndarray, least: int = CHAINED, shortest: int = LEAST_COPY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references: each window of ``least`` pixels is chained to the last equal one before it by its hash;
    neighbouring windows at one distance are one longer match; the first match in a row of ``shortest`` pixels or more wins.
    """
    n = len(argb) - least + 1
    none = (np.zeros(0, np.int64),) * 3
    if n < 2:
        return none
    if least == 8 and not ((argb ^ argb[0]) & np.uint32(0xFFFF00FF)).any():  # green alone: eight bytes at once
        h = np.ndarray((n,), "<u8", (argb >> np.uint32(8)).astype(np.uint8).tobytes(), strides=(1,))
    else:
        h = argb[:n].astype(np.uint64)
        for k in range(1, least):
            h = h * np.uint64(0x9E3779B97F4A7C15) + argb[k : k + n]
    # one number to sort: a hash of the window above its place
    bits = np.uint64(n.bit_length())
    key = (h * np.uint64(0x9E3779B97F4A7C15)) >> bits << bits | np.arange(n, dtype=np.uint64)
    key.sort()
    same = np.flatnonzero((key[1:] ^ key[:-1]) >> bits == 0)
    if not len(same):
        return none
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    back = np.zeros(n, np.int64)
    back[place[same + 1]] = place[same + 1] - place[same]
    edge = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1], [True]]))
    first, last = edge[:-1], edge[1:]
    some = (back[first] > 0) & (last - first > shortest - least)
    out, done = [], 0
    for s, e, far in zip(first[some].tolist(), last[some].tolist(), back[first[some]].tolist()):
        s = max(s, done)
        length = e - 1 + least - s
        if length >= shortest:
            out.append((s, length, far))
            done = s + length
    start, length, far = np.array(out, np.int64).reshape(-1, 3).T
    if len(start):  # equal hashes are no proof
        begin = np.cumsum(length) - length
        at = np.repeat(start - begin, length) + np.arange(int(length.sum()))
        true = np.logical_and.reduceat(argb[at] == argb[at - np.repeat(far, length)], begin)
        start, length, far = start[true], length[true], far[true]
    return start, length, far


@lru_cache(8)
def _near_codes(width: int) -> dict[int, int]:
    """Distance codes of near pixels, by distance."""
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), k)
    return out


def _distance_codes(far: np.ndarray, width: int) -> np.ndarray:
    near = _near_codes(width)
    return np.array([near.get(d, d + len(NEAR)) for d in far.tolist()], np.int64)


@lru_cache(64)
def _written_code(lengths: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A code as it stands in the stream (its bits and their number), and each symbol's code and length. lengths: of int32."""
    w = _Writer()
    codes = _write_code(w, np.frombuffer(lengths, np.int32))
    return w.value, w.n, *codes


@lru_cache(64)
def group_header(lengths: tuple[bytes, ...]) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
    """Five codes in a row, and each symbol's code and length in each."""
    value = n = 0
    parts = [_written_code(x) for x in lengths]
    for bits, size, _, _ in parts:
        value |= bits << n
        n += size
    return value, n, [(c, s) for _, _, c, s in parts]


@lru_cache(256)
def _single(symbol: int) -> bytes:
    """Code lengths of a channel with one value."""
    return np.eye(1, 256, symbol, dtype=np.int32)[0].tobytes()


@lru_cache(16)
def one_channel(counts: bytes, distances: bytes) -> tuple[bytes, ...]:
    """Code lengths for images in which only green varies, from int64 counts of all its 280 symbols and of the 40 distances; each gets a code."""
    single = [np.zeros(256, np.int32) for _ in range(3)]
    for x, value in zip(single, (0, 0, 255)):
        x[value] = 1
    green, distance = (code_lengths(np.maximum(np.frombuffer(c, np.int64), 1), MOST_CODE_BITS) for c in (counts, distances))
    return tuple(x.tobytes() for x in (green, *single, distance))


@lru_cache(4)
def _prior_table(prior: tuple[tuple[bytes, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of codes the lengths for green and for distances, and the bits of its description."""
    return *(np.stack([np.frombuffer(p[k], np.int32) for p in prior]).astype(float) for k in (0, 4)), np.array([group_header(p)[1] for p in prior])


def _entropy_bits(counts: np.ndarray) -> float:
    used = counts[counts > 0].astype(float)
    return float((used * np.log2(used.sum() / used)).sum()) if len(used) > 1 else 0.0


def _write_image(w: _Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, prior: tuple[tuple[bytes, ...], ...] | None = None, across: int = 1, told: list[str] | None = None) -> np.ndarray | None:
    """Writes an image; the main one's symbols come back as 32-bit words that start at the writer's end. prior: codes of which the best are used unless the image's own save OWN_SAVES of the bits. told: gets the tools used."""
    n = len(argb)
    start, length, far = _copies(argb) if main else (np.zeros(0, np.int64),) * 3
    pieces = -(-length // MOST_COPY)
    first = np.repeat(start, pieces) + MOST_COPY * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(MOST_COPY, np.repeat(start + length, pieces) - first)
    literal: np.ndarray | slice = slice(None)
    if len(start):
        inside = np.zeros(n + 1, np.int64)
        inside[start] += 1
        inside[start + length] -= 1
        literal = np.flatnonzero(np.cumsum(inside)[:n] == 0)
    elif cache_bits:
        literal = np.arange(n)
    green = ((argb[literal] >> 8) & 255).astype(np.int64)
    w.put(1 if cache_bits else 0, 1)
    hit = np.zeros(len(green), bool)
    if cache_bits:
        w.put(cache_bits, 4)
        slot = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        last: dict[int, int] = {}
        upto = 0
        for k, i in enumerate(literal.tolist()):
            for j in range(upto, i):
                last[int(slot[j])] = int(argb[j])
            upto = i
            hit[k] = last.get(int(slot[i])) == int(argb[i])
        green[hit] = 256 + LENGTH_CODES + slot[literal[hit]]
    if main:
        w.put(0, 1)  # one group of codes
    prefix, extra_bits, extra = _prefix(size)
    d_prefix, d_bits, d_extra = _prefix(_distance_codes(np.repeat(far, pieces), across))
    alphabet = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    counts = [np.bincount(np.concatenate([green, 256 + prefix]), minlength=alphabet), np.bincount(d_prefix, minlength=DISTANCE_CODES)]
    channels: list[np.ndarray] = []
    given, own_codes = None, False
    alone = main and n > 0 and not ((argb ^ argb[0]) & np.uint32(0xFFFF00FF)).any()
    if prior:
        # all that counts is green and distance, and the codes' description, which takes some five bits a symbol if they are the image's own
        of_green, of_far, heads = _prior_table(prior)
        bits = of_green @ counts[0] + of_far @ counts[1] + heads
        best = int(bits.argmin())
        own = sum(map(_entropy_bits, counts)) + 5 * sum(int(np.count_nonzero(c)) for c in counts) + 60
        if own > (1 - OWN_SAVES) * bits[best]:
            given = prior[best]
    if given is None:
        own_codes = True
        green_lengths, far_lengths = (code_lengths(c, MOST_CODE_BITS).tobytes() for c in (counts[0], counts[1] if len(size) else np.eye(1, DISTANCE_CODES, dtype=np.int64)[0]))
        if alone:
            others = [_single(int(argb[0]) >> shift & 255) for shift in (16, 0, 24)]
        else:
            channels = [((argb[literal] >> shift) & 255).astype(np.int64) for shift in (16, 0, 24)]
            others = [code_lengths(np.bincount(c[~hit], minlength=256), MOST_CODE_BITS).tobytes() for c in channels]
        given = (green_lengths, *others, far_lengths)
    if told is not None:
        told += ["copies"] * bool(len(size)) + ["cache"] * bool(hit.any()) + ["own codes" if own_codes else "shared codes"]
    head, bits, codes = group_header(given)
    w.put(head, bits)
    others, (d_codes, d_sizes) = codes[1:4], codes[4]
    codes, sizes = codes[0]
    value, width = codes[green], sizes[green]
    for channel, (c, s) in zip(channels, others):
        value |= np.where(hit, np.uint64(0), c[channel] << width.astype(np.uint64))
        width = width + np.where(hit, 0, s[channel])
    own = sizes[256 + prefix]
    if not len(first) and not main:
        for v, b in zip(value.tolist(), width.tolist()):
            w.put(v, b)
        return None
    if len(first):  # a copy is two fields: its length, then its distance
        copy, far = codes[256 + prefix] | extra.astype(np.uint64) << own.astype(np.uint64), d_codes[d_prefix] | d_extra.astype(np.uint64) << d_sizes[d_prefix].astype(np.uint64)
        order = np.argsort(np.concatenate([literal, first, first]), kind="stable")
        value, width = np.concatenate([value, copy, far])[order], np.concatenate([width, own + extra_bits, d_sizes[d_prefix] + d_bits])[order]
    at = w.n + np.concatenate([[0], np.cumsum(width)])
    out = np.zeros((int(at[-1]) >> 5) + 3, np.uint64)
    for part in range(0, 32 * -(-int(width.max(initial=1)) // 32), 32):  # at most 32 bits at a time, so that a field and its shift fit 64 bits
        p = at[:-1] + part
        v = ((value >> np.uint64(part)) & np.uint64(0xFFFFFFFF)) << (p & 31).astype(np.uint64)
        word = p >> 5
        keys = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low, high = np.add.reduceat(v & np.uint64(0xFFFFFFFF), keys), np.add.reduceat(v >> np.uint64(32), keys)
        put = word[keys] < len(out) - 1
        out[word[keys][put]] += low[put]
        out[word[keys][put] + 1] += high[put]
    w.n = int(at[-1])
    head = w.value
    for k in range((head.bit_length() + 31) // 32):
        out[k] |= np.uint64((head >> (32 * k)) & 0xFFFFFFFF)
    return out.astype("<u4")


def _start(width: int, height: int, alpha: bool) -> _Writer:
    if not (0 < height <= MOST_SIDE and 0 < width <= MOST_SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    w = _Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.put(value, n)
    return w


def _file(w: _Writer, words: np.ndarray) -> bytes:
    body = words.tobytes()[: (w.n + 7) // 8]
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def encode_grey(grey: np.ndarray, *, prior: tuple[tuple[bytes, ...], ...] | None = None, told: list[str] | None = None) -> bytes:
    """What ``encode`` makes of an opaque grey image with subtract_green, without its four channels in between."""
    w = _start(grey.shape[1], grey.shape[0], False)
    for value, n in ((1, 1), (SUBTRACT_GREEN, 2), (0, 1)):
        w.put(value, n)
    if told is not None:
        told.append("subtract-green")
    return _file(w, _write_image(w, grey.ravel().astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), True, 0, prior, grey.shape[1], told))


def encode(rgba: np.ndarray, *, predictor: tuple[np.ndarray, int] | None = None, cross: tuple[np.ndarray, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, prior: tuple[tuple[bytes, ...], ...] | None = None, told: list[str] | None = None) -> bytes:
    """rgba as lossless WebP. predictor: modes by tile and the tile's bits (2 to 9); cross: factors by tile and the tile's bits.

    prior: code lengths to choose from where the image's own would save little, see ``one_channel``; only for images that vary in green alone.
    """
    height, width = rgba.shape[:2]
    w = _start(width, height, bool((rgba[..., 3] < 255).any()))

    def start(kind: int) -> None:
        w.put(1, 1)
        w.put(kind, 2)

    if palette:
        argb = _join(rgba)
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        start(PALETTE)
        w.put(len(colours) - 1, 8)
        steps = _split(colours)
        steps = np.concatenate([steps[:1], steps[1:] - steps[:-1]])
        _write_image(w, _join(steps), False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << pack))))
        index = (index.reshape(height, -1, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(-1).astype(np.uint8)
        rgba = np.zeros((*index.shape, 4), np.uint8)
        rgba[..., 1], rgba[..., 3] = index, 255
    if predictor is not None:
        modes, tile = predictor
        start(PREDICTOR)
        w.put(tile - 2, 3)
        _write_image(w, (modes.astype(np.uint32) << 8 | np.uint32(0xFF000000)).ravel(), False)
        rgba = predict(rgba, modes, tile, False)
    if cross is not None:
        factors, tile = cross
        start(CROSS_COLOUR)
        w.put(tile - 2, 3)
        f = factors.astype(np.int8).astype(np.uint8).astype(np.uint32)
        _write_image(w, (f[..., 0] | f[..., 1] << 8 | f[..., 2] << 16 | np.uint32(0xFF000000)).ravel(), False)
        rgba = cross_colour(rgba, factors, tile, False)
    if subtract_green:
        start(SUBTRACT_GREEN)
        rgba = rgba.copy()
        rgba[..., 0] -= rgba[..., 1]
        rgba[..., 2] -= rgba[..., 1]
    w.put(0, 1)
    if told is not None:
        told += [name for name, used in (("palette", palette), ("predictor", predictor is not None), ("cross-colour", cross is not None), ("subtract-green", subtract_green)) if used]
    return _file(w, _write_image(w, _join(rgba).ravel(), True, cache_bits, prior, rgba.shape[1], told))
