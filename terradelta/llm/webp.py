"""Lossless WebP (VP8L) in numpy: prefix codes, back-references, colour cache, and the predictor, cross-colour, green and
palette transforms, after the published format (RFC 9649).

Decoding is done in two steps. Where a token ends depends on the bits alone, so the end of a token starting at *every* bit
of a stretch is looked up at once, and the tokens that are really there are found by following those ends in doubled
steps. Then pixels are placed: literals all at once, back-references in order. Only images with several prefix groups or a
colour cache (where a code depends on the pixels before) are read token by token.

Media columns: a text's bytes, padded with 255 to rows of 576, are the 8-bit samples of a grey image. With green taken from
red and blue one prefix code carries the samples, and runs are back-references. Rows beyond the format's 16,384 go to
further images, one behind the other. Files are kept as a binary column of a stored table and decoded from there.

Defined cases: null and empty texts are one row of 255; equal texts give equal files; a damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.common import stored, text_blocks

# Fixed values of the format.
WIDTH = 576
MAX_SIDE = 1 << 14
LENGTH_CODES, DISTANCE_CODES = 24, 40
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000

SEGMENT = 1 << 16  # bytes looked up at once
LEVELS = 4

#: (dx, dy) of the short distance codes: the 120 nearest earlier pixels by distance, then by |dx|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

_REVERSED = np.zeros(1 << 15, dtype=np.int64)
for _i in range(15):
    _REVERSED |= ((np.arange(1 << 15) >> _i) & 1) << (14 - _i)


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical prefix code, low bit first as they stand in the stream."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out, code, last = np.zeros(len(lengths), dtype=np.int64), 0, 0
    for s, n in zip(used.tolist(), lengths[used].tolist()):
        code <<= n - last
        out[s], last, code = code, n, code + 1
    return _REVERSED[out] >> (15 - lengths)


class Code:
    """A prefix code; ``bits`` is 0 if it has one symbol (which then takes no bits)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) else 0
        self.bits = int(lengths.max()) if len(used) > 1 else 0
        self.mask = (1 << self.bits) - 1
        if self.bits:
            # in code order the symbols fill the table in stretches; the stream has the low bit first
            order = used[np.argsort(lengths[used], kind="stable")]
            fill = 1 << (self.bits - lengths[order])
            if int(fill.sum()) != 1 << self.bits:
                raise ValueError("prefix code is not complete")
            turned = _REVERSED[: 1 << self.bits] >> (15 - self.bits)
            self.symbols = np.repeat(order, fill)[turned]
            self.sizes = np.repeat(lengths[order], fill)[turned]
            self.marked = self.sizes + 64 * ((self.symbols >= 256) & (self.symbols < 256 + LENGTH_CODES))  # 64: a back-reference


@lru_cache(512)
def cached_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, dtype=np.int64))


@lru_cache(512)
def simple_code(size: int, one: int, two: int) -> Code:
    if max(one, two) >= size:
        raise ValueError("a symbol outside its alphabet")
    lengths = np.zeros(size, dtype=np.int64)
    lengths[[one, two]] = 1
    return Code(lengths)


def huffman(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Code lengths of at most ``limit`` bits; a lone symbol gets length 1."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    floor = 0
    while True:
        heap = [(max(int(counts[s]), floor), k, (s,)) for k, s in enumerate(used)]
        heapq.heapify(heap)
        depth, made = dict.fromkeys(used, 0), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (both := a[2] + b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], made, both))
            made += 1
        if max(depth.values()) <= limit:
            lengths[list(depth)] = list(depth.values())
            return lengths
        floor = max(1, floor * 2, int(counts.sum()) >> (limit - 1))


def to_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, number of extra bits and extra bits of lengths or distances (from 1)."""
    v = value - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, high - 1)
    code = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return code, extra, v & ((1 << extra) - 1)


def from_prefix(code: np.ndarray, extra: np.ndarray) -> np.ndarray:
    n = np.where(code < 4, 0, (code - 2) >> 1)
    return np.where(code < 4, code, ((2 + (code & 1)) << n) + extra) + 1


def extra_bits(code: np.ndarray) -> np.ndarray:
    return np.where(code < 4, 0, (code - 2) >> 1)


# ---------------------------------------------------------------- decoding


class Reader:
    def __init__(self, data: bytes, start: int):
        self.data, self.at, self.end = data, start * 8, len(data) * 8
        self.buf = np.concatenate((np.frombuffer(data, dtype=np.uint8), np.zeros(64, dtype=np.uint8)))

    def bits(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return code.only
        k = self.at >> 3
        i = (int.from_bytes(self.data[k : k + 4], "little") >> (self.at & 7)) & code.mask
        self.at += int(code.sizes[i])
        return int(code.symbols[i])

    def code(self, size: int) -> Code:
        if self.bits(1):
            two, one = self.bits(1), self.bits(8 if self.bits(1) else 1)
            return simple_code(size, one, self.bits(8) if two else one)
        lengths = np.zeros(size, dtype=np.int64)
        first = np.zeros(19, dtype=np.int64)
        for s in CODE_LENGTH_ORDER[: 4 + self.bits(4)]:
            first[s] = self.bits(3)
        inner, left = cached_code(first.tobytes()), size
        if self.bits(1):
            left = 2 + self.bits(2 + 2 * self.bits(3))
        at, last = 0, 8
        while at < size and left:
            left -= 1
            s = self.symbol(inner)
            if s < 16:
                lengths[at] = s
                at, last = at + 1, s or last
            else:
                n = 3 + self.bits(2) if s == 16 else 3 + self.bits(3) if s == 17 else 11 + self.bits(7)
                if at + n > size:
                    raise ValueError("too many code lengths")
                lengths[at : at + n] = last if s == 16 else 0
                at += n
        return cached_code(lengths.tobytes())

    def group(self, cache: int) -> list[Code]:
        return [self.code(n) for n in (256 + LENGTH_CODES + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_CODES)]

    # -- all tokens of a stretch at once

    def tokens(self, codes: list[Code], n: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(argb, length, distance) of the tokens of ``n`` pixels; distance 0 marks a literal."""
        green, red, blue, alpha, far = codes
        done = 0
        while done < n:
            first = self.at >> 3
            if first >= len(self.data):
                raise ValueError("the image ends early")
            size = min(SEGMENT, len(self.data) - first)
            b = self.buf[first : first + size + 18].astype(np.int64)
            window = ((b[:-2] | (b[1:-1] << 8) | (b[2:] << 16))[:, None] >> np.arange(8)).reshape(-1) & 0x7FFF
            m = size * 8
            look = lambda code, w: code.sizes[w & code.mask] if code.bits else 0
            name = lambda code, w: code.symbols[w & code.mask] if code.bits else np.full(len(w), code.only)
            end = green.marked[window[:m] & green.mask] if green.bits else np.full(m, 64 * (green.only >= 256))
            back = np.flatnonzero(end >= 64)
            end[back] -= 64
            end += np.arange(m)
            begin = end[back]
            for code in (red, blue, alpha):
                if code.bits:
                    end = end + look(code, window[end])
            if len(back):
                at = begin + extra_bits(name(green, window[back]) - 256)
                end[back] = at + look(far, window[at]) + extra_bits(name(far, window[at]))
            steps = [np.concatenate((np.minimum(end, m), [m]))]
            for _ in range(LEVELS):
                steps.append(steps[-1][steps[-1]])
            at, found, far_step = self.at - first * 8, [], steps[LEVELS]
            while at < m:
                found.append(at)
                at = int(far_step[at])
            p = np.array(found, dtype=np.int64)
            for step in reversed(steps[:LEVELS]):
                p = np.stack((p, step[p]), axis=1).reshape(-1)
            p = p[p < m]
            s = name(green, window[p])
            is_back = s >= 256
            length, distance = np.ones(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
            begin = p + look(green, window[p])
            if is_back.any():
                q, c = begin[is_back], s[is_back] - 256
                n_extra = extra_bits(c)
                length[is_back] = from_prefix(c, window[q] & ((1 << n_extra) - 1))
                q = q + n_extra
                d = name(far, window[q])
                q = q + look(far, window[q])
                n_extra = extra_bits(d)
                distance[is_back] = pixel_distance(from_prefix(d, (window[q] | (window[q + 15] << 15)) & ((1 << n_extra) - 1)), width)
            total = done + np.cumsum(length)
            k = min(len(p), int(np.searchsorted(total, n)) + 1)
            argb = (s & 255).astype(np.uint32) << 8
            for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
                if code.bits:
                    w = window[begin] & code.mask
                    argb |= code.symbols[w].astype(np.uint32) << shift
                    begin = begin + code.sizes[w]
                else:
                    argb |= np.uint32(code.only << shift)
            done = int(total[k - 1])
            self.at = int(end[p[k - 1]]) + first * 8
            yield argb[:k], length[:k], distance[:k]
        if done != n or self.at > self.end:
            raise ValueError("the image does not end with its last row")

    def pixels(self, width: int, height: int, main: bool) -> np.ndarray:
        n = width * height
        cache = self.bits(4) if self.bits(1) else 0
        groups, which, block = [], None, 0
        if main and self.bits(1):
            block = self.bits(3) + 2
            which = ((self.pixels(-(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF).astype(np.int64)
        for _ in range(1 if which is None else int(which.max()) + 1):
            groups.append(self.group(cache))
        if which is None and not cache:
            return self._placed(groups[0], n, width)
        return self._one_by_one(groups, which, block, cache, n, width)

    def _placed(self, codes: list[Code], n: int, width: int) -> np.ndarray:
        if not any(c.bits for c in codes[:4]) and codes[0].only < 256:
            return np.full(n, codes[3].only << 24 | codes[1].only << 16 | codes[0].only << 8 | codes[2].only, dtype=np.uint32)
        out, at = np.zeros(n, dtype=np.uint32), 0
        for argb, length, distance in self.tokens(codes, n, width):
            place = at + np.cumsum(length) - length
            literal = distance == 0
            out[place[literal]] = argb[literal]
            for p, k, d in zip(place[~literal].tolist(), length[~literal].tolist(), distance[~literal].tolist()):
                _copy(out, p, k, d)
            at = int(place[-1] + length[-1])
        return out

    def _one_by_one(self, groups: list, which: np.ndarray | None, block: int, cache: int, n: int, width: int) -> np.ndarray:
        out, at, held, cached = np.zeros(n, dtype=np.uint32), 0, [0] * (1 << cache), 0
        per_row = -(-width >> block)

        def fill(upto: int) -> None:
            nonlocal cached
            for v in out[cached:upto].tolist():
                held[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache)] = v
            cached = upto

        while at < n:
            codes = groups[0] if which is None else groups[int(which[(at // width >> block) * per_row + (at % width >> block)])]
            s = self.symbol(codes[0])
            if s < 256:
                red, blue, alpha = (self.symbol(c) for c in codes[1:4])
                out[at] = alpha << 24 | red << 16 | s << 8 | blue
                at += 1
            elif s < 256 + LENGTH_CODES:
                k = int(from_prefix(np.int64(s - 256), self.bits(int(extra_bits(np.int64(s - 256))))))
                d = self.symbol(codes[4])
                d = int(pixel_distance(from_prefix(np.array([d]), np.array([self.bits(int(extra_bits(np.int64(d))))])), width)[0])
                _copy(out, at, k, d)
                at += k
            else:
                fill(at)
                out[at] = held[s - 256 - LENGTH_CODES]
                at += 1
        return out


def _copy(out: np.ndarray, at: int, n: int, back: int) -> None:
    if back > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    out[at : at + n] = out[at - back : at - back + n] if back >= n else np.resize(out[at - back : at], n)


_NEAR_X, _NEAR_Y = (np.array(x, dtype=np.int64) for x in zip(*NEAR))


def pixel_distance(code: np.ndarray, width: int) -> np.ndarray:
    near = np.minimum(code, len(NEAR)) - 1
    return np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width))


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    r = Reader(data, 21)
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform is given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.bits(3) + 2
            transforms.append((kind, inner, block, r.pixels(-(-inner >> block), -(-height >> block), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind,))
        else:
            size = r.bits(8) + 1
            colours = np.cumsum(split(r.pixels(size, 1, False)), axis=0, dtype=np.int64) & 255
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, inner, pack, colours))
            inner = -(-inner >> pack)
    image = r.pixels(inner, height, True).reshape(height, inner)
    for kind, *how in reversed(transforms):
        image = packed_green(image) if kind == SUBTRACT_GREEN else merge(INVERSE[kind](split(image), *how))
    return image


def packed_green(argb: np.ndarray) -> np.ndarray:
    """Add green to red and blue of packed pixels."""
    green = (argb >> np.uint32(8)) & np.uint32(255)
    red_blue = ((argb & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF)
    return (argb & np.uint32(0xFF00FF00)) | red_blue


def split(argb: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def merge(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


# ---------------------------------------------------------------- transforms (on alpha, red, green, blue)


def take_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] = (out[..., 1] - out[..., 2]) & 255
    out[..., 3] = (out[..., 3] - out[..., 2]) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 128) - 128


def _spread(values: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """A value per block, for every pixel."""
    table = values.reshape(-(-height >> block), -(-width >> block), *values.shape[1:])
    return table.repeat(1 << block, axis=0)[:height].repeat(1 << block, axis=1)[:, :width]


def cross_colour(image: np.ndarray, width: int, block: int, elements: np.ndarray, sign: int = 1) -> np.ndarray:
    """Add (or take away) what green says about red and blue, and red about blue."""
    e = _signed(_spread(split(elements), block, image.shape[0], width))
    red_blue, green_blue, green_red = e[..., 1], e[..., 2], e[..., 3]
    out, green = image.copy(), _signed(image[..., 2])
    out[..., 1] = (image[..., 1] + sign * (green_red * green >> 5)) & 255
    red = out[..., 1] if sign > 0 else image[..., 1]
    out[..., 3] = (image[..., 3] + sign * ((green_blue * green >> 5) + (red_blue * _signed(red) >> 5))) & 255
    return out


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left, top, right, corner) -> np.ndarray:
    """What a mode expects of pixels with these neighbours (left, top, top right, top left)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, right), top)
    if mode <= 9:
        return _halves(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _halves(_halves(left, corner), _halves(top, right))
    if mode == 11:
        closer = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(closer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _halves(left, top)
    gap = mean - corner
    return np.clip(mean + (np.abs(gap) >> 1) * np.sign(gap), 0, 255)


def _row_modes(modes: np.ndarray, block: int, y: int, width: int) -> np.ndarray:
    per_row = -(-width >> block)
    return (modes[(y >> block) * per_row : ((y >> block) + 1) * per_row] >> 8 & 255).astype(np.int64).repeat(1 << block)[:width]


def predicted(image: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    """Undo the predictor: the residuals plus what each pixel's mode expects. Modes that need the left pixel go pixel by pixel."""
    out = image.copy()
    for y in range(image.shape[0]):
        row, kinds = out[y], _row_modes(modes, block, y, width)
        if y == 0:
            row[0] = (row[0] + [255, 0, 0, 0]) & 255
            row[:] = np.cumsum(row, axis=0) & 255
            continue
        above = out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < width:
            end = x + 1
            while end < width and kinds[end] == kinds[x]:
                end += 1
            mode = int(kinds[x])
            if mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], axis=0)) & 255
            else:
                at_once = mode in (0, 2, 3, 4, 8, 9) or mode > 13
                for lo, hi in [(x, end)] if at_once else [(i, i + 1) for i in range(x, end)]:
                    # the pixel right of the last column is the first of this row
                    right = above[lo + 1 : hi + 1] if hi < width else np.concatenate((above[lo + 1 : width], row[:1]))
                    row[lo:hi] = (row[lo:hi] + predict(mode, row[lo - 1 : hi - 1], above[lo:hi], right, above[lo - 1 : hi - 1])) & 255
            x = end
    return out


def unpredicted(image: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    """Residuals of the predictor."""
    out = image.copy()
    out[0, 0] = (image[0, 0] - [255, 0, 0, 0]) & 255
    out[0, 1:] = (image[0, 1:] - image[0, :-1]) & 255
    for y in range(1, image.shape[0]):
        above, row, kinds = image[y - 1], image[y], _row_modes(modes, block, y, width)
        right = np.concatenate((above[2:], row[:1])) if width > 1 else above[:0]
        out[y, 0] = (row[0] - above[0]) & 255
        for mode in np.unique(kinds[1:]).tolist():
            x = np.flatnonzero(kinds[1:] == mode)
            out[y, x + 1] = (row[x + 1] - predict(mode, row[x], above[x + 1], right[x], above[x])) & 255
    return out


def unpacked(image: np.ndarray, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    """Colours of palette indices, of which a green value may hold 2, 4 or 8."""
    bits, x = 8 >> pack, np.arange(width)
    index = (image[:, x >> pack, 2] >> ((x & ((1 << pack) - 1)) * bits)) & ((1 << bits) - 1)
    table = np.zeros((256, 4), dtype=np.int64)
    table[: len(colours)] = colours
    return table[index]


INVERSE = {PREDICTOR: predicted, CROSS_COLOUR: cross_colour, PALETTE: unpacked}


# ---------------------------------------------------------------- encoding


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, lengths: np.ndarray) -> None:
        """Code lengths, each in a fixed code (4 bits; 5 for lengths 1 and 13 to 15) with runs of zeros."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            self.bits(1, 1)
            self.bits(max(0, len(used) - 1), 1)
            self.bits(1, 1)
            self.bits(int(used[0]) if len(used) else 0, 8)
            if len(used) == 2:
                self.bits(int(used[1]), 8)
            return
        self.bits(0, 1)
        sizes, codes = _length_code()
        self.bits(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.bits(int(sizes[s]), 3)
        self.bits(0, 1)
        edge = (np.flatnonzero(np.diff(lengths != 0)) + 1).tolist()
        values = lengths.tolist()
        for lo, hi in zip([0, *edge], [*edge, len(values)]):
            if values[lo]:
                for n in values[lo:hi]:
                    self.bits(codes[n], sizes[n])
                continue
            left = hi - lo
            while left:
                n = min(left, 138)
                s, extra, size = (18, n - 11, 7) if n >= 11 else (17, n - 3, 3) if n >= 3 else (0, 0, 0)
                self.bits(codes[s] | extra << sizes[s], sizes[s] + size)
                left -= n if n >= 3 else 1

    def single(self, symbol: int) -> None:
        """A code of one symbol under 256."""
        self.bits(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)

    def data(self, value: np.ndarray, size: np.ndarray) -> None:
        """Many fields at once."""
        keep = size > 0
        value, size = value[keep].astype(np.uint64), size[keep]
        if not len(size):
            return
        at = (self.n & 63) + np.cumsum(size) - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        words = np.zeros(int(at[-1] + size[-1] >> 6) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero((at & 63) + size > 64)
        words[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        low = self.n & ~63
        self.value |= int.from_bytes(words.tobytes(), "little") << low
        self.n = low + int(at[-1] + size[-1])


@lru_cache
def _length_code() -> tuple[list[int], list[int]]:
    sizes = np.array([4] * 16 + [0, 4, 4], dtype=np.int64)
    sizes[[1, 13, 14, 15]] = 5
    return sizes.tolist(), canonical(sizes).tolist()


def run_tokens(argb: np.ndarray, shortest: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, length, distance) tokens: literals, and the rest of a long run as a copy of the pixel before."""
    n = len(argb)
    start = np.flatnonzero(np.concatenate(([True], argb[1:] != argb[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    long = size > shortest
    if not long.any():
        return np.arange(n), np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    parts = -(-(size[long] - 1) // 4096)
    at = np.repeat(start[long] + 1, parts) + 4096 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    length = np.minimum(4096, np.repeat(start[long] + size[long], parts) - at)
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + length, -1)
    literal = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    pixel = np.concatenate((literal, at))
    order = np.argsort(pixel)
    return pixel[order], np.concatenate((np.ones(len(literal), dtype=np.int64), length))[order], np.concatenate((np.zeros(len(literal), dtype=np.int64), np.ones(len(at), dtype=np.int64)))[order]


def match_tokens(argb: np.ndarray, shortest: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy back-references to the last place where the next pixels stood."""
    v, last, out, at = argb.tolist(), {}, [], 0
    while at < len(v):
        key, n = tuple(v[at : at + shortest]), 0
        seen = last.get(key)
        if seen is not None and len(key) == shortest:
            while at + n < len(v) and n < 4096 and v[seen + n] == v[at + n]:
                n += 1
        out.append((at, n, at - seen) if n else (at, 1, 0))
        for i in range(at, at + max(1, n)):
            last[tuple(v[i : i + shortest])] = i
        at += max(1, n)
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out))


def write_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, tokens=run_tokens, cache: int = 0, group_bits: int = 0) -> None:
    """An entropy-coded image; ``group_bits`` deals blocks of that size to two prefix groups in turn."""
    w.bits(1 if cache else 0, 1)
    if cache:
        w.bits(cache, 4)
    pixel, length, distance = tokens(argb)
    group, n_groups = np.zeros(len(pixel), dtype=np.int64), 1
    if main:
        w.bits(1 if group_bits else 0, 1)
        if group_bits:
            w.bits(group_bits - 2, 3)
            across, down = -(-width >> group_bits), -(-(len(argb) // width) >> group_bits)
            deal = np.arange(across * down, dtype=np.uint32) & 1
            write_pixels(w, deal << 8 | np.uint32(BLACK), across, False)
            group = deal[(pixel // width >> group_bits) * across + (pixel % width >> group_bits)].astype(np.int64)
            n_groups = int(deal.max()) + 1
    literal = distance == 0
    back = np.flatnonzero(~literal)
    n_code, n_extra, n_bits = to_prefix(length[back])
    # a distance to the pixel before is the second of the short codes, others are written in full
    d_code, d_extra, d_bits = to_prefix(np.where(distance[back] == 1, NEAR.index((1, 0)) + 1, distance[back] + len(NEAR)))
    shown = argb[pixel]
    green = (shown >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    green[back] = 256 + n_code
    if cache:
        held, upto = {}, 0
        values = argb.tolist()
        for i, (p, lit) in enumerate(zip(pixel.tolist(), literal.tolist())):
            for v in values[upto:p]:
                held[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache)] = v
            upto = p
            slot = (CACHE_MULTIPLIER * values[p] & 0xFFFFFFFF) >> (32 - cache)
            if lit and held.get(slot, 0) == values[p]:
                green[i] = 256 + LENGTH_CODES + slot
    plain = np.flatnonzero(green < 256)
    sizes = (256 + LENGTH_CODES + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_CODES)
    every = np.arange(len(green))
    varies = int(np.bitwise_or.reduce(shown ^ shown[0])) if len(shown) else 0
    rows = {k: plain if varies >> k & 255 else plain[:1] for k in (16, 0, 24)}  # of a constant channel the first will do
    streams = [(every, green), *((at, (shown[at] >> np.uint32(k) & np.uint32(255)).astype(np.int64)) for k, at in rows.items()), (back, d_code)]
    fields: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in range(n_groups):
        for (rows, symbols), n, k in zip(streams, sizes, (0, 2, 3, 4, 5)):
            if n_groups > 1:
                mine = group[rows] == g
                rows, symbols = rows[mine], symbols[mine]
            if len(symbols) <= 1 and (not len(symbols) or symbols[0] < 256):
                w.single(int(symbols[0]) if len(symbols) else 0)
                continue
            lengths = huffman(np.bincount(symbols, minlength=n))
            w.code(lengths)
            if np.count_nonzero(lengths) > 1:
                value, size = fields.setdefault(k, (np.zeros(len(green), dtype=np.int64), np.zeros(len(green), dtype=np.int64)))
                value[rows], size[rows] = canonical(lengths)[symbols], lengths[symbols]
    for k, bits, extra in ((1, n_bits, n_extra), (6, d_bits, d_extra)):
        if extra.any():
            fields[k] = np.zeros(len(green), dtype=np.int64), np.zeros(len(green), dtype=np.int64)
            fields[k][0][back], fields[k][1][back] = bits, extra
    if fields:
        used = [fields[k] for k in sorted(fields)]
        w.data(*(used[0] if len(used) == 1 else (np.column_stack([f[i] for f in used]).reshape(-1) for i in (0, 1))))


def container(w: Writer) -> bytes:
    body = b"\x2f" + w.value.to_bytes((w.n + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def header(width: int, height: int) -> Writer:
    w = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.bits(value, n)
    return w


def encode(argb: np.ndarray, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None, green: bool = False, tokens=run_tokens, cache: int = 0, group_bits: int = 0) -> bytes:
    """A file of ARGB pixels (height, width) with the given transforms (block bits and a value per block)."""
    height, width = argb.shape
    w, image = header(width, height), split(argb)
    for kind, how, forward in ((PREDICTOR, predictor, unpredicted), (CROSS_COLOUR, cross, lambda *a: cross_colour(*a, sign=-1))):
        if how:
            w.bits(1, 1)
            w.bits(kind, 2)
            w.bits(how[0] - 2, 3)
            write_pixels(w, how[1], -(-width >> how[0]), False)
            image = forward(image, width, *how)
    if green:
        w.bits(1, 1)
        w.bits(SUBTRACT_GREEN, 2)
        image = take_green(image)
    w.bits(0, 1)
    write_pixels(w, merge(image).reshape(-1), width, True, tokens, cache, group_bits)
    return container(w)


def encode_grey(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples (height, width) as a grey image: green holds the samples, red and blue follow from it."""
    height, width = samples.shape
    w = header(width, height)
    w.bits(1, 1)
    w.bits(SUBTRACT_GREEN, 2)
    w.bits(0, 1)
    write_pixels(w, (samples.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK)).reshape(-1), width, True)
    return container(w)


def encode_palette(samples: np.ndarray) -> bytes:
    """The same with a palette of the grey levels; up to 16 levels go several to a pixel."""
    height, width = samples.shape
    levels = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    w = header(width, height)
    w.bits(1, 1)
    w.bits(PALETTE, 2)
    w.bits(len(levels) - 1, 8)
    step = np.diff(levels, prepend=0).astype(np.uint32)
    colours = step << 16 | step << 8 | step
    colours[0] |= np.uint32(BLACK)
    write_pixels(w, colours, len(levels), False)
    w.bits(0, 1)
    index = np.zeros(256, dtype=np.uint32)
    index[levels] = np.arange(len(levels))
    image = index[samples]
    pack = 3 if len(levels) <= 2 else 2 if len(levels) <= 4 else 1 if len(levels) <= 16 else 0
    if pack:
        per, bits = 1 << pack, 8 >> pack
        padded = np.zeros((height, -(-width // per) * per), dtype=np.uint32)
        padded[:, :width] = image
        image = (padded.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(bits))).sum(axis=2, dtype=np.uint32)
    write_pixels(w, (image << np.uint32(8) | np.uint32(BLACK)).reshape(-1), image.shape[1], True)
    return container(w)


# ---------------------------------------------------------------- media columns


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def to_media(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_grey(rows[i : i + MAX_SIDE]) for i in range(0, len(rows), MAX_SIDE))


def from_media(media: bytes) -> np.ndarray:
    """The samples (rows, 576) of one or more files in a row."""
    images, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        images.append(((decode(media[at:end]) >> 8) & 255).astype(np.uint8))
        at = end
    return np.concatenate(images)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation, levels and a 64-bit difference hash of 65 equal stretches."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    mean = float(counts @ np.arange(256)) / len(flat)
    deviation = float(counts @ (np.arange(256) - mean) ** 2 / len(flat)) ** 0.5
    edges = np.arange(65) * len(flat) // 65
    strips = np.add.reduceat(flat, edges, dtype=np.int64) / np.diff(np.concatenate((edges, [len(flat)])))
    bits = np.packbits(strips[1:] > strips[:-1]).tobytes().hex()
    return f"{len(samples)};{mean:.4f};{deviation:.4f};{np.count_nonzero(counts)};{bits}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], type=pa.int64()),
                                                  pa.array([to_media(payload(t)) for t in texts], type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded samples of a media column."""

    def row(doc_id, n_bytes: int, data: bytes) -> tuple:
        samples = from_media(data)
        own = samples.tobytes()
        return doc_id, n_bytes, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEDIA_SCHEMA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in MEDIA_SCHEMA.split(", ")]
        for b in batches:
            rows = [row(*(x.as_py() for x in r)) for r in zip(*b.columns)]
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, MEDIA_SCHEMA)


def stored_media_features(docs: DataFrame) -> DataFrame:
    """Store every text as a file in a table of the shared folder, read the files back and describe them."""
    return media_features(stored(media_column(docs), "media"))
