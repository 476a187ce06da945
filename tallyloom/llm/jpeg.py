"""Progressive JPEG of many images at once, by numpy: scans written from and accumulated into coefficient arrays.

An image is a strip of MCUs with components Y (sampled 2 x 2) and Cb, Cr (1 x 1): six blocks of 64
coefficients each. Blocks stand in component order (Y, Cb, Cr), each component's in raster order, with
coefficients in zigzag order. SCRIPT splits coefficients by spectral selection (bands) and successive
approximation (the lowest bit in scans of its own). Every RESTART MCUs the stream restarts, so that
intervals stand alone: all intervals of all images are coded and decoded in step, one symbol of each
at a time, and no Python step is taken for a single coefficient.

The reader follows the streams' own tables, scans and restart intervals, with runs of ended blocks;
other sampling, arithmetic coding or sample depth raise ValueError.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: MCUs between restarts, most MCUs in a row (65535 / 16), blocks that are coded at once.
RESTART, ROW, AT_ONCE = 4, 4095, 1 << 14
#: Blocks of an MCU by component, and its samples' width and height.
PATTERN, SIDE = np.array([0, 0, 0, 0, 1, 2]), 16


@dataclass(frozen=True)
class Scan:
    """Coefficients first to last of the components; high is 0 in their first scan, else the bit position before this one; low the position now."""

    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int


SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1), Scan((0,), 1, 5, 0, 1), Scan((0,), 6, 63, 0, 1), Scan((1,), 1, 63, 0, 1), Scan((2,), 1, 63, 0, 1),
    Scan((0, 1, 2), 0, 0, 1, 0), Scan((0,), 1, 63, 1, 0), Scan((1,), 1, 63, 1, 0), Scan((2,), 1, 63, 1, 0),
)
#: Row and column of each coefficient: diagonals, every other one upwards.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
#: The inverse transform of a block as one matrix of integers: coefficients (zigzag) by samples (raster), times 2**SCALE.
SCALE = 20


def _basis() -> np.ndarray:
    at = np.arange(8)
    wave = np.array([np.cos((2 * at + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)])
    return np.rint(np.array([np.outer(wave[r], wave[c]).ravel() for r, c in ZIGZAG]) * 2**SCALE)


BASIS = _basis()
_WIDTH = np.array([int(v).bit_length() for v in range(4096)], np.int32)


# Codes --------------------------------------------------------------------------------------------
def lengths(weights: dict[int, int]) -> list[tuple[int, int]]:
    """(length, symbol) of a Huffman code in canonical order; the code of ones alone stays unused, as the format asks."""
    heap = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    deep = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            deep[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    out = sorted((n, s) for s, n in deep.items() if s >= 0)
    if out[-1][0] > 16:
        raise ValueError("weights differ too much for codes of 16 bits")
    return out


def _spec(code: list[tuple[int, int]]) -> bytes:
    """A table as the format has it: how many codes of each length, then their symbols."""
    return bytes(sum(n == k for n, _ in code) for k in range(1, 17)) + bytes(s for _, s in code)


def _canonical(spec: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a table."""
    out, code, at = [], 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            out.append((code, n, spec[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _reading(spec: bytes) -> np.ndarray:
    """For each 16 bits that may come: length of the code they begin with, and 256 times its symbol; 0 if there is none."""
    out = np.zeros(1 << 16, np.int64)
    for code, n, symbol in _canonical(spec):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n | symbol << 8
    return out


@lru_cache(64)
def _writing(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for c, n, symbol in _canonical(spec):
        code[symbol], size[symbol] = c, n
    return code, size


def _tables() -> tuple[bytes, bytes, bytes]:
    """Specs for DC, first AC and later AC scans, from rough weights: short magnitudes and no runs are the rule."""
    dc = {s: 4 if 2 < s < 8 else 1 for s in range(10)}
    ends = {r << 4: 1 for r in range(1, 15)}
    often = (40, 30, 16, 6, 4, 3, 2, 1)
    first = {r << 4 | s: max(1, often[s - 1] * 50 // 40**r) for r in range(16) for s in range(1, 9)} | ends | {0x00: 30, 0xF0: 2}
    later = {r << 4 | 1: max(1, 40 >> r) for r in range(16)} | ends | {0x00: 200, 0xF0: 2}
    return tuple(_spec(lengths(w)) for w in (dc, first, later))


DC, AC_FIRST, AC_LATER = _tables()



# Places -------------------------------------------------------------------------------------------
def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass(frozen=True)
class Places:
    """Where the blocks of images of `wide` by `high` MCUs stand, one image after another."""

    wide: np.ndarray
    high: np.ndarray

    @property
    def mcus(self) -> np.ndarray:
        return self.wide * self.high

    @property
    def base(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(6 * self.mcus)))

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(blocks in the order of a scan, MCUs of the scan in each image, blocks of an MCU of the scan)."""
        n, base = self.mcus, self.base[:-1]
        if len(components) == 1:
            (c,) = components
            count = 4 * n if c == 0 else n
            return ranges(base + (0 if c == 0 else (3 + c) * n), count), count, 1
        return self.by_mcu().ravel(), n, 6

    def by_mcu(self) -> np.ndarray:
        """The six blocks of each MCU."""
        n, base = self.mcus, self.base[:-1]
        j, wide = ranges(np.zeros(len(n), np.int64), n), np.repeat(self.wide, n)
        y = np.repeat(base, n) + (j // wide) * 4 * wide + (j % wide) * 2
        cb = np.repeat(base + 4 * n, n) + j
        return np.stack([y, y + 1, y + 2 * wide, y + 2 * wide + 1, cb, cb + np.repeat(n, n)], axis=1)


def _intervals(units: np.ndarray, each: int, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of every interval, intervals of every image) for scans of `units` MCUs of `each` blocks."""
    per = -(-units // restart)
    sizes = np.full(int(per.sum()), restart, np.int64)
    sizes[np.cumsum(per) - 1] = units - (per - 1) * restart
    return sizes * each, per


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of intervals of about AT_ONCE blocks together."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
        yield first, last
        first = last


# Writing ------------------------------------------------------------------------------------------
def _magnitude(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << width) - 1, value)


def _dc_first(c: np.ndarray, sizes: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each block: the difference to the component's block before it, none before an interval's first."""
    v = (c[:, 0].astype(np.int64) >> scan.low).reshape(-1, 6)
    before = np.zeros_like(v)
    before[:, 1:4] = v[:, :3]
    before[1:, 0], before[1:, 4:] = v[:-1, 3], v[:-1, 4:]
    start = (np.cumsum(sizes) - sizes) // 6
    before[start, 0], before[start, 4:] = 0, 0
    diff = (v - before).ravel()
    width = _WIDTH[np.abs(diff)]
    code, size = _writing(DC)
    return code[width] << width | _magnitude(diff, width), size[width] + width


def _before(marks: np.ndarray) -> np.ndarray:
    """The last marked place before each place of a row; -1 if there is none."""
    out = np.full(marks.shape, -1, np.int8)
    out[:, 1:] = np.maximum.accumulate(np.where(marks, np.arange(marks.shape[1], dtype=np.int8), np.int8(-1)), axis=1)[:, :-1]
    return out.astype(np.int64)


def _ac_first(c: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the band, and one for the block's end, the bits that are written there."""
    band = c[:, scan.first : scan.last + 1].astype(np.int32)
    size = np.abs(band) >> scan.low
    n = band.shape[1]
    code, length = _writing(AC_FIRST)
    symbol = _WIDTH[size]
    bits = np.zeros((len(c), n + 1), np.int32)
    values = np.zeros_like(bits)
    bits[:, :n] = length[symbol] + symbol
    values[:, :n] = code[symbol] << symbol | _magnitude(np.where(band < 0, -size, size), symbol)
    # Blocks with zeros: runs before values, and the end.
    rows = np.flatnonzero((size == 0).any(axis=1))
    there, at = size[rows] > 0, np.arange(n)
    last = np.where(there, at, -1).max(axis=1)
    run, width = at - _before(there) - 1, symbol[rows]
    ran = (run & 15) << 4 | width
    skip = ~there & (run % 16 == 15) & (at < last[:, None])
    values[rows, :n] = np.where(there, code[ran] << width | values[rows, :n] & ((1 << width) - 1), code[0xF0])
    bits[rows, :n] = np.where(there, length[ran] + width, np.where(skip, length[0xF0], 0))
    bits[rows, n], values[rows, n] = np.where(last < n - 1, length[0], 0), code[0]
    return values, bits


def _ac_later(c: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Symbols for coefficients that become nonzero stand before the next bits of those that were so already, up to their place."""
    band = c[:, scan.first : scan.last + 1]
    size = np.abs(band) >> scan.low
    old, new = size > 1, size == 1
    n = band.shape[1]
    bits = np.zeros((len(c), n + 1, 2), np.int32)
    values = np.zeros_like(bits)
    bits[:, :n, 1], values[:, :n, 1] = old, size & 1
    code, length = _writing(AC_LATER)
    at = np.arange(n)
    last = np.where(new, at, -1).max(axis=1)
    rows = np.flatnonzero(last < n - 1)
    bits[rows, last[rows] + 1, 0], values[rows, last[rows] + 1, 0] = length[0], code[0]
    busy = np.flatnonzero(last >= 0)  # only blocks with new coefficients have more symbols
    fresh, plain = new[busy], np.cumsum(size[busy] == 0, axis=1)
    before = _before(fresh)
    zeros = plain - np.where(before >= 0, np.take_along_axis(plain, np.maximum(before, 0), axis=1), 0)
    marks = fresh | (size[busy] == 0) & (zeros % 16 == 0) & (at < last[busy][:, None])
    i, k = np.nonzero(marks)
    place = _before(marks)[i, k] + 1
    is_new = fresh[i, k]
    symbol = np.where(is_new, (zeros[i, k] & 15) << 4 | 1, 0xF0)
    bits[busy[i], place, 0] = length[symbol] + is_new
    values[busy[i], place, 0] = np.where(is_new, code[symbol] << 1 | (band[busy[i], k] > 0), code[symbol])
    return values.reshape(len(c), -1), bits.reshape(len(c), -1)


def _packed(values: np.ndarray, bits: np.ndarray, interval: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each interval): bits one after another, each interval filled with ones, FF followed by 00."""
    there = np.flatnonzero(bits)
    values, bits, interval = values[there], bits[there], interval[there]
    ends = np.cumsum(bits, dtype=np.int64)
    total = np.diff(ends[np.searchsorted(interval, np.arange(n), side="right") - 1], prepend=0)
    sizes = (total + 7) // 8
    offsets = np.cumsum(sizes) - sizes
    place = ends - bits + np.repeat(8 * offsets - (np.cumsum(total) - total), np.bincount(interval, minlength=n))
    bitmap = np.zeros(8 * int(sizes.sum()), np.uint8)
    left = bits.astype(np.int64) - 1
    while len(place):  # the first bit of every token, the second of those that have one, ...
        bitmap[place] = (values >> left) & 1
        more = np.flatnonzero(left)
        place, values, left = place[more] + 1, values[more], left[more] - 1
    bitmap[ranges(8 * offsets + total, 8 * sizes - total)] = 1
    data = np.packbits(bitmap)
    full = np.flatnonzero(data == 255)
    sizes = sizes + np.bincount(np.searchsorted(offsets, full, side="right") - 1, minlength=n)
    return np.insert(data, full + 1, 0), sizes


def _write_scan(coefs: np.ndarray, places: Places, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(the scan's bytes of all images with restart markers, where each image's begin and end)."""
    order, units, each = places.order(scan.components)
    sizes, per = _intervals(units, each, RESTART)
    starts = np.cumsum(sizes) - sizes
    datas, counts = [], []
    for a, b in _parts(sizes):
        own = sizes[a:b]
        c = coefs[order[starts[a] : starts[a] + int(own.sum())]]
        interval = np.repeat(np.arange(b - a), own)
        if scan.first == 0:
            values, bits = _dc_first(c, own, scan) if scan.high == 0 else ((c[:, 0].astype(np.int32) >> scan.low) & 1, np.ones(len(c), np.int32))
        else:
            values, bits = (_ac_first if scan.high == 0 else _ac_later)(c, scan)
            interval = np.repeat(interval, values.shape[1])
        data, count = _packed(values.ravel(), bits.ravel(), interval, b - a)
        datas.append(data)
        counts.append(count)
    data, count = np.concatenate(datas), np.concatenate(counts)
    number = ranges(np.zeros(len(per), np.int64), per)
    marked = np.ones(len(count), np.int64)
    marked[np.cumsum(per) - 1] = 0
    ends = np.cumsum(count + 2 * marked)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ranges(ends - count - 2 * marked, count)] = data
    at = (ends - 2)[marked > 0]
    out[at], out[at + 1] = 255, 0xD0 + number[marked > 0] % 8
    return out, np.concatenate(([0], ends[np.cumsum(per) - 1]))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def _head(wide: int, high: int, comment: bytes) -> bytes:
    frame = struct.pack(">BHHB", 8, SIDE * high, SIDE * wide, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    tables = b"".join((b"\x00" + DC, b"\x10" + AC_FIRST, b"\x11" + AC_LATER))
    return b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", RESTART))


def _scan_head(scan: Scan) -> bytes:
    table = 0x00 if scan.first == 0 or scan.high == 0 else 0x01
    return _segment(0xDA, bytes((len(scan.components), *(b for c in scan.components for b in (c + 1, table)), scan.first, scan.last, scan.high << 4 | scan.low)))


def encode(coefs: np.ndarray, places: Places, comments: list[bytes]) -> list[bytes]:
    """A file for each image; coefs: all blocks in component order, zigzag within a block."""
    scans = [(_scan_head(s), *_write_scan(coefs, places, s)) for s in SCRIPT]
    out = []
    for d, (w, h, comment) in enumerate(zip(places.wide.tolist(), places.high.tolist(), comments, strict=True)):
        parts = [_head(w, h, comment)]
        for head, data, at in scans:
            parts += (head, data[at[d] : at[d + 1]].tobytes())
        out.append(b"".join((*parts, b"\xff\xd9")))
    return out


# Reading ------------------------------------------------------------------------------------------
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


@dataclass(frozen=True)
class Header:
    """What a file says: size in MCUs, comment, quantities by component, scans as (Scan, table, restart interval, where its data begins and ends)."""

    wide: int
    high: int
    comment: bytes
    quantities: tuple[bytes, ...]
    scans: tuple[tuple[Scan, bytes, int, int, int], ...]


def header(media: bytes) -> Header:
    if media[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, wide, high, comment, restart = 2, 0, 0, b"", 0
    quantities: dict[int, bytes] = {}
    codes: dict[int, bytes] = {}
    of: tuple[int, ...] = ()
    ids: list[int] = []
    scans = []
    while media[at : at + 2] != b"\xff\xd9":
        if media[at : at + 1] != b"\xff" or at + 4 > len(media):
            raise ValueError(f"no marker at byte {at}")
        mark, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFE:
            comment = body
        elif mark == 0xDB:
            for i in range(0, len(body), 65):
                quantities[body[i]] = body[i + 1 : i + 65]
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                codes[body[0]], body = body[1:n], body[n:]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xC2:
            depth, tall, broad, n = struct.unpack(">BHHB", body[:6])
            ids = list(body[6::3])
            if depth != 8 or n != 3 or bytes(body[7::3]) != b"\x22\x11\x11" or tall % SIDE or broad % SIDE:
                raise ValueError("only 8 bits, three components, the first sampled 2 x 2, whole MCUs")
            wide, high, of = broad // SIDE, tall // SIDE, tuple(body[8::3])
        elif mark == 0xDA:
            n = body[0]
            chosen = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            table = codes.get(body[2] >> 4 if first == 0 else 0x10 | body[2] & 15, b"")
            found = _MARK.search(media, at)
            if not found:
                raise ValueError("a scan without an end")
            scans.append((Scan(chosen, first, last, bits >> 4, bits & 15), table, restart, at, found.start()))
            at = found.start()
        elif mark in (0xC0, 0xC1) or 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not progressive")
    return Header(wide, high, comment, tuple(quantities[q] for q in of), tuple(scans))


class _Stream:
    """Bits of many intervals, and where each begins."""

    def __init__(self, chunks: list[bytes], per: np.ndarray):
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        escape = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
        follower = raw[escape + 1]
        lengths_ = np.array([len(c) for c in chunks], np.int64)
        begins = np.cumsum(lengths_) - lengths_
        gone = np.zeros(len(raw), bool)
        gone[escape[follower == 0] + 1] = True
        marks = escape[(follower >= 0xD0) & (follower <= 0xD7)]
        gone[marks] = gone[marks + 1] = True
        left = np.cumsum(~gone) - ~gone  # bytes kept before each
        starts = np.sort(np.concatenate([begins, marks + 2]))
        if len(starts) != int(per.sum()):
            raise ValueError("restart markers are missing")
        kept = np.append(left, int((~gone).sum()))
        self.starts = kept[starts] * 8
        data = raw[~gone]
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.bytes = padded
        n = len(data) + 3
        self.windows = padded[:n] << 32 | padded[1 : n + 1] << 24 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 8 | padded[4 : n + 4]
        self.most = 8 * len(data)

    def symbol(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, bits of its code, the 40 bits from the byte where it begins)."""
        if len(at) and int(at.max()) > self.most:
            raise ValueError("a scan ends early")
        window = self.windows[at >> 3]
        found = table[(window >> (24 - (at & 7))) & 0xFFFF]
        length = found & 255
        if not length.all():
            raise ValueError("bits that are no code")
        return found >> 8, length, window

    def bits(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7))) & 1


def _extended(bits: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A value from its bits: those that begin with 0 are negative."""
    return np.where(bits < (1 << width) >> 1, bits - (1 << width) + 1, bits)


def _read_dc_first(stream: _Stream, starts: np.ndarray, sizes: np.ndarray, bits_at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The value of each block: all intervals advance by one block at a time."""
    out = np.zeros(int(starts[-1] + sizes[-1]) if len(starts) else 0, np.int64)
    before = np.zeros((len(starts), 3), np.int64)
    at = bits_at.copy()
    for t in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > t)
        width, length, window = stream.symbol(at[live], table)
        bits = (window >> (40 - (at[live] & 7) - length - width)) & ((1 << width) - 1)
        c = PATTERN[t % 6]
        before[live, c] += _extended(bits, width)
        out[starts[live] + t] = before[live, c]
        at[live] += length + width
    return out


def _read_ac_first(stream: _Stream, flat: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits_at: np.ndarray, table: np.ndarray, scan: Scan) -> None:
    """Coefficients of a band, put into the flat array: one symbol of every interval at a time."""
    at, i, end = bits_at.copy(), starts.copy(), starts + sizes
    k = np.full(len(i), scan.first, np.int64)
    while len(i):
        symbol, length, window = stream.symbol(at, table)
        run, width = symbol >> 4, symbol & 15
        k += run
        value = width > 0
        extra = (window >> (40 - (at & 7) - length - width)) & ((1 << width) - 1)
        at += length + width
        if value.all():
            if int(k.max()) > scan.last:
                raise ValueError("a run beyond its band")
            flat[order[i] * 64 + k] = _extended(extra, width) << scan.low
        else:
            v = np.flatnonzero(value)
            if len(v) and int(k[v].max()) > scan.last:
                raise ValueError("a run beyond its band")
            flat[order[i[v]] * 64 + k[v]] = _extended(extra[v], width[v]) << scan.low
            e = np.flatnonzero(~value & (run < 15))
            r = run[e]
            # The bits of a run's length follow its code, which took no others.
            more = (window[e] >> (40 - ((at[e] - length[e]) & 7) - length[e] - r)) & ((1 << r) - 1)
            at[e] += r
            i[e] += (1 << r) + more - 1
            k[e] = scan.last
        k += 1
        done = k > scan.last
        if done.any():
            i += done
            k[done] = scan.first
            live = i < end
            if not live.all():
                at, i, end, k = at[live], i[live], end[live], k[live]


def _read_ac_later(stream: _Stream, flat: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits_at: np.ndarray, table: np.ndarray, scan: Scan) -> None:
    """The next bit of a band: new coefficients by symbols, the bits of old ones collected as runs and read together."""
    n = scan.last - scan.first + 1
    cells = flat.reshape(-1, 64)[order, scan.first : scan.last + 1]
    old = cells != 0
    rows, columns = np.nonzero(old)
    seen = np.zeros((len(order), n + 1), np.int32)
    np.cumsum(old, axis=1, out=seen[:, 1:])
    total = np.concatenate(([0], np.cumsum(seen[:, n], dtype=np.int64)))
    free_rows, free_columns = np.nonzero(~old)
    free = np.full((len(order), n + 1), n, np.int16)  # places of zeros, in order
    free[free_rows, free_columns - seen[free_rows, free_columns]] = free_columns
    put, value, spans = [], [], []
    at, i, end = bits_at.copy(), starts.copy(), starts + sizes
    k, z = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    while len(i):
        symbol, length, window = stream.symbol(at, table)
        run, new = symbol >> 4, (symbol & 15) > 0
        at += length
        e = ~new & (run < 15)
        stop = z + run
        if (~e).any() and int(stop[~e].max()) >= n:
            raise ValueError("a run beyond its band")
        to = np.where(e, n, free[i, np.where(e, n, stop)]).astype(np.int64)
        if new.any():
            v = np.flatnonzero(new)
            if int(to[v].max()) >= n:
                raise ValueError("a run beyond its band")
            put.append(order[i[v]] * 64 + scan.first + to[v])
            value.append((2 * stream.bits(at[v]) - 1) << scan.low)
            at[v] += 1
        more = np.zeros(len(i), np.int64)
        if e.any():
            r = run[e]
            more[e] = (1 << r) + ((window[e] >> (40 - ((at[e] - length[e]) & 7) - length[e] - r)) & ((1 << r) - 1)) - 1
            at[e] += r
        first = total[i] + seen[i, k]
        count = np.where(e, total[np.minimum(i + 1 + more, end)], total[i] + seen[i, np.minimum(to, n)]) - first
        spans.append((first, at.copy(), count))
        at += count
        i += more
        k, z = to + 1, stop + 1
        done = e | (k >= n)
        if done.any():
            i += done
            k[done] = z[done] = 0
            live = i < end
            if not live.all():
                at, i, end, k, z = at[live], i[live], end[live], k[live], z[live]
    first, where, count = (np.concatenate(c) for c in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
    some = np.argsort(first[count > 0])
    where, count = where[count > 0][some], count[count > 0][some]
    if int(count.sum()) != len(rows):
        raise ValueError("bits of known coefficients are missing")
    bits = stream.bits(ranges(where, count))
    known = cells[rows, columns]
    flat[order[rows] * 64 + scan.first + columns] = known + np.sign(known) * (bits << scan.low).astype(known.dtype)
    for p, v in zip(put, value, strict=True):
        flat[p] = v


def decode(medias: list[bytes]) -> tuple[np.ndarray, Places, list[Header]]:
    """(coefficients of all blocks, where they stand, headers): scans are accumulated one after another, all images at once.

    Scans that the files have alike, in the same turn, are read together; others by themselves.
    """
    heads = [header(m) for m in medias]
    places = Places(np.array([h.wide for h in heads], np.int64), np.array([h.high for h in heads], np.int64))
    flat = np.zeros(64 * int(places.base[-1]), np.int16)
    for turn in range(max((len(h.scans) for h in heads), default=0)):
        alike: dict[tuple, list[int]] = {}
        for d, h in enumerate(heads):
            if turn < len(h.scans):
                alike.setdefault(h.scans[turn][:3], []).append(d)
        for (scan, table, restart), docs in alike.items():
            _read_scan(flat, medias, heads, places, docs, turn, scan, table, restart)
    return flat.reshape(-1, 64), places, heads


def _read_scan(flat: np.ndarray, medias: list[bytes], heads: list[Header], places: Places, docs: list[int], turn: int, scan: Scan, table: bytes, restart: int) -> None:
    chosen = np.array(docs)
    own = Places(places.wide[chosen], places.high[chosen])
    order, units, each = own.order(scan.components)
    order = order + np.repeat(places.base[chosen] - own.base[:-1], units * each)
    sizes, per = _intervals(units, each, restart or int(units.max()))
    stream = _Stream([medias[d][heads[d].scans[turn][3] : heads[d].scans[turn][4]] for d in docs], per)
    starts = np.cumsum(sizes) - sizes
    for a, b in _parts(sizes):
        base, at = starts[a], stream.starts[a:b]
        part = order[base : base + int(sizes[a:b].sum())]
        if scan.first:
            read = _read_ac_first if scan.high == 0 else _read_ac_later
            read(stream, flat, part, starts[a:b] - base, sizes[a:b], at, _reading(table), scan)
        elif scan.high == 0:
            flat[part * 64] = _read_dc_first(stream, starts[a:b] - base, sizes[a:b], at, _reading(table)) << scan.low
        else:
            flat[part * 64] |= (stream.bits(ranges(at, sizes[a:b])) << scan.low).astype(np.int16)


def tensors(coefs: np.ndarray, places: Places, heads: list[Header]) -> np.ndarray:
    """RGB samples of every MCU, as bytes of shape (MCUs, 16, 16, 3): inverse transform, chroma upsampled to full resolution, colours.

    All sums are of integers that doubles hold exactly, so equal files give equal samples wherever they run.
    """
    blocks = places.by_mcu()
    image = np.repeat(np.arange(len(heads)), places.mcus)
    out = np.empty((len(blocks), SIDE, SIDE, 3), np.uint8)
    steps = np.array([[np.frombuffer(q, np.uint8) for q in h.quantities] for h in heads], np.float64).reshape(len(heads), 3, 64)
    plain = bool((steps == 1).all())
    for a in range(0, len(blocks), AT_ONCE // 6):
        b = min(a + AT_ONCE // 6, len(blocks))
        c = coefs[blocks[a:b]].astype(np.float64)
        if not plain:
            c *= steps[image[a:b]][:, PATTERN]
        s = np.floor(c.reshape(-1, 64) @ BASIS / 2**SCALE + 0.5).astype(np.int32).reshape(-1, 6, 8, 8)
        y = np.clip(s[:, :4] + 128, 0, 255).reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, SIDE, SIDE)
        cb, cr = np.clip(s[:, 4], -128, 127), np.clip(s[:, 5], -128, 127)
        half = 1 << 15
        for channel, shift in enumerate(((91881 * cr + half) >> 16, -((22554 * cb + 46802 * cr + half) >> 16), (116130 * cb + half) >> 16)):
            out[a:b, :, :, channel] = np.clip(y + shift.repeat(2, axis=1).repeat(2, axis=2), 0, 255)
    return out


def tensor(mcus: np.ndarray, wide: int, high: int) -> np.ndarray:
    """One image's samples as (height, width, 3)."""
    return mcus.reshape(high, wide, SIDE, SIDE, 3).transpose(0, 2, 1, 3, 4).reshape(high * SIDE, wide * SIDE, 3)
