"""Words, shingles and byte streams of whole Arrow batches of texts, by numpy: no Python step for each word.

A word is a run of bytes other than space and 0x09 to 0x0D. A word's hash is a polynomial over a
random table of its bytes, modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240601)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: The most bytes of text that one vectorized step takes, unless a single text is longer.
STEP = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives back the memory it freed: it stays alive for other tasks, beside others' workers."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, int(base)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % 2**64
    return out[:n]


_cache: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        have = powers(base, max(n, STEP + 1))
        if len(have) <= 4 * STEP:
            _cache[name] = have
    return have[:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(raw: np.ndarray, offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, index of its text) over texts raw[offsets[i]:offsets[i+1]]; A-Z lower-cased."""
    base = int(offsets[0])
    raw = raw[base : int(offsets[-1])]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = LOWER[raw]
    word = ~IS_SPACE[data]
    inner = offsets[1:-1] - base
    inner = inner[(inner > 0) & (inner < len(raw))]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[inner] = word[inner]
    at = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    to = np.flatnonzero(ends) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers("base", _BASE, len(raw)), out=sums[1:])
    hashes = mix((sums[to] - sums[at]) * _powers("inverse", _INVERSE, len(raw))[at])
    text = np.searchsorted(offsets - base, at, side="right") - 1
    return hashes, text


def shingle_sets(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; offsets by text).

    A text of fewer than `width` words has its whole sequence as its one shingle; without words, none.
    """
    n = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        part = hashes[k:] if k else hashes
        rolled[: len(part)] = rolled[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part
    place = np.arange(len(hashes)) - first[text]
    keep = place <= n[text] - width
    short = np.flatnonzero((n > 0) & (n < width))
    for i in short:  # at most width - 1 words each
        x = 0
        for h in hashes[first[i] : first[i + 1]].tolist():
            x = (x * 0xD6E8FEB86659FD93 + h + 0x5851F42D4C957F2D) % 2**64
        rolled[first[i]], keep[first[i]] = x, True
    values, owner = mix(rolled[keep]), text[keep]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_texts))))
