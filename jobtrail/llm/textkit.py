"""Vectorized text kernels for Arrow batches (numpy; run inside ``mapInArrow`` tasks).

They work on the UTF-8 bytes of a whole batch at once, in pieces of about ``PIECE`` bytes, so
memory stays bounded by the batch and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

_U = np.uint64
_rng = np.random.default_rng(20240611)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
#: One random odd value per byte; separators hold 0 so that they add nothing to a word.
BYTE_VALUES = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1)

#: Separator bytes of the word pattern [^\x20\x09-\x0D]+.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separator bytes when words are runs of letters, digits and non-ASCII characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        _pow = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE)]), dtype=_U)
        _inv = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE_INV)]), dtype=_U)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: spreads every input bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if len(column) else (0, 0)
    return bytes_[lo:hi], (offs - lo if len(column) else np.zeros(1, np.int64))


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of so many rows: what is computed for one at a time stays small beside the batch."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def release() -> None:
    """Give freed memory back to the system. Spark keeps a worker for later stages, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task, with ``release`` behind it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + (upper.astype(np.uint8) << 5)


def _pieces(data: np.ndarray, separator: np.ndarray):
    """Cuts of ``data`` into pieces of about PIECE bytes that end behind a separator."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        while b < n:
            window = separator[data[b - 1: b + 4096]]
            k = int(window.argmax())
            if window[k]:
                b += k
                break
            b = min(n, b + len(window))
        yield a, b
        a = b


def text_pieces(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray):
    """Like ``_pieces``, but cut between texts, and within a text longer than PIECE at places that depend on
    that text alone: what is computed for a piece does not depend on the texts around it."""
    a = int(offsets[0])
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        if hi - lo > PIECE:
            if lo > a:
                yield a, lo
            for x, y in _pieces(data[lo:hi], separator):
                yield lo + x, lo + y
            a = hi
        elif hi - a >= PIECE:
            yield a, hi
            a = hi
    if a < offsets[-1]:
        yield a, int(offsets[-1])


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (maximal runs of non-separators) with A-Z lowered, in order,
    and the ``n + 1`` positions at which each text's words begin."""
    values = BYTE_VALUES.copy()
    values[0x41:0x5B] = values[0x61:0x7B]
    values[separator] = 0
    hashes, starts = [], []
    for a, b in _pieces(data, separator):
        d = data[a:b]
        word = ~separator[d]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins = offsets[np.searchsorted(offsets, a): np.searchsorted(offsets, b)] - a
        first[begins] = word[begins]
        at = np.flatnonzero(first)
        if len(at):
            power, inverse = _powers(len(d))
            hashes.append(mix(np.add.reduceat(values[d] * power, at) * inverse[at]))
            starts.append(at + a)
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


_STEP = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in order, and the positions at which each text's runs
    begin. A text of 1 to ``k - 1`` words has one run: all its words."""
    n = len(words)
    full = np.zeros(max(0, n - k + 1), _U)
    for j in range(k):
        full += (words[j: n - k + 1 + j] if n >= k else words[:0]) * (_STEP[j] | _U(1))
    full = mix(full)
    lengths = np.diff(bounds)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    out_bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    out = np.empty(int(out_bounds[-1]), _U)
    long_ = np.flatnonzero(lengths >= k)
    take = np.repeat(bounds[long_] - out_bounds[long_], counts[long_])
    where = np.repeat(lengths >= k, counts)
    out[where] = full[np.flatnonzero(where) + take]
    for i in np.flatnonzero((lengths > 0) & (lengths < k)):
        w = words[bounds[i]: bounds[i + 1]]
        out[out_bounds[i]] = mix((w * (_STEP[: len(w)] | _U(1))).sum(dtype=_U, keepdims=True) + _U(len(w)))[0]
    return out, out_bounds
