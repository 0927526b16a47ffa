"""Words and shingles of whole texts as 64-bit numbers, in numpy, in bounded blocks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: True for bytes that belong to a word: anything but blank, tab, line feeds, form feed, return.
NOT_BLANK = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: True for ASCII letters and digits and for all bytes of other characters.
ALPHANUMERIC = _table(lambda b: b >= 128 or chr(b).isalnum())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text with A-Z lower-cased."""
    return _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def word_spans(data: np.ndarray, inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin and end."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64))
_ODD = mix(np.arange(1001, 1065, dtype=U64)) | U64(1)
_POWERS: dict[U64, np.ndarray] = {}


def _powers(base: U64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for blocks of the usual length."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base)
        table[0] = 1
        with np.errstate(over="ignore"):
            table = np.cumprod(table)
        if len(table) <= 2 * _BLOCK:
            _POWERS[base] = table
    return table[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per span of bytes; spans are in order and don't overlap.

    A span is a polynomial of its bytes. It is summed at the place it has in its block and then moved to
    the front, so all work is on whole arrays. Works on about a megabyte at a time.
    """
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + _BLOCK))))
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = int(starts[a]), int(ends[b - 1])
        s, n = starts[a:b] - lo, ends[a:b] - starts[a:b]
        sums = np.zeros(hi - lo + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data[lo:hi]] * _powers(_BASE, hi - lo), out=sums[1:])
            total = (sums[s + n] - sums[s]) * _powers(_INVERSE, hi - lo)[s]
            out[a:b] = total + n.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def words_of(text: str | None) -> np.ndarray:
    """Numbers of the blank-separated words of a text, A-Z lower-cased; none for null or empty."""
    data = lower_ascii(text or "")
    return hash_spans(data, *word_spans(data))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` words, in order; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, U64)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * _ODD[k]
    return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; the whole sequence as one if it is shorter; none without words."""
    words = words_of(text)
    if 0 < len(words) < n:
        return grams(words, len(words)) ^ U64(len(words))
    return distinct(grams(words, n))


def release() -> None:
    """Give back the memory that a task has left behind: Python workers live on and serve other stages.

    Called when a task's last batch is done; it changes no result.
    """
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
