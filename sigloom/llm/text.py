"""Vectorised words of Arrow text columns.

Words are found on UTF-8 bytes with numpy: a 256-entry table says which bytes
belong to words and folds ``A-Z`` to ``a-z``. The hash of a word is a polynomial
over random byte values modulo 2**64, taken for all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


@dataclass(frozen=True)
class WordClass:
    """``mask[b]``: byte b belongs to words; ``value[b]``: its value in the hash, 0 for other bytes."""

    mask: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(in_word) -> WordClass:
        rng = np.random.default_rng(20240607)
        value = rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        value[65:91] = value[97:123]
        mask = np.array([bool(in_word(b)) for b in range(256)])
        return WordClass(mask, np.where(mask, value, _U(0)))


#: ``[^\x20\x09-\x0D]+``
SPACED = WordClass.of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding ``A-Z``
ALNUM = WordClass.of(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _P if kind == "up" else pow(_P, -1, 1 << 64)
        p = np.full(n, base, _U)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=_U)
    return _powers[kind]


@dataclass
class Words:
    """Words of one chunk: hash, byte range within ``data``, and for document i the words ``ptr[i]:ptr[i+1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    doc_start: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), z, z, np.zeros(len(offsets), np.int64), data, offsets[:-1])
    mask = kind.mask[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    if len(start):
        h = np.add.reduceat(kind.value[data] * _power("up", n)[:n], start)
        h = mix(h * _power("down", n)[start])
    else:
        h = np.zeros(0, _U)
    return Words(h, start, end, np.searchsorted(start, offsets), data, offsets[:-1])


def chunks(column: pa.Array, kind: WordClass) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a text column; a null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        o = offsets[row : to + 1]
        yield row, to, _words(data[o[0] : o[-1]], o - o[0], kind)
        row = to


def beginnings(words: Words, kind: WordClass, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of each word's first so many bytes (of the whole word where it is shorter)."""
    n = len(words.data)
    if not len(words.start):
        return [np.zeros(0, _U) for _ in lengths]
    run = np.zeros(n + 1, _U)
    np.cumsum(kind.value[words.data] * _power("up", n)[:n], out=run[1:])
    back = _power("down", n)[words.start]
    return [mix((run[np.minimum(words.end, words.start + k)] - run[words.start]) * back + _U(k)) for k in lengths]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and the pointer to them.

    A document of fewer than ``k`` words has its whole sequence as one shingle; one of no words has none.
    """
    counts = np.diff(words.ptr)
    h = words.hash
    n = len(h)
    total = np.zeros(n, _U)
    for j in range(min(k, n)):
        total[: n - j] += h[j:] * _U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    hashed = mix(total)
    out, ptr = [], np.zeros(len(counts) + 1, np.int64)
    for i, c in enumerate(counts):
        a = words.ptr[i]
        if c >= k:
            s = np.sort(hashed[a : a + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            s = np.array([c + 0x5BD1E995], _U)
            for w in h[a : a + c]:
                s = mix(s * _U(0xD6E8FEB86659FD93) + w)
        else:
            s = np.zeros(0, _U)
        out.append(s)
        ptr[i + 1] = ptr[i] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, _U)), ptr
