"""Whole-batch tokenisation on the raw UTF-8 buffers of Arrow string columns.

One numpy pass finds the word boundaries of many documents at once and gives each word a 64-bit
hash, so that no operator loops over words in Python.  Two word definitions exist:

* ``words``: lower-cased maximal runs of ASCII letters, digits, ``_`` and non-ASCII characters;
* ``blanks``: maximal runs of anything but ASCII white space, case kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES, SLICE = 1 << 20, 512  # bytes and documents that are tokenised at a time

_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_ASCII_WORD[128:] = True
_NOT_BLANK = np.ones(256, dtype=bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
WORD_CLASSES = {"words": _ASCII_WORD, "blanks": _NOT_BLANK}

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of consecutive documents: document ``d`` has words ``first[d] .. first[d + 1] - 1``."""

    buffer: np.ndarray
    offsets: np.ndarray  # byte offsets of the documents in buffer
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokenize(buffer: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """Words of the documents ``buffer[offsets[d]:offsets[d + 1]]``; a word never crosses documents."""
    n = len(buffer)
    inside = WORD_CLASSES[kind][buffer]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    power, inverse = _tables(n)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((buffer + U64(1)) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return Words(buffer, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, kind: str, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """Tokenises an Arrow column piece by piece: (index of the first document, its Words) for about
    ``size`` bytes at a time, so that temporary arrays stay in cache.  A longer document is one piece."""
    for k in range(0, len(texts), SLICE):
        part = texts.slice(k, SLICE)
        buffer, offsets = raw(pc.utf8_lower(part) if lower else part)
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield k + at, tokenize(buffer[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], kind)
            at = to
    pa.default_memory_pool().release_unused()  # workers live on from task to task


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def grams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``n`` words, by its first word; empty where there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j, k in enumerate(_multipliers(n, seed)):
        out += hashes[j : j + m] * k
    return mix(out)


def hash_words(text: str, kind: str = "words") -> np.ndarray:
    """Hashes of one text's words, for brute-force tests and small driver-side inputs."""
    found = [w.hashes for _, w in chunks(pa.array([text], pa.large_string()), kind, lower=kind == "words")]
    return np.concatenate(found) if found else np.zeros(0, U64)


def word_list(text: str, kind: str = "words") -> list[str]:
    """The words themselves, by the same definition."""
    text = pc.utf8_lower(pa.array([text], pa.large_string()))[0].as_py() if kind == "words" else text
    out = []
    for _, w in chunks(pa.array([text], pa.large_string()), kind):
        out += [bytes(w.buffer[s:e]).decode() for s, e in zip(w.starts, w.ends)]
    return out
