"""Words of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
PIECE = 1 << 19  # bytes hashed at once


@dataclass
class Words:
    """All words of a list of texts in order: hash, number of the text, words per text."""

    hashes: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Position of each text's first word."""
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(self.counts)))[:-1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of every value (a bijection of 64-bit integers)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table asked for so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.concatenate((np.ones(1, U), np.cumprod(np.full(size, base, dtype=U))))
        _POWERS[base] = have
    return have[:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def _hash_piece(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return range_hashes(raw.astype(U) + U(1), start, end, BYTE_BASE), start


def split(texts: list[bytes]) -> Words:
    """Words (runs of bytes outside 0x20 and 0x09-0x0D) of every text; None has none."""
    texts = [t or b"" for t in texts]
    hashes, docs, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        found, start = _hash_piece(b"\n".join(part))
        limits = np.cumsum([len(t) + 1 for t in part])
        hashes.append(found)
        docs.append(np.searchsorted(limits, start, side="right") + at)
        at = end
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, U), doc, np.bincount(doc, minlength=len(texts)).astype(np.int64)
    )


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every run of ``size`` words inside one text."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    start = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    return range_hashes(words.hashes, start, start + size, WORD_BASE), start
