"""Distinct word shingles of whole texts as 64-bit hashes, computed with NumPy over a batch of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SLICE = 200_000  # bytes hashed at once, so that the arrays stay in the cache


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# A random-looking 64-bit value for each byte, derived from a rule.
_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 65_536)
        table = np.full(size, _U(base % 2**64))
        table[0] = _U(1)
        _powers[name] = have = np.multiply.accumulate(table)
    return have


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased."""
    gap = _SPACE[data]
    inside = np.concatenate(([False], ~gap, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, _U)
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[_LOWER[data]] * _power_table(_BASE, "up", n)[:n], out=total[1:])
        value = (total[end] - total[start]) * _power_table(_INVERSE, "down", n)[start]
        return start, mix(value ^ (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; fewer words give one hash of them all, no words give none."""
    if not len(words):
        return words
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        value = np.full(len(words) - k + 1, _U(k))
        for i in range(k):
            value = value * _U(_BASE) + words[i : len(words) - k + 1 + i]
            value ^= value >> _U(29)
        return mix(value)


def shingle_sets(texts, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text; null and blank texts give an empty array."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        chunk.append(raw)
        size += len(raw) + 1
        if size >= _SLICE:
            out += _sets(chunk, k)
            chunk, size = [], 0
    return out + _sets(chunk, k)


def _sets(chunk: list[bytes], k: int) -> list[np.ndarray]:
    if not chunk:
        return []
    data = np.frombuffer(b"\n".join(chunk) + b"\n", np.uint8)
    start, words = word_hashes(data)
    bounds = np.cumsum([len(raw) + 1 for raw in chunk])
    cut = np.concatenate(([0], np.searchsorted(start, bounds)))
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(cut[:-1], cut[1:])]
