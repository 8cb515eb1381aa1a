"""Vectorised word and shingle hashes over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit hash is a polynomial of its
bytes (random value for each byte, arithmetic modulo 2^64) taken from running sums over the whole batch,
so the cost is a few array passes over the bytes and no Python work for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000  # texts are hashed in runs of about so many bytes (a longer text makes a run of its own)
SEPARATORS = b"\t\n\x0b\x0c\r "
_SEED = 20240229
_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULT = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row bounds) of runs of about CHUNK_BYTES; a null text counts as empty."""
    if pa.types.is_large_string(texts.type) is False:
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end - row, data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word, and for each row the index of its first word (one more at the end)."""
    rows = len(bounds) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    value = _BYTE[_LOWER[data] if lower else data] * _power(_BASE, len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    hashes = mix((total[end] - total[start]) * _power(_UNBASE, len(data))[start] + (end - start).astype(np.uint64))
    return hashes, start, end, np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (shorter input: none); the caller keeps to runs inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _MULT[0]
    for i in range(1, k):
        out = out + hashes[i:n + i] * _MULT[i]
    return mix(out)
