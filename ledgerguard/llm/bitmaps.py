"""Compressed bitmaps of documents for many keys at once, with planes for multiplicities.

A block numbers its documents from 0 to ``BLOCK_DOCS`` - 1. For each key, plane ``k`` is the bitmap of the
documents whose multiplicity has bit ``k`` set; the OR of a key's planes is the bitmap of its documents. A bitmap
is held the smaller way: positions as 16-bit numbers, or, where these take as much room, all bits.
All functions work on every key of a block together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK_DOCS = 8192
_FULL = BLOCK_DOCS // 8  # bytes of a bitmap that is held as bits


@dataclass
class PairBitmaps:
    """``codes``: the keys, ascending. ``planes``: for each key and plane in use, (index of the key) * 64 + plane,
    ascending. ``sizes``: bytes of each. ``bits``: their contents one after another."""

    codes: np.ndarray
    planes: np.ndarray
    sizes: np.ndarray
    bits: bytes

    @staticmethod
    def build(codes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> PairBitmaps:
        """From distinct (code, doc) with their multiplicities, in any order."""
        keys, index = np.unique(codes, return_inverse=True)
        slots, places = [], []
        for k in range(int(counts.max()).bit_length() if len(counts) else 0):
            has = (counts >> k) & 1 == 1
            slots.append(index[has] * 64 + k)
            places.append(docs[has])
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.lexsort((place, slot))
        slot, place = slot[order], place[order].astype("<u2")
        planes, first, n = np.unique(slot, return_index=True, return_counts=True)
        sizes = np.minimum(2 * n, _FULL)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(int(starts[-1]), np.uint8)
        sparse = np.repeat(sizes < _FULL, n)
        within = np.arange(len(slot)) - np.repeat(first, n)
        out.view("<u2")[(np.repeat(starts[:-1] // 2, n) + within)[sparse]] = place[sparse]
        for i in np.flatnonzero(sizes == _FULL):
            full = np.zeros(BLOCK_DOCS, np.uint8)
            full[place[first[i]:first[i] + n[i]]] = 1
            out[starts[i]:starts[i + 1]] = np.packbits(full, bitorder="little")
        return PairBitmaps(keys, planes.astype(np.int64), sizes.astype(np.int32), out.tobytes())

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``planes``, document) of every set bit."""
        raw = np.frombuffer(self.bits, np.uint8)
        sizes = self.sizes.astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        n = np.where(sizes < _FULL, sizes // 2, 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        at = np.repeat(starts // 2, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owners, docs = [owner], [raw.view("<u2")[at].astype(np.int64)]
        for i in np.flatnonzero(sizes == _FULL):
            set_bits = np.flatnonzero(np.unpackbits(raw[starts[i]:starts[i] + _FULL], bitorder="little"))
            owners.append(np.full(len(set_bits), i))
            docs.append(set_bits)
        return np.concatenate(owners), np.concatenate(docs)

    def plane_counts(self) -> np.ndarray:
        """Number of set bits of each plane."""
        sizes = self.sizes.astype(np.int64)
        raw = np.frombuffer(self.bits, np.uint8)
        starts = np.cumsum(sizes) - sizes
        out = sizes // 2
        for i in np.flatnonzero(sizes == _FULL):
            out[i] = int(np.bitwise_count(raw[starts[i]:starts[i] + _FULL]).sum())
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each key: documents (bits of the OR of its planes) and the sum of multiplicities (weighted planes)."""
        key, plane = self.planes >> 6, self.planes & 63
        ones = self.plane_counts()
        total = np.zeros(len(self.codes), np.int64)
        np.add.at(total, key, ones << plane)
        n_planes = np.bincount(key, minlength=len(self.codes))
        docs = np.zeros(len(self.codes), np.int64)
        single = n_planes[key] == 1
        docs[key[single]] = ones[single]
        if not single.all():
            owner, doc = self.entries()
            mixed = ~single[owner]
            merged = np.unique(key[owner[mixed]] * BLOCK_DOCS + doc[mixed])  # the OR of the planes
            docs += np.bincount(merged // BLOCK_DOCS, minlength=len(self.codes))
        return docs, total

    def weighted(self, values: np.ndarray) -> np.ndarray:
        """For each document: the sum over its keys of multiplicity times the key's value."""
        owner, doc = self.entries()
        key, plane = self.planes[owner] >> 6, self.planes[owner] & 63
        out = np.zeros(BLOCK_DOCS, np.int64)
        np.add.at(out, doc, values[key] << plane)
        return out
