"""Unigram segmentation by Viterbi over a double-array trie of pieces, and decoding.

The pieces are those of a SentencePiece model file. Spaces become the mark U+2581 with one put in front
(the dummy prefix). The best segmentation maximises the sum of log scores; a character that no piece covers
counts as unknown (the least score minus ``UNKNOWN_PENALTY``) and is written as its UTF-8 bytes' pieces.
Decoding joins the pieces, turns byte pieces into bytes (invalid ones into U+FFFD), marks into spaces, and
drops the one in front.

Of equal segmentations the one with the longest last piece is taken.

Scores: a unigram model file's own; for a file with merge ranks instead of log scores (a BPE model) the log
of a Zipf law over the rank, log(1 / (rank + ZIPF_SHIFT)), normalised over all pieces.

The trie is walked for many words at once: words of a batch go through the same (start, length) steps as
array operations, and each worker keeps the ids of the words it has met. Words may be segmented one by one
since no piece goes past a space mark or a line feed (checked; other models get whole texts).

Defined results: null and empty texts have no pieces; repeated rows give a row each; an empty table gives
an empty table; a text that itself holds U+2581 decodes with a space there, so it is not a round trip.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm import tokens
from ledgerguard.llm.common import map_arrow

UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 10.0
CELLS = 400_000  # words are segmented in batches of at most so many bytes after padding
_MARK = "▁".encode()
_models: dict[str, Unigram] = {}


class DoubleArray:
    """Double-array trie over byte strings: state s goes to base[s] + byte + 1 if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        base, check, value = {0: 0}, {0: 0}, {}
        taken = bytearray(1 << 16)
        taken[0] = 1
        cursor = [1] * 9  # where the search goes on, by number of children: it never goes back, so the build is fast
        todo = [(0, 0, len(keys), 0)]  # state, keys of its subtree, depth
        while todo:
            state, a, b, depth = todo.pop()
            if len(keys[a]) == depth:
                value[state] = values[a]
                a += 1
            codes, starts = [], []
            for i in range(a, b):
                c = keys[i][depth] + 1
                if not codes or codes[-1] != c:
                    codes.append(c)
                    starts.append(i)
            if not codes:
                continue
            kind = min(len(codes), 8)
            at = cursor[kind]
            while True:
                if at + 258 > len(taken):
                    taken.extend(bytes(len(taken)))
                if not any(taken[at + c] for c in codes):
                    break
                at += 1
            cursor[kind] = at
            base[state] = at
            starts.append(b)
            for j, c in enumerate(codes):
                taken[at + c] = 1
                check[at + c] = state
                todo.append((at + c, starts[j], starts[j + 1], depth + 1))
        size = max(check) + 258

        def laid_out(cells: dict[int, int], empty: int) -> np.ndarray:
            out = np.full(size, empty, np.int32)
            out[list(cells)] = list(cells.values())
            return out
        self.base, self.check, self.value = laid_out(base, 0), laid_out(check, -1), laid_out(value, -1)


class Unigram(tokens.WordCache):
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]) -> None:
        """kinds as in the model file: 1 normal, 4 user-defined, 6 byte; others never match text."""
        self.pieces = pieces
        normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.trie = DoubleArray([pieces[i].encode() for i in normal], normal)
        # (fixed-point scores: their sums are exact, so equal segmentations tie and the first one found stays)
        self.scores = np.round(np.array(scores, np.float64) * 2**20) / 2**20
        self.unknown = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        self.deepest = max(len(pieces[i].encode()) for i in normal)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace("▁", " ").encode() if k in (1, 4) else b"" for p, k in zip(pieces, kinds)]
        self.by_part = tokens.splits_by_space(pieces[i] for i in normal)
        super().__init__()

    @classmethod
    def load(cls, path: str) -> Unigram:
        if path not in _models:
            spec = tokens._proto()
            with open(path, "rb") as f:
                spec.ParseFromString(f.read())
            kinds = [p.type for p in spec.pieces]
            scores = [p.score for p in spec.pieces]
            if spec.trainer_spec.model_type != 1:
                scores = zipf_scores(kinds)
            _models[path] = cls([p.piece for p in spec.pieces], scores, kinds)
        return _models[path]

    def segment(self, words: list[bytes]) -> list[list[int]]:
        """Ids of the best segmentation of each byte string (valid UTF-8, marks in place)."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(words[order[end]]) <= CELLS:
                end += 1
            some = order[at:end]
            for i, ids in zip(some, self._batch([words[i] for i in some])):
                out[i] = ids
            at = end
        return out

    def _batch(self, words: list[bytes]) -> list[list[int]]:
        longest = max(map(len, words))
        if not longest:
            return [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        first = (text & 0xC0) != 0x80  # first bytes of characters
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((len(words), longest + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((len(words), longest + 1), -1, np.int32)
        back = np.zeros((len(words), longest + 1), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(longest):
            live = np.flatnonzero((sizes > s) & first[:, s] & (best[:, s] > -np.inf))
            if not len(live):
                continue
            char_end = s + width[live, s]
            covered = np.zeros(len(live), bool)
            rows, at, node = np.arange(len(live)), live, np.zeros(len(live), np.int64)
            for e in range(s, min(longest, s + self.deepest)):
                inside = sizes[at] > e
                rows, at, node = rows[inside], at[inside], node[inside]
                to = base[node] + text[at, e].astype(np.int64) + 1
                to[to >= len(check)] = 0
                go = (check[to] == node) & (to > 0)
                rows, at, node = rows[go], at[go], to[go]
                if not len(at):
                    break
                ids = value[node]
                ends = np.flatnonzero(ids >= 0)
                if len(ends):
                    r, w, got = rows[ends], at[ends], ids[ends]
                    covered[r[char_end[r] == e + 1]] = True
                    score = best[w, s] + self.scores[got]
                    up = score > best[w, e + 1]
                    w = w[up]
                    best[w, e + 1], piece[w, e + 1], back[w, e + 1] = score[up], got[up], s
            bare = np.flatnonzero(~covered)
            if len(bare):
                w, e = live[bare], char_end[bare]
                score = best[w, s] + self.unknown
                up = score > best[w, e]
                w, e = w[up], e[up]
                best[w, e], piece[w, e], back[w, e] = score[up], -1, s
        out = []
        for i, size in enumerate(sizes.tolist()):
            ids, e = [], size
            while e > 0:
                s = int(back[i, e])
                if piece[i, e] >= 0:
                    ids.append(int(piece[i, e]))
                else:
                    ids.extend(self.bytes[b] for b in reversed(words[i][s:e]))
                e = s
            out.append(ids[::-1])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        dtype = np.dtype("<u2" if len(self.pieces) <= 65536 else "<u4")
        if not self.by_part:
            whole = [(" " + t).replace(" ", "▁").encode() if t else b"" for t in texts]
            return [np.array(x, dtype) for x in self.segment(whole)]
        parts = [tokens.parts_of(t) if t else [] for t in texts]
        known = self._know(parts)
        return [np.frombuffer(b"".join([known[p] for p in ps]), dtype) for ps in parts]

    def _learn(self, words: set[str]) -> None:
        dtype = np.dtype("<u2" if len(self.pieces) <= 65536 else "<u4")
        need = list(words)
        marked = [(p if p[:1] == "\n" else " " + p).replace(" ", "▁").encode() for p in need]
        for p, ids in zip(need, self.segment(marked)):
            self.known[p] = np.array(ids, dtype).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        joined = b"".join([raw[i] for i in ids.tolist()])
        return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def zipf_scores(kinds: list[int]) -> list[float]:
    ranks = [i for i, k in enumerate(kinds) if k in (1, 4)]
    total = math.fsum(1 / (r + ZIPF_SHIFT) for r in ranks)
    return [-math.log((i + ZIPF_SHIFT) * total) if k in (1, 4) else 0.0 for i, k in enumerate(kinds)]


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.load(path)
        lengths = np.arange(len(model.pieces))
        is_byte = np.zeros(len(lengths), bool)
        is_byte[list(model.bytes.values())] = True
        for batch in batches:
            count, crc, spelled, same = [], [], [], []
            for texts in tokens.runs(t or "" for t in batch.column(1).to_pylist()):
                for text, ids in zip(texts, model.encode(texts)):
                    count.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    spelled.append(int(is_byte[ids].sum()))
                    same.append(model.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(spelled, pa.int64()), pa.array(same, pa.bool_())],
                                             ["doc_id", "n_pieces", "ids_crc32", "n_byte_pieces", "round_trip"])
    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32, n_byte_pieces, round_trip (decoding gives the text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _coder(model), "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, round_trip boolean")
