"""Which tokens of two tokenizers stand for the same text, over all documents.

Both tokenizers (byte-level BPE: A; SentencePiece: B) encode a document, and the byte offsets at which tokens of
both end cut it into groups. Tokens of a group are linked, each of A with each of B. A pair of ids is scored by
the documents that hold it linked.

Both tokenizers always end a token before white space that follows a word, so a document is worked on by its
words (with the white space before them), and each worker keeps the alignment of the words it has met.

Documents are dealt into blocks of bounded size. A block holds an inverted index of its pairs (``PairBitmaps``):
for each pair the bitmaps of its documents and, by planes, of how often each holds it. Counting needs one
row for each pair and block, never a pair's documents; the counts come back to the blocks, whose bitmaps give each document its
scores. A frequent pair has one row in each block, so no pair outweighs the others.

Defined cases: a null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens,
zeros, and the digest column ''. Rows are documents of their own, whatever their ids; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.bitmaps import BLOCK_DOCS, PairBitmaps
from ledgerguard.llm.bytebpe import ByteBpe
from ledgerguard.llm.common import map_arrow, materialize, ship
from ledgerguard.llm.tokens import PieceCounter, loose

BLOCK_CHARS = 4_000_000
KEPT_WORDS = 500_000  # words whose alignment a worker keeps
KEPT_CHARS = 8_000_000  # characters of them
PLAIN_CROSS = 4096  # links of a group that are listed before they are counted

_OTHER = r"\t\x0b-\x0d\x1c-\x1f\x85\xa0 ᠎ -     　"  # white space but space and line feed
# white space and the word behind it; spaces beside other white space are no place to cut
_WORD = re.compile(rf"[ \n]*[^ \n]+(?:(?:(?<=[{_OTHER}])[ \n]+|[ \n]+(?=[{_OTHER}]))[^ \n]*)*|[ \n]+")

_SPACE = re.compile(r"\s")
JOINED_WORDS = 500  # words encoded together

_STATS = ("n_a", "n_b", "n_groups", "n_links")
_SEGMENT = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _STATS],
                      ("groups", pa.list_(pa.string())), ("codes", pa.binary()), ("planes", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])
_SEGMENT_SQL = ("block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _STATS)
                + ", groups array<string>, codes binary, planes binary, sizes binary, bits binary")
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*_STATS, "n_best", "count_sum")], ("groups_sha256", pa.string())])
_RESULT_SQL = "doc_id long, " + ", ".join(f"{c} long" for c in (*_STATS, "n_best", "count_sum")) + ", groups_sha256 string"


def cross(groups: np.ndarray, start_a: np.ndarray, n_a: np.ndarray, start_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place of A, place of B) of all pairs of the given groups."""
    n = n_a[groups] * n_b[groups]
    owner = np.repeat(groups, n)
    within = spread(np.zeros(len(n), np.int64), n)
    return owner, start_a[owner] + within // n_b[owner], start_b[owner] + within % n_b[owner]


class TokenBytes:
    """The bytes of a tokenizer's tokens in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.large_string())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.first[ids], self.size[ids])]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def joined_lists(texts: pa.Array, n: np.ndarray, glue: str) -> pa.Array:
    """Consecutive runs of ``texts``, ``n`` long, each joined to one text."""
    ends = np.concatenate([[0], np.cumsum(n)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), texts), _text(glue))


def _text(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


class WordAlignments:
    """Alignments of words, kept by number: counts, linked pairs with multiplicities, and the groups as text.
    A word is written with the white space before it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        self.a = ByteBpe(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.of_a = TokenBytes(self.a.token_bytes())
        self.of_b = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.lone = self.b.piece_to_id("▁")
        feed = self.a.encode(["\n"])[0]
        self.feed = int(feed[0]) if len(feed) == 1 else None
        self.by_word = self.a.fast is not None and self.feed is not None and PieceCounter(path_b).by_part  # else each text is one word
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.chars = 0
        self.stats = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.good = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # where a word's pairs begin
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups = pa.array([], pa.large_string())

    def _ids_a(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids). Words behind one space go to the tokenizer together, with line feeds between them."""
        easy = [len(w) > 1 and w[0] == " " and w[1] not in " \n" and "\n" not in w and self.by_word for w in words]
        if any(easy) and loose(" ".join([w[1:] for w, e in zip(words, easy) if e])):
            easy = [e and not _SPACE.search(w, 1) for w, e in zip(words, easy)]
        together = [i for i, e in enumerate(easy) if e]
        size, found = np.zeros(len(words), np.int64), []
        for at in range(0, len(together), JOINED_WORDS):
            part = together[at:at + JOINED_WORDS]
            ids = self.a.encode(["\n".join([words[i] for i in part])])[0]
            cuts = np.flatnonzero(ids == self.feed)
            size[part] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            found.append(np.delete(ids, cuts))
        rest = [i for i, e in enumerate(easy) if not e]
        each = self.a.encode([words[i] for i in rest])
        size[rest] = [len(x) for x in each]
        order = np.array(together + rest, np.int64)
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return size, np.concatenate([np.zeros(0, np.int64), *found, *each])[spread(first, size)].astype(np.int64)

    def _ids_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of words as they are inside a text: the mark that B puts before a text is the word's own space."""
        ids = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        ids = [(x or [self.lone]) if w[0] == " " else x[1:] for w, x in zip(words, ids)]
        return np.array([len(x) for x in ids], np.int64), np.fromiter((i for x in ids for i in x), np.int64)

    def _same(self, words: list[str], of: TokenBytes, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which words their tokens give back byte for byte."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        owner = np.repeat(np.arange(len(words)), n)
        got = np.bincount(owner, of.size[ids], len(words)).astype(np.int64)
        good = got == size
        want, first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        fits = good[owner]
        differs = of.joined(ids[fits]) != want[spread(first[good], size[good])]
        good[np.repeat(np.flatnonzero(good), size[good])[differs]] = False
        return good

    def _learn(self, words: list[str]) -> None:
        (len_a, flat_a), (len_b, flat_b) = self._ids_a(words), self._ids_b(words)
        good = self._same(words, self.of_a, len_a, flat_a) & self._same(words, self.of_b, len_b, flat_b)
        flat_a, flat_b = flat_a[np.repeat(good, len_a)], flat_b[np.repeat(good, len_b)]
        len_a, len_b = len_a * good, len_b * good
        end_a, end_b = np.cumsum(self.of_a.size[flat_a]), np.cumsum(self.of_b.size[flat_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        word = np.repeat(np.arange(len(words)), len_a)[start_a]  # of each group
        links = n_a * n_b
        owner, at_a, at_b = cross(np.flatnonzero(links <= PLAIN_CROSS), start_a, n_a, start_b, n_b)
        owners, codes, counts = [word[owner]], [flat_a[at_a] * self.n_b + flat_b[at_b]], [np.ones(len(owner), np.int64)]
        for g in np.flatnonzero(links > PLAIN_CROSS):  # a long group: distinct ids with their numbers
            xs, nx = np.unique(flat_a[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
            ys, ny = np.unique(flat_b[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
            codes.append((xs[:, None] * self.n_b + ys).ravel())
            counts.append((nx[:, None] * ny).ravel())
            owners.append(np.full(len(xs) * len(ys), word[g]))
        owners, codes, counts = np.concatenate(owners), np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(owners, kind="stable")
        pairs, n_groups = np.bincount(owners, minlength=len(words)), np.bincount(word, minlength=len(words))
        n_links = np.zeros(len(words), np.int64)
        np.add.at(n_links, word, links)
        self.stats = np.concatenate([self.stats, np.stack([len_a, len_b, n_groups, n_links], axis=1)])
        self.good = np.concatenate([self.good, good])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(pairs)])
        self.codes, self.counts = np.concatenate([self.codes, codes[order]]), np.concatenate([self.counts, counts[order]])
        sides = [joined_lists(of.names.take(pa.array(flat)), n, ",") for of, flat, n in ((self.of_a, flat_a, n_a), (self.of_b, flat_b, n_b))]
        groups = joined_lists(pc.binary_join_element_wise(*sides, _text("|")), n_groups, ";")
        self.groups = pa.concat_arrays([self.groups, groups])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words, the new ones learnt."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        if len(new):
            self._learn(new.to_pylist())
            self.words = pa.concat_arrays([self.words, new])
            self.chars += pc.sum(pc.utf8_length(new)).as_py()
            at = pc.index_in(words, value_set=self.words)
        return at.to_numpy()

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, how many each text has)."""
        if len(self.words) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self._forget()
        odd = [not self.by_word or loose(t) for t in texts]
        plain = pc.split_pattern(pc.replace_substring(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), "\n", " \n"), " ")
        coded = plain.flatten().dictionary_encode()
        bare = coded.dictionary
        spaced = pc.if_else(pc.starts_with(bare, "\n"), bare, pc.binary_join_element_wise(_text(" "), bare, _text("")))
        of_plain = self._numbers(spaced)[coded.indices.to_numpy()]
        lengths = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = _WORD.findall if self.by_word else lambda t: [t]
        parts = [cut(" " + t) if t else [] for t, o in zip(texts, odd) if o]
        coded = pa.array([w for ws in parts for w in ws], pa.large_string()).dictionary_encode()
        of_odd = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        by_plain = iter(np.split(of_plain, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        by_odd = iter(np.split(of_odd, np.cumsum([len(ws) for ws in parts])[:-1]) if parts else [])
        out = [next(by_odd) if o else next(by_plain) for o in odd]
        return np.concatenate([np.zeros(0, np.int64), *out]), np.array([len(x) for x in out], np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], PairBitmaps]:
        """Counts by text, digests of groups, and the inverted index of the pairs."""
        words, lengths = self.words_of(texts)
        doc = np.repeat(np.arange(len(texts)), lengths)
        bad = np.bincount(doc[~self.good[words]], minlength=len(texts)) > 0
        stats = np.zeros((len(texts), 4), np.int64)
        np.add.at(stats, doc, self.stats[words])
        stats[bad] = 0
        whole = joined_lists(self.groups.take(pa.array(words)), lengths, ";").to_pylist()
        digests = [hashlib.sha256(t.encode()).hexdigest() if n and not wrong else "" for t, n, wrong in zip(whole, lengths.tolist(), bad.tolist())]
        keep = ~bad[doc]
        n = max(len(self.words), 1)
        seen, times = np.unique(doc[keep] * n + words[keep], return_counts=True)
        of_doc, word = seen // n, seen % n
        pairs = self.first[word + 1] - self.first[word]
        at_pair = spread(self.first[word], pairs)
        key = self.codes[at_pair] * BLOCK_DOCS + np.repeat(of_doc, pairs)
        key, where = np.unique(key, return_inverse=True)
        counts = np.zeros(len(key), np.int64)
        np.add.at(counts, where, self.counts[at_pair] * np.repeat(times, pairs))
        return stats, digests, PairBitmaps.build(key // BLOCK_DOCS, key % BLOCK_DOCS, counts)


_loaded: dict[tuple[str, str], WordAlignments] = {}


def _aligner(path_a: str, path_b: str) -> WordAlignments:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = WordAlignments(path_a, path_b)
    return _loaded[path_a, path_b]


def _packed(index: PairBitmaps) -> dict[str, bytes]:
    return {"codes": index.codes.astype("<i8").tobytes(), "sizes": index.sizes.astype("<u2").tobytes(), "bits": index.bits,
            # for each plane its number, with the top bit where a new key begins
            "planes": ((index.planes & 63) | (np.diff(index.planes >> 6, prepend=-1) > 0) * 128).astype(np.uint8).tobytes()}


def _unpacked(codes: bytes, planes: bytes, sizes: bytes, bits: bytes) -> PairBitmaps:
    marks = np.frombuffer(planes, np.uint8).astype(np.int64)
    return PairBitmaps(np.frombuffer(codes, "<i8"), (np.cumsum(marks >= 128) - 1) * 64 + (marks & 63), np.frombuffer(sizes, "<u2").astype(np.int32), bits)


def build_segments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The inverted pair index of ``docs`` (doc_id, text): one row for each block of documents."""
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if len(ids) == BLOCK_DOCS or size >= BLOCK_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(blocks(batches)):
            stats, groups, index = _aligner(path_a, path_b).align(texts)
            row = {"block": [base + number], "doc_id": [ids], "groups": [groups]} | {c: [stats[:, i].tolist()] for i, c in enumerate(_STATS)}
            yield pa.RecordBatch.from_pydict(row | {k: [v] for k, v in _packed(index).items()}, schema=_SEGMENT)

    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, _SEGMENT_SQL), "pairs")


def pair_counts(segments: DataFrame) -> DataFrame:
    """(code, block, docs, links): of each pair of a block, its documents and links there."""
    schema = pa.schema([("code", pa.int64()), ("block", pa.int64()), ("docs", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _unpacked(row["codes"], row["planes"], row["sizes"], row["bits"])
                docs, links = index.counts()
                yield pa.RecordBatch.from_arrays([pa.array(index.codes), pa.array(np.full(len(docs), row["block"])), pa.array(docs), pa.array(links)], schema=schema)

    return map_arrow(segments.select("block", "codes", "planes", "sizes", "bits"), run, "code long, block long, docs long, links long")


def pair_table(segments: DataFrame, path_b: str) -> DataFrame:
    """(a_id, b_id, n_docs, n_links) of every linked pair of the corpus."""
    n_b = _pieces_of(path_b)
    totals = pair_counts(segments).groupBy("code").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    return totals.select(F.floor(F.col("code") / n_b).alias("a_id"), F.pmod("code", F.lit(n_b)).alias("b_id"), "n_docs", "n_links")


def _pieces_of(path_b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _scores(segment: pa.Table, scored: pa.Table) -> pa.Table:
    """A block's documents with the scores of their pairs."""
    row = segment.to_pylist()[0]
    index = _unpacked(row["codes"], row["planes"], row["sizes"], row["bits"])
    order = np.argsort(scored["code"].to_numpy())
    count, best = scored["n_docs"].to_numpy()[order], scored["best"].to_numpy()[order].astype(np.int64)
    n = len(row["doc_id"])
    out = {"doc_id": row["doc_id"], "n_best": index.weighted(best)[:n], "count_sum": index.weighted(count)[:n], "groups_sha256": row["groups"]}
    return pa.table(out | {c: row[c] for c in _STATS}, schema=_RESULT)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document: its tokens, groups and links, and the scores of its links."""
    ship(docs.sparkSession)
    n_b = _pieces_of(path_b)
    segments = build_segments(docs, path_a, path_b)
    in_blocks = materialize(pair_counts(segments).select("code", "block", "docs"), "counts")
    totals = in_blocks.groupBy("code").agg(F.sum("docs").alias("n_docs")).withColumn("a", F.floor(F.col("code") / n_b))
    highest = totals.groupBy("a").agg(F.max("n_docs").alias("highest"))  # no more rows than A has tokens
    scored = totals.join(F.broadcast(highest), "a").select("code", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    back = in_blocks.select("code", "block").join(scored, "code")
    return segments.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scores, _RESULT_SQL)
