"""Ids of whole texts, equal to the libraries', at less cost.

* byte-level BPE: ``bytebpe``, whole texts.
* white space dropped and lower-cased (``word``): any space or line feed is a boundary, so texts are cut into words.
* SentencePiece with no piece that has the space mark after another character: every run of spaces
  starts a new part, and a line feed (in no piece) is a part of its own.

By word, the distinct words of many texts are looked up once, those met for the first time are encoded by the
library together, and the ids are put in their places by numpy. Any other tokenizer gets whole texts. The cache
of words is bounded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerguard.llm.bytebpe import ByteBpe, LatinWords

CACHE_WORDS = 300_000  # words of one generation of a cache
TABLE_WORDS = 300_000  # words of a table
JOINED_WORDS = 500  # words encoded together
PART_CHARS = 400_000  # texts are worked on in runs of about so many characters
TABLE_CHARS = 4_000_000  # the same where words are looked up in a table
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(r"\s")
_PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
_OTHER_SPACE = re.compile(r"[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def loose(text: str) -> bool:
    """Whether there is no text, white space first, or white space that does not simply stand between two words."""
    return (text[:1] in ("", " ", "\n") or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or _OTHER_SPACE.search(text) is not None)


# letters whose class no Unicode version changes, punctuation that starts no contraction
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_MARK = "\x01"
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer at ``path``, once for each worker: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path) if path.endswith(".model") else WordEncoder(path)
    return _loaded[path]


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import importlib.metadata
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def runs(texts: Iterable[str], chars: int = PART_CHARS) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class WordCache:
    """Words met lately. Words of the generation before that come up again move to the current one; the
    others go when it is full, so frequent words stay however many rare ones pass."""

    def __init__(self) -> None:
        self.known: dict = {}
        self.before: dict = {}

    def _learn(self, words: set[str]) -> None:
        raise NotImplementedError

    def _know(self, texts: list[list[str]]) -> dict:
        """The cache, holding all words of ``texts``."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        need = set().union(*texts).difference(self.known) if texts else set()
        again = [w for w in need if w in self.before]
        for w in again:
            self.known[w] = self.before[w]
        need.difference_update(again)
        if need:
            self._learn(need)
        return self.known


class IdTable:
    """Ids of words met lately, found by Arrow. When it is full, only the words at hand stay."""

    def __init__(self, dtype: np.dtype) -> None:
        self.words = pa.array([], pa.large_string())
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def places(self, words: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, number of ids) of distinct words. ``learn(list of words)``
        gives (place, number, ids) of them."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        if len(new):
            if len(self.words) + len(new) > TABLE_WORDS:
                old = at.drop_null().to_numpy()
                size = self.size[old]
                ends = np.cumsum(size)
                self.ids = self.ids[np.repeat(self.first[old] - (ends - size), size) + np.arange(int(size.sum()))]
                self.words, self.first, self.size = words.filter(pc.is_valid(at)), ends - size, size
            first, size, ids = learn(new.to_pylist())
            self.words = pa.concat_arrays([self.words, new])
            self.first = np.concatenate([self.first, len(self.ids) + first])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            at = pc.index_in(words, value_set=self.words)
        at = at.to_numpy()
        return self.first[at], self.size[at]

    def encode(self, texts: list[str], learn) -> list[np.ndarray]:
        """Ids of texts whose words stand between single spaces."""
        if not texts:
            return []
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        first, size = self.places(coded.dictionary, learn)
        word = coded.indices.to_numpy()
        n = size[word]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(first[word] - (ends - n), n) + np.arange(int(n.sum()))]
        last = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))[:-1]  # (no text is without a word: "" is one)
        return np.split(ids, ends[last - 1])


def _cut(ids: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the runs between the ids ``at``, the other ids)."""
    cuts = np.flatnonzero(ids == at)
    return np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1, np.delete(ids, cuts)


class WordEncoder:
    """Ids of whole texts, as arrays, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.kind = _kind(config)
        self.latin = LatinWords(config) if self.kind == "word" else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.whole = ByteBpe(path) if self.kind == "byte" else None
        self.table = IdTable(self.dtype)
        self.break_id = None
        if self.kind:
            ids = self._whole("\n" if self.kind == "byte" else _MARK)
            self.break_id = ids[0] if len(ids) == 1 else None

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return self.whole.encode(texts) if self.whole else [np.array(self._whole(t), self.dtype) for t in texts]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the ids, number of ids, ids) of distinct words; many words go to one call with a break between them."""
        glue, before = ("\n ", " ") if self.kind == "byte" else (f" {_MARK} ", "")
        blob = " ".join(words)
        other = _SPACE.search(blob.replace(" ", "").replace("\n", "")) is not None  # white space but space and line feed
        easy = [w != "" and "\n" not in w and not (other and _SPACE.search(w)) for w in words]
        if self.break_id is None or _MARK in blob:
            easy = [False] * len(words)
        joined = [i for i, e in enumerate(easy) if e]
        # words behind a line feed: without it they stand at the beginning of a line, as between breaks
        lines = [i for i, w in enumerate(words) if self.kind == "byte" and self.break_id is not None and w[:1] == "\n" and w[1:] and not _SPACE.search(w, 1)]
        size, ids = np.zeros(len(words), np.int64), []
        for places, skip in ((joined, 0), (lines, 1)):
            for at in range(0, len(places), JOINED_WORDS):
                part = places[at:at + JOINED_WORDS]
                texts = [words[i][skip:] for i in part]
                n, found = _cut(self._each(["\n".join(texts) if skip else before + glue.join(texts)])[0], self.break_id)
                if len(n) != len(part):  # a word that holds the break itself
                    each = self._each([("" if skip else before) + t for t in texts])
                    n, found = np.array([len(x) for x in each]), np.concatenate(each)
                if skip:
                    found, n = np.insert(found, np.cumsum(n) - n, self.break_id), n + 1
                size[part] = n
                ids.append(found)
        done = set(lines)
        rest = [i for i, e in enumerate(easy) if not e and i not in done]
        each = self._each([words[i] if words[i][:1] == "\n" and self.kind == "byte" else before + words[i] for i in rest])
        size[rest] = [len(x) for x in each]
        joined = joined + lines
        order = np.array(joined + rest, np.int64)
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return first, size, np.concatenate([np.zeros(0, self.dtype), *ids, *each])

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of Latin letters with punctuation behind them are put together from ids of both, which the
        tokenizer never joins; there are far fewer of these than of words. Others are encoded as they are."""
        if self.latin.encoding is None:
            return self._learn(words)
        cores: dict[str, int] = {}
        others: dict[str, int] = {"": 0}
        pairs = []  # (number of the core or -1, number of what else there is)
        for w in words:
            m = _SIMPLE.fullmatch(w)
            pairs.append((cores.setdefault(m[1].lower(), len(cores)), others.setdefault(m[2], len(others))) if m
                         else (-1, others.setdefault(w, len(others))))
        size, ids = _cut(self.latin.encode(list(cores)), self.latin.gap) if cores else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
        core_first = np.cumsum(size) - size
        other_first, other_size, other_ids = self._learn(list(others))
        # numbers of cores come after those of the others; the number behind them all has no ids
        first = np.concatenate([len(ids) + other_first, core_first, [0]])
        size = np.concatenate([other_size, size, [0]])
        ids = np.concatenate([ids.astype(self.dtype), other_ids])
        core, other = np.array(pairs, np.int64).T
        both = np.stack([np.where(core < 0, len(size) - 1, core + len(others)), other], axis=1).ravel()
        n = size[both]
        ids = ids[np.repeat(first[both] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        whole = n.reshape(-1, 2).sum(axis=1)
        return np.cumsum(whole) - whole, whole, ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.kind:
            return self._each(texts)
        if self.kind == "word":
            return self.table.encode([t.replace("\n", " ") for t in texts], self._learn_words)
        if not self.whole.fast or self.break_id is None:
            return self._each(texts)
        # a space starts a piece with the word behind it, a line feed is a piece of its own; a line feed before the
        # text gives two ids of its own, which go again
        odd = [loose(t) for t in texts]
        plain = iter(self.table.encode([f"\n{t}".replace("\n", " \n") for t, o in zip(texts, odd) if not o], self._learn))
        whole = iter(self._each([t for t, o in zip(texts, odd) if o]))
        return [next(whole) if o else next(plain)[2:] for o in odd]


def _kind(config: dict) -> str | None:
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    lower = {"type": "Lowercase"} in [norm, *((norm or {}).get("normalizers") or [])]
    if lower and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" \
            and steps[0].get("pattern", {}).get("Regex") == _WORD_PATTERN:
        return "word"
    return None


def parts_of(text: str) -> list[str]:
    """Parts of a text for a SentencePiece model without pieces across parts. A part that starts with a
    line feed stands for itself, any other for a space mark and itself; spaces in front of it count."""
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " in text or text[:1] == " ":
        return [p[1:] if p[0] == " " else p for p in _PARTS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def splits_by_space(pieces: Iterable[str]) -> bool:
    """Whether no piece has the space mark behind another character, nor a line feed."""
    return not any("▁" in p.lstrip("▁") or "\n" in p or " " in p for p in pieces)


class PieceCounter(WordCache):
    """Number of pieces of whole texts, equal to ``len(encode(text))``."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece.sentencepiece_model_pb2.ModelProto() if hasattr(sentencepiece, "sentencepiece_model_pb2") else _proto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.by_part = (splits_by_space(p.piece for p in spec.pieces if p.type == 1) and norm.add_dummy_prefix
                        and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap
                        and all(p.type in (1, 2, 3, 6) for p in spec.pieces) and not spec.trainer_spec.treat_whitespace_as_suffix)

    def _learn(self, words: set[str]) -> None:
        words.discard("")
        self.known[""] = 1  # the space mark alone
        some = list(words)
        for w, ids in zip(some, self.model.encode(some, num_threads=1)):
            self.known[w] = len(ids) - (w[0] == "\n")

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_part:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        words = [parts_of(t) if t else [] for t in texts]
        known = self._know(words)
        return [sum([known[w] for w in ws]) for ws in words]


def _proto():
    from sentencepiece import sentencepiece_model_pb2
    return sentencepiece_model_pb2.ModelProto()
