"""Token files, token counts, packing and unigram segmentation against the libraries themselves."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from ledgerguard.llm import digestcache, packing, tokenfile, tokens, unigram
from ledgerguard.llm.common import scratch

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n", "a\nb", "a \nb", "a\n b", "a  b", "a   b\n\n c ", "x<|endoftext|>y z", "\tq\t r", "don't DON'T 's", "\x01", "a\x01b c", "  lead",
       "▁a ▁▁b", "a\r\nb", "1234 56,7.8", "Σας ΣΑΣ İ", "a" * 3000, "new\n" * 5, "a\x1cb c", "日本語 テキスト", "́ b ́c", "\x85x　y z"]


def crc(ids, end):
    return zlib.crc32(np.array([*ids, end], "<u4").tobytes())


def wanted(rows, path, end):
    library = Tokenizer.from_file(path)
    return [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sZ1. \n\t\x01é́ <|▁")), max_size=12), max_size=3))
def test_ids_equal_the_library(path, texts):
    ours = tokens.load(path)
    library = Tokenizer.from_file(path) if path not in _libraries else _libraries[path]
    _libraries[path] = library
    texts = texts + ODD[:4]
    assert [x.tolist() for x in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


_libraries: dict = {}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_texts_equal_the_library(path):
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in tokens.load(path).encode(ODD)] == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_counts_equal_the_library_with_a_small_cache(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "TABLE_WORDS", 3)
    ours = tokens.PieceCounter(PIECE)
    for _ in range(3):
        assert [ours.count([t])[0] for t in ODD] == [len(library.encode(t)) for t in ODD]


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code = tokenfile.EliasFano.of(values)
    assert code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    if len(values):  # near-minimal space: two bits a number besides the low bits
        assert len(code.high) * 8 <= 3 * len(values) + 8 and len(code.low) * 8 <= code.low_bits * len(values) + 8


def test_token_file(spark, docs, no_docs, rows, monkeypatch):
    out = scratch(spark, "t")
    tokenfile.write_tokens(docs, out, WORD, 1)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_summaries(spark, out).collect()), key=lambda r: r[2])
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)  # in ascending id order, nulls first
    assert [g[2] for g in got] == np.concatenate([[0], np.cumsum([g[3] for g in got])[:-1]]).tolist()
    assert sorted(g[:2] + g[3:] for g in got) == sorted((i is not None, i or 0, len(ids), crc(ids[:-1], 1)) for i, ids in wanted(rows, WORD, 1))
    out = scratch(spark, "t")
    tokenfile.write_tokens(no_docs, out, WORD, 1)
    assert tokenfile.read_summaries(spark, out).count() == 0


def test_segments_split(monkeypatch):
    segment = tokenfile._segment(0, 0, 0, [None, 3, 3, 9], [np.arange(n, dtype="<u2") for n in (1, 4, 0, 2)])
    ids, starts, ends, data = tokenfile.segment_documents(segment.to_pylist()[0])
    assert ids == [None, 3, 3, 9] and starts.tolist() == [0, 1, 5, 5] and ends.tolist() == [1, 5, 5, 7] and data.tolist() == [0, 0, 1, 2, 3, 0, 1]


def test_digest_cache(spark, docs, no_docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = scratch(spark, "cache")
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 100) for r in rows)
    for _ in range(2):  # the second time all counts are stored
        got = digestcache.count_tokens(docs, PIECE, cache, limit=100).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})
    spark.read.parquet(cache).write.mode("append").parquet(scratch(spark, "other"))
    assert digestcache.count_tokens(no_docs, PIECE, scratch(spark, "cache"), limit=1).count() == 0


def brute_fullest(counts, room):
    sums = {0}
    for x, c in counts.items():
        sums = {s + x * m for s in sums for m in range(c + 1) if s + x * m <= room}
    return max(sums)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=7), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_fullest_combination(counts, room):
    chosen = packing.fullest(counts, room)
    assert all(m <= counts[x] for x, m in chosen.items())
    assert sum(x * m for x, m in chosen.items()) == brute_fullest(counts, room)


def test_packing(spark, docs, no_docs, rows):
    got = packing.pack(docs, BYTE, 2, capacity=64).collect()
    want = []
    for i, ids in wanted(rows, BYTE, 2):
        for p, (s, n) in enumerate(packing.cuts(len(ids), 64)):
            want.append((str(i), p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 64) * 1.05 + 1
    assert packing.pack(no_docs, BYTE, 2).count() == 0


def zipf_model():
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as f:
        spec.ParseFromString(f.read())
    ours = unigram.Unigram.load(PIECE)
    spec.trainer_spec.model_type = 1
    for piece, score in zip(spec.pieces, ours.scores):
        piece.score = float(score)
    return ours, sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def test_unigram_equals_the_library(rows):
    ours, library = zipf_model()
    texts = [t for t in {r[1] for r in rows if r[1]} if len(t) < 400] + ODD
    for text in texts:
        got, want = ours.encode([text])[0].tolist(), library.encode(text)
        assert got == want or abs(sum(ours.scores[got]) - sum(ours.scores[want])) < 1e-3, text  # (ties go either way)
        assert ours.decode(np.array(got)) == library.decode(got)


def test_unigram_on_a_table(docs, no_docs, rows):
    ours = unigram.Unigram.load(PIECE)
    got = sorted((str(r.doc_id), r.n_pieces, r.ids_crc32, r.round_trip) for r in unigram.encode_documents(docs, PIECE).collect())
    want = []
    for r in rows:
        ids = ours.segment([(" " + r[1]).replace(" ", "▁").encode()])[0] if r[1] else []  # the whole text at once
        want.append((str(r[0]), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), "▁" not in (r[1] or "")))
    assert got == sorted(want)
    assert unigram.encode_documents(no_docs, PIECE).count() == 0


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"bc"]
    trie = unigram.DoubleArray(keys, list(range(6)))

    def find(key):
        state = 0
        for byte in key:
            to = int(trie.base[state]) + byte + 1
            if to >= len(trie.check) or trie.check[to] != state:
                return -1
            state = to
        return int(trie.value[state])
    assert [find(k) for k in keys] == list(range(6)) and find(b"ac") == find(b"") == find(b"\xff") == -1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_many_odd_texts_encode_as_the_library_does(name):
    r, library = random.Random(21), Tokenizer.from_file(public_tokenizers.path(name))
    white = [" ", " ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\xa0", "\x85", " \n", "\r\n", " ", "\x1c", "　"]
    words = ["the", "The", "don't", "It's", "é", "É", "naïve,", "日本語", "🎉", "<s>", "<|endoftext|>", "<|startoftext|>x", "x", "123", "a1b2", "...", "\x01", "ß!", "ſ", "İ", "K",
             "क्षि", "é", "(why?)", "Ab-cd", "'s", "\x00"]
    texts = ["".join(r.choice(white if r.random() < 0.45 else words) for _ in range(r.randrange(16))) for _ in range(10_000)]
    texts += ["paragraph one.\n\nparagraph two is here.\n\n\n  indented"] * 2 + ["w" * 3000, "日" * 2000, "\n" * 500, " " * 500 + "x"]
    got = tokens.load(public_tokenizers.path(name)).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
