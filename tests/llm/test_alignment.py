"""Alignment of two tokenizers against whole-text encoding by the libraries, pair by pair in plain Python."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerguard.llm import alignment, bitmaps
from ledgerguard.llm.bytebpe import ByteBpe, byte_alphabet

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def plain_groups(libraries, text):
    """[(ids of A, ids of B)] of a text, or nothing."""
    a, b = libraries
    if not text:
        return []
    alphabet, want = byte_alphabet(), (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spans = []
    for ids, to_bytes in ((ids_a, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
                          (ids_b, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, ends, joined = 0, [], b""
        for i in ids:
            joined += to_bytes(i)
            ends.append(len(joined))
        if joined != want:
            return []
        spans.append(ends)
    cuts, out = sorted(set(spans[0]) & set(spans[1])), []
    low = 0
    for cut in cuts:
        out.append(tuple([i for i, e in zip(ids, ends) if low < e <= cut] for ids, ends in zip((ids_a, ids_b), spans)))
        low = cut
    return out


def plain_alignment(libraries, texts):
    per_doc, docs = [], Counter()
    for text in texts:
        groups = plain_groups(libraries, text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        docs.update(links.keys())
        per_doc.append((groups, links))
    highest: dict = {}
    for (x, _), n in docs.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for groups, links in per_doc:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, docs, sum((links for _, links in per_doc), Counter())


def compare(libraries, df, ids, texts):
    got = sorted((str(r.doc_id), *[r[c] for c in STATS]) for r in alignment.align_documents(df, BYTE_BPE, PIECE_BPE).collect())
    assert got == sorted((str(i), *w) for i, w in zip(ids, plain_alignment(libraries, texts)[0]))


def test_documents(docs, no_docs, rows, libraries):
    compare(libraries, docs, [r[0] for r in rows], [r[1] for r in rows])
    assert alignment.align_documents(no_docs, BYTE_BPE, PIECE_BPE).count() == 0


WHITE = [" ", "  ", "\n", "\n\n", "\t", "\xa0", "\x85", " ", "\x1c", "　", "᠎", "\r\n", " \n"]
WORDS = ["the", "The", "'s", "don't", "é", "日本語", "🎉", "<s>", "<|endoftext|>", "</s>", "<0x41>", "x", "123", "\x00", "ß.", "...", "Ω", "क्षि", "́"]


def test_odd_texts(spark, libraries):
    r = random.Random(11)
    texts = ["".join(r.choice(WHITE if r.random() < 0.45 else WORDS) for _ in range(r.randrange(14))) for _ in range(3000)]
    texts += ["▁", "a▁b", " ", "  ", "\n", " \n", "a ", "a\n", None, "", "z" * 3000, "日" * 2500, "क्" * 900, "\x01" * 300, "é" * 1000 + " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    compare(libraries, df, range(len(texts)), texts)
    segments = alignment.build_segments(df, BYTE_BPE, PIECE_BPE)
    _, docs, links = plain_alignment(libraries, texts)
    found = {(p.a_id, p.b_id): (p.n_docs, p.n_links) for p in alignment.pair_table(segments, PIECE_BPE).collect()}
    assert found == {p: (docs[p], links[p]) for p in docs}


def test_many_blocks_and_a_word_table_that_starts_anew(spark, libraries):
    r = random.Random(2)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20))) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    compare(libraries, df, range(len(texts)), texts)  # one partition: a full block of documents and a second one
    kept = alignment.WordAlignments(BYTE_BPE, PIECE_BPE)
    first = kept.align(texts[:50])
    kept.chars = alignment.KEPT_CHARS + 1
    again = kept.align(texts[:50])
    assert first[1] == again[1] and (first[0] == again[0]).all() and first[2].bits == again[2].bits


@given(st.dictionaries(st.tuples(st.integers(0, 30), st.integers(0, bitmaps.BLOCK_DOCS - 1)), st.integers(1, 70), max_size=80), st.booleans())
@settings(max_examples=80, deadline=None)
def test_bitmaps(pairs, dense):
    if dense:  # a key of most documents
        pairs = pairs | {(5, d): 1 + d % 3 for d in range(0, bitmaps.BLOCK_DOCS, 2)}
    codes, docs = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    index = bitmaps.PairBitmaps.build(codes, docs, np.array(list(pairs.values()), np.int64))
    n_docs, total = index.counts()
    assert dict(zip(index.codes.tolist(), n_docs.tolist())) == dict(Counter(c for c, _ in pairs))
    want = Counter()
    for (c, _), m in pairs.items():
        want[c] += m
    assert dict(zip(index.codes.tolist(), total.tolist())) == dict(want)
    value = index.codes * 7 + 1
    by_doc = Counter()
    for (c, d), m in pairs.items():
        by_doc[d] += m * (c * 7 + 1)
    assert {d: v for d, v in enumerate(index.weighted(value).tolist()) if v} == dict(by_doc)
    back = alignment._unpacked(*[alignment._packed(index)[k] for k in ("codes", "planes", "sizes", "bits")])
    assert (back.planes == index.planes).all() and (back.sizes == index.sizes).all() and max(index.sizes.tolist(), default=0) <= bitmaps.BLOCK_DOCS // 8


@pytest.mark.parametrize("plain", [False, True])
def test_byte_level_encoding(plain):
    r = random.Random(4)
    encoder = ByteBpe(BYTE_BPE, plain)
    texts = ["".join(r.choice(WHITE + WORDS + list("abcdefg")) for _ in range(r.randrange(30))) for _ in range(20_000)]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(60))) for _ in range(20_000)] + ["q" * 5000, "", "a\n\n\nb\n\n", "\n" * 3000]
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = plain
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.fast is not None and all(w.ids == g.tolist() for w, g in zip(want, encoder.encode(texts)))
