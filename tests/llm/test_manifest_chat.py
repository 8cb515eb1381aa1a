"""The Merkle manifest and the chat format against plain Python."""
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerguard.llm import chat, merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return H(*fields)


def plain_tree(leaves):
    """(root, for each leaf its siblings with the side) by whole levels."""
    paths = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append(None if other >= len(level) else (other < p, level[other]))
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        some = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = some, *plain_tree([plain_leaf(*r) for r in some])
    root, tops = plain_tree([trees[lang][1] for lang in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        some, subroot, paths = trees[lang]
        for r, path in zip(some, paths):
            steps = path + top
            h = plain_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = plain_leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for s in steps:
                h = H(h) if s is None else H(s[1], h) if s[0] else H(h, s[1])
            out.append((str(r[0]), plain_leaf(*r), subroot, root, H(*[s[1] for s in steps if s]), h, h == root))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_manifest(spark, docs, no_docs, rows):
    assert found(merkle.Manifest(docs).verify()) == plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert merkle.Manifest(no_docs).verify().count() == 0


def test_manifest_of_several_blocks_and_languages(spark):
    r = random.Random(3)
    sizes = {"big": 2 * merkle.BLOCK + 1, "even": merkle.BLOCK, None: 5, "": 1, "é": 3, "z": merkle.BLOCK + 7}
    rows = [(i if r.random() < 0.97 else None, r.choice([None, "a", "ü"]), lang, r.choice([None, 5, 2 ** 63 - 1]), f"t{i % 50}")
            for lang, n in sizes.items() for i in range(n)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    manifest = merkle.Manifest(df)
    want = plain_manifest(rows)
    assert found(manifest.verify()) == want
    # a version holds a copied node for each level only, its root is the folded one
    versions = manifest.versions().collect()
    changed = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert len(versions) == len(changed) and {len(v.copied) for v in versions if v.lang == "big"} == {1 + 12 + 3}
    assert {(str(v.doc_id), v.root) for v in versions} <= {(w[0], w[5]) for w in want}


@given(st.integers(1, 40), st.data())
@settings(max_examples=60, deadline=None)
def test_versions_share_untouched_nodes(n, data):
    leaves = [H(str(i)) for i in range(n)]
    tree = merkle.PersistentTree(leaves)
    before, at = list(tree.nodes), data.draw(st.integers(0, n - 1))
    copied = tree.replace(at, H("new"))
    assert tree.nodes[:len(before)] == before and len(copied) == tree.height + 1 == len(tree.nodes) - len(before)
    assert tree.nodes[copied[-1]][0] == plain_tree([*leaves[:at], H("new"), *leaves[at + 1:]])[0]
    tree.release(copied)
    assert tree.nodes == before


PIECES = ["### ", "</turn>", "\n", "\\", "user", "a", " ", "\n</turn>\n", "### assistant\n", "é", "\\n", "\\s", "#", "🎉"]


def plain_conversations(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    done = []
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        done.append((str(conv), len(turns), H(*[f"{r}\n{t}\n" for r, t in turns]), len(loss), H(loss)))
    return sorted(done)


def read(df):
    return sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect())


def test_chat_round_trip(spark):
    r = random.Random(8)
    said = lambda n: "".join(r.choice(PIECES) for _ in range(r.randrange(n)))
    rows = [(r.randrange(60), r.randrange(4), r.choice(["user", "assistant", "system", said(4)]), said(12)) for _ in range(1500)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (5, None, "assistant", None), (61, 0, "assistant", "long " * 100_000)]
    rows += [(62, i % 40, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(3 * chat.SEGMENT_TURNS + 5)] + [rows[0]] * 3
    df = spark.createDataFrame([(*x, "c", "d") for x in rows], "conv_id long, turn long, role string, text string, turns string, segment string").repartition(4)
    written = chat.format_conversations(df).cache()
    assert read(chat.read_conversations(written)) == plain_conversations(rows)
    by_conv = {}
    for row in written.collect():
        by_conv.setdefault(row.conv_id, []).append((row.segment, row.formatted, row.loss))
    assert len(by_conv[62]) == 4 and all(len(v) == 1 for k, v in by_conv.items() if k != 62)
    lengths = {x.conv_id: x.formatted_chars for x in chat.read_conversations(written).collect()}
    assert lengths == {k: sum(len(s[1]) for s in v) for k, v in by_conv.items()}
    empty = df.where("conv_id < 0")
    assert chat.read_conversations(chat.format_conversations(empty)).count() == 0


def test_plain_turns_stay_as_they_are(spark):
    text = "no ###conflict here </turn> inside a line, nor a \\ alone"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, "user", "### x\n</turn>")],
                               "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert out[1].formatted == f"### user\n{text}\n</turn>\n### assistant\n\\\\### Assistant: </turn> ok\n</turn>\n"
    assert out[2].formatted == "### user\n\\### x\n\\</turn>\n</turn>\n"
    (span,) = out[1].loss
    assert out[1].formatted[span.start:span.start + span.length] == "\\\\### Assistant: </turn> ok" and out[2].loss == []


def test_parser_refuses_other_texts(spark):
    texts = ["", "x", "### user\na", "### user\na\n</turn>", "user\na\n</turn>\n", "### user\n### b\n</turn>\n", "### user\n</turn>\n", "### user\n\n</turn>\n"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chat.parse(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got[:7] == [[], None, None, None, None, None, None] and [(t.role, t.text) for t in got[7]] == [("user", "")]
