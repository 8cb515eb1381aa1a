"""Merkle manifest of a table of documents, kept as a persistent tree.

A leaf is the digest of one row. The leaves of a language, in order of their ids, are joined two by two until
one node, the language's sub-root, remains; the sub-roots, in order of their languages, likewise give the root.

The tree is built in aligned blocks of ``BLOCK`` consecutive nodes: one task works on one block, whose root is a
node of the next level, and so on, so no task ever holds more than ``BLOCK`` nodes of a level and no row of a
level depends on the size of its language. A changed leaf never alters a tree: it makes a *version*, which copies
the ancestors of the leaf inside its block (``PersistentTree.replace``) and shares every other node. The version
goes on above the block along the block's own path, which is handed down from the top level by joins of at most
``BLOCK`` rows for each key.

Defined cases: null and repeated ids are leaves like any other (null ids first, equal ids by their leaf digest,
equal rows in any order); a null language is a language of its own and comes first; null fields are ``-``; an
empty table has no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import materialize, ship
from ledgerguard.plans.ranking import null_safe_join, rank_within

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10
BLOCK = 1 << BLOCK_LEVELS
TAMPERED_EACH = 7

# One step of a path: "" for a node without a sibling, "<" and ">" with the digest of a left or right sibling.
_LEVEL = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.string()), ("steps", pa.list_(pa.string())),
                    ("copied", pa.list_(pa.string())), ("is_root", pa.bool_()), ("raised", pa.int32())])
_LEVEL_SQL = ("key string, pos long, doc_id long, hash string, steps array<string>, copied array<string>, "
              "is_root boolean, raised int")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class PersistentTree:
    """A binary hash tree whose nodes are never altered: a node is (digest, left, right)."""

    def __init__(self, leaves: list[str]) -> None:
        self.nodes: list[tuple[str, int, int]] = [(h, -1, -1) for h in leaves]
        self.width = len(leaves)
        level = list(range(len(leaves)))
        self.height = 0
        while len(level) > 1:
            level = [self._join(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
            self.height += 1
        self.root = level[0]

    def _join(self, left: int, right: int) -> int:
        self.nodes.append((digest(self.nodes[left][0], self.nodes[right][0] if right >= 0 else ""), left, right))
        return len(self.nodes) - 1

    def _descent(self, index: int) -> list[tuple[int, bool]]:
        """(node, whether the way goes right) from the root down to leaf ``index``."""
        node, way = self.root, []
        for level in range(self.height - 1, -1, -1):
            right = bool(index >> level & 1)
            way.append((node, right))
            node = self.nodes[node][2 if right else 1]
        return way

    def steps(self, index: int) -> list[str]:
        """The siblings on the way from a leaf to the root."""
        out = []
        for node, right in reversed(self._descent(index)):
            _, a, b = self.nodes[node]
            out.append("<" + self.nodes[a][0] if right else ">" + self.nodes[b][0] if b >= 0 else "")
        return out

    def replace(self, index: int, leaf: str) -> list[int]:
        """A version with another leaf: the copied nodes from the new leaf to the new root. All others are shared."""
        self.nodes.append((leaf, -1, -1))
        copied = [len(self.nodes) - 1]
        for node, right in reversed(self._descent(index)):
            _, a, b = self.nodes[node]
            copied.append(self._join(a, copied[-1]) if right else self._join(copied[-1], b))
        return copied

    def release(self, nodes: list[int]) -> None:
        """Forget the newest nodes, those of a version that has been written out."""
        del self.nodes[nodes[0]:]


def _block(rows: pa.Table) -> pa.Table:
    """One block: each node's path inside it, the versions of its changed leaves, and its root as a node of the next level."""
    rows = rows.sort_by("pos")
    pos, raised = rows["pos"].to_pylist(), rows["raised"].to_pylist()
    alone = pos == [0]  # the only node of its language: its sub-root as it is
    lifts = [0 if alone else BLOCK_LEVELS - r for r in raised]
    hashes = rows["hash"].to_pylist()
    lifted = [reduce(lambda h, _: digest(h), range(n), h) for h, n in zip(hashes, lifts)]
    tree = PersistentTree(lifted)
    copied: list = []
    for i, changed in enumerate(rows["changed"].to_pylist()):
        if changed is None:
            copied.append(None)
            continue
        made = tree.replace(i, changed)
        copied.append([tree.nodes[n][0] for n in made])
        tree.release(made)
    n = len(pos)
    out = {"pos": [*pos, pos[0] // BLOCK], "doc_id": [*rows["doc_id"].to_pylist(), None], "hash": [*hashes, tree.nodes[tree.root][0]],
           "steps": [[""] * lift + tree.steps(i) for i, lift in enumerate(lifts)] + [None], "copied": [*copied, None],
           "is_root": [False] * n + [True], "raised": [0] * n + [raised[0] if alone else tree.height]}
    return pa.table(out | {"key": [rows["key"][0].as_py()] * (n + 1)}, schema=_LEVEL)


def _raise_level(nodes: DataFrame) -> DataFrame:
    """nodes (key, pos from 0, doc_id, hash, changed, raised) -> their paths and the roots of their blocks."""
    ship(nodes.sparkSession)
    blocks = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"))
    return materialize(blocks.applyInArrow(_block, _LEVEL_SQL), "merkle")


def leaf_digest(changed_chars: bool = False) -> Column:
    """Digest of a row's fields; with ``changed_chars``, of the row with one more character counted."""
    def field(name: str) -> Column:
        value = F.col(name)
        if name == "n_chars" and changed_chars:
            value = value.cast("decimal(20,0)") + 1
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[field(c) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(key = language, doc_id, hash, changed): the leaf of every row, and the leaf of its changed form where there is one."""
    rows = docs.select(*FIELDS)
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_EACH)) == 0 if changed is None else changed
    return rows.select(F.col("lang").alias("key"), "doc_id", leaf_digest().alias("hash"), F.when(changed, leaf_digest(True)).alias("changed"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """All levels above ``nodes`` until each key has one node."""
    levels = []
    while True:
        level = _raise_level(nodes)
        levels.append(level)
        nodes = level.where("is_root").select("key", "pos", "doc_id", "hash", F.lit(None).cast("string").alias("changed"), "raised")
        if nodes.agg(F.max("pos")).first()[0] in (None, 0):
            return levels


def _paths(roots: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, pos, path, subroot, root) of the nodes that ``levels`` were built of, down from ``roots`` (key, pos, path,
    subroot, root), the one node of each key. A path goes up to the root of all."""
    paths = roots
    for level in reversed(levels):
        own = level.where("not is_root").select("key", F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").alias("node"), "steps")
        paths = null_safe_join(own, paths.withColumnRenamed("pos", "block"), ["key", "block"])
        paths = paths.select("key", F.col("node").alias("pos"), F.concat("steps", "path").alias("path"), "subroot", "root")
    return paths


def climb_path(start: Column, path: Column) -> Column:
    """The nodes above ``start`` along ``path``; ``start`` itself comes first."""
    def step(done: Column, s: Column) -> Column:
        last, sibling = F.element_at(done, -1), F.substring(s, 2, 64)
        joined = F.when(F.startswith(s, F.lit("<")), F.concat(sibling, last)).otherwise(F.concat(last, sibling))
        return F.concat(done, F.array(F.sha2(joined.cast("binary"), 256)))
    return F.aggregate(path, F.array(start), step)


def fold_path(start: Column, path: Column) -> Column:
    """The root that ``start`` gives along ``path``."""
    def step(last: Column, s: Column) -> Column:
        sibling = F.substring(s, 2, 64)
        joined = F.when(F.startswith(s, F.lit("<")), F.concat(sibling, last)).otherwise(F.concat(last, sibling))
        return F.sha2(joined.cast("binary"), 256)
    return F.aggregate(path, start, step)


class Manifest:
    """A stored tree: ``nodes`` has each leaf with its path in its block and the nodes that its version copied
    there, ``above`` the path, sub-root and root above each block."""

    def __init__(self, docs: DataFrame, changed: Column | None = None) -> None:
        salted = materialize(leaves(docs, changed).withColumn("row", F.monotonically_increasing_id()), "leaves")
        numbered = rank_within(salted, ["key"], ["doc_id", "hash", "row"], out="pos")
        levels = _climb(numbered.select("key", F.col("pos") - 1, "doc_id", "hash", "changed", F.lit(BLOCK_LEVELS))
                        .toDF("key", "pos", "doc_id", "hash", "changed", "raised"))
        subroots = levels[-1].where("is_root").select(F.lit("root").alias("all"), "key", F.col("hash").alias("subroot"))
        langs = materialize(rank_within(subroots, ["all"], ["key"], out="pos"), "subroots")
        top_levels = _climb(langs.select("all", F.col("pos") - 1, F.lit(None).cast("long"), "subroot", F.lit(None).cast("string"), F.lit(BLOCK_LEVELS))
                            .toDF("key", "pos", "doc_id", "hash", "changed", "raised"))
        top = top_levels[-1].where("is_root").select("key", "pos", F.array().cast("array<string>").alias("path"),
                                                     F.lit("").alias("subroot"), F.col("hash").alias("root"))
        of_langs = _paths(top, top_levels).select(F.col("pos").alias("node"), "path", "root")
        tops = langs.join(of_langs, F.col("pos") - 1 == F.col("node")).select("key", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
        self.above = _paths(tops, levels[1:])
        self.nodes = levels[0].where("not is_root")

    def paths(self) -> DataFrame:
        """(key, doc_id, leaf, steps, copied, above, subroot, root): every leaf with its path inside and above its block."""
        own = self.nodes.select("key", F.floor(F.col("pos") / BLOCK).alias("block"), "doc_id", F.col("hash").alias("leaf"), "steps", "copied")
        above = self.above.select("key", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
        return null_safe_join(own, above, ["key", "block"])

    def versions(self) -> DataFrame:
        """(doc_id, lang, root, copied): one row for each changed leaf, with the nodes its version copied, from the
        leaf to the version's root. The version shares all other nodes with the manifest."""
        found = self.paths().where("copied is not null")
        whole = F.concat(F.slice("copied", F.lit(1), F.size("copied") - 1), climb_path(F.element_at("copied", -1), F.col("above")))
        return (found.withColumn("copied", whole)
                .select("doc_id", F.col("key").alias("lang"), F.element_at("copied", -1).alias("root"), "copied"))

    def verify(self) -> DataFrame:
        """One row for each leaf: its proof, and the root that its changed (else its own) form folds to."""
        whole = F.concat("steps", "above")
        siblings = F.array_join(F.transform(whole, lambda s: F.substring(s, 2, 64)), "")
        # a version goes on from the root of its block, an unchanged leaf from itself
        start = F.when(F.col("copied").isNotNull(), F.element_at("copied", -1)).otherwise(F.col("leaf"))
        path = F.when(F.col("copied").isNotNull(), F.col("above")).otherwise(whole)
        rows = self.paths().select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                                   fold_path(start, path).alias("folded_root"))
        return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
