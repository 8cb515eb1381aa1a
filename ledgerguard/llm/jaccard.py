"""Exact n-gram Jaccard join by a size-aware heavy-light method.

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets form one class (keyed by a
64-bit digest of the set), and classes are compared once each.

Filter. With ``o`` the least overlap a pair of similarity t needs, the i-th common hash of a linked pair
lies within the first ``n - ceil(t n) + i`` hashes of either set (hash order). Each class keeps the prefix
for ``k(n) = max(2, n // 20)`` common hashes, so a linked class shares at least ``k(ceil(t n))`` prefix
hashes with other classes; classes that share fewer drop out.

Light lists (at most ``LIGHT`` classes) are searched by size: below a boundary size, classes enumerate the
2-subsets of their prefix hashes and meet on equal subsets; above it, their inverted lists are scanned and
matches are counted. The boundary is the size at which the sum of both costs, from counts by size, is
least. Hot hashes (longer lists) are left out of these searches, and the number of matches asked for is
lowered by the number of hot hashes in the prefix.

Classes whose prefix has so many hot hashes that fewer than two matches would be left are heavy. Pairs of
heavy classes are found from their whole sets: hashes are ordered by frequency, rarest first, and each
list of a prefix is first linked to one centre (the class with the fewest hashes of its own), so a large
group of near copies costs a row for each member instead of each pair. Only pairs of a list that are still
in different components, and that the counts of hashes of their own still allow, are then compared.

All candidates are verified on the whole sets; links are exact up to 64-bit hash collisions.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and is
its own component; with fewer than ``k`` words the whole word sequence is the one shingle; repeated rows
give one output row each; a null id takes part but never names a component if another id can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerguard.llm import wordhash
from ledgerguard.llm.common import map_arrow, materialize
from ledgerguard.llm.graph import components
from ledgerguard.plans.ranking import null_safe_join

LIGHT = 16  # longest inverted list that is searched pair by pair


def need_of(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def matches_of(n: np.ndarray) -> np.ndarray:
    """k(n): common prefix hashes looked for."""
    return np.maximum(2, n // 20)


def _k(n: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(n / 20)).cast("long")


def _ceil_share(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def text_sets(texts: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text, in order."""
    for _, rows, data, bounds in wordhash.text_runs(texts):
        hashes, _, _, first = wordhash.words(data, bounds, lower)
        runs = wordhash.shingles(hashes, k)
        for i in range(rows):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(runs[a:b - k + 1])
            elif b > a:  # fewer words than a shingle: the sequence itself, told apart by its length
                yield wordhash.mix(np.array([(hashes[a:b] * wordhash._MULT[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def class_key(members: np.ndarray) -> int:
    """64-bit digest of a set."""
    if not len(members):
        return 0
    a = wordhash.mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(wordhash.mix(members * wordhash._MULT[40]))
    joined = np.array([a], np.uint64) * wordhash._MULT[41] + b + np.uint64(len(members))
    return int(wordhash.mix(joined).view(np.int64)[0])


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _sketcher(k: int, percent: int, whole: bool, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, cid, kept = [], [], []
                for members in text_sets(part.column(1), k, lower):
                    size = len(members)
                    n.append(size)
                    cid.append(class_key(members))
                    if not whole:
                        size_ = np.int64(size)
                        members = members[:min(size, int(size_ - need_of(size_, percent) + matches_of(size_)))]
                    kept.append(members.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), _binary(kept), part.column(2)],
                                                 ["doc_id", "n", "cid", "hashes", "t"])
    return run


def _exploder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, hashes) -> a row (cid, n, h) for each hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("cid").to_numpy(zero_copy_only=False), sizes)),
                 pa.array(np.repeat(part.column("n").to_numpy(zero_copy_only=False), sizes)),
                 pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["cid", "n", "h"])


def _postings(sets: DataFrame) -> DataFrame:
    return map_arrow(sets.select("cid", "n", "hashes"), _exploder, "cid long, n long, h long")


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, base = [], None, None
            left, right = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                one = left[i].as_buffer()
                if last is None or not one.equals(last):
                    last, base = one, np.frombuffer(one, np.uint64)
                other = np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.searchsorted(base, other)
                at[at == len(base)] = 0
                common = int((base[at] == other).sum()) if len(base) else 0
                if 100 * common >= percent * (len(base) + len(other) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64()))], ["u", "v"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of candidate pairs (u, v)."""
    x = sets.select(F.col("cid").alias("u"), F.col("hashes").alias("x"))
    y = sets.select(F.col("cid").alias("v"), F.col("hashes").alias("y"))
    return map_arrow(pairs.join(y, "v").join(x, "u").select("u", "v", "x", "y"), _verifier(percent), "u long, v long")


def _boundary(light: DataFrame, lists: DataFrame) -> int:
    """The size below which enumerating 2-subsets is cheaper than scanning lists. Costs are summed by
    size class (powers of 1.19, so some hundred rows at most reach the driver)."""
    per_class = light.join(lists, "h").groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), F.sum("df").alias("scan"))
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    rows = per_class.groupBy(step.alias("step")).agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("enum"), F.sum("scan").alias("scan"), F.max("n").alias("top")).orderBy("step").collect()
    best, cost, size = sum(r["scan"] for r in rows), 0.0, 0
    total = best
    for r in rows:
        cost += r["enum"] - r["scan"]
        if total + cost < best:
            best, size = total + cost, r["top"] + 1
    return size


def _subsets(light: DataFrame) -> DataFrame:
    """(cid, n, key) for each 2-subset of a class's light prefix hashes (at most its prefix, which is short here)."""
    hashes = light.groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("h")).alias("hs"))
    pairs = F.flatten(F.transform("hs", lambda a, i: F.transform(F.slice("hs", i + 2, F.size("hs")), lambda b: F.xxhash64(a, b))))
    return hashes.select("cid", "n", F.explode(pairs).alias("key"))


def _light_pairs(light: DataFrame, lists: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs with at least one class that is not heavy."""
    boundary = _boundary(light, lists)
    low = F.lit(percent) / 100
    info = light.groupBy("cid").agg(F.first("n").alias("n")).join(hot, "cid", "left").select(
        "cid", _k(F.col("n")).alias("k"), F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("heavy", F.lit(False)).alias("heavy"))

    def side(rows: DataFrame, c: str, *key: str) -> DataFrame:
        return rows.select(*key, F.col("cid").alias(c), F.col("n").alias(f"n{c}"))

    near = (F.col("u") < F.col("v")) & (F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent)
    small = _subsets(light.where(F.col("n") < boundary))
    small = side(small, "u", "key").join(side(small, "v", "key"), "key").where(near).select("u", "v").distinct()
    large = light.where(F.col("n") >= F.floor(F.lit(boundary) * low))
    large = (side(large, "u", "h").join(side(large, "v", "h"), "h").where(near & (F.greatest("nu", "nv") >= boundary))
             .groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")).where("c >= 2"))

    def told(rows: DataFrame, c: str) -> DataFrame:
        return rows.join(info.select(F.col("cid").alias(c), F.col("k").alias(f"k{c}"), F.col("q").alias(f"q{c}"), F.col("heavy").alias(f"heavy{c}")), c)

    large = told(told(large, "u"), "v").where(
        (~F.col("heavyu") | ~F.col("heavyv")) & (F.col("c") >= F.least("ku", "kv") - F.least("qu", "qv"))).select("u", "v")
    return small.union(large)


def _heavy_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes of whole sets by frequency: (h, cid, n, own, at), own = hashes of the class that no other
    has (the first in its order), at = the hash's place in that order."""
    postings = _postings(sets)
    df = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = postings.join(df, "h")
    rank = Window.partitionBy("cid").orderBy("df", "h")
    whole = Window.partitionBy("cid")
    ranked = common.select("cid", "n", "h", F.row_number().over(rank).alias("r"), F.count(F.lit(1)).over(whole).alias("c"))
    own = F.col("n") - F.col("c")
    return ranked.where(own + F.col("r") <= F.col("n") - _ceil_share(F.col("n"), percent) + 1).select("h", "cid", "n", own.alias("own"), (own + F.col("r")).alias("at"))


def _centre_pairs(lists: DataFrame) -> DataFrame:
    centre = lists.groupBy("h").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("s"), F.col("cid"))).alias("c")).select("h", F.col("c.cid").alias("c"))
    pairs = lists.join(centre, "h").where("cid <> c")
    return pairs.select(F.least("cid", "c").alias("u"), F.greatest("cid", "c").alias("v")).distinct()


def _open_pairs(lists: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list in different components that counts still allow.

    Hashes that one class alone has are in the union only. And where a pair's first common hash stands at
    places i and j of the two orders, at most 1 + min(n_u - i, n_v - j) hashes are common. A pair is taken
    from that first list alone."""
    rooted = lists.join(links.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    rooted = rooted.join(mixed, "h")
    prefixes = rooted.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]).alias("p"))
    rooted = rooted.join(prefixes, "cid")  # (a prefix is bounded by its set)

    def side(c: str) -> DataFrame:
        return rooted.select("h", F.col("cid").alias(c), *[F.col(x).alias(x + c) for x in ("n", "own", "at", "root", "p")])
    rest_u, rest_v = F.col("nu") - F.col("ownu"), F.col("nv") - F.col("ownv")
    possible = F.least(rest_u, rest_v) * 100 >= (F.greatest(rest_u, rest_v) + F.col("ownu") + F.col("ownv")) * percent
    common = 1 + F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv"))
    possible = possible & (common * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent)
    first = F.col("h") == F.get(F.array_intersect("pu", "pv"), 0)
    return (side("u").join(side("v"), "h").where((F.col("u") < F.col("v")) & (F.col("rootu") != F.col("rootv")) & possible & first)
            .select("u", "v"))


def _text_key(text: Column) -> Column:
    """With its id, what tells a row from others: rows alike in both are copies of one another."""
    return F.xxhash64(text)


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, lower: bool) -> tuple[DataFrame, DataFrame]:
    """(sketch, roots): a row (doc_id, n, cid, t) for each document, and (cid, root) for each class of equal sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("t", _text_key(F.col("text")))
    kind = "doc_id long, n long, cid long, hashes binary, t long"
    sketch = materialize(map_arrow(rows, _sketcher(k, percent, False, lower), kind), "sketch")
    classes = sketch.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    postings = _postings(classes)
    shared_lists = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = materialize(postings.join(shared_lists, "h").select("cid", "n", "h", "df"), "shared")
    least = _k(_ceil_share(F.col("n"), percent))
    status = (shared.groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"),
                                        F.sum((F.col("df") > LIGHT).cast("long")).alias("q"))
              .where(F.col("c") >= least).select("cid", "n", "q", (least - F.col("q") < 2).alias("heavy")))
    status = materialize(status, "status")
    light = materialize(shared.where(F.col("df") <= LIGHT).join(status.select("cid"), "cid", "left_semi").select("cid", "n", "h"), "light")
    lists = light.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    light = light.join(lists.select("h"), "h", "left_semi")
    candidates = materialize(_light_pairs(light, lists, status.select("cid", "q", "heavy"), percent), "candidates")
    heavy = status.where("heavy").select("cid")
    wanted = candidates.select(F.col("u").alias("cid")).union(candidates.select(F.col("v").alias("cid"))).union(heavy).distinct()
    # one document of each wanted class, with or without an id; its whole set is read from its text
    wanted_docs = sketch.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "t")).alias("d")).select("d.doc_id", "d.t").distinct()
    sets = (map_arrow(null_safe_join(rows, wanted_docs, ["doc_id", "t"], "left_semi").select("doc_id", "text", "t"), _sketcher(k, percent, True, lower), kind)
            .groupBy("cid").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")))
    sets = materialize(sets, "sets")
    heavy_lists = materialize(_heavy_lists(sets.join(heavy, "cid", "left_semi"), percent), "heavy")
    links = materialize(_verified(candidates.union(_centre_pairs(heavy_lists)).distinct(), sets, percent), "links")
    roots = materialize(components(links), "roots")
    rest = _verified(_open_pairs(heavy_lists, roots, percent), sets, percent)
    roots = materialize(components(links.union(rest)), "roots")
    named = (sketch.where("n > 0").select("cid").distinct()
             .join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root")))
    return sketch.select("doc_id", "n", "cid", "t"), named


def jaccard_components(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text",
                       lower: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    sketch, roots = _classes(docs, k, percent, id_col, text_col, lower)
    named = sketch.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least")).join(roots, "cid")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "root").select("cid", "component_id")
    full = sketch.where("n > 0").select("doc_id", "n", "cid").join(of_class, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sketch.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (same columns) of each component: that of the least id, ids that are null coming last, and of rows with
    that id the one of the least text digest. Of rows alike in id and text one stays. Rows without words are linked
    with nothing and stay. Unlike texts are never taken for each other because their ids are null or the same."""
    sketch, roots = _classes(docs, k, percent, id_col, text_col, True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    stays = (sketch.where("n > 0").join(roots, "cid").groupBy("root").agg(F.min(order).alias("d"))
             .select(F.col("d.doc_id").alias("__doc"), F.col("d.t").alias("__t")).distinct())
    keyed = docs.withColumn("__key", _text_key(F.col(text_col)))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__t"))
    kept = keyed.where(worded).join(stays, same, "left_semi").dropDuplicates([id_col, "__key"])
    return kept.union(keyed.where(~worded)).drop("__key")
