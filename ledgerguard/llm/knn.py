"""Nearest neighbours by a block matrix join over int8 tiles with proven error bounds.

Vectors are grouped into blocks; every query block meets every candidate block once (a tile). A tile
quantises its vectors to int8 (one scale for each vector), gets all inner products from one integer-valued
matrix product and bounds the error of each by |q||c - c'| + |q - q'||c'|. A pair whose upper bound is below
the k-th largest lower bound of its query cannot be among the nearest; the others are recomputed in double
precision, added left to right. Each query keeps a heap of k along the candidate blocks of a task, which
also sharpens the bound, and the heaps of all tasks are merged at the end.

A task holds one query block and one candidate block at a time. The result is exact: scores are those of
the original vectors, ties go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows
with a null id; vectors meet those of their own length only; fewer than k candidates give fewer rows; a row is no
candidate of its own id. Rows that share an id are vectors of their own: each may appear among the nearest of others,
and each that is a query has its own k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import map_arrow, materialize

BLOCK = 2048  # vectors in a block
GROUPS = 8  # candidate blocks are dealt to so many tasks for each query block
_SLACK = 1e-5  # relative slack for the rounding of the bounds themselves


def _usable(vector: Column) -> Column:
    """Non-empty, finite, without nulls, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def _blocker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector, is_query) rows -> blocks of BLOCK rows of one length: ids and double vectors as bytes."""
    held: dict[tuple[bool, int], tuple[list, list]] = {}

    def block(key, ids, rows):
        return pa.RecordBatch.from_pylist([{"is_query": key[0], "dim": key[1], "n": len(ids),
                                            "ids": np.array(ids, np.int64).tobytes(), "vectors": np.concatenate(rows).astype("<f8").tobytes()}],
                                          pa.schema([("is_query", pa.bool_()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))
    for batch in batches:
        vectors = batch.column("v")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for id_, query, end, size in zip(batch.column("id").to_pylist(), batch.column("q").to_pylist(), ends.tolist(), sizes.tolist()):
            for key in ((False, size), (True, size))[:2 if query else 1]:
                ids, rows = held.setdefault(key, ([], []))
                ids.append(id_)
                rows.append(flat[end - size:end])
                if len(ids) == BLOCK:
                    yield block(key, ids, rows)
                    del held[key]
    for key, (ids, rows) in held.items():
        yield block(key, ids, rows)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale of each row, length of each row's rounding error)."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a row of tiny numbers whose scale vanished: its error is its length
    whole = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return whole, scale, np.sqrt(((x - whole * scale[:, None]) ** 2).sum(axis=1))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 products summed exactly: slices of at most 1024 dimensions stay below 2^24 in float32."""
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], 1024):
        out += a[:, at:at + 1024].astype(np.float32) @ b[:, at:at + 1024].astype(np.float32).T
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added left to right, the same for equal rows anywhere."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _joiner(k: int):
    def survivors(q, qn, c, cn, floor, own):
        q8, qs, qe = q
        c8, cs, ce = c
        near = tile_products(q8, c8) * qs[:, None] * cs[None, :]
        size8 = np.sqrt((c8.astype(np.float64) ** 2).sum(axis=1)) * cs
        error = qn[:, None] * ce[None, :] + qe[:, None] * size8[None, :]
        error += _SLACK * (qn[:, None] * cn[None, :])
        low = np.where(own, -np.inf, near - error)  # rows of the query's own id are no candidates, however many there are
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        return np.nonzero((near + error >= floor[:, None]) & ~own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heaps = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                key = at["block"].as_py()
                if key != now:
                    if heaps is not None:
                        yield _heap_rows(now, ids, heaps)
                    now, dim = key, at["dim"].as_py()
                    ids = np.frombuffer(at["q_ids"].as_buffer(), np.int64)
                    q = np.frombuffer(at["q_vectors"].as_buffer(), "<f8").reshape(-1, dim)
                    qq, qn = quantise(q), np.sqrt((q ** 2).sum(axis=1))
                    heaps = [[] for _ in ids]
                c_ids = np.frombuffer(at["c_ids"].as_buffer(), np.int64)
                c = np.frombuffer(at["c_vectors"].as_buffer(), "<f8").reshape(-1, dim)
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                i, j = survivors(qq, qn, quantise(c), np.sqrt((c ** 2).sum(axis=1)), floor, ids[:, None] == c_ids[None, :])
                scores = exact_products(q[i], c[j])
                for a, s, b in zip(i.tolist(), scores.tolist(), c_ids[j].tolist()):
                    heap = heaps[a]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -b))
                    elif (s, -b) > heap[0]:
                        heapq.heapreplace(heap, (s, -b))
        if heaps is not None:
            yield _heap_rows(now, ids, heaps)
    return run


def _heap_rows(block: int, ids: np.ndarray, heaps: list[list[tuple[float, int]]]) -> pa.RecordBatch:
    rows = [(block, i, int(q), -b, s) for i, (q, heap) in enumerate(zip(ids, heaps)) for s, b in heap]
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))],
                                      ["block", "row", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product, from all other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("q", F.coalesce("q", F.lit(False)))
    blocks = map_arrow(rows, _blocker, "is_query boolean, dim int, n int, ids binary, vectors binary")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    queries = blocks.where("is_query").select("block", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    names = queries.groupBy("dim").agg(F.collect_list("block").alias("meets"))  # block numbers only: a row for BLOCK queries
    candidates = (blocks.where("not is_query").join(names, "dim")
                  .select(F.explode("meets").alias("block"), F.pmod(F.xxhash64("block"), F.lit(GROUPS)).alias("part"),
                          F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors")))
    parts = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))).alias("part"))
    count = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = candidates.join(parts, ["block", "part"]).repartition(count, "block", "part").sortWithinPartitions("block", "part")
    best = map_arrow(tiles, _joiner(k), "block long, row int, query_id long, vec_id long, score double")
    merged = best.groupBy("block", "row", "query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("vec_id"), F.col("score"))).alias("all"))
    # (a query is a row: rows that share an id are queries each); at most k rows from each of a query's GROUPS tasks, so the list is bounded
    ranked = merged.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
