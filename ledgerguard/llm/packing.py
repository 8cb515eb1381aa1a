"""Packing of token pieces into sequences by minimum bin slack.

Documents are encoded and cut into pieces of at most ``capacity`` tokens (a longer document's first piece
takes the remainder, all others are full). Which pieces go together depends only on how many pieces there
are of each length, so the plan is made from that table (at most ``capacity`` rows, whatever the input):
per bin the longest length left is taken and a bitset subset-sum over the lengths still available finds the
fullest feasible filling of the rest; that combination is used as often as the lengths allow and removed.

Pieces then learn their places without any of them passing through one task: a piece's number among those
of its length is its task's running count plus the counts of the tasks before (one row for each task and
length), and the plan maps length and number to sequence and offset.

Defined results: a null or empty text is one piece with the end id; repeated rows are packed each; an empty
table gives no rows. No sequence is longer than ``capacity``; offsets of a sequence leave no gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerguard.llm import tokens
from ledgerguard.llm.common import map_arrow, materialize

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load(path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            at = 0
            for texts in tokens.runs((t or "" for t in batch.column(1).to_pylist()), tokens.TABLE_CHARS):
                rows: list[tuple] = []
                end = np.array([end_id], "<u4")
                for ids in tokenizer.encode(texts):
                    wide = np.concatenate([ids, end], dtype="<u4")
                    for i, (start, length) in enumerate(cuts(len(wide), capacity)):
                        rows.append((doc_ids[at], i, start, length, zlib.crc32(wide[start:start + length].tobytes()), part, seen[length]))
                        seen[length] += 1
                    at += 1
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])
    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``: bit s of ``reach`` says
    that sum s can be made. Longer lengths come first and the search ends once the room can be filled, so
    of equal sums it takes one with long pieces."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # blocks of 1, 2, 4, ... pieces stand for any number of them
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces in each bin)])] that use up ``counts``."""
    left = {x: c for x, c in counts.items() if c}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // m for x, m in chosen.items())
        plan.append((times, sorted(chosen.items(), reverse=True)))
        for x, m in chosen.items():
            left[x] -= times * m
            if not left[x]:
                del left[x]
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> list[tuple[np.ndarray, ...] | None]:
    """For each length: first number, first sequence, pieces in a bin and offset of its stretches of the plan."""
    stretches: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    used = [0] * (capacity + 1)
    sequence = 0
    for times, items in plan:
        offset = 0
        for length, m in items:
            stretches[length].append((used[length], sequence, m, offset))
            used[length] += times * m
            offset += length * m
        sequence += times
    return [tuple(np.array(c, np.int64) for c in zip(*s)) if s else None for s in stretches]


def _placer(plan: list, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(plan, capacity)
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, m, place = places[x]
                i = np.searchsorted(first, number[at], "right") - 1
                nth = number[at] - first[i]
                sequence[at] = base[i] + nth // m[i]
                offset[at] = place[i] + nth % m[i] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(map_arrow(rows, _cutter(tokenizer, end_id, capacity), PIECES), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["c"] for r in by_task.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    plan = plan_bins(counts, capacity)
    numbered = pieces.join(before, ["part", "length"]).withColumn("number", F.col("number") + F.col("before")).drop("before")
    return map_arrow(numbered, _placer(plan, capacity),
                     "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
