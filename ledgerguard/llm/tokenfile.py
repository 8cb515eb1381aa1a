"""Token files: one concatenated id array with Elias-Fano coded document boundaries.

The file is a folder of Parquet parts holding segments. A segment has consecutive documents in ascending
doc_id order (nulls first, ties by text) and these fields:

* ``part``, ``seq``: its place; segments ordered so concatenate to the whole id array;
* ``n_docs``, ``n_tokens``, ``part_start``: tokens of the part before it;
* ``width``, ``ids``: the ids, little-endian unsigned, 2 bytes where the vocabulary fits, else 4;
* ``ends``: Elias-Fano code of the documents' end offsets in the segment;
* ``n_null``, ``first_id``, ``doc_ids``: ids, the same code of doc_id - first_id behind the null ones.

The code of m ascending numbers below u takes about m (2 + log2(u / m)) bits: low bits packed, high bits in
unary with a sample of every ``SAMPLE``-th one's position, from which select(i) starts. No table of 64-bit
offsets is kept; a document's global start is the part's start (a table of one row for each part) plus the
segment's plus a select.

Defined results: a null or empty text is a document with the end id alone; repeated rows are documents of
their own; an empty table gives a file without segments. Texts go to the library whole in effect (see
``tokens``), without added special tokens, truncation or padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerguard.llm import tokens
from ledgerguard.llm.common import map_arrow

SEGMENT_TOKENS = 1_000_000  # a segment is closed when it holds at least so many
SAMPLE = 256
CODE = "struct<count: long, low_bits: int, low: binary, high: binary, samples: binary>"
SEGMENT = (f"part int, seq int, n_docs long, n_tokens long, part_start long, width int, ids binary, ends {CODE}, "
           f"n_null long, first_id long, doc_ids {CODE}")


@dataclass
class EliasFano:
    """Elias-Fano code of ascending numbers (repeats allowed)."""

    count: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        m = len(values)
        if not m:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(math.floor(math.log2(max(1, (int(values[-1]) + 1) // m)))))
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(m)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(m, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number, read from the nearest sample on."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        bits = np.frombuffer(self.high, np.uint8)
        byte, skip = at >> 3, at & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(bits[byte:byte + 64], bitorder="little")[skip:])
            if left < len(ones):
                place = byte * 8 + skip + int(ones[left])
                break
            left -= len(ones)
            byte, skip = byte + 64, 0
        low = np.frombuffer(self.low, np.uint8)
        value = place - i
        for b in range(self.low_bits - 1, -1, -1):
            spot = i * self.low_bits + b
            value = (value << 1) | ((int(low[spot >> 3]) >> (spot & 7)) & 1)
        return value

    def all(self) -> np.ndarray:
        if not self.count:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.count]
        high = (places - np.arange(self.count)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.count * self.low_bits]
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return high + low.reshape(self.count, self.low_bits).astype(np.int64) @ weights

    def row(self) -> dict:
        return {"count": self.count, "low_bits": self.low_bits, "low": self.low, "high": self.high, "samples": self.samples}


_CODE_TYPE = pa.struct([("count", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_SEGMENT_TYPE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("part_start", pa.int64()),
    ("width", pa.int32()), ("ids", pa.binary()), ("ends", _CODE_TYPE), ("n_null", pa.int64()), ("first_id", pa.int64()), ("doc_ids", _CODE_TYPE)])


def _segment(part: int, seq: int, start: int, ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([len(a) for a in arrays])
    known = np.array([i for i in ids if i is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": int(ends[-1]), "part_start": start,
           "width": arrays[0].dtype.itemsize, "ids": np.concatenate(arrays).tobytes(), "ends": EliasFano.of(ends).row(),
           "n_null": len(ids) - len(known), "first_id": first,
           "doc_ids": EliasFano.of(known.view(np.uint64) - np.int64(first).view(np.uint64)).row()}
    return pa.RecordBatch.from_pylist([row], _SEGMENT_TYPE)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load(path)
        end = np.array([end_id], tokenizer.dtype)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids, arrays, held = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            at = 0
            for texts in tokens.runs((t or "" for t in batch.column(1).to_pylist()), tokens.TABLE_CHARS):
                for got in tokenizer.encode(texts):
                    ids.append(doc_ids[at])
                    arrays.append(np.concatenate([got, end]))
                    held += len(arrays[-1])
                    at += 1
                    if held >= SEGMENT_TOKENS:
                        yield _segment(part, seq, start, ids, arrays)
                        seq, start = seq + 1, start + held
                        ids, arrays, held = [], [], 0
        if ids:
            yield _segment(part, seq, start, ids, arrays)
    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the token file to the folder ``out``. Documents are dealt by ranges of
    their id before encoding, so no task holds more than its range and texts are encoded once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_arrow(dealt, _encoder(tokenizer, end_id), SEGMENT).write.option("compression", "zstd").parquet(out)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: tokens of all segments before them. The running sum is over one row for
    each part, and so is the table that is broadcast."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    return segments.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def segment_documents(row: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, starts in the segment, ends, ids) of one segment."""
    ends = EliasFano(**row["ends"]).all()
    values = EliasFano(**row["doc_ids"]).all() + row["first_id"]
    return [None] * row["n_null"] + values.tolist(), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, np.frombuffer(row["ids"], f"<u{row['width']}")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            doc_ids, starts, ends, ids = segment_documents(row)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"], pa.int64()),
                                              pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token file."""
    return map_arrow(read_segments(spark, path), _summaries, "doc_id long, start long, n_tokens long, ids_crc32 long")
