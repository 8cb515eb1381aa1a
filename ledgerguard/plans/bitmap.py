"""Bitmaps of keys, broadcast so that rows without a partner stay where they are read instead of being shuffled.

A key's hash names a chunk of the bitmap and two bits in it; a row whose bits are not both set has no partner for certain. Of the
others one in about seventy has none either, so a join on the keys themselves decides (``among`` only keeps rows back).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MOST_BITS, CHUNK = 16, 1 << 30, 32768  # 128 MB at most, in chunks of 4 KB
FEWEST = 32  # chunks


@dataclass
class Bitmap:
    chunks: DataFrame  # _of, _bits: 1024 words of 32 bits
    count: int         # of chunks


def _places(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, n).bitwiseAND(F.lit(CHUNK - 1)).cast("int") for n in (15, 30)]


def bitmap_of(keys: DataFrame, column: str, count: int | None = None) -> Bitmap:
    """The bitmap of a column of hashes, read twice unless its ``count`` is given: it should be written or cheap."""
    count, chunks, key = keys.count() if count is None else count, FEWEST, F.col(column)
    while chunks * CHUNK < min(count * BITS_A_KEY, MOST_BITS):
        chunks *= 2
    bits = (keys.where(key.isNotNull()).select(F.pmod(key, F.lit(chunks)).alias("_of"), F.explode(F.array(*[p.cast("long") for p in _places(key)])).alias("_at"))
            .groupBy("_of").agg(F.bitmap_construct_agg("_at").alias("_raw")))
    word = F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 32 - 1)),
                       lambda i: F.conv(F.hex(F.substring(F.col("_raw"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return Bitmap(bits.select("_of", F.transform(word, lambda w: (w - F.when(w >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int")).alias("_bits")), chunks)


def among(df: DataFrame, key: Column, bitmap: Bitmap) -> DataFrame:
    """The rows of ``df`` whose ``key`` (a hash) has its bits set: all that are in the bitmap, and a few more. A semi-join, so
    that Spark moves it down to where a table is read."""
    def held(at: Column) -> Column:  # a word's bytes lie highest first
        return F.getbit(F.get("_bits", F.shiftright(at, 5)), F.lit(24) - at.bitwiseAND(F.lit(24)) + at.bitwiseAND(F.lit(7))) == 1
    one, other = _places(key)
    return df.join(F.broadcast(bitmap.chunks), (F.pmod(key, F.lit(bitmap.count)) == F.col("_of")) & held(one) & held(other), "left_semi")
