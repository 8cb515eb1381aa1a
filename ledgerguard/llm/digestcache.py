"""Token counts through a digest cache.

A text's key is the SHA-256 of its content (null as empty) after the tokenizer's own normalisation, and a
count is stored under that key and the tokenizer's version digest (its file and its library). Texts whose
key is stored are not encoded; of the others each distinct text is encoded once and its count appended. A
count is looked up by an ordinary join; keys with very many copies (at most 1000, so a bounded table) are
joined by broadcast.

Normalisation: the stored models leave content as it is (no character map, spaces kept), so the normalised
content is the content; a model with a lossy normalisation may pass a column function of its own.

Defined results: null and empty texts count 0; repeated rows give a row each; an empty table gives an empty
table; the cache folder may be missing or hold other versions or the same key twice (two writers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.llm import tokens
from ledgerguard.llm.common import heavy_light_join, map_arrow, materialize

CACHE = "version string, key binary, n_tokens long"


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(key, n_tokens) stored for a tokenizer version; no rows where nothing was ever stored."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("key").agg(F.min("n_tokens").alias("n_tokens"))


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load(path)
        for batch in batches:
            counts: list[int] = []
            for texts in tokens.runs(batch.column("text").to_pylist()):
                counts += tokenizer.count(texts) if hasattr(tokenizer, "count") else [len(x) for x in tokenizer.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64())], ["key", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. New counts are appended to ``cache``."""
    spark = docs.sparkSession
    version = tokens.version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.col("text"), 256)))
    keys = materialize(keyed.select("doc_id", "n_bytes", "key"), "keys")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))  # copies are put together before they are dealt by key
    misses = texts.join(stored_counts(spark, cache, version), "key", "left_anti")
    new = map_arrow(misses.select("key", "text"), _counter(tokenizer), "key binary, n_tokens long")
    new.select(F.lit(version).alias("version"), "key", "n_tokens").write.mode("append").parquet(cache)
    counted = heavy_light_join(keys, "key", stored_counts(spark, cache, version), "n_tokens")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
