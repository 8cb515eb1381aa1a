"""Registry of this subpackage: query name -> builder, and the SQL it is checked against."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.llm import alignment, chat, digestcache, jaccard, knn, merkle, packing, passages, pii, quality, revisits, tokenfile, unigram
from ledgerguard.llm.common import materialize, scratch, table
from ledgerguard.llm.oracles import ORACLES


WORD_BPE, BYTE_BPE, PIECE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_elias_fano_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), out, WORD_BPE, end_id=1)
    return tokenfile.read_summaries(spark, out)


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.withColumn("headers", text)


def op3_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_rules(table(spark, sf_dir, "documents")).drop("host")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # (a cache of its own, so that every text is a miss once and the whole work is done)
    return digestcache.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE, scratch(spark, "counts"), limit=4096)


def op7_int8_tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


def op9_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_conversations(materialize(chat.format_conversations(turns.unionByName(planted)), "chat"))


def op12_path_copying_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(table(spark, sf_dir, "documents")).verify()


def op13_inverted_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES = {f.__name__: f for f in (
    op1_elias_fano_token_file,
    op2_revisit_resolution,
    op3_collinear_passages,
    op4_host_quality_rules,
    op5_ngram_jaccard_join,
    op6_digest_cache_counts,
    op7_int8_tile_neighbours,
    op8_minimum_bin_slack,
    op9_semi_markov_pii,
    op10_unigram_viterbi,
    op11_grammar_round_trip,
    op12_path_copying_manifest,
    op13_inverted_pair_bitmaps)}
QUERIES["pipeline"] = corpus_pipeline.run


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
