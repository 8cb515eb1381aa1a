"""ledgerguard: contract receivables analytics and PII governance on Spark DataFrames.

Sub-packages
    sources    typed inputs (driver parquet -> contract tables, policy) and sinks (audit, JSON rows)
    functions  column expressions (regex patterns, span extraction, normalisation, formatting)
    operators  DataFrame -> DataFrame jobs (contract answers, data quality, detection, vault, masking)
    plans      the registry of named queries and their DuckDB oracle SQL
    streaming  Structured Streaming versions of masking, audit and the session vault
"""

from ledgerguard.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
