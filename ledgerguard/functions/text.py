"""Scalar and row-shaping helpers (F2, F5, F6, F7, F8, S5, S6) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JSON_OPTS = {"ignoreNullFields": "false"}


def full_name(first: Column, last: Column) -> Column:
    """``FirstName + ' ' + LastName`` with T-SQL NULL propagation (``concat``, not ``concat_ws``)."""
    return F.concat(first, F.lit(" "), last)


def payload_digest(payload: Column) -> list[Column]:
    """payload length in characters and the first 16 hex digits of its SHA-256."""
    return [F.length(payload).alias("chars"), F.substring(F.sha2(payload, 256), 1, 16).alias("sha256")]


def money(c: Column) -> Column:
    """``1,234.56``."""
    return F.format_number(c, 2)


def jsonable(c: Column, dtype: str) -> Column:
    """decimals and dates as text, everything else unchanged."""
    if dtype.startswith("decimal") or dtype in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("string")
    return c


def json_row(df_or_cols, dtypes: dict | None = None) -> Column:
    """One JSON object per row, NULL fields kept."""
    cols = df_or_cols
    return F.to_json(F.struct(*[F.col(c) for c in cols]), JSON_OPTS) if dtypes is None else \
        F.to_json(F.struct(*[jsonable(F.col(c), dtypes[c]).alias(c) for c in cols]), JSON_OPTS)


def cap_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per key in a declared order, plus a ``truncated`` flag. A rank of ``n + 1`` shows
    that a key was cut, so one pass does: Spark limits each group to n + 1 rows map-side (WindowGroupLimit)
    before the shuffle, and no group is ever held whole in one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("row_number", F.row_number().over(w)).where(F.col("row_number") <= n + 1)
    cut = F.max("row_number").over(Window.partitionBy(*keys)) > n
    return top.withColumn("truncated", cut).where(F.col("row_number") <= n)


def rows_json(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """F8: each row as one JSON object with JSON-safe values and its place among the rows of its key, so that
    the rows of a key make a JSON array in that order however many there are."""
    from ledgerguard.plans.ranking import rank_within
    dtypes = dict(df.dtypes)
    obj = F.to_json(F.struct(*[jsonable(F.col(c), dtypes[c]).alias(c) for c in cols]), JSON_OPTS)
    rows = df.select(*keys, obj.alias("row_json"), F.monotonically_increasing_id().alias("_tie"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(cols)])
    ranked = rank_within(rows, keys, [*[f"_o{i}" for i in range(len(cols))], "_tie"], out="row_number")
    return ranked.select(*keys, "row_number", "row_json")
