"""Quality rules with host-level verdicts (DataFrame functions only).

Base rules look at one text. Their failures are then aggregated by host, each host's failure rate is
shrunk with a beta prior fitted to all hosts (method of moments), and documents of a host whose shrunk
rate passes ``MAX_HOST_RATE`` are rejected as well. Shrinking keeps a host with three unlucky documents
from being rejected on that evidence alone.

Defined results: a null or empty text has no words and fails (fewer than 20 words); a null host takes no
part in the host step, so its documents keep the base verdict; repeated rows count once per row; an empty
table gives an empty table. Only the named columns are read, so further columns cannot clash.

Windows and lines are compared by 64-bit hashes (windows) and by value (lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import SEPARATORS, bind, heavy_light_join, materialize

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
MAX_HOST_RATE = 0.5


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs without separators. Single-character replacement and splitting avoid
    a regular expression for each word."""
    flat = F.coalesce(text, F.lit(""))
    for ch in SEPARATORS.replace(" ", ""):
        flat = F.replace(flat, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def _tail(values: Column, skip: int) -> Column:
    return F.slice(values, skip + 1, F.greatest(F.size(values) - skip, F.lit(0)))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each 8-word window, in order: hashes of 1, 2, 4 and 8 words, each from two of the
    step before, so a window costs three hash calls instead of eight."""
    def doubled(hashes: Column, by: int) -> Column:
        return bind(hashes, lambda h: F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - by, F.lit(0))), _tail(h, by), lambda a, b: F.xxhash64(a, b)))
    out = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        out = doubled(out, by)
    return out


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur at least twice; sorting brings equal windows together."""
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    positions = bind(tagged, lambda s: F.array_sort(F.transform(
        F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])),
        lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW_WORDS).alias("last"))
    return F.aggregate(
        positions, start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW_WORDS), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    return bind(window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_stats(text: Column) -> Column:
    """Struct of the base counts and the base verdict of one text."""
    # (the struct is bound word list by word list, so a text is split once)
    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"))
    return bind(words_of(text), counts)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, k, shrunk) for each host: ``shrunk`` = (k + a) / (n + a + b) with a beta(a, b) prior whose
    mean is the overall failure rate and whose strength comes from how far host rates spread beyond
    binomial noise. One partial aggregation over the rows, one over the hosts; one row reaches the driver.
    """
    hosts = (rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("k")))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("hosts"),
                      F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    a, b = beta_prior(total["n"] or 0, total["k"] or 0, total["hosts"], total["kk"] or 0.0)
    return hosts.select("host", "n", "k", ((F.col("k") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("shrunk"))


def beta_prior(n: int, k: int, hosts: int, kk: float) -> tuple[float, float]:
    """Method of moments. ``kk`` is the sum of k*k/n over hosts. The spread of host rates around the mean
    m, weighted by rows, is m(1-m) * (r + (1-r) * hosts / n) for a beta prior of strength 1/r - 1."""
    if n == 0:
        return 1.0, 1.0
    mean = min(max(k / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    noise = min(hosts / n, 0.999999)
    spread = (kk / n - (k / n) ** 2) / (mean * (1 - mean))
    r = min(max((spread - noise) / (1 - noise), 0.001), 0.999)
    strength = 1 / r - 1
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, base counts, base_failed, host_rate, kept."""
    stats = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), base_stats(F.col(text_col)).alias("s"))
    stats = materialize(stats.select("doc_id", "host", "s.*", base_failed(F.col("s")).alias("base_failed")), "stats")
    rates = host_rates(stats, "host", "base_failed").select("host", F.col("shrunk").alias("host_rate"))
    judged = heavy_light_join(stats, "host", rates, "host_rate")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= MAX_HOST_RATE))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` (same columns) that pass the base rules and whose host passes. The rules are
    worked out twice, for the host step and for the filter, so that no text is written in between."""
    flagged = docs.withColumn("__failed", base_failed(base_stats(F.col(text_col))))
    rates = host_rates(flagged, host_col, "__failed").select(F.col("host").alias(host_col), F.col("shrunk").alias("__rate"))
    judged = heavy_light_join(flagged, host_col, rates, "__rate")
    good = judged.where(~F.col("__failed") & (F.coalesce("__rate", F.lit(0.0)) <= MAX_HOST_RATE))
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])
