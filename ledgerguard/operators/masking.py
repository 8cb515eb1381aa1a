"""Masking, unmasking, egress guard and leak scan over DataFrames.

Flow of ``mask_cells`` (the core of M3/M4/M5/G1):

1. detect spans per cell in-row (the policy's regex detectors + the session's known values joined by session
   id + spans found elsewhere, such as names), resolve overlaps in-row; a classified cell is one whole-cell span;
2. explode spans to occurrences ``(row id, session, entity, norm, value, pos)`` with ``pos`` = (row order,
   column order, -start): right-to-left inside a text, row by row, column by column; written once to the shared
   folder, so detection runs once and no text is stored;
3. number first appearances per (session, entity) -> vault (continuing an existing vault);
4. hand occurrences their tokens, regroup per row id, left-join to the texts and rebuild. Without an earlier vault, all of this
   but the last join is done in one exchange by session (very large sessions apart).

No row is ever lost: the row id is a 128-bit digest of the row's keys, session, order and text, so repeated
rows and rows that share a key are masked each by their own spans; a null session is a session of its own;
and the last step is a left join of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.operators.vault import VAULT_COLUMNS, assign_tokens, known_struct, number_sessions, session_values, vault_of
from ledgerguard.plans.bitmap import among, bitmap_of
from ledgerguard.plans.ranking import HOT, null_safe_join
from ledgerguard.session import spread, written
from ledgerguard.sources.policy import DEFAULT, Policy

KNOWN = "array<struct<value:string,entity:string,pattern:string,plain:string>>"
TOKENS = "array<struct<_c:int,_i:int,start:int,end:int,entity:string,token:string>>"


@dataclass
class Masked:
    cells: DataFrame      # input columns + masked text + pii_counts
    vault: DataFrame      # session_id, entity, norm, value, n, token


def row_id(*cols: Column) -> Column:
    """128-bit digest of values, nulls told apart."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def detected_spans(text, known=None, extra=None, policy: Policy = DEFAULT):
    """Raw (unresolved) spans of a text column: the policy's regex detectors, then known values, then extra
    spans (names)."""
    parts = []
    if policy.detectors.regex:
        parts.append(S.all_regex_spans(text, policy.detectors.regex))
    if known is not None and policy.detectors.known_values:
        parts.append(S.known_spans(text, known))
    if extra is not None and policy.detectors.names:
        parts.append(F.coalesce(extra, F.array().cast(S.SPANS)))
    if not parts:
        return F.array().cast(S.SPANS)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def counts_map(spans) -> F.Column:
    """entity -> number of spans (MaskResult.counts)."""
    ents = F.array_distinct(F.transform(spans, lambda s: s["entity"]))
    return F.map_from_entries(F.transform(ents, lambda e: F.struct(
        e.alias("key"), F.size(F.filter(spans, lambda s: s["entity"] == e)).alias("value"))))


def mask_cells(cells: DataFrame, keys: list[str], order: list[str], text_col: str = "text",
               entity_col: str | None = None, col_idx_col: str | None = None, session_col: str = "session_id",
               known_values: DataFrame | None = None, vault: DataFrame | None = None,
               extra_spans_col: str | None = None, out_col: str = "masked", policy: Policy = DEFAULT) -> Masked:
    """Mask one text per row. ``order`` gives the tokenization order of rows within a session; ``entity_col``
    (optional) classifies a whole cell; ``col_idx_col`` orders cells of one source row; ``extra_spans_col``
    holds spans of other detectors. Every input row gives one output row."""
    text = F.col(text_col)
    identity = list(dict.fromkeys([*keys, *order, session_col, text_col, *[c for c in (entity_col, col_idx_col) if c]]))
    c = spread(cells.withColumn("_rid", row_id(*[F.col(x) for x in identity])), "_rid")
    occ = _occurrences(c, order, text_col, entity_col, col_idx_col, session_col, known_values, extra_spans_col, policy)
    tokens, tok = _tokens_of_rows(occ, vault)
    out = c.join(tok, F.col("_rid") == F.col("_tok_rid"), "left")
    out = out.withColumn("_tok", F.coalesce("_tok", F.array().cast(TOKENS)))
    out = (out.withColumn(out_col, F.when(text.isNull(), F.lit("")).otherwise(S.rebuild(text, F.col("_tok"))))
           .withColumn("pii_counts", counts_map(F.col("_tok")))
           .drop("_rid", "_tok_rid", "_tok"))
    return Masked(out, tokens)


def _occurrences(c: DataFrame, order: list[str], text_col: str, entity_col: str | None, col_idx_col: str | None, session_col: str,
                 known_values: DataFrame | None, extra_spans_col: str | None, policy: Policy) -> DataFrame:
    """Steps 1 and 2: the resolved spans of the cells ``c`` (``_rid``: the row that a cell is of), one row each, written."""
    text = F.col(text_col)
    found = c.withColumn("_session", F.col(session_col))
    extra = F.col(extra_spans_col) if extra_spans_col else None
    # ASCII texts that need nothing but the detectors and plain known values are searched many at a time in Arrow batches
    by_batch = entity_col is None and S.portable(policy)
    easy = S.is_ascii(F.coalesce(text, F.lit(""))) if by_batch else F.lit(False)
    if extra is not None and policy.detectors.names:
        easy = easy & (F.coalesce(F.size(extra), F.lit(0)) <= 0)
    known = None
    if known_values is not None and policy.detectors.known_values:
        kn = session_values(known_values, policy).withColumnRenamed("session_id", "_known_session")
        found = found.join(kn, F.col("_session") == F.col("_known_session"), "left")
        easy = easy & (F.col("known_values").isNull() | (F.col("searchable") & S.simple_text(text)))
    found = found.withColumn("_easy", easy)
    if known_values is not None and policy.detectors.known_values:  # patterns are made for the other texts only
        full = F.transform("known_values", lambda v: known_struct(v["value"], v["entity"]))
        found = found.withColumn("_full", F.when(~F.col("_easy"), full))
        known = F.coalesce(F.col("_full"), F.array().cast(KNOWN))
    # Raw spans get their own projection: resolve() reads them more than once and higher-order functions
    # are not covered by subexpression elimination, so an inlined detector would run twice per row.
    raw = detected_spans(text, known, extra, policy)
    if entity_col is not None:
        raw = F.when(F.col(entity_col).isNull(), raw).otherwise(F.array().cast(S.SPANS))
    found = found.withColumn("_raw", F.when(~F.col("_easy"), raw))
    spans = S.resolve(text, F.col("_raw"), policy)
    if entity_col is not None:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).cast("int").alias("end"),
                                 F.col(entity_col).alias("entity"), F.lit("column").alias("source"),
                                 F.lit(0).alias("rank")))
        spans = (F.when(F.col(entity_col).isNotNull() & text.isNotNull(), whole)
                 .when(F.col(entity_col).isNotNull(), F.array().cast(S.SPANS)).otherwise(spans))
    cidx = F.col(col_idx_col) if col_idx_col else F.lit(0)
    pos = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], cidx.cast("int").alias("c"))
    places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"),
                                                   S.span_text(text, s).alias("said")))
    kept = ["_rid", F.col("_session").alias("session_id"), pos.alias("_at")]
    # values are tidied in columns of their own, not inside the array: compiled code, each step once
    if by_batch:
        values = [F.col("known_values")] if known is not None else []
        sent = found.select(*kept, text.alias("_text"), *values, F.when(~F.col("_easy"), places).alias("_given"))
        occ = S.spans_by_batch(sent, len(kept), known is not None, policy)
        value = F.coalesce("value", S.display_value(F.col("said")))
    else:
        occ = found.select(*kept, F.posexplode(places).alias("_i", "s")).select("_rid", "session_id", "_at", "_i", "s.*")
        occ, value = occ.withColumn("norm", F.lit(None).cast("string")), S.display_value(F.col("said"))
    occ = occ.select("_rid", "session_id", "_at", "_i", "start", "end", "entity", value.alias("value"), "norm")
    occ = occ.withColumn("norm", F.coalesce("norm", S.casefold(F.col("value"))))
    return written(occ, "occurrences")


def _tokens_of_rows(occ: DataFrame, vault: DataFrame | None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Steps 3 and 4: the vault, and the tokens of each row (``_tok_rid``) in the order of cells and places. Occurrences meet
    once, by session, and are numbered and handed their tokens there; those of sessions with more than ``hot`` of them, and all
    if there is a vault to go on from, are numbered by ``assign_tokens`` and joined to it."""
    placed = occ.withColumn("pos", F.struct("_at", (-F.col("start")).alias("_neg")))
    if vault is not None:
        return _tokens_by_join(placed, vault)
    large = occ.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("session_id")
    large = written(large, "hot-sessions")
    numbered = number_sessions(null_safe_join(placed, F.broadcast(large), ["session_id"], "left_anti"))
    tokens, tok = vault_of(numbered), _by_row(numbered, "session_id")
    if not large.isEmpty():
        more, tok_more = _tokens_by_join(null_safe_join(placed, F.broadcast(large), ["session_id"], "left_semi"), None)
        tokens, tok = tokens.unionByName(more), tok.unionByName(tok_more)
    return tokens, tok


def _by_row(occ: DataFrame, *session: str) -> DataFrame:
    """The tokens of each row. A row is of one session, so grouping by the session too lets rows stay where it is."""
    return (occ.groupBy(*session, F.col("_rid").alias("_tok_rid"))
            .agg(F.sort_array(F.collect_set(F.struct(F.col("_at.c").alias("_c"), "_i", "start", "end", "entity", "token"))).alias("_tok"))
            .select("_tok_rid", "_tok"))


def _tokens_by_join(placed: DataFrame, vault: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    tokens = assign_tokens(placed.select("session_id", "entity", "norm", "value", "pos"), vault)
    return tokens, _by_row(null_safe_join(placed, tokens.select("session_id", "entity", "norm", "token"), ["session_id", "entity", "norm"]))


def mask_text(df: DataFrame, text_col: str, keys: list[str], order: list[str] | None = None,
              session_col: str = "session_id", known_values: DataFrame | None = None,
              vault: DataFrame | None = None, out_col: str | None = None, extra_spans_col: str | None = None,
              policy: Policy = DEFAULT) -> Masked:
    """M4: mask a free-text column; NULL/'' -> ''."""
    return mask_cells(df, keys, order or keys, text_col=text_col, session_col=session_col, known_values=known_values,
                      vault=vault, out_col=out_col or "masked", extra_spans_col=extra_spans_col, policy=policy)


def mask_errors(df: DataFrame, text_col: str, keys: list[str], limit: int, session_col: str = "session_id",
                policy: Policy = DEFAULT) -> Masked:
    """M5: error lines masked with the fast detector set: ``masked`` in full, and ``error_text``, its first ``limit``
    characters (masked first, then cut, so a cut value cannot survive)."""
    m = mask_text(df, text_col, keys, session_col=session_col, policy=policy.fast())
    return Masked(m.cells.withColumn("error_text", F.substring("masked", 1, limit)), m.vault)


def mask_rows(df: DataFrame, column_types: dict[str, str], keys: list[str], order: list[str] | None = None,
              session_col: str = "session_id", known_values: DataFrame | None = None,
              vault: DataFrame | None = None, policy: Policy = DEFAULT) -> Masked:
    """M3: classified cells -> token of ``str(value)``; other string cells -> free-text masking; numbers,
    dates, booleans and NULLs pass through. Key columns are cells like any other; only the session column is
    left as it is. Cells are melted to (row, column) where they are read, in one distributed pass; only their spans
    are shuffled, and each row gets its tokens back by row id. Equal rows have equal spans, so they need no removal."""
    order = order or keys
    dtypes = dict(df.dtypes)
    targets = [c for c in df.columns if c != session_col and (c in column_types or dtypes[c] == "string")]
    if not targets:  # nothing to mask: numbers and dates only
        none = df.select(F.lit(None).cast("long").alias("session_id"), *[F.lit(None).cast("long" if c == "n" else "string").alias(c) for c in VAULT_COLUMNS[1:]])
        return Masked(df.withColumn("pii_counts", F.create_map().cast("map<string,int>")), none.where(F.lit(False)) if vault is None else vault)
    marked = df.withColumn("_rid", row_id(*[F.col(f"`{c}`") for c in df.columns]))
    places = [f"_order{i}" for i in range(len(order))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.col(c).cast("string").alias("text"),
                                         F.lit(column_types.get(c)).cast("string").alias("cell_entity"))
                                for i, c in enumerate(df.columns) if c in targets]))
    melted = marked.select("_rid", *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)], F.col(session_col).alias("_of"), cells.alias("x"))
    melted = spread(melted.select("_rid", *places, "_of", "x.*").where(F.col("text").isNotNull()), "_rid")
    occ = _occurrences(melted, places, "text", "cell_entity", "col_idx", "_of", known_values, None, policy)
    tokens, tok = _tokens_of_rows(occ, vault)
    out = marked.join(tok, F.col("_rid") == F.col("_tok_rid"), "left").withColumn("_tok", F.coalesce("_tok", F.array().cast(TOKENS)))

    def masked(i: int, c: str) -> Column:
        tokens_of_cell = F.filter("_tok", lambda t: t["_c"] == i)
        said = F.col(f"`{c}`").cast("string")
        if c in column_types:  # one span, the whole cell
            return F.when(said.isNotNull(), tokens_of_cell[0]["token"]).alias(c)
        cell = F.transform(F.array(tokens_of_cell), lambda own: S.rebuild(said, own))[0]  # filtered once, read often
        return F.when(said.isNotNull(), cell).alias(c)

    cols = [masked(i, c) if c in targets else F.col(f"`{c}`") for i, c in enumerate(df.columns)]
    return Masked(out.select(*cols, counts_map(F.col("_tok")).alias("pii_counts")), tokens)


def unmask(df: DataFrame, text_col: str, keys: list[str], vault: DataFrame, session_col: str = "session_id",
           out_col: str = "unmasked", policy: Policy = DEFAULT) -> DataFrame:
    """M6: tokens back to values when the policy shows the entity, ``[REDACTED]`` when not; tokens unknown to
    the session's vault stay as written. Every input row gives one output row. The rows, which hold tokens, are written
    once: their tokens are looked up in one pass and put back in another."""
    shown = [e for e, r in policy.shown.items() if r]
    text = F.col(text_col)
    marked = written(spread(df.withColumn("_rid", row_id(F.col(session_col), text)), "_rid"), "to-unmask")  # equal texts of a session unmask alike
    toks = marked.select("_rid", F.col(session_col).alias("session_id"),
                         F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.TOKEN_PATTERN), F.lit(0)))
                         .alias("_i", "token"))
    j = null_safe_join(toks, vault.select("session_id", "token", "value", "entity"), ["session_id", "token"], "left")
    repl = (F.when(F.col("value").isNull(), F.col("token"))
            .when(F.col("entity").isin(*shown), F.col("value")).otherwise(F.lit(P.REDACTED)))
    per_row = (j.groupBy(F.col("_rid").alias("_of")).agg(F.sort_array(F.collect_set(F.struct("_i", repl.alias("r")))).alias("_r")))
    out = marked.join(per_row, F.col("_rid") == F.col("_of"), "left")
    reps = F.transform(F.coalesce(F.col("_r"), F.array().cast("array<struct<_i:int,r:string>>")), lambda x: x["r"])
    return out.withColumn(out_col, F.when(text.isNull(), F.lit(None))
                          .otherwise(S.interleave_replace(text, P.TOKEN_PATTERN, reps))).drop("_r", "_rid", "_of")


def guard(df: DataFrame, text_col: str, keys: list[str], session_col: str = "session_id",
          known_values: DataFrame | None = None, vault: DataFrame | None = None, policy: Policy = DEFAULT,
          mode: str | None = None):
    """Re-scan outgoing text with the fast detector set (regex + known values, no names).
    ``mask``: returns masked text and findings per row. ``block``: returns (passed, blocked) where blocked
    rows carry entity counts only, never values. ``mode`` defaults to the policy's."""
    mode = mode or policy.exit.mode
    if mode not in ("mask", "block"):
        raise ValueError("guard mode must be 'mask' or 'block'")
    m = mask_text(df, text_col, keys, session_col=session_col, known_values=known_values, vault=vault,
                  out_col="guarded", policy=policy.fast())
    out = m.cells.withColumnRenamed("pii_counts", "findings")
    if mode == "mask":
        return out, m.vault
    hit = F.size("findings") > 0
    passed = out.where(~hit).drop("guarded", "findings")
    blocked = out.where(hit).select(*keys, "findings")
    return passed, blocked


def _tasks(df: DataFrame) -> int:
    """A number of tasks that work on small but costly rows is dealt over: given as a number, it is kept."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def value_keys(values: DataFrame, value_col: str) -> DataFrame:
    """``values`` with ``key``: the hash of all words of a value of up to ``S.GRAM`` words, else of the run of so many words
    that the fewest values hold. A text that holds the value holds these words one behind the other (``S.grams``). Values
    without words have no key and drop out."""
    folded = values.withColumn("_words", S.folded_words(F.col(value_col))).where(F.size("_words") > 0)
    short = folded.where(F.size("_words") <= S.GRAM).withColumn("key", F.get(S.grams_at("_words", F.lit(0)), F.size("_words") - 1)).drop("_words")
    n = F.size("_words")
    of_size = F.slice(S.grams("_words"), n + n, n - 2)  # behind the n single words and the n - 1 pairs
    runs = folded.where(n > S.GRAM).select(*values.columns, F.explode(of_size).alias("key"))
    often = runs.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (runs.join(often, "key").groupBy(*values.columns).agg(F.min(F.struct("_n", "key")).alias("_k"))
              .select(*values.columns, F.col("_k.key").alias("key")))
    return short.unionByName(rarest)


FEW_VALUES = 1_000_000  # keys that are broadcast as they are (some tens of MB at most); of more, a bitmap


def text_keys(texts: DataFrame, text_col: str, keys: list[str], keyed: DataFrame) -> DataFrame:
    """``keys`` of the texts with each ``key`` of ``keyed`` among their runs of words, once. Runs that are no key stay where
    they are: the keys are broadcast, or of many keys a bitmap of their hashes (it lets some others through). The runs are
    hashed one word after the other, in compiled code, and told apart only if they may be keys; texts that are dealt by
    ``keys`` need no exchange for it."""
    distinct = keyed.select("key").distinct()
    count = distinct.count()
    words = texts.select(*keys, S.folded_words(F.col(text_col)).alias("_words"))
    runs = (words.select(*keys, "_words", F.posexplode("_words").alias("_i", "_word"))
            .select(*keys, F.explode(S.grams_at("_words", F.col("_i"))).alias("key")).where(F.col("key").isNotNull()))
    if count <= FEW_VALUES:
        kept = runs.join(F.broadcast(distinct), "key", "left_semi")
    else:
        kept = among(runs, F.col("key"), bitmap_of(distinct, "key", count))
    return kept.select(*keys, "key").distinct()


def leak_scan(texts: DataFrame, text_col: str, keys: list[str], values: DataFrame,
              shortest: int = P.KNOWN_VALUE_MIN_LENGTH) -> DataFrame:
    """Every (text row, entity, value) where a known PII value appears in a text, case-insensitively
    on word boundaries. ``values(value, entity)`` may hold every customer's values.

    Blocked join instead of values x texts: each value is keyed by all its words (of a long one, by its rarest run of
    three), texts by their runs of one to three words; only (text, value) pairs that share a key are verified with the
    value's regex on the text. So a word that many values hold, or that is in each text, makes no pairs. The texts are
    shuffled once, by ``keys``, and both sides of the last join read that shuffle."""
    v = (values.where(F.col("value").isNotNull())
         .select(S.display_value(F.col("value")).alias("value"), "entity")
         .where(F.length("value") >= shortest)
         .repartition(_tasks(values), "value", "entity").distinct().withColumn("plain", S.searchable(F.col("value"))))
    keyed = value_keys(written(v, "values"), "value")  # written: filters on words would move to the few tasks that read
    texts = texts.select(*keys, text_col).repartition(*keys)
    cand = text_keys(texts, text_col, keys, keyed).join(keyed, "key").select(*keys, "value", "entity", "plain")  # a value has one key: each once
    read = texts.withColumn("_low", S.between_spaces(F.col(text_col))).withColumn("_simple", S.simple_text(F.col(text_col)))
    pairs = read.join(cand, keys)
    return pairs.where(S.holds(text_col, "_low", "_simple", F.col("value"), F.col("plain"))).select(*keys, "entity", "value")
