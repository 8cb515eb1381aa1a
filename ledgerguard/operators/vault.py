"""The token vault as tables: known values and value<->token assignments per session.

``known_values(session_id, norm, value, entity, reg_order)`` – values to find in free text (T1, W5).
``vault(session_id, entity, norm, value, n, token)`` – stable tokens ``<ENTITY_n>`` (T2-T5).

Token identity is (entity, whitespace-collapsed lower-cased value); the stored display value is the first
one seen; numbers are handed out per (session, entity) in order of first appearance. Numbering uses
``rank_within`` so a session that spans a whole corpus is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions.spans import display_value, known_value_pattern, normalize_value, plain_value, searchable
from ledgerguard.plans.ranking import null_safe_join, rank_within
from ledgerguard.session import by_key
from ledgerguard.sources.policy import DEFAULT, Policy

VAULT_COLUMNS = ("session_id", "entity", "norm", "value", "n", "token")


PROFILE_PART = 1 << 18  # bytes of profiles, each row of which becomes eight values, for a task


def register_known(profiles: DataFrame, session_col: str = "session_id", order_col: str | None = None) -> DataFrame:
    """Profile rows -> known values. Blank values are skipped; the full name ``FirstName + ' ' +
    LastName`` is added when both parts are non-empty; per (session, norm) the first registration wins
    (profile row order, then column order). Few tasks read the profiles, so rows are dealt before they become values, and
    values before they are grouped, as nearly each is a group of its own."""
    profiles = by_key(profiles, *dict.fromkeys([session_col, *[c for c, _ in P.PROFILE_TYPES]]), part=PROFILE_PART)
    cols = [c for c, _ in P.PROFILE_TYPES]
    order = F.col(order_col) if order_col else F.lit(0)
    full = F.when((F.trim(F.col("FirstName")) != "") & (F.trim(F.col("LastName")) != ""),
                  F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")))
    entries = [F.struct(F.col(c).cast("string").alias("raw"), F.lit(e).alias("entity"), F.lit(i).alias("col_idx"))
               for i, (c, e) in enumerate(P.PROFILE_TYPES)]
    entries.append(F.struct(full.alias("raw"), F.lit("PERSON").alias("entity"), F.lit(len(cols)).alias("col_idx")))
    x = (profiles.select(F.col(session_col).alias("session_id"), order.alias("_row"), F.explode(F.array(*entries)).alias("e"))
         .where(F.col("e.raw").isNotNull() & (F.trim(F.regexp_replace(F.col("e.raw"), r"(?U)\s+", " ")) != ""))
         .select("session_id", "_row", "e.col_idx", "e.entity", display_value(F.col("e.raw")).alias("value"),
                 normalize_value(F.col("e.raw")).alias("norm")))
    first = F.min(F.struct("_row", "col_idx", "value", "entity")).alias("f")
    return (by_key(x, "session_id", "norm", part=PROFILE_PART).groupBy("session_id", "norm").agg(first)
            .select("session_id", "norm", F.col("f.value").alias("value"), F.col("f.entity").alias("entity"),
                    F.struct("f._row", "f.col_idx").alias("reg_order")))


def known_values_ranked(kv: DataFrame) -> DataFrame:
    """Per session, longest value first (ties: registration order)."""
    w = Window.partitionBy("session_id").orderBy(F.length("value").desc(), "reg_order")
    return kv.withColumn("rank", F.row_number().over(w))


def _usable(kv: DataFrame, policy: Policy) -> DataFrame:
    return kv.where(F.length("value") >= policy.detectors.shortest_known)


def known_struct(value: Column, entity: Column) -> Column:
    """A known value with what the detector needs to find it (``spans.known_spans``)."""
    return F.struct(value.alias("value"), entity.alias("entity"), known_value_pattern(value).alias("pattern"), plain_value(value).alias("plain"))


def session_known(kv: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Known values usable by the detector (long enough for the policy), one array per session: a session's
    registered profile values, which are few. Whole customer bases belong into ``masking.leak_scan``."""
    known = F.collect_list(known_struct(F.col("value"), F.col("entity")))
    return _usable(kv, policy).groupBy("session_id").agg(known.alias("known"))


def session_values(kv: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The same values as they are (``known_values``), and whether plain search finds all of a session (``searchable``)."""
    values = F.collect_list(F.struct("value", "entity"))
    return _usable(kv, policy).groupBy("session_id").agg(values.alias("known_values"), F.bool_and(searchable(F.col("value"))).alias("searchable"))


def assign_tokens(occ: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """``occ(session_id, entity, norm, value, pos)`` -> vault rows. ``pos`` is any orderable
    column giving first appearance; values already in ``vault`` keep their tokens and new ones continue
    each (session, entity) counter."""
    first = (occ.groupBy("session_id", "entity", "norm")
             .agg(F.min(F.struct(F.col("pos").alias("p"), F.col("value").alias("v"))).alias("f"))
             .select("session_id", "entity", "norm", F.col("f.p").alias("first_pos"), F.col("f.v").alias("value")))
    keys = ["session_id", "entity", "norm"]
    if vault is not None:
        first = null_safe_join(first, vault.select(*keys), keys, "left_anti")
        base = vault.groupBy("session_id", "entity").agg(F.max("n").alias("_base"))
    ranked = rank_within(first, ["session_id", "entity"], ["first_pos"], out="_rank")
    if vault is not None:
        ranked = null_safe_join(ranked, base, ["session_id", "entity"], "left")
        n = F.coalesce(F.col("_base"), F.lit(0)) + F.col("_rank")
    else:
        n = F.col("_rank")
    new = ranked.select("session_id", "entity", "norm", "value", n.cast("long").alias("n"))
    new = new.withColumn("token", F.concat(F.lit("<"), F.col("entity"), F.lit("_"), F.col("n").cast("string"), F.lit(">")))
    if vault is None:
        return new
    return vault.select(*VAULT_COLUMNS).unionByName(new)


def number_sessions(occ: DataFrame) -> DataFrame:
    """``occ`` (as for ``assign_tokens``, without an earlier vault) with ``first`` (the value's place and wording of first
    appearance), ``n`` and ``token`` of each occurrence. All of it is done where a session's occurrences meet, in one exchange by
    session: sessions must be small enough for a task (``ranking.HOT``)."""
    keys = ["session_id", "entity"]
    first = F.min(F.struct(F.col("pos").alias("p"), F.col("value").alias("v"))).over(Window.partitionBy(*keys, "norm"))
    n = F.dense_rank().over(Window.partitionBy(*keys).orderBy("first.p", "norm")).cast("long")
    return (occ.repartition("session_id").withColumn("first", first).withColumn("n", n)
            .withColumn("token", F.concat(F.lit("<"), F.col("entity"), F.lit("_"), F.col("n").cast("string"), F.lit(">"))))


def vault_of(numbered: DataFrame) -> DataFrame:
    """The vault rows of ``number_sessions``."""
    return (numbered.groupBy("session_id", "entity", "norm").agg(F.min("first.v").alias("value"), F.min("n").alias("n"), F.min("token").alias("token"))
            .select(*VAULT_COLUMNS))


def token_lookup(vault: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(session_id, token)`` -> value, NULL when the token is not in the vault."""
    return null_safe_join(requests, vault.select("session_id", "token", "value"), ["session_id", "token"], "left")


def vault_summary(vault: DataFrame, kv: DataFrame | None = None) -> DataFrame:
    """T4: counts only, never values."""
    s = vault.groupBy("session_id").agg(F.count(F.lit(1)).alias("tokens"),
                                        F.countDistinct("entity").alias("entity_types"))
    if kv is not None:
        s = s.join(kv.groupBy("session_id").agg(F.count(F.lit(1)).alias("known_values")), "session_id", "full_outer")
    return s

