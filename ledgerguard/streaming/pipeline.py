"""Structured Streaming: masked turns (ST1), the session vault with an idle TTL as keyed state (ST2) and an
append-only audit sink (ST3), all reading ``conversations`` as a file stream.

* ST1 ``stream_mask``: ``foreachBatch`` runs the batch masking job on each micro-batch. Each batch writes the tokens it
  gave to the shared folder; neighbouring folders are merged level by level, so batch n reads one folder for each bit
  of n. It reads batches before n only, so a replayed batch sees what it saw the first time, gives the same tokens,
  and overwrites its own outputs.
* ST2 ``stream_vault``: ``transformWithStateInPandas`` keyed by session. Spans are detected JVM-side before the state
  step, which gets numbers and spans only and hands out tokens; texts stay where they are, and ``masked_turns`` joins
  them with the decisions. Its clock (``vault_clock``) holds any time that Spark's timestamps do. A session ends by an idle TTL (event-time timer) or by an event of role ``close``; a use
  after that fails closed (``error``), a turn that the watermark left out comes as ``late``. The mark of an ended
  session goes after ``FORGET_MS``; a later use then starts a session without any old token.
  No value is stored in clear: tokens are looked up by keyed digest, values are written encrypted (AES-GCM) by a key
  made of the deployment's secret and a nonce in the session's state. The end of a session destroys the nonce, and
  with it all that was encrypted; versions of the state older than ``KEEP_VERSIONS`` are cleared by Spark's maintenance.
* ST3 ``stream_audit``: stateless per-turn records (length, digest, findings) to an append JSON sink.

A stream runs until all files present are done (``availableNow``); a caller that bounds the wait gets an error,
never a part of the result. Event time for the turns is derived from the table: turn ``t`` of conversation
``c`` happens at ``2024-01-01 + c days + t * 25 min * (1 + c % 4)``, so some sessions idle past the TTL.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import StreamingQueryException

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.functions.text import payload_digest
from ledgerguard.operators import masking as M
from ledgerguard.operators.audit import NOT_ASKED, with_event_time, with_notes
from ledgerguard.plans.ranking import null_safe_join
from ledgerguard.session import checkpoint_dir, scratch_path, written
from ledgerguard.sources.policy import DEFAULT, Policy

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
VAULT_SCHEMA = "session_id long, entity string, norm string, value string, n long, token string"


class StreamNotFinished(RuntimeError):
    """A bounded wait ended before the stream had read all its files."""


def read_stream(spark: SparkSession, sf_dir: str, name: str = "conversations",
                schema: T.StructType = CONVERSATION_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """File stream over a table, stored as one Parquet file or as a folder of part files (written as a glob,
    which Spark lists either way)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def asked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in the files that are there now."""
    return written(spark.read.schema(CONVERSATION_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/[c]onversations.parquet").select("conv_id").distinct(), "asked")


def noted_stream(spark: SparkSession, sf_dir: str, notes: DataFrame | None, files_per_batch: int | None) -> DataFrame:
    """The turns as a stream, with their notes. Notes are made for the conversations of the files that are there; files that
    come between that look and the stream's start are told by ``NOT_ASKED`` (``_finish``)."""
    asked = asked_conversations(spark, sf_dir) if notes is not None else None
    return with_notes(read_stream(spark, sf_dir, files_per_batch=files_per_batch), notes, asked)


def _finish(start, wait_s: float | None = None) -> None:
    """Run the stream that ``start`` starts. If it met conversations that came after their list was made, it goes on from its
    checkpoint with a new list."""
    while True:
        try:
            return _run(start(), wait_s)
        except StreamingQueryException as e:
            if f"[USER_RAISED_EXCEPTION] {NOT_ASKED}" not in str(e):  # as raised: the plan, which is in each message, names it too
                raise


def _run(query, wait_s: float | None = None) -> None:
    """Wait for the stream to end by itself; its failure is raised here. After ``wait_s``, if given, it is
    stopped and ``StreamNotFinished`` is raised."""
    try:
        done = query.awaitTermination(wait_s) if wait_s else query.awaitTermination() or True
    finally:
        query.stop()
    if not done:
        raise StreamNotFinished(f"the stream was stopped after {wait_s} s with input left")


# --- ST1 ----------------------------------------------------------------------------------------
def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, where = _file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(where)


def level_folder(vault_dir: str, start: int, level: int) -> str:
    """The tokens of the batches start .. start + 2**level - 1."""
    return f"{vault_dir}/level={level}/from={start}"


def cover(n: int) -> list[tuple[int, int]]:
    """(start, level) of the fewest aligned folders that hold batches 0 .. n-1: one for each bit of n."""
    out, start = [], 0
    for level in range(n.bit_length() - 1, -1, -1):
        if n >> level & 1:
            out.append((start, level))
            start += 1 << level
    return out


def held_folders(vault_dir: str, start: int, level: int, complete) -> list[str]:
    """The folder of these batches; one that was not merged to the end (its writer was lost) is read by its halves. A
    missing batch is an error when it is read, since its tokens are in use."""
    folder = level_folder(vault_dir, start, level)
    if level == 0 or complete(folder):
        return [folder]
    return [f for at in (start, start + (1 << (level - 1))) for f in held_folders(vault_dir, at, level - 1, complete)]


def write_level(df: DataFrame, folder: str) -> None:
    """Tokens, sorted by session so that a read for some sessions skips most of them."""
    df.repartitionByRange(F.col("session_id")).sortWithinPartitions("session_id").write.mode("overwrite").parquet(folder)


def merge_levels(spark: SparkSession, vault_dir: str, batch_id: int) -> None:
    """After a batch: two neighbouring folders of a level become one of the next, as in adding one to a binary
    number. Each token is written once for each level, so log2(batches) times. Doing it again gives the same."""
    end, level = batch_id + 1, 1
    while end % (1 << level) == 0:
        start = end - (1 << level)
        halves = [f for at in (start, start + (1 << (level - 1))) for f in held_folders(vault_dir, at, level - 1, lambda f: _complete(spark, f))]
        write_level(spark.read.schema(VAULT_SCHEMA).parquet(*halves), level_folder(vault_dir, start, level))
        level += 1


def drop_merged(spark: SparkSession, vault_dir: str, batch_id: int) -> None:
    """When a batch begins, the one before it is committed and never comes again: the halves of the folders that it
    completed are read by nobody from now on."""
    level = 1
    while batch_id and batch_id % (1 << level) == 0:
        start = batch_id - (1 << level)
        if _complete(spark, level_folder(vault_dir, start, level)):
            for at in (start, start + (1 << (level - 1))):
                fs, where = _file_system(spark, level_folder(vault_dir, at, level - 1))
                fs.delete(where, True)
        level += 1


def earlier_vault(spark: SparkSession, vault_dir: str, batch_id: int, sessions: DataFrame) -> DataFrame | None:
    """Tokens that batches before ``batch_id`` gave to the sessions of this one."""
    if batch_id == 0:
        return None
    folders = [f for start, level in cover(batch_id) for f in held_folders(vault_dir, start, level, lambda f: _complete(spark, f))]
    vault = spark.read.schema(VAULT_SCHEMA).parquet(*folders)
    return null_safe_join(vault, sessions.select("session_id").distinct(), ["session_id"], "left_semi")


def mask_batch(batch: DataFrame, batch_id: int, out_dir: str, known_values: DataFrame | None = None, policy: Policy = DEFAULT) -> None:
    spark, vault_dir = batch.sparkSession, f"{out_dir}/vault"
    drop_merged(spark, vault_dir, batch_id)
    turns = batch.withColumn("session_id", F.col("conv_id"))
    vault = earlier_vault(spark, vault_dir, batch_id, turns)
    m = M.mask_text(turns, "text", ["conv_id", "turn"], ["turn"], known_values=known_values, vault=vault, policy=policy)
    new = m.vault if vault is None else null_safe_join(m.vault, vault.select("session_id", "entity", "norm"),
                                                       ["session_id", "entity", "norm"], "left_anti")
    write_level(new, level_folder(vault_dir, batch_id, 0))
    m.cells.select("conv_id", "turn", "masked").write.mode("overwrite").parquet(f"{out_dir}/rows/batch={batch_id}")
    merge_levels(spark, vault_dir, batch_id)


def stream_mask(spark: SparkSession, sf_dir: str, out_dir: str | None = None, notes: DataFrame | None = None,
                known_values: DataFrame | None = None, policy: Policy = DEFAULT, files_per_batch: int | None = None,
                wait_s: float | None = None) -> str:
    out_dir = out_dir or scratch_path(spark, "stream-mask")
    _finish(lambda: (noted_stream(spark, sf_dir, notes, files_per_batch)
                     .writeStream.foreachBatch(lambda batch, i: mask_batch(batch, i, out_dir, known_values, policy.fast()))
                     .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start()), wait_s)
    return f"{out_dir}/rows"


# --- ST3 ----------------------------------------------------------------------------------------
def audit_stream_records(stream: DataFrame) -> DataFrame:
    raw = stream.withColumn("_raw", S.all_regex_spans(F.col("text")))
    spans = S.resolve(F.col("text"), F.col("_raw"))
    chars, sha = payload_digest(F.coalesce(F.col("text"), F.lit("")))
    return raw.select("conv_id", "turn", "role", chars, sha, F.size(spans).alias("findings"))


def stream_audit(spark: SparkSession, sf_dir: str, out_dir: str | None = None, notes: DataFrame | None = None,
                 files_per_batch: int | None = None, wait_s: float | None = None) -> str:
    out_dir = out_dir or scratch_path(spark, "stream-audit")
    _finish(lambda: (audit_stream_records(noted_stream(spark, sf_dir, notes, files_per_batch)).writeStream.format("json").outputMode("append")
                     .option("path", f"{out_dir}/records").option("checkpointLocation", f"{out_dir}/_checkpoint")
                     .trigger(availableNow=True).start()), wait_s)
    return f"{out_dir}/records"


AUDIT_STREAM_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("chars", T.IntegerType()), T.StructField("sha256", T.StringType()),
    T.StructField("findings", T.IntegerType())])


# --- ST2 ----------------------------------------------------------------------------------------
_TTL_MS = P.VAULT_TTL_SECONDS * 1000
FORGET_MS = 30 * 86_400_000
CLOSE = "close"  # the role of an event that ends a session
CLOCK = 1000  # milliseconds of event time in one of the vault's clock
KEEP_VERSIONS = 2  # versions of the state that are kept, so that a key is gone soon after its session

_TOKENS = "array<struct<start:int,end:int,token:string>>"
_NEW = "array<struct<token:string,entity:string,value:string>>"
DECISION_SCHEMA = (f"conv_id long, turn long, row long, status string, reason string, tokens {_TOKENS}, "
                   "vault array<struct<token:string,entity:string,sealed:binary>>")
VAULT_OUT = f"conv_id long, turn long, row long, status string, reason string, tokens {_TOKENS}, new {_NEW}, key binary"
_OUT = ["conv_id", "turn", "row", "status", "reason", "tokens", "new", "key"]

OK, ERROR, LATE = "ok", "error", "late"
EXPIRED, CLOSED = "expired", "closed"


def session_key(secret: bytes, nonce: bytes) -> bytes:
    """The data key of a session. Without the nonce, which lives in the session's state only, nobody has it again."""
    return hmac.new(secret, nonce, hashlib.sha256).digest()


try:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class SessionVault(StatefulProcessor):
        """Per-session vault with idle TTL (event time) and a close event; uses after either fail closed.

        State: a random nonce that makes the session's data key, the session's tokens by keyed digest of what they
        stand for, a counter for each type, and the time of the last use. Values are in no state: a token's value goes
        out with the row that made it, to be encrypted before it is written. Texts never come in here."""

        def __init__(self, secret: bytes, ttl_ms: int = _TTL_MS) -> None:
            self.secret, self.ttl_ms = secret, ttl_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.nonce = handle.getValueState("nonce", "nonce binary")
            self.tokens = handle.getMapState("tokens", "digest binary", "token string")
            self.counters = handle.getMapState("counters", "entity string", "n long")
            self.last_use = handle.getValueState("last_use", "ms long")
            self.ended = handle.getValueState("ended", "reason string")

        def _end(self, reason: str, now_ms: int) -> None:
            """Destroy the key and forget all tokens; remember that the session is over, and forget that too later on."""
            for state in (self.nonce, self.tokens, self.counters, self.last_use):
                state.clear()
            self.ended.update((reason,))
            self._timer(now_ms + FORGET_MS)

        def _timer(self, at_ms: int) -> None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-at_ms // CLOCK))

        def _key(self) -> bytes:
            if not self.nonce.exists():
                self.nonce.update((os.urandom(32),))
            return session_key(self.secret, bytes(self.nonce.get()[0]))

        def _token(self, key: bytes, span, new: list) -> str:
            digest = hmac.new(key, f"{span['entity']}\x1f{span['norm']}".encode(), hashlib.sha256).digest()
            if self.tokens.containsKey((digest,)):
                return self.tokens.getValue((digest,))[0]
            entity = span["entity"]
            n = (self.counters.getValue((entity,))[0] if self.counters.containsKey((entity,)) else 0) + 1
            self.counters.updateValue((entity,), (n,))
            token = f"<{entity}_{n}>"
            self.tokens.updateValue((digest,), (token,))
            new.append({"token": token, "entity": entity, "value": span["value"]})
            return token

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            """A session's events of a batch in the order of their time: numbers and spans only, no texts."""
            events = sorted(((int(r.ms), r.kind == CLOSE, int(r.turn), int(r.row), r.conv_id, r.spans) for part in rows for r in part.itertuples(index=False)),
                            key=lambda e: e[:4])
            out, last = [], self.last_use.get()[0] if self.last_use.exists() else None
            for ms, closes, turn, row, conv_id, spans in events:
                reason = self.ended.get()[0] if self.ended.exists() else None
                if reason is None and last is not None and ms - last > self.ttl_ms:
                    reason = EXPIRED
                    self._end(reason, last + self.ttl_ms)
                if closes:
                    if reason is None:
                        self._end(CLOSED, ms)
                    continue
                if reason is not None:
                    out.append((conv_id, turn, row, ERROR, reason, None, None, None))
                    continue
                last = ms
                self.last_use.update((last,))
                spans = [] if spans is None else list(spans)
                if not spans:
                    out.append((conv_id, turn, row, OK, None, [], [], None))
                    continue
                data_key, new = self._key(), []
                right_to_left = sorted(spans, key=lambda s: -s["start"])  # the order in which tokens are given
                done = [{"start": int(s["start"]), "end": int(s["end"]), "token": self._token(data_key, s, new)} for s in right_to_left]
                out.append((conv_id, turn, row, OK, None, done[::-1], new, data_key if new else None))
            if last is not None and not self.ended.exists():
                self._timer(last + self.ttl_ms)
            for at in range(0, len(out), 10_000):
                yield pd.DataFrame(out[at:at + 10_000], columns=_OUT)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.ended.exists():
                self.ended.clear()
            else:
                self._end(EXPIRED, expiredTimerInfo.getExpiryTimeInMs() * CLOCK)
            yield pd.DataFrame([], columns=_OUT)

        def close(self) -> None:
            pass
except ImportError:             # older PySpark: ST2 unavailable
    SessionVault = None


def turn_row(df: DataFrame) -> DataFrame:
    """``row``: a digest that tells rows of one turn apart by their text."""
    return df.withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))


def vault_clock(ts: Column) -> Column:
    """The event time by which the vault's watermark and timers go: ``CLOCK`` times slower since 1970. All columns of the state
    step pass through pandas, whose nanoseconds end in 2262; any timestamp of Spark, so slowed, lies before that."""
    return F.timestamp_micros(F.unix_millis(ts))


def vault_delay(spark: SparkSession, lateness: str) -> str:
    """``lateness`` (an interval) by the vault's clock, rounded up."""
    ms = spark.sql("SELECT unix_millis(timestamp_seconds(0) + CAST(:late AS INTERVAL)) AS ms", {"late": lateness}).first()["ms"]
    return f"{-(-ms // CLOCK)} milliseconds"


def session_events(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, row, kind, clock, ms, spans) of turns (conv_id, turn, role, text, ts, clock): what the vault needs to know."""
    with_vals = F.transform(S.resolve(F.col("text"), F.col("_raw")), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"),
        S.display_value(S.span_text(F.col("text"), s)).alias("value"),
        S.normalize_value(S.span_text(F.col("text"), s)).alias("norm")))
    found = turn_row(turns).withColumn("_raw", F.when(F.col("role") == CLOSE, F.array().cast(S.SPANS)).otherwise(S.all_regex_spans(F.col("text"))))
    kind = F.when(F.col("role") == CLOSE, F.lit(CLOSE)).otherwise(F.lit("turn"))
    return found.select("conv_id", "turn", "row", kind.alias("kind"), "clock", F.unix_millis("ts").alias("ms"), with_vals.alias("spans"))


def seal(decided: DataFrame) -> DataFrame:
    """The new tokens' values encrypted by their session's key (AES-GCM); the key itself goes no further."""
    sealed = F.transform(F.col("new"), lambda v: F.struct(v["token"].alias("token"), v["entity"].alias("entity"),
                                                          F.aes_encrypt(v["value"].cast("binary"), F.col("key"), F.lit("GCM")).alias("sealed")))
    return decided.select("conv_id", "turn", "row", "status", "reason", "tokens", sealed.alias("vault"))


def stream_vault(spark: SparkSession, sf_dir: str, out_dir: str | None = None, notes: DataFrame | None = None,
                 lateness: str = "1 hour", files_per_batch: int | None = None, wait_s: float | None = None,
                 secret: bytes | None = None, closes: Column | None = None) -> str:
    """Run the keyed vault over the turns and give the folder of its decisions; ``masked_turns`` puts them to the
    texts, ``reveal`` opens the values of sessions that still live.

    ``secret``: the key of this deployment, kept outside of all folders; without one, a new secret is drawn and the
    values can be opened by nobody. ``closes``: a condition on a turn after which its session is closed, for sources
    whose turns carry no event of role ``close``. ``lateness``: how far a turn may lie behind the latest one seen, over
    all sessions; the vault takes no part in later ones, which come out as ``late``."""
    checkpoint_dir(spark)
    # The processor runs in Python workers that may not have this package on their path: pickle this
    # module's classes and functions by value (the processor only uses pandas and the constants above).
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out_dir = out_dir or scratch_path(spark, "stream-vault")
    secret, delay = secret or os.urandom(32), vault_delay(spark, lateness)

    def start():
        turns = with_event_time(noted_stream(spark, sf_dir, notes, files_per_batch))
        if closes is not None:
            at_once = F.struct(F.lit(CLOSE).alias("role"), F.lit(None).cast("string").alias("text"), F.col("ts"))
            own = F.struct("role", "text", "ts")
            turns = (turns.withColumn("_events", F.when(closes, F.array(own, at_once)).otherwise(F.array(own)))
                     .select("conv_id", "turn", F.explode("_events").alias("_e")).select("conv_id", "turn", "_e.*"))
        timed = turns.withColumn("clock", vault_clock(F.col("ts"))).withWatermark("clock", delay)
        decided = session_events(timed).groupBy("conv_id").transformWithStateInPandas(
            statefulProcessor=SessionVault(secret), outputStructType=VAULT_OUT, outputMode="Append", timeMode="EventTime")
        q = (seal(decided).writeStream.format("parquet").outputMode("append").option("path", f"{out_dir}/rows")
             .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True))
        # settings of the session; they are put back once the query has started with its own
        own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.minBatchesToRetain": str(KEEP_VERSIONS)}
        before = {k: spark.conf.get(k, None) for k in own}
        for k, v in own.items():
            spark.conf.set(k, v)
        try:
            return q.start()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v else spark.conf.unset(k)

    _finish(start, wait_s)
    return f"{out_dir}/rows"


def masked_turns(turns: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, turn, masked, status): the turns with their tokens in place. A turn that the vault has not decided on
    came too late (``late``); it is never shown, nor is one of an ended session (``error``)."""
    best = F.max_by(F.struct("status", "tokens"), F.col("status") == OK).alias("_d")
    known = decisions.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("row").alias("_r")).agg(best)
    rows = turn_row(turns)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("row") == F.col("_r"))
    status = F.coalesce(F.col("_d.status"), F.lit(LATE))
    masked = F.when(status == OK, S.rebuild(F.col("text"), F.col("_d.tokens")))
    return rows.join(known, same, "left").select("conv_id", "turn", masked.alias("masked"), status.alias("status"))


def live_keys(spark: SparkSession, out_dir: str, secret: bytes) -> DataFrame:
    """(session_id, key) of the sessions whose key has not been destroyed, from the newest version of the state."""
    states = (spark.read.format("statestore").option("path", f"{out_dir}/_checkpoint").option("stateVarName", "nonce").load())
    # HMAC-SHA256(secret, nonce) in functions of Spark: two hashes over the padded secret
    block = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    pads = [bytes(b ^ p for b in block.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(F.lit(pads[0]), F.col("value.nonce")), 256))
    return states.select(F.col("key.conv_id").alias("session_id"), F.unhex(F.sha2(F.concat(F.lit(pads[1]), inner), 256)).alias("key"))


def reveal(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """(session_id, token, entity, value) of all tokens given; ``value`` is null where the session's key is gone."""
    entries = decisions.select(F.col("conv_id").alias("_s"), F.explode("vault").alias("v"))
    opened = F.try_aes_decrypt(F.col("v.sealed"), F.col("key"), F.lit("GCM")).cast("string")
    return (entries.join(keys, F.col("_s") == F.col("session_id"), "left")
            .select(F.col("_s").alias("session_id"), "v.token", "v.entity", F.when(F.col("key").isNotNull(), opened).alias("value")))
