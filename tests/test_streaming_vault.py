"""The keyed session vault: order, expiry, close, late turns, keys and what lies in its folders."""
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerguard.streaming import pipeline as SP

SECRET = b"a secret of this deployment"
# Event time of turn t of conversation c: c days and t * 25 min * (1 + c % 4); sessions idle out after an hour.
FILES = [
    [(4, 0, "user", "mail Ada@Host.example please"), (4, 1, "assistant", "wrote to ada@host.example and bo@host.example"), (8, 0, "user", "call 555-0142"),
     (5, 0, "user", "card 4111 1111 1111 1111")],
    [(4, 2, "user", "again bo@host.example"), (4, 2, "close", None), (4, 3, "user", "after the close: zed@host.example"), (8, 1, "user", "or 555-0143"),
     (8, 1, "user", "or 555-0143"), (5, 3, "user", "idle for too long: 555-0199")],
    [(40, 0, "user", "a later day, xi@host.example")],
    [(44, 0, "user", "nothing here")],
    [(6, 0, "user", "late: yo@host.example"), (44, 1, "assistant", "in time: 555-0177")],
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("conv")
    folder = root / "conversations.parquet"
    folder.mkdir()
    for i, rows in enumerate(FILES):
        part = str(root / f"part{i}")
        spark.createDataFrame(rows, SP.CONVERSATION_SCHEMA).coalesce(1).write.parquet(part)
        (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
        target = folder / f"{i}.parquet"
        target.write_bytes(open(os.path.join(part, name), "rb").read())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    return str(root)


@pytest.fixture(scope="module")
def ran(spark, source, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("vault") / "out")
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")  # so that a scan of the files sees what is in them
    try:
        SP.stream_vault(spark, source, out, files_per_batch=1, secret=SECRET)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
    return out


def decisions(spark, out):
    return spark.read.schema(SP.DECISION_SCHEMA).parquet(f"{out}/rows")


def test_decisions(spark, source, ran):
    turns = spark.read.parquet(f"{source}/conversations.parquet").where(F.col("role") != SP.CLOSE)
    got = [(r.conv_id, r.turn, r.masked, r.status) for r in SP.masked_turns(turns, decisions(spark, ran)).collect()]
    assert sorted(got, key=str) == sorted([
        (4, 0, "mail <EMAIL_1> please", "ok"), (4, 1, "wrote to <EMAIL_1> and <EMAIL_2>", "ok"), (4, 2, "again <EMAIL_2>", "ok"), (4, 3, None, "error"),
        (8, 0, "call <PHONE_1>", "ok"), (8, 1, "or <PHONE_2>", "ok"), (8, 1, "or <PHONE_2>", "ok"), (5, 0, "card <CREDIT_CARD_1>", "ok"), (5, 3, None, "error"),
        (40, 0, "a later day, <EMAIL_1>", "ok"), (44, 0, "nothing here", "ok"), (44, 1, "in time: <PHONE_1>", "ok"), (6, 0, None, "late")], key=str)
    reasons = {(r.conv_id, r.turn): r.reason for r in decisions(spark, ran).where("status = 'error'").collect()}
    assert reasons == {(4, 3): SP.CLOSED, (5, 3): SP.EXPIRED}


def _files(root):
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".zip"):
                with zipfile.ZipFile(path) as z:
                    for inner in z.namelist():
                        yield f"{path}!{inner}", z.read(inner)
            else:
                with open(path, "rb") as f:
                    yield path, f.read()


def test_no_value_lies_in_clear_in_any_file(spark, ran):
    values = [v.encode() for v in ("host.example", "555-014", "555-0177", "4111", "Ada@", "zed@", "yo@")]
    seen = list(_files(ran))
    assert len(seen) > 10 and not [(path, v) for path, raw in seen for v in values if v.lower() in raw.lower()]
    for state in ("nonce", "tokens", "counters", "last_use", "ended"):  # the state's own files may be compressed: read them as tables, too
        rows = spark.read.format("statestore").option("path", f"{ran}/_checkpoint").option("stateVarName", state).load().collect()
        assert not any(v.decode().lower() in str(rows).lower() for v in values)


def test_values_open_for_live_sessions_only(spark, ran):
    opened = {(r.session_id, r.token): r.value for r in SP.reveal(decisions(spark, ran), SP.live_keys(spark, ran, SECRET)).collect()}
    assert set(opened) >= {(4, "<EMAIL_1>"), (4, "<EMAIL_2>"), (8, "<PHONE_1>"), (44, "<PHONE_1>")}
    assert opened[44, "<PHONE_1>"] == "555-0177"
    assert opened[4, "<EMAIL_1>"] is None and opened[4, "<EMAIL_2>"] is None  # closed
    assert opened[5, "<CREDIT_CARD_1>"] is None and opened[8, "<PHONE_1>"] is None  # idle for too long
    other = SP.reveal(decisions(spark, ran), SP.live_keys(spark, ran, b"another secret")).collect()
    assert not any(r.value for r in other)


def test_the_key_in_sql_is_the_key_of_the_state(spark, ran):
    nonces = spark.read.format("statestore").option("path", f"{ran}/_checkpoint").option("stateVarName", "nonce").load()
    want = {r["key"]["conv_id"]: SP.session_key(SECRET, bytes(r["value"]["nonce"])) for r in nonces.collect()}
    assert want and {r.session_id: bytes(r.key) for r in SP.live_keys(spark, ran, SECRET).collect()} == want


def test_a_second_run_goes_on_where_the_first_ended(spark, source, ran):
    before = decisions(spark, ran).count()
    SP.stream_vault(spark, source, ran, files_per_batch=1, secret=SECRET)
    assert decisions(spark, ran).count() == before


def test_a_bounded_wait_is_an_error(spark, source, tmp_path):
    with pytest.raises(SP.StreamNotFinished):
        SP.stream_vault(spark, source, str(tmp_path / "o"), files_per_batch=1, wait_s=0.2, secret=SECRET)


def test_times_beyond_the_years_of_pandas(spark, tmp_path):
    """Conversations whose days lie after 2262 and after 9999: decided, expired, closed and late as any others."""
    at = 87_000, 150_000, 3_000_000
    files = [[(c + i, t, r, x) for c in at[:n + 1] for i, t, r, x in rows] for n, rows in enumerate((
        [(4, 0, "user", "mail ada@host.example"), (5, 0, "user", "call 555-0142"), (5, 3, "user", "too long: 555-0199")],
        [(44, 0, "user", "card 4111 1111 1111 1111"), (44, 0, "close", None), (44, 1, "user", "closed")],
        [(48, 0, "user", "call 555-0143")], [(52, 0, "user", "call 555-0144")]))]
    folder = tmp_path / "conversations.parquet"
    folder.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SP.CONVERSATION_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
        (name,) = [n for n in os.listdir(tmp_path / f"p{i}") if n.endswith(".parquet")]
        (folder / f"{i}.parquet").write_bytes((tmp_path / f"p{i}" / name).read_bytes())
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    out = f"{tmp_path}/out"
    SP.stream_vault(spark, str(tmp_path), out, files_per_batch=1, secret=SECRET)
    turns = spark.read.parquet(str(folder)).where(F.col("role") != SP.CLOSE)
    got = {(r.conv_id, r.turn): (r.masked, r.status) for r in SP.masked_turns(turns, decisions(spark, out)).collect()}
    first, later, last = at
    assert got[first + 4, 0] == ("mail <EMAIL_1>", "ok") and got[first + 5, 0] == ("call <PHONE_1>", "ok") and got[first + 5, 3] == (None, "error")
    assert got[later + 44, 0] == ("card <CREDIT_CARD_1>", "ok") and got[later + 44, 1] == (None, "error")
    assert got[last + 48, 0] == got[last + 52, 0] == ("call <PHONE_1>", "ok") and got[first + 52, 0] == (None, "late")
    opened = {(r.session_id, r.token): r.value for r in SP.reveal(decisions(spark, out), SP.live_keys(spark, out, SECRET)).collect()}
    assert opened[last + 52, "<PHONE_1>"] == "555-0144" and opened[last + 48, "<PHONE_1>"] is None and opened[later + 44, "<CREDIT_CARD_1>"] is None and opened[first + 4, "<EMAIL_1>"] is None


def test_a_failure_of_another_kind_is_raised(spark, tmp_path, monkeypatch):
    """Its message holds the plan, which names the marker of conversations that came late."""
    spark.createDataFrame([(1, 0, "user", "hi")], SP.CONVERSATION_SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    notes = spark.createDataFrame([(1, "call 555-0001")], "ContractId long, note string")
    runs, real = [], SP._run

    def once(query, wait_s=None):
        runs.append(query)
        assert len(runs) == 1
        return real(query, wait_s)

    monkeypatch.setattr(SP, "_run", once)
    fails = notes.withColumn("note", F.raise_error(F.lit("a broken note")))
    with pytest.raises(SP.StreamingQueryException, match="a broken note"):
        SP.stream_audit(spark, str(tmp_path), f"{tmp_path}/out", notes=fails)
