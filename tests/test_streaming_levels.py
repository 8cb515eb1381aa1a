"""ST1: levelled vault folders and replayed batches."""
import os

import pytest
from pyspark.sql import functions as F

from ledgerguard.streaming import pipeline as SP


@pytest.mark.parametrize("n", range(0, 300, 7))
def test_a_batch_reads_one_folder_for_each_bit(n):
    parts = SP.cover(n)
    assert [b for start, level in parts for b in range(start, start + 2 ** level)] == list(range(n))
    assert len(parts) == bin(n).count("1") <= max(1, n.bit_length()) and all(start % 2 ** level == 0 for start, level in parts)


def _tokens(spark, i):
    return spark.createDataFrame([(i % 3, "EMAIL", f"v{i}", f"V{i}", i, f"<EMAIL_{i}>")], SP.VAULT_SCHEMA)


def _seen(spark, vault, n):
    sessions = spark.createDataFrame([(0,), (1,), (2,)], "session_id long")
    got = SP.earlier_vault(spark, vault, n, sessions)
    return [] if got is None else sorted(r.n for r in got.collect())


def test_levels_hold_every_batch_once(spark, tmp_path):
    vault = str(tmp_path / "vault")
    for i in range(11):
        for _ in range(2 if i in (3, 7) else 1):  # replayed after its merge
            SP.drop_merged(spark, vault, i)
            assert _seen(spark, vault, i) == list(range(i))
            SP.write_level(_tokens(spark, i), SP.level_folder(vault, i, 0))
            SP.merge_levels(spark, vault, i)
    left = sorted(os.path.relpath(d, vault) for d, _, names in os.walk(vault) if "_SUCCESS" in names)
    assert left == ["level=0/from=10", "level=1/from=8", "level=3/from=0"]


def test_a_lost_merge_is_read_by_its_halves(spark, tmp_path):
    vault = str(tmp_path / "vault")
    for i in range(4):
        SP.write_level(_tokens(spark, i), SP.level_folder(vault, i, 0))
        if i != 3:
            SP.merge_levels(spark, vault, i)
    assert _seen(spark, vault, 4) == [0, 1, 2, 3]
    SP.drop_merged(spark, vault, 4)  # nothing complete above them: nothing goes
    assert _seen(spark, vault, 4) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        _seen(spark, vault, 6)


def test_a_replayed_batch_gives_the_same_tokens(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [[(1, 0, "user", "a@x.io and b@x.io"), (2, 0, "user", "555-0101")], [(1, 1, "user", "b@x.io then c@x.io")], [(2, 1, "user", "555-0102 or 555-0101"), (1, 2, "user", "d@x.io c@x.io")]]
    texts = {}
    for again in (False, True):
        for i, rows in enumerate(batches):
            if again and i < 2:
                continue  # only the last batch can come again
            SP.mask_batch(spark.createDataFrame(rows, SP.CONVERSATION_SCHEMA), i, out)
        got = {(r.conv_id, r.turn): r.masked for r in spark.read.parquet(f"{out}/rows").collect()}
        texts[again] = got
    assert texts[False] == texts[True] == {(1, 0): "<EMAIL_2> and <EMAIL_1>", (2, 0): "<PHONE_1>", (1, 1): "<EMAIL_1> then <EMAIL_3>",
                                           (2, 1): "<PHONE_2> or <PHONE_1>", (1, 2): "<EMAIL_4> <EMAIL_3>"}


def test_stream_mask_and_audit_over_several_batches(spark, tmp_path):
    folder = tmp_path / "conversations.parquet"
    folder.mkdir()
    for i in range(3):
        part = str(tmp_path / f"p{i}")
        spark.createDataFrame([(7, i, "user", f"u{i}@x.io u0@x.io"), (8, i, "user", None)], SP.CONVERSATION_SCHEMA).coalesce(1).write.parquet(part)
        (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
        (folder / f"{i}.parquet").write_bytes(open(f"{part}/{name}", "rb").read())
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    rows = spark.read.parquet(SP.stream_mask(spark, str(tmp_path), str(tmp_path / "m"), files_per_batch=1))
    got = {(r.conv_id, r.turn): r.masked for r in rows.collect()}
    assert got == {(7, 0): "<EMAIL_1> <EMAIL_1>", (7, 1): "<EMAIL_2> <EMAIL_1>", (7, 2): "<EMAIL_3> <EMAIL_1>", **{(8, i): "" for i in range(3)}}
    audit = spark.read.schema(SP.AUDIT_STREAM_SCHEMA).json(SP.stream_audit(spark, str(tmp_path), str(tmp_path / "a"), files_per_batch=1))
    assert sorted((r.conv_id, r.turn, r.findings) for r in audit.collect()) == [(7, i, 2) for i in range(3)] + [(8, i, 0) for i in range(3)]
    assert audit.where(F.length("sha256") != 16).count() == 0


def test_streams_make_notes_for_their_conversations_only_and_miss_none(spark, tmp_path, monkeypatch):
    """The first list of conversations lacks one, as if its file had come after the look: the stream goes on with a new list."""
    from ledgerguard.operators.audit import with_notes
    from ledgerguard.streaming import pipeline as SP
    rows = [(1, 0, "user", "my mail is a@b.org"), (1, 1, "assistant", "ok"), (2, 0, "user", "hi"), (None, 0, "user", "none"), (9, 0, "user", None)]
    spark.createDataFrame(rows, SP.CONVERSATION_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    notes = spark.createDataFrame([(1, "call 555-0001"), (2, "call 555-0002"), (2, "call 555-0003"), (7, "call 555-0007")], "ContractId long, note string")
    real, lists = SP.asked_conversations, []

    def some_at_first(*args):
        lists.append(real(*args))
        return lists[-1].where("conv_id <> 2") if len(lists) == 1 else lists[-1]

    monkeypatch.setattr(SP, "asked_conversations", some_at_first)
    path = SP.stream_audit(spark, str(tmp_path), out_dir=f"{tmp_path}/out", notes=notes)
    got = sorted((r.conv_id or 0, r.turn, r.chars) for r in spark.read.schema(SP.AUDIT_STREAM_SCHEMA).json(path).collect())
    turns = with_notes(spark.createDataFrame(rows, SP.CONVERSATION_SCHEMA), notes)
    assert got == sorted((r.conv_id or 0, r.turn, len(r.text or "")) for r in turns.collect())
    assert len(lists) == 2
