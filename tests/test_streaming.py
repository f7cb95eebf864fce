import hashlib
import random

from vellum.operators.grounding import conversation_state
from vellum.streaming.conversations import conversation_stream, latest_states
from vellum.streaming.ingest import stream_ingest


def test_two_triggers_equal_one_batch(spark, tmp_path):
    zone, ledger, points, state = (str(tmp_path / n) for n in ("zone", "ledger", "points", "state"))
    (tmp_path / "zone").mkdir()
    (tmp_path / "zone" / "a.txt").write_text("one")
    (tmp_path / "zone" / "b.txt").write_text("two")
    stream_ingest(spark, zone, ledger, points, state).awaitTermination()
    (tmp_path / "zone" / "c.txt").write_text("one")
    (tmp_path / "zone" / "d.txt").write_text("three")
    (tmp_path / "zone" / "e.pdf").write_text("four")
    stream_ingest(spark, zone, ledger, points, state).awaitTermination()
    assert sorted(r.clean_text for r in spark.read.parquet(points).collect()) == ["one", "three", "two"]
    assert spark.read.parquet(ledger).count() == 3


def test_hashes_from_before_are_not_new(spark, tmp_path):
    zone, ledger, points, state = (str(tmp_path / n) for n in ("zone", "ledger", "points", "state"))
    (tmp_path / "zone").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "two")):
        (tmp_path / "zone" / name).write_text(text)
    known = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(),)] * 2, "doc_hash string")
    stream_ingest(spark, zone, ledger, points, state, known).awaitTermination()
    assert [r.clean_text for r in spark.read.parquet(points).collect()] == ["two"]
    assert [r.doc_hash for r in spark.read.parquet(ledger).collect()] == [hashlib.sha256(b"two").hexdigest()]


def test_late_and_repeated_turns(spark, tmp_path):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "system", None]), rng.choice(["hi", "", None, "é" * t])) for c in range(6) for t in range(12)] + [(9, None, "user", "x"), (None, 1, "user", "y")]
    schema = "conv_id long, turn long, role string, text string"
    arrived, states, state = (str(tmp_path / n) for n in ("turns", "states", "state"))
    rest = turns * 2
    rng.shuffle(rest)
    for k in range(3):
        spark.createDataFrame(rest[k::3], schema).write.mode("append").parquet(arrived)
        conversation_stream(spark, spark.readStream.schema(schema).parquet(arrived), states, state).awaitTermination()
    want = sorted(conversation_state(spark.createDataFrame(turns, schema).distinct()).collect(), key=repr)
    assert sorted(latest_states(spark, states).collect(), key=repr) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
