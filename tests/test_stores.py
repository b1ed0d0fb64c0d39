"""Voices and consents in a database and in a snapshot store."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.operators.voice_store import CONSENTS, FILES, VOICES, VoiceDatabase, VoiceSnapshots
from lexmill.plans import stores
from lexmill.sources import shared
from lexmill.sources.database import Database
from lexmill.sources.snapshots import Conflict, Store

AT = datetime.datetime(2024, 1, 1)
NOW = "2024-06-01 00:00:00"


def voice(i, owner, consent=None, day=0):
    return (i, f"voice '{i}'", owner, "active", consent, f"voices/{i}.wav", AT + datetime.timedelta(days=day), AT)


def consent(i, of):
    return (i, of, "someone", "verified", f"consents/{i}.wav", AT, AT + datetime.timedelta(days=365), None)


@pytest.fixture(scope="module")
def voices(spark):
    return spark.createDataFrame([voice(i, i % 3, 100 + i if i % 2 else None, i) for i in range(1, 13)], VOICES)


@pytest.fixture(scope="module")
def consents(spark):
    return spark.createDataFrame([consent(100 + i, i) for i in range(1, 13, 2)], CONSENTS)


@pytest.fixture
def kept(spark, voices, consents):
    store = VoiceDatabase(Database(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"))
    store.create_tables()
    store.create_tables()
    assert (store.create(voices), store.save_consents(consents)) == (12, 6)
    return store


def rows(df, *columns):
    return sorted(tuple(r[c.upper()] if c.upper() in df.columns else r[c] for c in columns) for r in df.collect())


def test_database(spark, kept, voices, consents):
    assert rows(kept.voices(), "voice_id", "name", "owner_id", "consent_id") == rows(voices, "voice_id", "name", "owner_id", "consent_id")
    assert rows(kept.get(5), "voice_id", "owner_id") == [(5, 2)] == rows(kept.get(5, 2), "voice_id", "owner_id")
    assert kept.get(5, 1).count() == 0 == kept.get(99).count() and rows(kept.get_consent(105), "voice_id") == [(5,)]
    assert [r.VOICE_ID for r in kept.list(1, 2, 1).collect()] == [7, 4]  # newest first, after the newest
    plan = kept.voices(1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(OWNER_ID,1)" in plan and kept.voices().rdd.getNumPartitions() == 8
    with pytest.raises(Exception, match="(?i)duplicate"):
        kept.create(voices.filter("voice_id = 3").unionByName(spark.createDataFrame([voice(50, 1)], VOICES)))
    assert kept.get(50).count() == 0  # none of a write that fails
    assert kept.save_consents(consents.filter("consent_id = 101").withColumn("subject_name", F.lit("other"))) == 1
    assert rows(kept.get_consent(101), "subject_name") == [("other",)] and kept.consents().count() == 6
    assert kept.set_status(voices.filter("voice_id IN (2, 4)"), "disabled", NOW) == 2
    assert kept.revoke(consents.filter("consent_id IN (101, 103)"), NOW) == (2, 2)
    assert rows(kept.voices().filter("STATUS = 'disabled'"), "voice_id") == [(1,), (2,), (3,), (4,)]
    assert rows(kept.consents().filter("STATUS = 'revoked'"), "consent_id", "revoked_at") == [(i, datetime.datetime(2024, 6, 1)) for i in (101, 103)]
    assert kept.delete(voices.filter("voice_id IN (5, 6)"), owner=0) == (0, 1) and kept.get(5).count() == 1
    assert kept.delete(voices.filter("voice_id IN (5, 6)")) == (1, 1) and kept.get_consent(105).count() == 0
    assert kept.voices().count() == 10 and not [t for t in rows(kept.db.query("SELECT TABLENAME FROM SYS.SYSTABLES"), "tablename") if "STAGING" in t[0]]


def test_failed_transaction_changes_nothing(kept):
    with pytest.raises(Exception):  # noqa: B017 - py4j's class
        kept.db.run("DELETE FROM voices", "DELETE FROM nowhere")
    assert kept.voices().count() == 12


@pytest.fixture
def store(spark):
    return Store(spark, shared.folder(spark, "test-store"))


def test_snapshots(spark, store, voices, consents):
    own = VoiceSnapshots(store)
    assert store.version() == 0 and store.tables() == [] and own.create_tables() == 1 and store.read("voices").count() == 0
    paths = voices.select(F.col("audio_path").alias("path")).unionByName(consents.select(F.col("audio_path").alias("path")))
    assert own.enrol(voices, consents, paths.withColumn("content", F.lit(b"x"))) == 2
    assert own.revoke(consents.filter("consent_id = 101"), F.lit(NOW).cast("timestamp")) == 3
    assert own.delete(voices.filter("voice_id IN (3, 4)"), owner=0) == 4
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    assert ids(store.read("voices"), "voice_id") == [i for i in range(1, 13) if i != 3]
    assert ids(store.read("consents"), "consent_id") == [101, 105, 107, 109, 111] and store.read("files").count() == 16
    assert [store.read(t, 3).count() for t in ("voices", "consents", "files")] == [12, 6, 18]
    assert ids(store.read("voices").filter("status = 'disabled'"), "voice_id") == [1] and store.read("voices", 2).filter("status = 'disabled'").count() == 0
    # A deleted key can come back; a compacted table reads the same.
    again = store.begin().insert("voices", spark.createDataFrame([voice(3, 9)], VOICES)).commit()
    assert rows(store.read("voices").filter("voice_id = 3"), "owner_id") == [(9,)]
    assert store.compact("voices") == again + 1 and store.read("voices").count() == 12 and len(store.manifest(again + 1)["tables"]["voices"]["parts"]) == 1
    lost = store.vacuum(keep=1)
    assert lost and store.versions() == [again + 1] and store.read("voices").count() == 12 and store.read("files").count() == 16
    plan = store.read("files").filter("path = 'voices/1.wav'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path,voices/1.wav)" in plan


def test_one_of_two_writers_loses_cleanly(spark, store):
    VoiceSnapshots(store).create_tables()
    first, second = store.begin(), store.begin()
    first.insert("voices", spark.createDataFrame([voice(1, 1)], VOICES))
    second.insert("voices", spark.createDataFrame([voice(2, 2)], VOICES)).insert("files", spark.createDataFrame([("a", b"a")], FILES))
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert rows(store.read("voices"), "voice_id") == [(1,)] and store.read("files").count() == 0
    # A writer that dies before its commit leaves data that nothing names.
    store.begin().insert("voices", spark.createDataFrame([voice(3, 3)], VOICES))
    assert store.version() == 2 and store.read("voices").count() == 1
    assert len(store.vacuum(keep=2)) == 3 and store.read("voices").count() == 1
    with pytest.raises(KeyError):
        store.read("nothing")


def test_voices_without_a_database(spark, monkeypatch):
    """On a cluster executors don't reach a database in the driver's JVM; the queries keep voices in the shared folder then."""
    data = "/root/testdata/sf0.001"
    found = lambda q: sorted(map(str, q(spark, data).collect()))
    queries = stores.stored_voices, stores.stored_voice_page
    want = [found(q) for q in queries]
    monkeypatch.setattr(stores, "database", lambda _: None)
    got = [found(q) for q in queries]
    assert [[r.lower() for r in x] for x in got] == [[r.lower() for r in x] for x in want] and all(want)


def test_an_update_deals_out_no_keys(spark, store, voices):
    """The keys of an update are those of the rows as written: no exchange of their own, the rows written once."""
    VoiceSnapshots(store).create_tables()
    store.begin().insert("voices", voices).commit()
    change = store.begin().update("voices", voices.filter("voice_id < 4").withColumn("status", F.lit("disabled")).unionByName(voices.filter("voice_id = 50")))
    parts = change.tables["voices"]["parts"][-2:]
    assert {p["kind"] for p in parts} == {"rows", "gone"} and change.commit() == 3
    assert rows(store.read("voices").filter("status = 'disabled'"), "voice_id") == [(1,), (2,), (3,)] and store.read("voices").count() == 12
    twice = voices.filter("voice_id = 5")
    again = store.begin().delete("voices", twice.unionByName(twice))
    gone = spark.read.parquet(f"{store.path}/data/{again.tables['voices']['parts'][-1]['data']}")
    assert again.commit() == 4 and gone.count() == 2 and store.read("voices").count() == 11  # repeated keys are merged when read
