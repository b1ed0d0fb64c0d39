"""Voices, their consents and their audio, kept in a database or in a snapshot store.

Both keep to the same rules: an owner sees its own voices only, and a voice of another owner is as absent as one that
isn't there; revoking a consent disables all voices that rest on it in the same transaction or commit; deleting a voice
takes its consent (and, in the snapshot store, the audio of both) along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.sources.database import Database, quoted
from lexmill.sources.snapshots import Store

VOICES = "voice_id BIGINT, name STRING, owner_id BIGINT, status STRING, consent_id BIGINT, audio_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
CONSENTS = "consent_id BIGINT, voice_id BIGINT, subject_name STRING, status STRING, audio_path STRING, created_at TIMESTAMP, expires_at TIMESTAMP, revoked_at TIMESTAMP"
FILES = "path STRING, content BINARY"
_KEYS = {"voices": "voice_id", "consents": "consent_id", "files": "path"}


@dataclass(frozen=True)
class VoiceDatabase:
    db: Database

    def create_tables(self) -> None:
        for name, columns, sought in (("voices", VOICES, ("owner_id", "consent_id")), ("consents", CONSENTS, ("voice_id",))):
            if not self.db.exists(name):
                first, rest = columns.replace("STRING", "VARCHAR(4096)").split(",", 1)
                self.db.run(f"CREATE TABLE {name} ({first} NOT NULL PRIMARY KEY,{rest})", *[f"CREATE INDEX {name}_{c} ON {name} ({c})" for c in sought])

    def create(self, voices: DataFrame) -> int:
        """Adds voices; one that is there already fails them all."""
        return self.db.insert("voices", voices)

    def save_consents(self, consents: DataFrame) -> int:
        """Adds consents, in place of those of the same id."""
        return self.db.insert("consents", consents, key="consent_id")

    def voices(self, owner: int | None = None, partitions: int = 8) -> DataFrame:
        """All voices, or an owner's; the condition goes to the database."""
        all_ = self.db.table("voices", "voice_id", partitions)
        return all_ if owner is None else all_.filter(F.col("owner_id") == owner)

    def consents(self, partitions: int = 8) -> DataFrame:
        return self.db.table("consents", "consent_id", partitions)

    def get(self, voice_id: int, owner: int | None = None) -> DataFrame:
        """The voice, or no row where there is none or it belongs to another owner."""
        return self.db.query(f"SELECT * FROM voices WHERE voice_id = {quoted(voice_id)}" + (f" AND owner_id = {quoted(owner)}" if owner is not None else ""))

    def get_consent(self, consent_id: int) -> DataFrame:
        return self.db.query(f"SELECT * FROM consents WHERE consent_id = {quoted(consent_id)}")

    def list(self, owner: int, limit: int = 50, offset: int = 0) -> DataFrame:
        """An owner's voices, newest first."""
        return self.db.page("voices", f"owner_id = {quoted(owner)}", "created_at DESC, voice_id", limit, offset)

    def set_status(self, voice_ids: DataFrame, status: str, at: str) -> int:
        """How many of voice_ids are there; at: the time of the change."""
        return self._by_key(voice_ids, "voice_id", lambda t: [f"UPDATE voices SET status = {quoted(status)}, updated_at = TIMESTAMP({quoted(at)}) WHERE voice_id IN (SELECT voice_id FROM {t})"])[0]

    def revoke(self, consent_ids: DataFrame, at: str) -> tuple[int, int]:
        """Revokes consents and disables the voices that rest on them; how many of each there were."""
        own = "WHERE consent_id IN (SELECT consent_id FROM {0})"
        return tuple(self._by_key(consent_ids, "consent_id", lambda t: [
            f"UPDATE consents SET status = 'revoked', revoked_at = TIMESTAMP({quoted(at)}) {own.format(t)}",
            f"UPDATE voices SET status = 'disabled', updated_at = TIMESTAMP({quoted(at)}) {own.format(t)}",
        ]))

    def delete(self, voice_ids: DataFrame, owner: int | None = None) -> tuple[int, int]:
        """Deletes voices (of an owner, if one is given) with their consents; how many consents and voices there were."""
        scope = f"v.owner_id = {quoted(owner)}" if owner is not None else "1 = 1"
        return tuple(self._by_key(voice_ids, "voice_id", lambda t: [
            f"CREATE TABLE {t}_gone (voice_id BIGINT, consent_id BIGINT)",
            f"INSERT INTO {t}_gone SELECT DISTINCT v.voice_id, v.consent_id FROM voices v JOIN {t} k ON v.voice_id = k.voice_id WHERE {scope}",
            f"DELETE FROM consents WHERE consent_id IN (SELECT consent_id FROM {t}_gone)",
            f"DELETE FROM voices WHERE voice_id IN (SELECT voice_id FROM {t}_gone)",
            f"DROP TABLE {t}_gone",
        ])[2:4])

    def _by_key(self, keys: DataFrame, key: str, statements) -> list[int]:
        """Statements over a table of keys that is there for them alone, as one transaction."""
        with self.db.held(keys.select(F.col(key).cast("long")).distinct(), key) as name:
            return self.db.run(*statements(name))


@dataclass(frozen=True)
class VoiceSnapshots:
    store: Store

    def create_tables(self) -> int:
        change = self.store.begin()
        for name, columns in (("voices", VOICES), ("consents", CONSENTS), ("files", FILES)):
            change.create(name, StructType.fromDDL(columns), [_KEYS[name]])
        return change.commit()

    def enrol(self, voices: DataFrame, consents: DataFrame, files: DataFrame) -> int:
        """Voices, consents and audio, all seen at once."""
        return self.store.begin().insert("voices", voices).insert("consents", consents).insert("files", files).commit()

    def voices(self) -> DataFrame:
        return self.store.read("voices")

    def consents(self) -> DataFrame:
        return self.store.read("consents")

    def list(self, owner: int, limit: int = 50, offset: int = 0) -> DataFrame:
        """An owner's voices, newest first."""
        return self.voices().filter(F.col("owner_id") == owner).orderBy(F.desc("created_at"), "voice_id").offset(offset).limit(limit)

    def revoke(self, consent_ids: DataFrame, at: Column) -> int:
        change = self.store.begin()
        voices, consents = (self.store.read(t, change.base).join(consent_ids.select("consent_id").distinct(), "consent_id", "left_semi") for t in ("voices", "consents"))
        change.update("consents", consents.withColumn("status", F.lit("revoked")).withColumn("revoked_at", at))
        change.update("voices", voices.withColumn("status", F.lit("disabled")).withColumn("updated_at", at))
        return change.commit()

    def delete(self, voice_ids: DataFrame, owner: int | None = None) -> int:
        """Voices (of an owner, if one is given), their consents and the audio of both vanish at once."""
        change = self.store.begin()
        voices = self.store.read("voices", change.base).join(voice_ids.select("voice_id").distinct(), "voice_id", "left_semi")
        voices = voices if owner is None else voices.filter(F.col("owner_id") == owner)
        consents = self.store.read("consents", change.base).join(voices.select("consent_id"), "consent_id", "left_semi")
        change.delete("files", voices.select(F.col("audio_path").alias("path")).unionByName(consents.select(F.col("audio_path").alias("path"))).filter("path IS NOT NULL"))
        return change.delete("consents", consents).delete("voices", voices).commit()
