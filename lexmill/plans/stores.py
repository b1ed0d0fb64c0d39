"""Queries over voices and consents that are kept in stores; orders stand for both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.operators import evaluation
from lexmill.operators.voice_store import FILES, VoiceDatabase, VoiceSnapshots
from lexmill.plans.catalogue import query, table
from lexmill.sources import shared
from lexmill.sources.database import Database
from lexmill.sources.snapshots import Store

NOW = "2024-06-01 00:00:00"


def database(spark: SparkSession) -> Database | None:
    """The store's database, by the settings lexmill.store.url and .driver. Where they are unset, a new one in the session's own
    JVM in local mode; on a cluster None, for executors don't reach that one."""
    url = spark.conf.get("lexmill.store.url", None)
    if url:
        return Database(spark, url, spark.conf.get("lexmill.store.driver", None))
    if not spark.sparkContext.master.startswith("local["):
        return None
    return Database(spark, f"jdbc:derby:memory:lexmill{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")


def voices_and_consents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    id_, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    path = lambda kind: F.concat(F.lit(f"{kind}/"), id_.cast("string"), F.lit(".wav"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("active")
    voices = o.select(id_.alias("voice_id"), F.concat(F.lit("voice "), id_.cast("string")).alias("name"), F.col("o_custkey").alias("owner_id"), status.alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", id_ + 1).alias("consent_id"), path("voices").alias("audio_path"), at.alias("created_at"), at.alias("updated_at"))
    consents = o.filter("o_orderpriority <> '5-LOW'").select((id_ + 1).alias("consent_id"), id_.alias("voice_id"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("subject_name"),
        F.lit("verified").alias("status"), path("consents").alias("audio_path"), at.alias("created_at"), (at + F.expr("INTERVAL 365 DAYS")).alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return voices, consents


_STORED = """v AS (SELECT o_orderkey AS voice_id, o_custkey AS owner_id, o_orderdate AS created_at, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey + 1 END AS consent_id,
  CASE WHEN o_orderpriority <> '5-LOW' AND (o_orderkey + 1) % 11 = 0 THEN 'disabled' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'active' END AS status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN (o_orderkey + 1) % 11 = 0 THEN 'revoked' ELSE 'verified' END END AS consent_status FROM orders)"""


def kept(spark: SparkSession, db: Database | None, voices: DataFrame, consents: DataFrame) -> VoiceDatabase | VoiceSnapshots:
    """Voices and consents written to a database, or without one to a snapshot store in the shared folder; some consents revoked."""
    revoked = consents.filter("consent_id % 11 = 0")
    if db is None:
        store = VoiceSnapshots(Store(spark, shared.folder(spark, "voices")))
        store.create_tables()
        store.enrol(voices, consents, spark.createDataFrame([], FILES))
        store.revoke(revoked, F.lit(NOW).cast("timestamp"))
        return store
    store = VoiceDatabase(db)
    store.create_tables()
    store.create(voices)
    store.save_consents(consents)
    store.revoke(revoked, NOW)
    return store


@query(f"""WITH {_STORED} SELECT voice_id, owner_id, status, consent_id, consent_status FROM v WHERE owner_id % 13 <> 0""")
def stored_voices(spark, sf_dir):
    """Voices and consents written to a store, some consents revoked, some owners' voices deleted, all read back."""
    voices, consents = voices_and_consents(spark, sf_dir)
    store = kept(spark, database(spark), voices, consents)
    store.delete(voices.filter("owner_id % 13 = 0"))
    own = store.consents().select("consent_id", F.col("status").alias("consent_status"))
    return store.voices().join(own, "consent_id", "left").select("voice_id", "owner_id", "status", "consent_id", "consent_status")


@query(f"""WITH {_STORED} SELECT voice_id, status, created_at FROM v WHERE owner_id = (SELECT min(owner_id) FROM v) ORDER BY created_at DESC, voice_id LIMIT 50 OFFSET 1""")
def stored_voice_page(spark, sf_dir):
    """A page of an owner's voices, newest first, sorted and cut by the database where there is one."""
    voices, consents = voices_and_consents(spark, sf_dir)
    store = kept(spark, database(spark), voices, consents)
    return store.list(voices.agg(F.min("owner_id")).first()[0], 50, 1).toDF(*map(str.lower, voices.columns)).select("voice_id", "status", "created_at")


@query(f"""WITH {_STORED}, o AS (SELECT o_orderkey AS voice_id, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'active' END AS first FROM orders)
SELECT CAST(2 AS INTEGER) AS version, voice_id, first AS status, CASE WHEN consent_id IS NOT NULL THEN 'verified' END AS consent_status, CASE WHEN consent_id IS NULL THEN 1 ELSE 2 END AS files FROM v JOIN o USING (voice_id)
UNION ALL SELECT 3, voice_id, status, consent_status, CASE WHEN consent_id IS NULL THEN 1 ELSE 2 END FROM v
UNION ALL SELECT 4, voice_id, status, consent_status, CASE WHEN consent_id IS NULL THEN 1 ELSE 2 END FROM v WHERE owner_id % 13 <> 0""")
def snapshot_versions(spark, sf_dir):
    """The voices of each version of a snapshot store: enrolled, some consents revoked, some owners' voices deleted."""
    store = Store(spark, shared.folder(spark, "voice-snapshots"))
    own = VoiceSnapshots(store)
    own.create_tables()
    voices, consents = voices_and_consents(spark, sf_dir)
    paths = voices.select(F.col("audio_path").alias("path")).unionByName(consents.select(F.col("audio_path").alias("path")))
    own.enrol(voices, consents, paths.withColumn("content", F.encode("path", "UTF-8")))
    own.revoke(consents.filter("consent_id % 11 = 0"), F.lit(NOW).cast("timestamp"))
    own.delete(voices.filter("owner_id % 13 = 0"))

    def at(version: int) -> DataFrame:
        own = store.read("consents", version).select("consent_id", F.col("status").alias("consent_status"), F.col("audio_path").alias("consent_path"))
        there = store.read("files", version).select("path")
        rows = store.read("voices", version).join(own, "consent_id", "left").select("voice_id", "status", "consent_status", F.explode(F.array("audio_path", "consent_path")).alias("path"))
        rows = rows.join(there.withColumn("held", F.lit(1)), "path", "left").groupBy("voice_id", "status", "consent_status").agg(F.count("held").cast("int").alias("files"))
        return rows.select(F.lit(version).alias("version"), "voice_id", "status", "consent_status", "files")

    return at(2).unionByName(at(3)).unionByName(at(4))


_CASES = """c AS (SELECT conv_id * 1000 + turn AS id, role AS category, length(text) AS n, turn FROM conversations WHERE role <> 'system'),
r AS (SELECT id, category, CASE WHEN n % 5 = 0 THEN 'backend_unavailable' WHEN n % 7 = 0 THEN 'text_too_long' END AS error, n, turn FROM c),
m AS (SELECT id, category, error, CASE WHEN error IS NULL THEN round(n / 16, 3) ELSE 0.0 END AS audio_seconds, CASE WHEN error IS NOT NULL OR n = 0 THEN CAST('inf' AS DOUBLE) ELSE round((turn + 1) / 8 / (n / 16), 4) END AS real_time_factor FROM r)"""


def _evaluated(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("category"), "text", "turn")
    n = F.length("text")
    came = turns.filter(n % 5 != 0).select("id", F.col("text").alias("normalized_text"), (n / 16).alias("audio_seconds"), ((F.col("turn") + 1) / 8).alias("generation_seconds"),
        F.lit(None).cast("string").alias("heard"), F.when(n % 7 == 0, "text_too_long").alias("error"))
    roles = [r.category for r in turns.select("category").distinct().collect() if r.category != "system"]
    return evaluation.results(evaluation.chosen(turns, roles), came)


@query(f"WITH {_CASES} SELECT id, category, audio_seconds, real_time_factor, error FROM m")
def evaluation_results(spark, sf_dir):
    """Turns as cases; some have no outcome, some an error."""
    return _evaluated(spark, sf_dir).select("id", "category", "audio_seconds", "real_time_factor", "error")


@query(f"""WITH {_CASES} SELECT category, CAST(GROUPING(category) AS INTEGER) AS overall, count(*) AS cases, count(error) AS errors, round(avg(CASE WHEN real_time_factor < CAST('inf' AS DOUBLE) THEN real_time_factor END), 6) AS mean_real_time_factor
FROM m GROUP BY GROUPING SETS ((category), ())""")
def evaluation_summary(spark, sf_dir):
    df = evaluation.summary(_evaluated(spark, sf_dir))
    return df.select("category", "overall", "cases", "errors", F.round("mean_real_time_factor", 6).alias("mean_real_time_factor"))


@query("SELECT role AS key, count(*) AS n FROM conversations GROUP BY role")
def case_counts(spark, sf_dir):
    return evaluation.category_counts(table(spark, sf_dir, "conversations").withColumnRenamed("role", "category"))


@query("""SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS passed, CASE WHEN l_tax > 0.02 THEN l_tax ELSE 1.0 END AS phrase_cer, CAST(CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END AS INTEGER) AS nonce_words_found, CAST(NULL AS DOUBLE) AS speaker_similarity FROM lineitem""")
def verification_defaults(spark, sf_dir):
    """Consents' verifications from JSON in which keys are missing."""
    text = F.to_json(F.struct(F.when(F.col("l_discount") > 0.05, True).alias("passed"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("phrase_cer"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("nonce_words_found")))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.verification_of(text).alias("v"))
    return df.select("l_orderkey", "l_linenumber", "v.passed", "v.phrase_cer", "v.nonce_words_found", "v.speaker_similarity")
