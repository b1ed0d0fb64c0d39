"""Corpus preparation and enrolment as tables: each row gets an outcome, none ends the job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import audio, clip_quality, frontend, phonemes, unicode_text
from lexmill.functions import columns as C
from lexmill.sources import shared


@dataclass(frozen=True)
class Preparing:
    target: float = -23.0
    trim: bool = True
    most_cer: float = 0.15
    test: float = 0.05
    validation: float = 0.05
    salt: str = "corpus-v1"


#: What the second measurement, of the finished clip, replaces in the first.
_FINAL = ("duration_seconds", "silence_ratio", "peak_dbfs", "clipping_ratio")


def prepared(entries: DataFrame, how: Preparing = Preparing(), *, transcriber: Callable[[Column], Column] | None = None, denoiser: Callable[[Column], Column] | None = None) -> DataFrame:
    """entries: id, text, speaker_id, clip and what else they carry. Adds clip (trimmed, denoised, at the target),
    quality, normalized_text, phonemes, asr_text, asr_cer, split, and stage (null, or error, quality,
    asr_mismatch) with reasons. A null clip or text is an error. Cost: one Python pass over clips and one over texts."""

    def finish(x, rate):
        raw = clip_quality.report(x, rate)
        y = clip_quality.trimmed(x, rate) if how.trim else x
        return {"samples": y, "sample_rate": rate, "raw": raw}

    def settle(x, rate):
        y, _, _ = audio.normalized_loudness(x, rate, target=how.target)
        return {"samples": y, "sample_rate": rate, "final": clip_quality.report(y, rate)}

    shape = "struct<samples:array<float>,sample_rate:int,{}:" + clip_quality.REPORT + ">"
    cut = audio._on_clips(finish, shape.format("raw"))(F.col("clip"))
    cut_, done_, text_, report_ = (shared.free_name(entries, c) for c in ("cut", "done", "frontend", "report"))
    df = entries.withColumn(cut_, cut)
    clean = F.struct(F.col(f"{cut_}.value.samples").alias("samples"), F.col(f"{cut_}.value.sample_rate").alias("sample_rate"))
    clean = F.when(F.col(f"{cut_}.value").isNotNull(), clean)
    df = df.withColumn(done_, audio._on_clips(settle, shape.format("final"))(denoiser(clean) if denoiser else clean))
    df = df.withColumn(text_, frontend.processed(F.col("text")))
    done = F.col(f"{done_}.value")
    out = F.when(done.isNotNull(), F.struct(done["samples"].alias("samples"), done["sample_rate"].alias("sample_rate")))
    merged = F.struct(*[(done["final"][k] if k in _FINAL else F.col(f"{cut_}.value.raw")[k]).alias(k) for k in ("duration_seconds", "peak_dbfs", "clipping_ratio", "dc_offset", "silence_ratio", "estimated_snr_db")])
    df = df.withColumn("clip", out).withColumn(report_, F.when(done.isNotNull(), merged))
    df = df.withColumn("quality", F.when(done.isNotNull(), clip_quality.rounded(F.col(report_))))
    df = df.withColumn("normalized_text", F.col(f"{text_}.value.routed"))
    said = F.transform(F.col(f"{text_}.value.phonemes"), lambda p: phonemes.rendered_column(p, ascii=True))
    df = df.withColumn("phonemes", F.array_join(said, " | "))
    df = df.withColumn("asr_text", transcriber(F.col("clip")) if transcriber else F.lit(None).cast("string"))
    df = df.withColumn("asr_cer", C.character_error_rate(F.col("normalized_text"), F.col("asr_text")))
    df = df.withColumn("split", C.assigned_split(F.col("speaker_id"), test=how.test, validation=how.validation, salt=how.salt))
    broken = C.reasons((F.col("clip").isNull(), F.coalesce(F.col(f"{cut_}.error_code"), F.col(f"{done_}.error_code"), F.lit("audio_error"))))
    # The gate comes before the text: what it refuses is never asked whether its text can be read.
    unread = C.reasons((F.col("normalized_text").isNull(), F.coalesce(F.col(f"{text_}.error_code"), F.lit("validation_error"))))
    gate = F.coalesce(clip_quality.gate(F.col(report_)), F.array().cast("array<string>"))
    cer = C.reasons((F.col("asr_cer") > how.most_cer, F.format_string("cer %.3f", F.col("asr_cer"))))
    rules = [("error", broken), ("quality", gate), ("error", unread), ("asr_mismatch", cer)]
    stage, why = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, found in reversed(rules):
        stage, why = F.when(F.size(found) > 0, name).otherwise(stage), F.when(F.size(found) > 0, found).otherwise(why)
    return df.withColumn("stage", stage).withColumn("reasons", why).drop(cut_, done_, text_, report_)


def accepted(done: DataFrame) -> DataFrame:
    return done.filter("stage IS NULL").drop("stage", "reasons")


def rejected(done: DataFrame) -> DataFrame:
    return done.filter("stage IS NOT NULL").select(F.col("id").alias("entry_id"), "stage", "reasons")


def verified(requests: DataFrame, as_of: Column, *, verifier: Callable[[Column, Column], Column] | None = None, most_cer: float = 0.25, least_alike: float = 0.70, hours: int = 1) -> DataFrame:
    """requests: phrase, nonce (words), issued_at, heard (transcript of the recording), consent_voice and
    reference_voice (embeddings). Adds verification: passed, phrase_cer, nonce_words_found, speaker_similarity,
    reasons. Without a verifier none passes; nothing heard is a failure."""
    columns, heard = requests.columns, F.coalesce("heard", F.lit(""))
    cer = C.character_error_rate(F.col("phrase"), heard)
    # Words are sought in canonical text, so that two spellings of one word are one.
    canonical = lambda c: unicode_text.normalized(c)["text"]
    words, text = (shared.free_name(requests, c) for c in ("nonce_words", "heard_text"))
    requests = requests.withColumn(words, F.filter(F.split(canonical(F.array_join("nonce", "\n")), "\n"), lambda w: w != "")).withColumn(text, canonical(heard))
    found = F.size(F.filter(words, lambda w: F.col(text).contains(w)))
    alike = verifier(F.col("consent_voice"), F.col("reference_voice")) if verifier else F.lit(None).cast("double")
    stale = as_of > F.col("issued_at") + F.expr(f"INTERVAL {int(hours)} HOURS")
    why = C.reasons(
        (F.coalesce(stale, F.lit(True)), "challenge_expired"), (F.coalesce(cer > most_cer, F.lit(True)), "phrase_mismatch"),
        (found < F.size(words), "nonce_words_missing"), (F.coalesce(alike < least_alike, F.lit(True)), "other_speaker" if verifier else "no_verifier"),
    )
    parts = F.struct((F.size(why) == 0).alias("passed"), cer.alias("phrase_cer"), found.alias("nonce_words_found"), alike.cast("double").alias("speaker_similarity"), why.alias("reasons"))
    return requests.withColumn("verification", parts).select(*[c for c in columns if c != "verification"], "verification")


def enrolled(requests: DataFrame, blocked: Column, as_of: Column, *, days: int = 365) -> DataFrame:
    """requests after `verified`, with reference_reasons (of the gate). Adds refusal (null, or moderation_error,
    audio_error, consent_error, the first that holds) and expires_at of the consent that an accepted one starts."""
    refusal = F.when(F.coalesce(blocked, F.lit(False)), "moderation_error").when(F.size(F.coalesce("reference_reasons", F.array().cast("array<string>"))) > 0, "audio_error")
    refusal = refusal.when(~F.coalesce(F.col("verification.passed"), F.lit(False)), "consent_error")
    return requests.withColumn("refusal", refusal).withColumn("expires_at", F.when(refusal.isNull(), as_of + F.expr(f"INTERVAL {int(days)} DAYS")))
