"""Corpus preparation and enrolment."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import clip_quality
from lexmill.operators import backends, preparation

RATE = 8000


def _clip(seconds=3.0, noise=1e-4):
    t = np.arange(int(seconds * RATE)) / RATE
    on = (t > 0.5) & (t < seconds - 0.5) & (np.sin(2 * np.pi * 1.5 * t) > -0.7)
    return 0.4 * np.sin(2 * np.pi * 200 * t) * on + noise * np.random.default_rng(3).standard_normal(len(t))


def _row(id_, x, text="നാട്"):
    return (id_, text, "s1", None if x is None else ([float(v) for v in x], RATE))


def test_trim_and_report():
    x = _clip()
    y = clip_quality.trimmed(x, RATE)
    assert len(x) - len(y) > 0.7 * RATE and np.abs(y).max() == np.abs(x).max()
    assert clip_quality.trimmed(np.zeros(RATE), RATE).shape == (RATE,)
    r = clip_quality.report(x, RATE)
    assert r["duration_seconds"] == 3.0 and r["estimated_snr_db"] > 20 and r["clipping_ratio"] == 0


def test_prepared(spark):
    rows = [_row("good", _clip()), _row("noisy", _clip(noise=0.2)), _row("silent", np.zeros(RATE)), _row("none", None), _row("blank", _clip(), " "), _row("wrong", _clip(), "മലയാളം കേരളം")]
    df = spark.createDataFrame(rows, "id string, text string, speaker_id string, clip struct<samples:array<float>,sample_rate:int>")
    done = preparation.prepared(df, transcriber=backends.backend("transcriber", "constant", text="നാട്"), denoiser=backends.backend("denoiser", "noop"))
    got = {r.id: r for r in done.select("id", "stage", "reasons", "phonemes", "asr_cer", "quality", "split").collect()}
    assert {k: r.stage for k, r in got.items()} == {"good": None, "noisy": "quality", "silent": "error", "none": "error", "blank": "error", "wrong": "asr_mismatch"}
    assert got["good"].phonemes == "n aa tt ax" and got["good"].asr_cer == 0 and got["good"].quality["duration_seconds"] < 3
    assert "noisy" in got["noisy"].reasons and got["blank"].reasons == ["validation_error"]
    assert preparation.accepted(done).count() + preparation.rejected(done).count() == len(rows)


def test_enrolled(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    ok, late = "2024-01-01 00:00:00", "2024-01-01 02:00:00"
    rows = [("ok", "one two red", "one two red", v, ok, []), ("other", "one two red", "one two red", w, ok, []), ("deaf", "one two red", None, v, ok, []), ("loud", "one two red", "one two red", v, ok, ["noisy"]), ("bad", "one two red", "one two red", v, ok, [])]
    df = spark.createDataFrame(rows, "name string, phrase string, heard string, consent_voice array<double>, issued string, reference_reasons array<string>")
    df = df.withColumn("nonce", F.array(F.lit("red"))).withColumn("reference_voice", F.array(F.lit(1.0), F.lit(0.0))).withColumn("issued_at", F.to_timestamp("issued"))
    now = lambda t: F.to_timestamp(F.lit(t))
    done = preparation.verified(df, now(ok), verifier=backends.backend("verifier", "cosine"))
    got = {r.name: r for r in preparation.enrolled(done, F.col("name") == "bad", now(ok)).collect()}
    assert {k: r.refusal for k, r in got.items()} == {"ok": None, "other": "consent_error", "deaf": "consent_error", "loud": "audio_error", "bad": "moderation_error"}
    assert got["ok"].expires_at.year == 2024 and got["bad"].expires_at is None and got["deaf"].verification.nonce_words_found == 0
    assert {r.verification.reasons[0] for r in preparation.verified(df.filter("name = 'ok'"), now(late)).collect()} == {"challenge_expired"}
    assert preparation.verified(df.filter("name = 'ok'"), now(ok)).first().verification.reasons == ["no_verifier"]
