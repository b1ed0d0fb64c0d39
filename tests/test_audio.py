"""Clips, marks, backends and the streaming limiter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import audio
from lexmill.operators import backends, voices
from lexmill.sources import clips
from lexmill.streaming import limits

RATE = 24000


def _voice(seconds=2.0, seed=1):
    t = np.arange(int(seconds * RATE)) / RATE
    x = sum(np.sin(2 * np.pi * 150 * k * t) / k for k in range(1, 6)) * (np.sin(2 * np.pi * 2 * t) > -0.5)
    return (0.5 * x / np.abs(x).max() + 1e-3 * np.random.default_rng(seed).standard_normal(len(t))).astype(np.float32)


def test_wav():
    x = _voice()
    y, rate = audio.decode_wav(audio.encode_wav(x, RATE))
    assert rate == RATE and np.abs(x - y).max() < 1e-4 and len(audio.wav_header(RATE)) == 44
    for bad in (b"", b"RIFF", audio.wav_header(RATE, 0)):
        with pytest.raises(audio.AudioError):
            audio.decode_wav(bad)


def test_loudness():
    t = np.arange(RATE * 3) / RATE
    level, method = audio.loudness(np.sin(2 * np.pi * 997 * t), RATE)
    assert method == "itu_bs1770" and abs(level + 3.01) < 0.2
    assert audio.loudness(0.5 * np.ones(100), RATE) == (pytest.approx(-6.02, abs=0.01), "rms_dbfs")
    y, before, _ = audio.normalized_loudness(_voice(), RATE)
    assert audio.loudness(y, RATE)[0] == pytest.approx(-23, abs=0.1) and before > -23
    loud, _, _ = audio.normalized_loudness(_voice(), RATE, target=0.0)
    assert 20 * np.log10(np.abs(loud).max()) == pytest.approx(-1.0, abs=1e-3)
    with pytest.raises(audio.AudioError):
        audio.normalized_loudness(np.zeros(100, np.float32), RATE)


def test_resampling():
    x = np.sin(2 * np.pi * 440 * np.arange(RATE) / RATE).astype(np.float32)
    y = audio.resampled(x, RATE, 16000)
    assert len(y) == 16000 and np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)).max() < 1e-3
    high = np.sin(2 * np.pi * 11000 * np.arange(RATE) / RATE)
    assert np.abs(audio.resampled(high, RATE, 16000)).max() < 1e-6


def test_mark():
    x, key, payload = _voice(4.0), b"key", 0xDEADBEEF
    y = audio.marked(x, payload, key)
    assert audio.mark_of(y, key)[0] == payload and audio.mark_of(0.3 * y, key)[0] == payload
    assert audio.mark_of(x, key)[0] is None and audio.mark_of(y, b"other")[0] is None and audio.mark_of(x[:100], key) == (None, 0.0)
    for bad in ((x[:100], 1, key), (x, 1 << 32, key), (x, 1, b"")):
        with pytest.raises(audio.AudioError):
            audio.marked(*bad)


def test_clip_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(audio.encode_wav(_voice(4.0), RATE))
    (tmp_path / "in" / "b.wav").write_bytes(b"nothing")
    df = clips.read_clips(spark, str(tmp_path / "in")).withColumn("name", F.substring_index("path", "/", -1))
    c = F.col("clip")
    m = audio.mark_column(audio.marked_column(c, F.lit(7), b"k")["value"], b"k")
    got = {r.name: r for r in df.select("name", "error_code", audio.loudness_column(c).alias("l"), audio.normalized_column(c).alias("n"), m.alias("m"), audio.resampled_column(c, 16000)["value"]["sample_rate"].alias("r")).collect()}
    a, b = got["a.wav"], got["b.wav"]
    assert a.m.value.payload == 7 and a.l.value.method == "itu_bs1770" and a.r == 16000 and len(a.n.value.samples) == 4 * RATE
    assert b.error_code == "audio_error" and b.l.value is None and b.m.value is None
    clips.write_clips(df, "name", c, str(tmp_path / "out"))
    assert {r.name: r.wav is not None for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.wav": True, "b.wav": False}
    cut = df.select(F.size(audio.sliced(c["samples"], c["sample_rate"], F.lit(1.0), F.lit(9.0))).alias("n")).collect()
    assert [r.n for r in cut if r.n and r.n > 0] == [3 * RATE]


def test_stub_seconds(spark):
    df = spark.createDataFrame([(["n", "aː", "ʈ"],)], "p array<string>").select(audio.stub_seconds(F.col("p")).alias("s"))
    assert df.first().s == pytest.approx(0.085 * 3.6)


def test_backends(spark):
    with pytest.raises(ValueError, match="already"):
        backends.register("denoiser", "noop")(lambda: None)
    with pytest.raises(ValueError, match="no mos"):
        backends.backend("mos", "x")
    v = backends.backend("verifier", "cosine")
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(v(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(1.0)


def test_limiter_stream(spark, tmp_path):
    rows = [(k, k * 100 + i, i, 1) for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, request_id long, s long, cost int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.filter("request_id % 100 < 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "mark")}

    def go():
        limits.rate_limited(stream, 6).writeStream.format("parquet").options(**sink).trigger(availableNow=True).start().awaitTermination()

    go()
    df.filter("request_id % 100 >= 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in voices.rate_limited(df, 6).collect()} and len(got) == 40
