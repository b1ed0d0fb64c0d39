"""WAV files as a data source: slices, formats, commits."""

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.audio import AudioError
from lexmill.sources import wave_source
from lexmill.sources.wave_source import WaveSource


@pytest.fixture(scope="module")
def wav(spark):
    spark.dataSource.register(WaveSource)
    return spark


def clips(spark, n=5, rate=1000):
    rng = np.random.default_rng(1)
    return {f"c{i}": (rng.uniform(-1, 1, 1000 + 100 * i)).astype(np.float32) for i in range(n)}, rate


@pytest.mark.parametrize("subtype,off", [("PCM_16", 2 / 32767), ("PCM_24", 2 / 8388607), ("FLOAT", 0)])
def test_round_trip_and_slices(wav, tmp_path, subtype, off):
    x, rate = clips(wav)
    df = wav.createDataFrame([(k, v.tolist(), rate) for k, v in x.items()], wave_source.WRITTEN).repartition(3)
    df.write.format("wav").option("subtype", subtype).mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"{k}.wav" for k in x]
    whole = {os.path.basename(r.path)[:-4]: r for r in wav.read.format("wav").load(str(tmp_path / "out")).collect()}
    for k, v in x.items():
        assert np.abs(np.array(whole[k].samples) - v).max() <= off and whole[k].seconds == len(v) / rate and whole[k].sample_rate == rate
    some = {os.path.basename(r.path)[:-4]: r for r in wav.read.format("wav").option("start", 0.5).option("end", 0.75).load(str(tmp_path / "out")).collect()}
    width = wave_source.SUBTYPES[subtype][0]
    for k, v in x.items():
        assert some[k].samples == whole[k].samples[500:750] and some[k].seconds == len(v) / rate
        assert whole[k].bytes_read - some[k].bytes_read == (len(v) - 250) * width
    assert all(r.samples == [] for r in wav.read.format("wav").option("start", 9).load(str(tmp_path / "out")).collect())


def test_other_writers_files(wav, tmp_path):
    """Chunks before the samples, stereo, 8 bits, an extensible header, a data size that is too large; and what is no WAV."""
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as f:
        f.setparams((2, 1, 100, 0, "NONE", ""))
        f.writeframes(bytes([128, 255, 0, 128] * 50))
    x = np.array([0.5, -0.25, 1.0], np.float32)
    form = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 8, 32, 4, 32, 22, 32, 0, 3, b"\x00" * 14)
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 0xFFFFFFF) + x.tobytes()
    (tmp_path / "far.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    (tmp_path / "text.wav").write_bytes(b"no sound at all")
    (tmp_path / "short.wav").write_bytes(b"RIFF\0\0\0\0WAVE")
    (tmp_path / "_hidden.wav").write_bytes(b"")
    got = {os.path.basename(r.path): r for r in wav.read.format("wav").load(str(tmp_path)).collect()}
    assert got["far.wav"].samples == x.tolist() and len(got) == 4
    assert got["stereo.wav"].samples[:2] == pytest.approx([127 / 256, -0.5]) and len(got["stereo.wav"].samples) == 100
    assert {k for k, r in got.items() if r.error_code == "audio_error"} == {"text.wav", "short.wav"}


def wavs(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".wav"))


def test_files_count_once_the_job_commits(wav, tmp_path):
    out = str(tmp_path / "out")
    x, rate = clips(wav)
    df = wav.createDataFrame([(k, v.tolist(), rate) for k, v in x.items()], wave_source.WRITTEN)
    bad = df.withColumn("samples", F.when(F.col("name") == "c3", F.lit(None)).otherwise(F.col("samples"))).repartition(5)
    with pytest.raises(Exception, match="no samples"):
        bad.write.format("wav").mode("append").save(out)
    assert not os.path.exists(out) or wavs(out) == []
    writer = wave_source._Writer({"path": out}, False)
    row = df.first()
    lost, told = writer.write(iter([row])), writer.write(iter([row]))  # the same task, run twice; one message is lost
    assert wavs(out) == [] and lost.files != told.files and os.path.exists(lost.files[0][0])
    writer.commit([told, None])
    assert wavs(out) == [f"{row['name']}.wav"] and not os.path.exists(lost.files[0][0])
    with pytest.raises(Exception, match="one name"):
        df.unionByName(df).write.format("wav").mode("append").save(out)
    assert wavs(out) == [f"{row['name']}.wav"]
    df.filter("name = 'c4'").write.format("wav").mode("overwrite").save(out)
    assert wavs(out) == ["c4.wav"]
    with pytest.raises(AudioError):
        wave_source._Writer({"path": out, "subtype": "MP3"}, False)
