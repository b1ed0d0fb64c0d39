"""Clips as rows of blocks: the same levels and samples as of whole clips, for any size of block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import audio
from lexmill.operators import long_audio


def clip(seconds, rate, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    x = 0.3 * np.sin(2 * np.pi * 300 * t) + 0.1 * np.sin(2 * np.pi * 1100 * t + 1) + rng.normal(0, 0.001, len(t))
    return (x * (0.05 + np.abs(np.sin(t / 3)))).astype(np.float32)


@pytest.fixture(scope="module")
def clips(spark):
    x = {"long": clip(13.37, 8000), "short": clip(0.35, 8000), "silent": np.zeros(20_000, np.float32), "one": clip(2.0, 8000, 3), "soft": clip(5, 8000, 4) / 50}
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "k string, x array<float>")


@pytest.mark.parametrize("size", [4000, 8000, 800_000])
def test_loudness(clips, size):
    x, df = clips
    blocks = long_audio.blocks_of(df, "k", "x", size)
    assert blocks.filter("clip = 'long'").count() == -(-len(x["long"]) // size)
    got = {r.clip: r for r in long_audio.loudness(blocks, 8000, size).collect()}
    for k, v in x.items():
        level, method = audio.loudness(v, 8000)
        assert got[k].method == method and got[k].loudness == pytest.approx(level, abs=0.01) and got[k].peak == pytest.approx(np.abs(v).max()), k


def whole(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip, r.block)):
        out.setdefault(r.clip, []).extend(r.samples)
    return {k: np.array(v) for k, v in out.items()}


def test_normalized(clips):
    x, df = clips
    blocks = long_audio.blocks_of(df, "k", "x", 4000)
    got = whole(long_audio.normalized(blocks, long_audio.loudness(blocks, 8000, 4000)))
    for k, v in x.items():
        want = audio.normalized_loudness(v, 8000)[0] if np.abs(v).max() else v
        assert np.abs(got[k] - want).max() < 2e-3, k


@pytest.mark.parametrize("to", [16_000, 11_025, 4000, 8000])
def test_resampled(clips, to):
    """Blocks join without a seam, and what lies under both rates' limits stays."""
    x, df = clips
    one, some = (whole(long_audio.resampled(long_audio.blocks_of(df, "k", "x", size), 8000, to, size)) for size in (1 << 20, 1000))
    for k, v in x.items():
        assert len(one[k]) == len(some[k]) == max(1, round(len(v) * to / 8000))
        assert np.abs(one[k] - some[k]).max() < 1e-6, k
    t = np.arange(16_000) / 8000
    tone = np.sin(2 * np.pi * 440 * t)
    spark = df.sparkSession
    got = whole(long_audio.resampled(long_audio.blocks_of(spark.createDataFrame([("t", tone.tolist())], "k string, x array<float>"), "k", "x", 4000), 8000, to, 4000))["t"]
    inside = slice(len(got) // 8, -len(got) // 8)
    assert np.abs(got - np.sin(2 * np.pi * 440 * np.arange(len(got)) / to))[inside].max() < 1e-3
    assert np.abs(got - audio.resampled(tone, 8000, to))[inside].max() < 2e-2


def test_an_hour_is_many_small_rows(spark):
    """36,000 hops of an hour at 8 kHz: no row holds more than a block."""
    hour = spark.range(360).select(F.lit("h").alias("clip"), F.col("id").cast("int").alias("block"), F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.sin(i * 0.3).cast("float") * F.lit(0.25)).cast("array<float>").alias("samples"))
    got = long_audio.loudness(hour, 800, 8000).first()
    assert got.method == "itu_bs1770" and -25 < got.loudness < -10
    with pytest.raises(audio.AudioError):
        long_audio.loudness(hour, 8000, 8001)
