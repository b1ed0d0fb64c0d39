"""Frame energies, quality and speech segments of clips, as tables of frames. No task holds a clip, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.columns import reasons
from lexmill.operators import scans, selection
from lexmill.sources import shared


def frame_energy(samples: DataFrame, clip: str, pos: str, value: str, frame: int) -> DataFrame:
    """clip, frame, energy in dB for each whole frame; a clip shorter than one frame has one value for all of it."""
    df = scans.sized(samples.select(clip, F.col(pos).alias("pos"), F.col(value).alias("value")), clip, F.count(F.lit(1)).alias("n"))[0]
    at = F.when(F.col("n") < frame, 0).otherwise(F.floor(F.col("pos") / frame))
    df = df.withColumn("frame", at.cast("int")).filter((F.col("n") < frame) | ((F.col("frame") + 1) * frame <= F.col("n")))
    return df.groupBy(clip, "frame").agg((20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value"))) + 1e-12)).alias("energy"))


def noise_floor(frames: DataFrame, clip: str, *, window: int = 25, many: int = 50) -> DataFrame:
    """Tenth percentile of the least energy of whole windows; of clips under `many` frames the fifth of all frames."""
    df = scans.sized(frames.select(clip, "frame", "energy"), clip, F.count(F.lit(1)).alias("n"))[0]
    low = df.filter(F.col("n") >= many).groupBy(clip, F.floor(F.col("frame") / window).alias("w")).agg(F.min("energy").alias("least"), F.count(F.lit(1)).alias("full"))
    long_ = selection.quantiles(low.filter(F.col("full") == window), [clip], "least", {"floor": 0.10})
    return long_.unionByName(selection.quantiles(df.filter(F.col("n") < many), [clip], "energy", {"floor": 0.05}))


def quality_report(frames: DataFrame, clip: str) -> DataFrame:
    """clip, floor, snr and silence_ratio of the frames."""
    floor = shared.written(noise_floor(frames, clip).join(selection.quantiles(frames, [clip], "energy", {"high": 0.90}), clip), "floors")
    df = selection.with_facts(frames, floor, [clip]).groupBy(clip, "floor", "high")
    return df.agg(F.avg(F.when(F.col("energy") < F.col("floor") + 6, 1.0).otherwise(0.0)).alias("silence_ratio")).select(clip, "floor", (F.col("high") - F.col("floor")).alias("snr"), "silence_ratio")


def speech_segments(frames: DataFrame, clip: str, *, margin: float = 10.0, idle: int = 9, least: int = 5, size: int = scans.RANGE) -> DataFrame:
    """Runs of frames over the tenth percentile plus margin, closed after more than `idle` quiet ones. A closed
    run ends before its last active frame; the one open at the clip's end runs to that end. Clips are scanned in ranges of
    `size` frames."""
    last = frames.groupBy(clip).agg(F.max("frame").alias("last"))
    facts = shared.written(selection.quantiles(frames, [clip], "energy", {"low": 0.10}).join(last, clip), "thresholds")
    active = selection.with_facts(frames, facts, [clip]).filter(F.col("energy") > F.col("low") + margin)
    runs = scans.runs(active, clip, "frame", idle, size).join(facts.select(clip, "last"), clip)
    open_ = F.col("last") - F.col("end") <= idle
    runs = runs.withColumn("end", F.when(open_, F.col("last") + 1).otherwise(F.col("end")))
    return runs.filter(F.col("end") - F.col("start") >= least).select(clip, "segment", "start", "end")


def quality_reasons(duration, snr, silence):
    """Reason codes of the gate in fixed order: 0.5 to 30 s, 20 dB and 0.6 are its limits."""
    return reasons((duration < 0.5, "too_short"), (duration > 30.0, "too_long"), (snr < 20.0, "noisy"), (silence > 0.6, "mostly_silence"))


def rounded(x, digits):
    """A double at so many decimals (4 at most) as printf has it: by the binary number's exact value, halves to the even digit,
    zeros with their sign. From 2^52 units of the last digit on by its shortest decimal."""
    scale = 10.0**digits
    low = F.floor(x * scale).cast("double")
    wide = x * 134217729.0  # 2^27 + 1: the leading 26 bits and the rest, whose products with the scale are exact
    head = wide - (wide - x)
    beyond = (head * scale - (low + 0.5)) + (x - head) * scale
    near = F.when((beyond > 0) | ((beyond == 0) & (low % 2 != 0)), low + 1.0).otherwise(low) / scale
    return F.when(F.abs(x * scale) < float(1 << 52), F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)).otherwise(F.bround(x, digits))


def quality_texts(duration, snr, clipping, silence, offset, peak, *, least_seconds=0.5, most_seconds=30.0, least_snr=20.0, most_clipping=0.001, most_silence=0.6, most_offset=0.01, least_peak=-40.0):
    """All reasons of the gate as texts with their measure, in fixed order; none: the clip passes."""
    f = lambda text, x, digits: F.format_string(text, rounded(x, digits))
    return reasons(
        (duration < least_seconds, f("too short (%.2fs)", duration, 2)), (duration > most_seconds, f("too long (%.2fs)", duration, 2)), (snr < least_snr, f("snr too low (%.1f dB)", snr, 1)),
        (clipping > most_clipping, f("clipped (%.4f%% of samples)", clipping * 100, 4)), (silence > most_silence, f("mostly silence (%.0f%%)", silence * 100, 0)),
        (F.abs(offset) > most_offset, f("dc offset (%+.4f)", offset, 4)), (peak < least_peak, f("level too low (peak %.1f dBFS)", peak, 1)),
    )
