"""What a voice returns, as tables: samples, pauses between pieces, whole utterances, speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT16_SCALE = 32768.0


def real_time_factor(generation: Column, duration: Column) -> Column:
    """Seconds of work for a second of audio; infinity where there is no audio, null where either is null."""
    endless = F.when(duration.isNotNull() & generation.isNotNull(), F.lit(float("inf")))
    return F.when(duration > 0, generation.cast("double") / duration.cast("double")).otherwise(endless)


def unit_samples(samples: Column, *, int16: bool = False) -> Column:
    """Samples as array<float> in -1..1: 16-bit integers by their scale, then all by the peak where that is over 1.
    Null samples: null; none: none."""
    x = F.transform(samples, lambda s: s.cast("double") / (INT16_SCALE if int16 else 1.0))
    peak = F.array_max(F.transform(x, F.abs))
    return F.transform(x, lambda s: (s / F.greatest(peak, F.lit(1.0))).cast("float"))


def with_pause(samples: Column, rate: Column, pause_ms: Column) -> Column:
    """A piece's samples and the silence after it. Works row by row, so on a stream of pieces too."""
    n = F.floor(rate * F.greatest(F.coalesce(pause_ms, F.lit(0)), F.lit(0)) / 1000.0).cast("int")
    return F.concat(samples.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), n))


def utterances(pieces: DataFrame, by: str, order: str, samples: str = "samples", rate: str = "sample_rate", pause_ms: str = "pause_ms") -> DataFrame:
    """by, samples, sample_rate (the first piece's), pieces: pieces in order, each with its pause.

    An utterance's audio is one array in memory; its text is at most 5,000 characters, so that is bounded. A piece
    without samples adds nothing, an utterance without pieces has no row. Pieces of equal order go by their samples.
    """
    piece = F.struct(F.col(order), with_pause(F.col(samples), F.col(rate), F.col(pause_ms)).alias("x"), F.col(rate).alias("rate"))
    got = pieces.filter(F.col(samples).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return got.select(by, F.flatten("p.x").alias("samples"), F.col("p")[0]["rate"].alias("sample_rate"), F.size("p").alias("pieces"))
