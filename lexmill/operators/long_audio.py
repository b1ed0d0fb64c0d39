"""Clips of any length as rows of blocks (clip, block from 0, samples): loudness, gain and resampling block by block.

All blocks of a clip have one length but the last. Filters see a block with a halo, the ends of its neighbours, which are
exchanged as rows of their own; gates are aggregates over windows of 400 ms, which are sums over four hops of 100 ms. So
a task holds a block, and no row or window holds a clip.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import audio
from lexmill.operators.selection import with_facts
from lexmill.sources import shared

#: Zero crossings of the resampling kernel on each side, and the shape of its window.
CROSSINGS, SHAPE = 32, 9.0


def blocks_of(clips: DataFrame, clip: str, samples: str, size: int) -> DataFrame:
    """Rows of blocks of whole clips."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    parts = clips.filter(n > 0).select(F.col(clip).alias("clip"), F.posexplode(F.transform(starts, lambda i: F.slice(samples, i + 1, F.lit(size)))).alias("block", "samples"))
    return parts.select("clip", "block", F.col("samples").cast("array<float>").alias("samples"))


def with_halo(blocks: DataFrame, halo: int) -> DataFrame:
    """Adds before and after: up to `halo` samples of the neighbours. Blocks but the last are at least that long."""
    n = F.size("samples")
    own = blocks.select("clip", "block", F.lit(0).alias("side"), "samples")
    ends = F.when(n > halo, F.slice("samples", n - halo + 1, F.lit(halo))).otherwise(F.col("samples"))
    right = blocks.select("clip", (F.col("block") + 1).alias("block"), F.lit(-1).alias("side"), ends.alias("samples"))
    left = blocks.select("clip", (F.col("block") - 1).alias("block"), F.lit(1).alias("side"), F.slice("samples", 1, halo).alias("samples"))
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("samples")), ignorenulls=True)
    every = own.unionByName(right).unionByName(left).groupBy("clip", "block")
    none = F.array().cast("array<float>")
    met = every.agg(of(0).alias("samples"), F.coalesce(of(-1), none).alias("before"), F.coalesce(of(1), none).alias("after"))
    return met.filter("samples IS NOT NULL")


def _hops(rate: int, weighted: bool) -> Column:
    """Sums of squares of each whole hop of 100 ms of a block, after the weighting filters, which start in the halo."""
    step = rate // 10

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, samples in batches:
            out = []
            for b, x in zip(before, samples, strict=True):
                y = np.concatenate((b, x)).astype(np.float64)
                for f in audio._weighting(rate) if weighted else ():
                    y = audio._filtered(y, *f)
                y = y[len(b) :]
                out.append((y[: len(y) // step * step].reshape(-1, step) ** 2).sum(axis=1))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")("before", "samples")


def _level(power: Column) -> Column:
    return -0.691 + 10 * F.log10(F.greatest(power, F.lit(1e-30)))


def loudness(blocks: DataFrame, rate: int, size: int, *, weighted: bool = True, halo_seconds: float = 0.5) -> DataFrame:
    """clip, loudness, method, peak: as audio.loudness() of whole clips. size: samples of a block, a multiple of 100 ms of
    samples, which is a whole number."""
    if rate % 10 or size % (rate // 10):
        raise audio.AudioError("blocks are of a whole number of hops of 100 ms")
    halo, step = min(size, int(halo_seconds * rate)), rate // 10
    x = lambda v: v.cast("double")
    squares = F.aggregate("samples", F.lit(0.0), lambda a, v: a + x(v) * x(v))
    facts = blocks.groupBy("clip").agg(F.sum(squares).alias("squares"), F.sum(F.size("samples")).alias("n"), F.max(F.array_max(F.transform("samples", lambda v: F.abs(x(v))))).alias("peak"))
    hops = with_halo(blocks, halo).select("clip", "block", F.posexplode(_hops(rate, weighted)).alias("i", "e"))
    hop = F.col("block") * (size // step) + F.col("i")
    windows = hops.select("clip", "e", F.explode(F.sequence(hop - 3, hop)).alias("window")).filter("window >= 0").groupBy("clip", "window")
    windows = windows.agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("k")).filter("k = 4")
    heard = shared.written(windows.select("clip", (F.col("e") / (4 * step)).alias("power")).filter(_level(F.col("power")) >= -70), "windows")
    gate = shared.written(heard.groupBy("clip").agg(F.avg("power").alias("mean")), "gates")
    above = with_facts(heard, gate, ["clip"]).filter(_level(F.col("power")) > _level(F.col("mean")) - 10)
    gated = above.groupBy("clip").agg(_level(F.avg("power")).alias("gated"))
    rms = 10 * F.log10(F.col("squares") / F.col("n") + 1e-12)
    method = F.when(F.col("gated").isNull(), "rms_dbfs").otherwise("itu_bs1770")
    return facts.join(gated, "clip", "left").select("clip", F.coalesce("gated", rms).alias("loudness"), method.alias("method"), "peak")


def normalized(blocks: DataFrame, levels: DataFrame, *, target: float = -23.0, ceiling: float = -1.0, most: float = 30.0) -> DataFrame:
    """Blocks at the target, as far as gain limit and peak ceiling let them; levels: of loudness(). Silent clips stay."""
    gain = F.least(F.lit(target) - F.col("loudness"), F.lit(most), F.lit(ceiling) - 20 * F.log10(F.col("peak")))
    factor = F.when(F.col("peak") > 0, F.pow(F.lit(10.0), gain / 20)).otherwise(1.0)
    df = with_facts(blocks, shared.written(levels.select("clip", factor.alias("factor")), "gains"), ["clip"])
    return df.select("clip", "block", F.transform("samples", lambda v: F.greatest(F.least(v.cast("double") * F.col("factor"), F.lit(1.0)), F.lit(-1.0)).cast("float")).alias("samples"))


@lru_cache(maxsize=8)
def _bank(up: int, down: int) -> tuple[int, np.ndarray]:
    """A windowed sinc for each phase of up, over `reach` samples on each side, cut off at the lower of both rates."""
    cut = min(1.0, up / down)
    reach = math.ceil(CROSSINGS / cut)
    away = np.arange(up)[:, None] / up - np.arange(1 - reach, reach + 1)[None, :]
    window = np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (away / reach) ** 2))) / np.i0(SHAPE)
    bank = cut * np.sinc(cut * away) * np.where(np.abs(away) <= reach, window, 0)
    return reach, bank / bank.sum(axis=1, keepdims=True)


def resampled(blocks: DataFrame, rate: int, to: int, size: int) -> DataFrame:
    """Blocks of the clips at another rate, in the same blocks of time, by a polyphase filter; outside a clip is silence."""
    if to <= 0:
        raise audio.AudioError("a sample rate is positive")
    if to == rate:
        return blocks
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    reach = _bank(up, down)[0]
    if size < reach:
        raise audio.AudioError(f"blocks of {size} samples are shorter than the filter's reach of {reach}")
    facts = shared.written(blocks.groupBy("clip").agg(F.max("block").alias("last"), F.sum(F.size("samples")).alias("n")), "lengths")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        reach, bank = _bank(up, down)
        for columns in batches:
            out = []
            for block, last, n, before, x, after in zip(*columns, strict=True):
                # Sample k of the result lies at k * down / up.
                first = -(-block * size * up // down)
                end = max(1, round(n * to / rate)) if block == last else -(-(block + 1) * size * up // down)
                left, right = np.zeros(reach), np.zeros(reach + down)
                left[reach - len(before) :], right[: len(after)] = before, after
                whole = np.concatenate((left, np.asarray(x, np.float64), right))
                k = np.arange(first, end, dtype=np.int64) * down
                at, phase = k // up - block * size, k % up
                y = [(whole[at[i : i + 8192, None] + np.arange(1, 2 * reach + 1)] * bank[phase[i : i + 8192]]).sum(axis=1) for i in range(0, len(k), 8192)]
                out.append(np.concatenate(y).astype(np.float32) if y else np.empty(0, np.float32))
            yield pd.Series(out, dtype=object)

    df = with_facts(with_halo(blocks, reach), facts, ["clip"])
    return df.select("clip", "block", F.pandas_udf(run, "array<float>")("block", "last", "n", "before", "samples", "after").alias("samples"))
