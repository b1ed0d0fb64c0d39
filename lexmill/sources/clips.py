"""WAV files as a table of clips, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.audio import CLIP, AudioError, decode_wav, resampled, wav_column


def read_clips(spark: SparkSession, path: str, *, sample_rate: int | None = None) -> DataFrame:
    """path, clip, error_code, error_message for each WAV file; at sample_rate if one is given."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch:
                try:
                    x, rate = decode_wav(data)
                    x, rate = (resampled(x, rate, sample_rate), sample_rate) if sample_rate else (x, rate)
                    out.append(({"samples": x, "sample_rate": rate}, None, None))
                except AudioError as e:
                    out.append((None, e.code, str(e)))
            yield pd.DataFrame(out, columns=["clip", "error_code", "error_message"], dtype=object)

    files = spark.read.format("binaryFile").load(path)
    done = F.pandas_udf(decode, f"clip {CLIP}, error_code string, error_message string")(F.col("content"))
    return files.select("path", done.alias("x")).select("path", "x.*")


def write_clips(clips: DataFrame, key: str, clip: Column, path: str) -> None:
    """Table of key, wav (whole files of 16-bit PCM): tasks may be run again, so the files are rows of one committed
    table and not written one by one."""
    clips.select(key, wav_column(clip)["value"].alias("wav")).write.mode("overwrite").parquet(path)
