"""Evaluation by cases: which are chosen, what came of each, and the report of all as one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.operators import reports, synthesis
from lexmill.sources import shared

#: Error of a case that nothing came of.
MISSING = "backend_unavailable"


def chosen(cases: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """The cases of these categories; without any named, all."""
    return cases if categories is None else cases.filter(F.col("category").isin(list(categories)))


def category_counts(cases: DataFrame) -> DataFrame:
    """key (category), n; most frequent first."""
    return reports.count_by(cases, "category")


def results(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row a case (id, category, text), whatever came of it. outcomes: id, normalized_text, audio_seconds,
    generation_seconds, heard (a transcript, or null) and error. A case with an error, or without an outcome, has no text,
    no audio, an infinite real-time factor and its error; rates are null where nothing was heard."""
    own = outcomes.select("id", F.col("normalized_text").alias("spoken"), "audio_seconds", "generation_seconds", "heard", F.col("error").alias("own_error"), F.lit(True).alias("there"))
    df = cases.select("id", "category", F.col("text").alias("input_text")).join(own, "id", "left")
    error = F.when(F.col("there").isNull(), MISSING).otherwise(F.col("own_error"))
    good = error.isNull()
    rtf = synthesis.real_time_factor(F.col("generation_seconds"), F.col("audio_seconds"))
    heard = good & F.col("heard").isNotNull()
    df = df.withColumn("asr_text", F.when(heard, F.col("heard")))
    return df.select(
        "id", "category", "input_text", F.when(good, F.coalesce("spoken", F.lit(""))).otherwise("").alias("normalized_text"),
        *[F.when(good, F.round(c, 3)).otherwise(0.0).alias(c) for c in ("audio_seconds", "generation_seconds")],
        F.when(good, F.round(rtf, 4)).otherwise(float("inf")).alias("real_time_factor"), "asr_text",
        C.character_error_rate(F.col("spoken"), F.col("asr_text")).alias("cer"), C.word_error_rate(F.col("spoken"), F.col("asr_text")).alias("wer"), error.alias("error"),
    )


def summary(done: DataFrame) -> DataFrame:
    """category, cases, errors, mean_cer, mean_wer and mean_real_time_factor of what has no error, by category and, as
    category null and overall 1, over all."""
    means = {f"mean_{c}": F.col(c) for c in ("cer", "wer")} | {"mean_real_time_factor": F.when(F.col("real_time_factor") < float("inf"), F.col("real_time_factor"))}
    return reports.synthesis_report(done, "category", F.col("error"), means)


def document(done: DataFrame, **about: str) -> str:
    """The report as one JSON document in UTF-8: what it is about, the summary and the failed cases, which are collected.
    The results themselves are a table."""
    fields = [F.lit(v).alias(k) for k, v in about.items()]
    whole = summary(done).select(F.struct("*").alias("row"))
    failed = done.filter("error IS NOT NULL").select(F.struct("id", "category", "error").alias("row"))
    lists = [df.agg(F.sort_array(F.collect_list("row")).alias(name)) for name, df in (("summary", whole), ("failed", failed))]
    one = lists[0].join(F.broadcast(lists[1]))
    return one.select(F.to_json(F.struct(*fields, "summary", "failed"), {"pretty": "true", "ignoreNullFields": "false"}).alias("text")).first().text


def write_document(done: DataFrame, path: str, **about: str) -> None:
    """The document as a new file."""
    if not shared.write_once(done.sparkSession, path, document(done, **about)):
        raise FileExistsError(path)
