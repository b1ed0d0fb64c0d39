"""Labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import workers

FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id isn't held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, featurise: Callable, schema: str) -> list:
    """Features and label of at most `most` documents that are labelled and not held out, chosen by a hash of
    their id, the same in each run; of several texts of an id the least counts. At most that many ids are broadcast, and features, not texts, come back."""
    workers.ship(docs.sparkSession)
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("y"))
    return sorted(rows.mapInArrow(featurise, f"doc_id long, y int, {schema}").collect(), key=lambda r: r.doc_id)
