"""Scans along sequences of any length: ranges in parallel, then their summaries, then ranges again.

What a scan must know of all that lies before a range fits into the range's summary (its first and last active frame and
how many runs begin inside), and summaries can be merged by prefix. So a task holds a range, or the summaries of a
sequence, one row for each of its ranges, but never a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.selection import with_facts
from lexmill.sources import shared

RANGE = 4096


def positions(rows: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """rows with their place, from 0, in the order of their key. Ranges of (key, order) are written, numbered inside, and
    moved by what the ranges before them hold."""
    range_, n, before = (shared.free_name(rows, c) for c in ("range", "n", "before"))
    ranged = shared.written(rows.repartitionByRange(key, *order).withColumn(range_, F.spark_partition_id()), "ranged")
    ahead = Window.partitionBy(key).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    size = ranged.groupBy(key, range_).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(key, range_).orderBy(*order)) - 1
    numbered = ranged.withColumn(name, turn).join(size, [key, range_])
    return numbered.withColumn(name, (F.col(name) + F.col(before)).cast("long")).select(*rows.columns, name)


def runs(active: DataFrame, key: str, place: str, idle: int, size: int = RANGE) -> DataFrame:
    """Runs of the places that active holds (key, place: long, each once): key, segment (from 1), start and end, their first
    and last place. More than `idle` places that aren't there end a run."""
    at = active.select(F.col(key).alias("key"), F.col(place).alias("place"), F.floor(F.col(place) / size).alias("range"))
    inside = Window.partitionBy("key", "range").orderBy("place")
    at = at.withColumn("gap", F.col("place") - F.lag("place").over(inside) - 1).withColumn("begins", F.coalesce(F.col("gap") > idle, F.lit(False)).cast("long"))
    summary = at.groupBy("key", "range").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("begins").alias("inner"))
    ahead = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("opens", F.coalesce(F.col("first") - F.max("last").over(ahead) - 1 > idle, F.lit(True)).cast("long"))
    summary = summary.withColumn("before", F.coalesce(F.sum(F.col("inner") + F.col("opens")).over(ahead), F.lit(0)) + F.col("opens"))
    so_far = F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = at.withColumn("segment", so_far).join(summary.select("key", "range", "before"), ["key", "range"])
    found = joined.groupBy("key", (F.col("segment") + F.col("before")).alias("segment")).agg(F.min("place").alias("start"), F.max("place").alias("end"))
    return found.withColumnRenamed("key", key)


def sized(rows: DataFrame, key: str, *facts) -> tuple[DataFrame, DataFrame]:
    """rows joined with facts (aggregates) of their key, and those facts."""
    own = shared.written(rows.groupBy(key).agg(*facts), "facts")
    return with_facts(rows, own, [key]), own
