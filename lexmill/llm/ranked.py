"""Gapless places of rows in an order, group by group, with no group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm import skew, staging, workers


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with a column `name`: 0, 1, 2 ... within each value of the long column `group`, ascending by `order`.

    One exchange by ranges of (group, order) parts a hot group as it parts any rows that order tells apart. Each task
    counts on through its range, and the ranges' counts, one row for each range and group, say what lies before it.
    Ranges are written to the shared folder before they are counted. Rows that tie in all of order: in any turn.
    """
    workers.ship(rows.sparkSession)
    range_, turn_, before = (staging.free_name(rows, c) for c in ("range", "turn", "before"))

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, turn = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.asarray(batch.column(group))
            new = np.flatnonzero(np.diff(at)) + 1
            first = np.zeros(len(at), np.int64)
            first[new] = new
            turns = np.arange(len(at)) - np.maximum.accumulate(first)
            if at[0] == last:
                turns[: new[0] if len(new) else len(at)] += turn
            last, turn = at[-1], turns[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, pa.int64())], names=[*batch.schema.names, turn_])

    keys = [group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(range_, F.spark_partition_id().cast("long"))
    ranged = staging.stage(ranged.mapInArrow(count_on, StructType([*ranged.schema.fields, StructField(turn_, LongType())])), "ranged")
    size = ranged.groupBy(group, range_).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(group).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    size = staging.stage(size.withColumn(before, F.coalesce(F.sum("n").over(ahead), F.lit(0))), "range-sizes")
    total = size.agg(F.sum("n")).first()[0] or 0
    n = staging.free_name(rows, "n")
    ranged = ranged.withColumnRenamed("n", n) if "n" in rows.columns else ranged
    found = skew.joined(ranged, size, [group, range_], total).withColumn(name, F.col(turn_) + F.col(before)).drop(range_, turn_, before, "n")
    return found.withColumnRenamed(n, "n").select(*rows.columns, name) if "n" in rows.columns else found.select(*rows.columns, name)
