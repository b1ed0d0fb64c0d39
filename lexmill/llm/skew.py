"""Joins of rows with facts about their keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT, FEW = 50_000, 1000


def joined(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with facts, which have one row a key. The column n of facts is how many rows have the key, or
    more; total is about the sum of n. Keys of more than total / MOST_HOT rows (and more than FEW) are so at most about
    MOST_HOT: rows that have one meet them by broadcast, in place; only the others are dealt out by key."""
    hot = F.col("n") > max(FEW, total // MOST_HOT)
    few = facts.filter(hot)
    there = rows.join(F.broadcast(few), on)
    return there.unionByName(rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(facts.filter(~hot), on))
