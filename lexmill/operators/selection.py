"""Exact percentiles of groups of any size by narrowing histograms.

Each wanted rank has an interval of values that holds it. A round counts the rows of every open interval in 256 bins of
equal width, with the least and greatest value of each bin, and keeps the bin that holds the rank; so an interval loses at
least a factor of 256 of its width and always at least one value. It is open while it holds more than `most` rows of
different values. Then the rows of the one interval left are ranked. No task holds a group, only counts are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources import shared

BINS = 256
#: Facts of at most so many groups are broadcast.
FEW = 100_000


def with_facts(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Inner join with one or few rows for each key; facts are a written table, so that their number is known."""
    return rows.join(F.broadcast(facts) if facts.count() <= FEW else facts, by)


def _bin(x: Column, low: Column, high: Column) -> Column:
    """0 to BINS - 1, ascending with x; quarters, so that no difference overflows."""
    width = (high / 4 - low / 4) / BINS
    even = F.least(F.floor((x / 4 - low / 4) / width), F.lit(BINS - 1))
    return F.when(width > 0, even).otherwise(F.when(x == low, 0).otherwise(BINS - 1)).cast("int")


def quantiles(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float], most: int = 65_536) -> DataFrame:
    """by and a column for each name of fractions: the value at that fraction of the group's sorted values, between
    neighbours in proportion. Nulls, NaN and infinities have no place; a group of nothing else has no row."""
    named, by = by, [f"group{i}" for i in range(len(by))]
    kept = rows.select(*[F.col(c).alias(g) for c, g in zip(named, by, strict=True)], F.col(value).cast("double").alias("x")).filter("x = x AND abs(x) < double('infinity')")
    size = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in fractions.values()])))
    open_ = (F.col("n") > most) & (F.col("low") < F.col("high"))
    wanted = shared.written(size.select(*by, F.col("n").alias("all"), "n", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("rank")), "ranks")
    while not (some := wanted.filter(open_)).isEmpty():
        asked = shared.written(some.select(*by, "low", "high").distinct(), "intervals")
        there = with_facts(kept, asked, by).filter("x BETWEEN low AND high")
        seen = there.groupBy(*by, "low", "high", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("least"), F.max("x").alias("greatest"))
        below = F.sum("k").over(Window.partitionBy(*by, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        seen = seen.withColumn("below", F.coalesce(below, F.lit(0)))
        met = some.join(seen, [*by, "low", "high"]).filter("rank >= before + below AND rank < before + below + k")
        next_ = met.select(*by, "all", F.col("k").alias("n"), F.col("least").alias("low"), F.col("greatest").alias("high"), (F.col("before") + F.col("below")).alias("before"), "rank")
        wanted = shared.written(wanted.filter(~open_).unionByName(next_), "ranks")
    same = wanted.filter("low = high").select(*by, "all", "rank", F.col("low").alias("v"))
    inside = shared.written(wanted.filter("low < high").select(*by, "low", "high", "before").distinct(), "intervals")
    turn = F.row_number().over(Window.partitionBy(*by, "low", "high").orderBy("x")) - 1 + F.col("before")
    ranked = with_facts(kept, inside, by).filter("x BETWEEN low AND high").select(*by, turn.cast("long").alias("rank"), F.col("x").alias("v"))
    found = same.unionByName(ranked.join(wanted.filter("low < high").select(*by, "all", "rank"), [*by, "rank"]).select(*by, "all", "rank", "v"))
    value_at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    n = (F.col("all") - 1).cast("double")
    each = []
    for name, p in fractions.items():
        h = F.lit(float(p)) * n
        each += [value_at(F.floor(h)).alias(f"{name}_low"), value_at(F.ceil(h)).alias(f"{name}_high"), F.max(h - F.floor(h)).alias(f"{name}_part")]
    mixed = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name) for name in fractions]
    return found.groupBy(*by).agg(*each).select(*[F.col(g).alias(c) for c, g in zip(named, by, strict=True)], *mixed)
