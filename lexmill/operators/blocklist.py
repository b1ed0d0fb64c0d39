"""Names against a blocklist of any length, both as tables: a name is blocked if it holds an entry or an entry holds it.

Both sides are folded first. What holds a text holds all its grams of q letters, so each text is looked up by one gram
alone, the one that fewest texts of the other side have: only names and entries that share that gram meet, and each
meeting is verified. Texts under q letters are looked up whole among the other side's pieces of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.voices import folded_name

Q = 3


def folded(name: Column) -> Column:
    """As folded_name(); only names beyond ASCII go through Python, which has the Unicode normalisation that Spark lacks."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if n is None else folded_name(n) for n in batch], dtype=object)

    beyond = name.rlike(r"[^\x00-\x7f]")
    return F.when(beyond, F.pandas_udf(run, "string")(F.when(beyond, name))).otherwise(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def _pieces(texts: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """text and each distinct piece of low to high letters of it."""
    n = F.length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col(text), i, F.lit(k)))
    every = F.flatten(F.array(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(low, high + 1)]))
    return texts.select(text, F.explode(F.array_distinct(every)).alias("gram"))


def holding(holders: DataFrame, holder: str, held: DataFrame, text: str, q: int = Q) -> DataFrame:
    """Pairs holder, text, where the text is a part of the holder. Both sides distinct, not null, not empty."""
    grams = _pieces(holders, holder, q, q)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    own = _pieces(held.filter(F.length(text) >= q), text, q, q).join(often, "gram", "left")
    rarest = own.groupBy(text).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("least")).filter("least.often > 0").select(text, F.col("least.gram").alias("gram"))
    met = rarest.join(grams, "gram").filter(F.contains(holder, text)).select(holder, text)
    short = held.filter(F.length(text) < q).join(_pieces(holders, holder, 1, q - 1).withColumnRenamed("gram", text), text)
    return met.unionByName(short.select(holder, text))


def blocked(names: DataFrame, name: str, entries: DataFrame, entry: str, q: int = Q) -> DataFrame:
    """Pairs name, entry (as given, each pair once), where one holds the other once both are folded. Null names and entries,
    and those without letters or digits, match nothing."""
    n = names.select(F.col(name).alias("name")).distinct().withColumn("n", folded(F.col("name"))).filter("n <> ''")
    e = entries.select(F.col(entry).alias("entry")).distinct().withColumn("e", folded(F.col("entry"))).filter("e <> ''")
    own, listed = n.select("n").distinct(), e.select("e").distinct()
    pairs = holding(own, "n", listed, "e", q).unionByName(holding(listed, "e", own, "n", q).select("n", "e")).distinct()
    return pairs.join(n, "n").join(e, "e").select("name", "entry")
