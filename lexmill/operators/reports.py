"""Balance and evaluation reports: one pass each, by grouping sets or conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rendered(df: DataFrame, field: str) -> Column:
    """A field as report key: null is None, booleans are True and False."""
    if field not in df.columns:
        raise ValueError(f"no field {field!r}; there are {', '.join(df.columns)}")
    text = F.col(field).cast("string")
    if isinstance(df.schema[field].dataType, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit("None"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    """key, n; most frequent first, then by key."""
    return df.groupBy(rendered(df, field).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def balance(df: DataFrame, dimensions: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """dimension, key and the measures for each value of each dimension and, as dimension `all`, over everything."""
    keyed = df.select("*", *[rendered(df, d).alias(f"__{d}") for d in dimensions])
    names = [f"__{d}" for d in dimensions]
    sets = [[n] for n in names] + [[]]
    out = keyed.groupingSets([[F.col(n) for n in s] for s in sets], *names).agg(F.grouping_id().alias("__id"), *[m.alias(k) for k, m in measures.items()])
    full = (1 << len(names)) - 1
    dimension, key = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        own = F.col("__id") == full - (1 << (len(names) - 1 - i))
        dimension, key = F.when(own, d).otherwise(dimension), F.when(own, F.col(f"__{d}")).otherwise(key)
    return out.select(dimension.alias("dimension"), key.alias("key"), *measures)


def hours(seconds: Column) -> Column:
    return F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600


def pass_rate(passed: Column) -> Column:
    """Share of the asserted that passed; 1.0 where nothing is asserted (null)."""
    return F.coalesce(F.count_if(passed) / F.nullif(F.count(passed), F.lit(0)), F.lit(1.0))


def mean_without_errors(value: Column, error: Column) -> Column:
    return F.avg(F.when(error.isNull(), value))


def by_category(df: DataFrame, category: str, passed: Column) -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("cases"), F.count(passed).alias("asserted"), F.count_if(passed).alias("passed"), pass_rate(passed).alias("pass_rate")
    )


def synthesis_report(df: DataFrame, category: str, error: Column, means: dict[str, Column]) -> DataFrame:
    """category, cases, errors and the means of what has no error, by category and, as category null, over all."""
    rows = df.withColumn("category", F.col(category)).groupingSets([[F.col("category")], []], "category")
    made = [F.count(F.lit(1)).alias("cases"), F.count(error).alias("errors"), F.grouping("category").cast("int").alias("overall")]
    return rows.agg(*made, *[mean_without_errors(v, error).alias(k) for k, v in means.items()]).orderBy("overall", "category")


def write_report(df: DataFrame, path: str) -> None:
    """One file of one JSON object a row, as is in UTF-8; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
