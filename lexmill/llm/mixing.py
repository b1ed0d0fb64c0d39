"""Mixing sources to target weights.

Every document gets a hash-random key. Documents of a source lie in key order in about sqrt(n) ranges of the
key (n: the source's documents), so a range holds about sqrt(n) documents however large or hot the source is.
Sums of the ranges give each range's offset, a window inside the range the rest of the prefix sum, and the
source's budget is cut at its exact word, after as many whole epochs as the target holds.

Null text: size 0. Null source: a source of its own, last. Sources without words: target 0. Repeated rows:
each takes its own words. Ties of the key: by id, size and text. Very long texts count whole and are cut like others. Empty
table: empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import staging

SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")).cast("long")


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source: n, source_size, target. Sources in code-point order, null last, get the weights in turn
    and share all words by them; a target stops at `most` times its source, and what is over goes to the others.

    That sharing has one level: target = min(cap, level * weight). Sources with the least cap per weight fill
    first, so the level is the first (all words - caps so far) / (weights left) that the next cap doesn't stop.
    """
    per = rows.groupBy("no_source", "source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("no_source", "source_key")) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("no_source"), F.col("source_key"), F.col("level").alias("level")))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("no_source", "source_key", "n", "source_size", target.alias("target"))


_SOURCE = ["no_source", "source_key"]


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), *more,
    )


def _taken(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows with source_size, target and taken; sizes: the same rows, where all that isn't needed for sums may be missing."""
    aims = staging.stage(targets(sizes, weights, most), "targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(2**32)
    ranges = aims.select(*_SOURCE, F.ceil(F.sqrt("n")).cast("long").alias("ranges"))
    dealt = lambda df: df.join(ranges, _SOURCE).withColumn("range", F.floor(place * F.col("ranges"))).drop("ranges")
    sums = dealt(sizes).groupBy(*_SOURCE, "range").agg(F.sum("size").alias("range_size")).join(aims, _SOURCE)
    offset = F.sum("range_size").over(Window.partitionBy(*_SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    sums = sums.withColumn("offset", offset).withColumn("budget", F.floor("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    sums = sums.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy(*_SOURCE, "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    df = dealt(rows).join(sums.drop("range_size", "n"), [*_SOURCE, "range"]).withColumn("at", at)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at")))
    return df.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: words that the mix takes, repeats counted."""
    rows = staging.stage(_rows(docs), "sizes")
    return _taken(rows, rows, weights, most).select("doc_id", "source", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself, with the columns of docs: a document as often as its source's epochs ask, and where the
    budget cuts a document, its text up to the cut. Each row keeps its own place in the mix, whatever its id."""
    sizes = staging.stage(_rows(docs), "sizes")
    df = _taken(_rows(docs, F.struct(*docs.columns).alias("doc")), sizes, weights, most).filter("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    df = df.select("doc", "size", "taken", F.explode(copies).alias("copy"))
    left, text = F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("doc").getField("text")
    df = df.select("doc", F.when(left < F.col("size"), first_words(text, left)).otherwise(text).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lv,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r
  FROM s WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lv AS level FROM l WHERE lv * w <= cap ORDER BY r LIMIT 1),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM f) * w, CAST(cap AS DOUBLE))) AS target FROM s),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(size, greatest(0, budget - (budget // source_size) * source_size - place)) END AS BIGINT) AS taken
FROM x
"""
