"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, mixing, near_dedup, pii, quality_classifier, staging


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more).

    Null and empty texts are scored by their length class, very long ones whole. Null ids are scored, and never
    learned from. Repeated rows: each by itself. Neighbours that tie for the last place: any of them. Empty table: empty result.
    Columns of any name pass through."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = staging.free_name(docs, "score")
    return quality_classifier.scored(docs, model, docs.columns, name).filter(F.col(name) >= 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest id.

    Null and empty texts and null ids are linked with nothing and stay. Of the rows that repeat an id the least (by
    all columns in order) stays. Empty table: empty result. Columns of any name pass through."""
    linked = near_dedup.link(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    linked = staging.stage(linked.filter("NOT kept OR n > 1"), "linked")
    named = docs.filter("doc_id IS NOT NULL")
    twice = linked.filter("kept").select("doc_id")
    once = named.join(linked.select("doc_id"), "doc_id", "left_anti")
    least = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    least = least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return once.select(*docs.columns).unionByName(least).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind in brackets, overlapping spans by one.

    A null text stays null, an empty one empty; very long texts are read whole. Repeated rows and null ids: each row
    by itself. Empty table: empty result. Columns of any name pass through; n_chars, where there is one, follows."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion of their target weights; documents repeat or are cut as the budgets ask.

    Null and empty texts hold no words and go; a null source is a source of its own. Repeated rows and null ids have
    each their own place in the mix; ties of the key go by id, size and text. Very long texts are cut like others.
    Empty table: empty result. Columns of any name pass through; n_chars, where there is one, follows."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests, with the number of tokens.

    A null text is read as empty: no tokens. Repeated rows and null ids: each row by itself. Very long texts are
    encoded whole. Empty table: empty result. Other columns don't matter, whatever their names."""
    return bpe.digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The stages are learned models and similarities, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staging.stage(docs, name)
    return docs
