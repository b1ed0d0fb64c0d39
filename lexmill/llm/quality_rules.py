"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, and the
posterior probability of quality decides, instead of the demand that every rule pass.

DataFrame functions only. A row is read once; what is kept of it are a few numbers, written to the shared
folder. Only the counts of vote patterns (at most 3^7) go to the driver.

Null or empty text: no words, all counts 0, base_failed. Null ids are kept; repeated rows: each is judged by itself. Very long
texts are measured whole. Other columns of the input don't matter, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import staging, weak_labels

SPACE = r"\x20\x09-\x0D"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the and of to in is that for with by on as it was are be at this or an from der die das und ist nicht mit sich ein eine zu den von für auf le la les et de des un une en que est pour dans par sur pas el los las del al por con para su se lo como más".split()


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to doc_id what the rules need; the words' 3-word windows are compared inside the row."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.select("doc_id", t.alias("t"), words.alias("words"), lines.alias("lines"))
    triples = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("triples", F.when(F.size("words") >= 4, F.sort_array(triples)))
    same = lambda j, x: F.coalesce(F.get("triples", j).h == x.h, F.lit(False))
    twice = F.filter("triples", lambda x, i: (F.when(i > 0, same(i - 1, x)).otherwise(False)) | same(i + 1, x))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")),
        lambda a: a.n,
    )
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    as_long = lambda c: c.cast("long")
    return df.select(
        "doc_id",
        as_long(F.size("words")).alias("n_words"),
        as_long(F.length(F.translate("t", " \t\n\x0b\f\r", ""))).alias("word_chars"),
        as_long(without("#*$%&|<>")).alias("n_symbols"),
        as_long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        as_long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        as_long(F.size("lines")).alias("n_lines"),
        as_long(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        as_long(without("!?")).alias("n_loud"),
        as_long(F.size(F.filter("words", lambda w: w.isin(*FUNCTION_WORDS)))).alias("n_function"),
    )


def votes() -> list[Column]:
    """One column for each rule: 1 for quality, -1 against, 0 abstains. A text without words gets no vote for it."""
    n, per = F.col("n_words"), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when((n > 0) & good, 1).otherwise(0)
    length = per("word_chars")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        vote(per("n_symbols") > 0.25, per("n_symbols") <= 0.05),
        vote(upper > 0.3, upper < 0.1),
        vote(lines > 0.3, F.col("n_dup_lines") == 0),
        vote(per("n_repeat_words") > 0.4, per("n_repeat_words") < 0.15),
        vote(per("n_loud") > 0.3, per("n_loud") < 0.1),
        vote((length < 2.5) | (length > 12), (length >= 3.5) & (length <= 9)),
        vote(per("n_function") < 0.02, per("n_function") >= 0.1),
    ]


def score(docs: DataFrame, *, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, quality_posterior and kept."""
    rows = staging.stage(with_measures(docs).withColumns({f"v{j}": v for j, v in enumerate(votes())}), "rules")
    names = [c for c in rows.columns if c[0] == "v" and c[1:].isdigit()]
    patterns = [([r[c] for c in names], r["n"]) for r in rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    # A rule knows one defect: it nearly never votes against a good text, and seldom sees what another rule sees.
    model = weak_labels.fit(sorted(patterns), prior=0.9, hit=0.99, miss=0.75)
    posterior = 1 / (1 + F.exp(-model.log_odds_column([F.col(c) for c in names]))) if patterns else F.lit(0.5)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("quality_posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= keep_at)).drop(*names)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_posterior")
