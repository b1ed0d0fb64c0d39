"""Queries of the catalogue against their SQL, and functions on cases that the driver's tables don't hold."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.functions import columns as C
from lexmill.functions import numerals, unicode_text
from lexmill.operators import signal, voices
from lexmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _shown(v):
    """Whole numbers alike, whatever kind nulls beside them make of them."""
    if pd.isna(v):
        return "None"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _rows(df, columns):
    return sorted(tuple(map(_shown, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.oracles()[name]).df()
    got = catalogue.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("n", "words"),
    [(0, "പൂജ്യം"), (25, "ഇരുപത്തിയഞ്ച്"), (22, "ഇരുപത്തിരണ്ട്"), (101, "നൂറ്റിയൊന്ന്"), (250, "ഇരുനൂറ്റിയമ്പത്"), (1000, "ആയിരം"), (100000, "ഒരു ലക്ഷം"), (-5, "മൈനസ് അഞ്ച്")],
)
def test_cardinal(n, words):
    assert numerals.cardinal(n) == words


def test_numbers_out_of_range():
    for call in (lambda: numerals.cardinal(10**19), lambda: numerals.ordinal(0), lambda: numerals.spoken_digits("1a"), lambda: numerals.decimal("x")):
        with pytest.raises(numerals.NumberError):
            call()
    assert numerals.decimal("-2.50") == "മൈനസ് രണ്ട് പോയിന്റ് അഞ്ച് പൂജ്യം"


def test_normalize():
    text, counts = unicode_text.normalize("അവന്‍  \x07പറ‌ഞ്ഞു ൧൨…\n\n\n\nx")
    assert text == "അവൻ പറഞ്ഞു 12...\n\nx"
    assert (counts["chillu_composed"], counts["control_stripped"], counts["zero_width_stripped"], counts["digits_converted"]) == (1, 1, 1, 2)
    for t in ("ൻ‌റ", "ൻറ", "a  b", ""):
        once = unicode_text.normalize(t)[0]
        assert unicode_text.normalize(once)[0] == once


def test_word_error_rate(spark):
    rows = [("the cat sat", "the dog sat down", 2 / 3), ("a b c", "a b c", 0.0), ("a", "", 1.0), ("", "a", None)]
    df = spark.createDataFrame(rows, "r string, h string, want double").select(C.word_error_rate(F.col("r"), F.col("h")).alias("got"), "want")
    assert [(r.got, r.want) for r in df.collect()] == [(r[2], r[2]) for r in rows]


def test_token_buckets():
    b = voices.TokenBuckets(6)
    state = b.fresh(0.0)
    assert sum(b.check(state, 0.0, 1)[0] for _ in range(20)) == 9
    allowed, wait, _, reason = b.check(state, 0.0, 1)
    assert (allowed, wait, reason) == (False, 10.0, "requests")
    assert b.check(state, 10.0, 1)[0]


def test_speech_segments(spark):
    loud = {*range(10, 20), *range(40, 50)}
    frames = spark.createDataFrame([("a", i, 0.0 if i in loud else -60.0) for i in range(50)], "clip string, frame int, energy double")
    got = sorted((r.start, r.end) for r in signal.speech_segments(frames, "clip").collect())
    assert got == [(10, 19), (40, 50)]


def test_blocked_names_fold(spark):
    """Diacritics, composed or not, and full-width letters don't hide a name."""
    names = ["Jose\u0301 X", "JOS\u00c9", "jose", "\uff2a\uff4f\uff53\uff45", "Joe", "--", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [sorted(r.i for r in voices.blocked_names(df, "n", e).collect()) for e in (["Jose"], ["Jos\u00e9"], ["", "--"], [])] == [[0, 1, 2, 3], [0, 1, 2, 3], [], []]


def test_error_rates_of_one_word_spelled_twice(spark):
    """A chillu and its older spelling (letter, virama, joiner), and digits of both scripts, are no errors."""
    df = spark.createDataFrame([("\u0d05\u0d35\u0d7b \u0d67", "\u0d05\u0d35\u0d28\u0d4d\u200d 1"), (None, "x"), ("x", None), (" ", "x")], "r string, h string")
    for rate in (C.character_error_rate, C.word_error_rate):
        assert [r.x for r in df.select(rate(F.col("r"), F.col("h")).alias("x")).collect()] == [0.0, None, None, None]


def test_moderation_composes(spark):
    df = spark.createDataFrame([("Cafe\u0301",), ("CAF\u00c9",), ("cafe",), (None,)], "t string")
    got = df.select(C.moderation(F.col("t"), (("c", "block", "caf\u00e9"), ("d", "flag", "afe$"))).alias("m")).select("m.severity").collect()
    assert [r.severity for r in got] == ["block", "block", "flag", "allow"]


def test_word_error_rate_of_many_words(spark):
    """Beyond 35,327 distinct words a pair's letters were surrogates, then cut to four digits."""
    words = [f"w{i}" for i in range(50_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[36_000:36_010])), (" ".join(words), " ".join(words[49_990:]))], "r string, h string")
    assert [r.x for r in df.select((C.word_error_rate(F.col("r"), F.col("h")) * 50_000).alias("x")).collect()] == [49_990.0, 49_990.0]
    r, h = C.lettered(" ".join(words), " ".join(words))
    assert r == h and len(set(r)) == 50_000 and r.encode()
