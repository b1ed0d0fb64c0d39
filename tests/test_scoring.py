"""Edit parts, challenge tokens, script runs and small columns against plain Python."""

import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lexmill.functions import codemix, columns, scoring
from lexmill.operators import signal, synthesis
from lexmill.sources import listings


def test_edits():
    def cost(r, h):
        table = {(0, j): j for j in range(len(h) + 1)} | {(i, 0): i for i in range(len(r) + 1)}
        for i, j in itertools.product(range(1, len(r) + 1), range(1, len(h) + 1)):
            table[i, j] = min(table[i - 1, j - 1] + (r[i - 1] != h[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
        return table[len(r), len(h)]

    rng = random.Random(1)
    for _ in range(300):
        r, h = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        s, d, n = scoring.edits(r, h)
        assert s + d + n == cost(r, h) and n - d == len(h) - len(r)
    assert scoring.edits([], list("ab")) == (0, 0, 2) and scoring.edits(list("ab"), []) == (0, 2, 0) and scoring.edits(list("abc"), list("axc")) == (1, 0, 0)


def test_challenges(spark):
    df = spark.createDataFrame([('{"a": "മഴ"}',), (None,)], "body string").select("body", scoring.challenge_tokens(F.col("body"), b"k").alias("t"))
    for r in df.select("body", scoring.challenge_bodies(F.col("t"), b"k").alias("b")).collect():
        assert r.b.value == r.body and r.b.error_code is None
    bad = df.filter("t IS NOT NULL").select(F.explode(F.array(F.concat("t", F.lit("A")), F.concat(F.lit("A"), "t"), F.lit("nothing"), F.lit("a.b.c"))).alias("t"))
    assert all(r.b.error_code == "consent_required" for r in bad.select(scoring.challenge_bodies(F.col("t"), b"k").alias("b")).collect())


def test_script_runs(spark):
    """Each character of the basic plane, between two letters, falls in the class that segments() gives it."""
    rows = [(f"x{chr(c)}x",) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [("ab12മഴ, cd",), ("",)]
    got = spark.createDataFrame(rows, "t string").select("t", *[codemix.script_runs(F.col("t"), k).alias(k) for k in ("malayalam", "latin", "digit", "other")]).collect()
    for r in got:
        kinds = [s["script"] for s in codemix.segments(r.t)]
        assert {k: r[k] for k in ("malayalam", "latin", "digit", "other")} == {k: kinds.count(k) for k in ("malayalam", "latin", "digit", "other")}, hex(ord(r.t[1]))


def test_small_columns(spark):
    one = spark.range(1)
    row = one.select(
        columns.reference_plausibility(F.lit("  "), F.lit(5.0)).alias("none"), columns.reference_plausibility(F.lit("a" * 80), F.lit(0.0)).alias("zero"), columns.worst(("ok", "warn", "fail"), F.array().cast("array<string>")).alias("calm"),
        columns.consent_phrase(F.lit(" "), F.array(F.lit("x")), F.lit("2024-01-02").cast("date")).alias("nobody"), synthesis.unit_samples(F.array(F.lit(16384)), int16=True).alias("unit"), columns.stock_moderation(F.lit("hello"), ["hel+o"]).alias("extra"),
    ).first()
    assert row.none.error_code == "validation_error" and row.zero.characters_per_second == float("inf") and row.calm == "ok" and row.nobody is None and row.unit == [0.5]
    assert (row.extra.severity, row.extra.rules) == ("block", ["extra_1"])


def test_listing_edges(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert listings.read_blocklist(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.warns(UserWarning):
        assert listings.read_blocklist(spark, str(tmp_path)).count() == 0
    assert listings.write_manifest(spark.range(3).selectExpr("string(id) AS id"), str(tmp_path / "m")) == 3
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        listings.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def _parts_by_table(r, h):
    table = {(i, j): i + j for i in range(len(r) + 1) for j in range(len(h) + 1) if not i or not j}
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            table[i, j] = min(table[i - 1, j - 1] + (r[i - 1] != h[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
    i, j, s, d, n = len(r), len(h), 0, 0, 0
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (r[i - 1] != h[j - 1]):
            i, j, s = i - 1, j - 1, s + (r[i - 1] != h[j - 1])
        elif i and table[i, j] == table[i - 1, j] + 1:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return s, d, n


def test_parts_are_those_of_the_whole_table():
    rng = random.Random(8)
    for _ in range(600):
        r = [rng.choice("abc") for _ in range(rng.randint(0, 45))]
        h = [rng.choice("abcd") for _ in range(rng.randint(0, 45))] if rng.random() < 0.6 else [rng.choice([w, w, w, "z"]) for w in r][rng.randint(0, 3) :]
        assert scoring.edits(r, h) == _parts_by_table(r, h)


def test_long_pairs_need_little_memory():
    rng = random.Random(9)
    r = [str(rng.randint(0, 5000)) for _ in range(100_000)]
    h = [*r[:30_000], "new", *r[30_000:60_000], *r[60_004:90_000], "other", *r[90_001:]]
    tracemalloc.start()
    assert scoring.edits(r, h) == (1, 4, 1)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_measures_round_as_printf_does(spark):
    rng = random.Random(5)
    numbers = [50.725, 168.525, 2.5, 3.5, -2.5, 0.125, 0.375, -0.04, 0.05, 1.005, 2.675, 1e-300, -1e-9, 0.0, 1e17, 4503599627370497.5, *(rng.randrange(10**6) / 1000 for _ in range(500)), *(rng.random() * 100 for _ in range(200))]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = df.select("x", *[F.format_string(f"%.{d}f", signal.rounded(F.col("x"), d)).alias(f"d{d}") for d in (0, 1, 2, 4)]).collect()
    assert [(r.x, r[f"d{d}"]) for r in got for d in (0, 1, 2, 4)] == [(x, f"{x:.{d}f}") for x in numbers for d in (0, 1, 2, 4)]


def test_pairs_together_are_those_one_by_one():
    rng = random.Random(7)
    text = lambda most: [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(most))]
    pairs = [(text(30), text(30)) for _ in range(400)] + [([], []), ([], ["a"]), (["a"], []), (["a"] * 600, ["b", "a"]), (text(500), text(500))]
    assert scoring.edits_of_pairs(pairs) == [scoring.edits(*p) for p in pairs] and scoring.edits_of_pairs([]) == []


def test_script_counts(spark):
    rng = random.Random(8)
    texts = [None, "", *("".join(rng.choice("ab1 ൦൧കഖ\u0663²,.\nZ\U0001f600") for _ in range(rng.randrange(12))) for _ in range(300))]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", codemix.script_counts(F.col("text")).alias("n")).select("id", "n.*").collect()
    want = {i: [None if t is None else [s["script"] for s in codemix.segments(t)].count(k) for k in ("malayalam", "latin", "digit", "other")] for i, t in enumerate(texts)}
    assert {r.id: list(r[1:]) for r in got} == want
