"""Scans in ranges, exact percentiles, blocklists as tables: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocklist, scans, selection, signal
from lexmill.operators.voices import folded_name

_rng = random.Random(3)


def runs_by_force(places, idle):
    out = []
    for p in sorted(places):
        if out and p - out[-1][1] - 1 <= idle:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(i + 1, a, b) for i, (a, b) in enumerate(out)]


@pytest.mark.parametrize("idle,size", [(0, 4), (3, 4), (9, 7), (40, 16)])
def test_runs_cross_ranges(spark, idle, size):
    held = {"a": [p for p in range(400) if _rng.random() < 0.3], "b": list(range(50, 300)), "c": [5], "d": [0, 15, 16, 31, 32, 399], "e": [399, 0]}
    rows = [(k, p) for k, v in held.items() for p in v]
    _rng.shuffle(rows)
    got = scans.runs(spark.createDataFrame(rows, "k string, p long"), "k", "p", idle, size).collect()
    assert sorted((r.k, r.segment, r.start, r.end) for r in got) == sorted((k, *x) for k, v in held.items() for x in runs_by_force(v, idle))
    assert scans.runs(spark.createDataFrame([], "k string, p long"), "k", "p", idle, size).count() == 0


def test_segments_of_a_long_recording_hold_no_clip_in_a_task(spark):
    """One clip with a run across all ranges: the same segments for any size of range, no window over the clip's frames."""
    frames = spark.range(20_000).select(F.lit(1).alias("clip"), F.col("id").cast("int").alias("frame"), F.when((F.col("id") > 3000) & (F.col("id") < 18_000) & (F.col("id") % 5 > 0), 0.0).otherwise(-60.0).alias("energy"))
    results = [sorted(map(tuple, signal.speech_segments(frames, "clip", size=size).collect())) for size in (64, 1000, 1 << 20)]
    assert results[0] == results[1] == results[2] == [(1, 1, 3001, 17_999)]
    wide = scans.runs(frames.filter("energy > -1"), "clip", "frame", 9, 64).withColumn("task", F.lit(0))
    assert wide.count() == 1


def test_positions(spark):
    rows = [(i % 3, _rng.random(), i) for i in range(3000)]
    got = scans.positions(spark.createDataFrame(rows, "k int, x double, i int"), "k", ["x", "i"]).collect()
    for k in range(3):
        want = sorted((x, i) for key, x, i in rows if key == k)
        assert [(r.x, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == want
        assert sorted(r.pos for r in got if r.k == k) == list(range(1000))


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_quantiles(spark, most):
    groups = {
        "even": [_rng.random() for _ in range(700)], "ties": [1.0] * 300 + [2.0] * 300 + [5.0], "one": [3.5], "far": [1e-300, 1e300, -1e308, 1e308, 0.0, 5e-324] * 3,
        "steep": [2.0**k for k in range(-60, 60)], "same": [7.0] * 500, "signed": [-x for x in range(200)],
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    at = {"least": 0.0, "low": 0.1, "third": 1 / 3, "middle": 0.5, "high": 0.9, "most": 1.0}
    got = {r.k: r for r in selection.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", at, most=most).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        with np.errstate(over="ignore", invalid="ignore"):
            want = [float(np.quantile(v, p)) for p in at.values()]
        if k != "far":
            assert [got[k][name] for name in at] == pytest.approx(want, rel=1e-12, abs=1e-300), k
    assert got["far"].least == -1e308 and got["far"].most == 1e308 and got["far"].middle == pytest.approx(5e-324, abs=1e-300)


NAMES = ["José Pérez", "jose perez", "ＪＯＳＥ", "Ann", "A", "", "---", None, "Company of Ann and Bob", "Bo", "x y", "supplier 17", "supplier 18", "Kim Lee-Park"]
ENTRIES = ["Jose", "perez", "ann", "b", "ob", None, "", "!", "the company of ann and bob inc", "supplier17", "supplier", "kimlee", "xyz", "José"]


@pytest.mark.parametrize("q", [2, 3, 5])
def test_blocklist(spark, q):
    names, entries = (spark.createDataFrame([(x,) for x in [*v, v[0]]], "t string") for v in (NAMES, ENTRIES))
    got = {tuple(r) for r in blocklist.blocked(names, "t", entries, "t", q).collect()}
    want = {(n, e) for n in NAMES for e in ENTRIES if n and e and (a := folded_name(n)) and (b := folded_name(e)) and (a in b or b in a)}
    assert got == want


def test_long_blocklist_meets_by_rare_grams(spark):
    """10,000 entries that share nearly all of their grams: each meets few names before it is verified."""
    names = spark.range(3000).select(F.format_string("supplier number %06d", F.col("id") * 7).alias("t"))
    entries = spark.range(10_000).select(F.format_string("number%06d", F.col("id")).alias("t"))
    got = blocklist.blocked(names, "t", entries, "t")
    assert got.count() == sum(7 * i < 10_000 for i in range(3000))


def test_frame_energy_and_floor(spark):
    x = [np.sin(i / 3) * (0.001 if 300 < i < 700 else 0.5) for i in range(1003)]
    rows = [("long", i, float(v)) for i, v in enumerate(x)] + [("short", 0, 0.5), ("short", 1, -0.5)]
    energy = signal.frame_energy(spark.createDataFrame(rows, "clip string, i long, v double"), "clip", "i", "v", 8)
    got = {(r.clip, r.frame): r.energy for r in energy.collect()}
    assert len(got) == 1003 // 8 + 1 and got["short", 0] == pytest.approx(20 * np.log10(0.5 + 1e-12))
    e = [20 * np.log10(np.sqrt(np.mean(np.square(x[8 * i : 8 * i + 8]))) + 1e-12) for i in range(125)]
    assert [got["long", i] for i in range(125)] == pytest.approx(e)
    least = [min(e[25 * w : 25 * w + 25]) for w in range(5)]
    report = {r.clip: r for r in signal.quality_report(energy, "clip").collect()}
    floor = np.quantile(least, 0.1)
    assert report["long"].floor == pytest.approx(floor) and report["long"].snr == pytest.approx(np.quantile(e, 0.9) - floor)
    assert report["long"].silence_ratio == pytest.approx(np.mean(np.array(e) < floor + 6))


def test_pieces_in_order(spark, tmp_path):
    """Pieces come in any order and twice over two runs of one query: each leaves once, in order; nothing stays in state."""
    from lexmill.streaming.pieces import in_order, in_order_of_data

    sent = [(k, i, [float(k), i / 10], 10, 100 * i, i == 6) for k in (1, 2, 3) for i in range(7)]
    df = spark.createDataFrame(sent, "utterance long, index int, samples array<float>, sample_rate int, pause_ms int, last boolean")
    came = str(tmp_path / "in")
    order = _rng.sample(range(7), 7)
    put = lambda ids: df.filter(F.col("index").isin(ids)).coalesce(1).write.mode("append").parquet(came)
    put(order[:3])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(came)
    sink = {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "mark")}

    def go():
        with in_order_of_data(spark):
            in_order(stream).writeStream.format("parquet").options(**sink).trigger(availableNow=True).start().awaitTermination()

    go()
    early = 0
    while early in order[:3]:
        early += 1
    left = lambda: sorted((r.utterance, r["index"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert left() == sorted((k, i) for k in (1, 2, 3) for i in range(early))
    put(order[2:5])  # one of them again
    put(order[5:])
    go()
    got = {(r.utterance, r["index"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(left()) == 21 and set(got) == {(k, i) for k in (1, 2, 3) for i in range(7)}
    assert all(r.samples == pytest.approx([k, i / 10, *[0.0] * i]) and r.error_code is None for (k, i), r in got.items())
    held = [spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "mark")).count() for name in ("due", "held")]
    assert held == [0, 0]


def test_pieces_wait_for_slow_batches(spark, tmp_path):
    """The second piece comes first, and the one it waits for two batches later, after the time to expire."""
    from lexmill.streaming.pieces import in_order, in_order_of_data

    df = spark.createDataFrame([(k, i, [1.0], 10, 0, i == 1) for k in range(40) for i in (1, 0)], "utterance long, index int, samples array<float>, sample_rate int, pause_ms int, last boolean")
    for part in ("index = 1 AND utterance > 0", "utterance = 0", "index = 0 AND utterance > 0"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def errors(expire_ms):
        out = str(tmp_path / f"out-{expire_ms}")
        with in_order_of_data(spark):
            in_order(stream, expire_ms).writeStream.format("parquet").options(path=out, checkpointLocation=out + "-mark").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out)
        return got.filter("error_code IS NULL").count(), got.filter("error_code IS NOT NULL").count()

    assert errors(None) == (80, 0) and errors(1)[1] > 0
