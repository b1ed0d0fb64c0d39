"""Samples, pauses and utterances on cases that the driver's tables don't hold."""

import math

from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.operators import synthesis as S
from lexmill.plans import catalogue


def test_real_time_factor(spark):
    df = spark.createDataFrame([(0, 1.0, 4.0), (1, 1.0, 0.0), (2, None, 2.0), (3, 1.0, None)], "id int, g double, d double")
    got = [r.x for r in df.orderBy("id").select(S.real_time_factor(F.col("g"), F.col("d")).alias("x")).collect()]
    assert got[0] == 0.25 and math.isinf(got[1]) and got[2:] == [None, None]


def test_real_time_factor_rows_of_unknown_discounts(spark, tmp_path):
    import duckdb

    rows = [(1, 1, 1.0, 0.0), (1, 2, 1.0, None), (1, 3, None, 0.5), (1, 4, None, None), (1, 5, 1.0, -0.5), (2, 1, 17.000123, 0.07), (2, 2, 2.3e-6, 0.4), (2, 3, None, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.oracles()["real_time_factor_rows"]).fetchall())
    assert sorted(map(tuple, catalogue.real_time_factor_rows(spark, str(tmp_path)).collect())) == want


def test_unit_samples(spark):
    df = spark.createDataFrame([(0, [0.5, -2.0]), (1, [0.25, -0.5]), (2, []), (3, None)], "id int, x array<double>")
    assert [r.x for r in df.orderBy("id").select(S.unit_samples(F.col("x")).alias("x")).collect()] == [[0.25, -1.0], [0.25, -0.5], [], None]
    df = spark.createDataFrame([([16384, -32768],)], "x array<short>")
    assert df.select(S.unit_samples(F.col("x"), int16=True)).first()[0] == [0.5, -1.0]


def test_utterances(spark):
    rows = [("a", 2, [0.5], 1000, 0), ("a", 1, [0.25, 1.0], 1000, 3), ("b", 1, [], 1000, 2), ("c", 1, None, 1000, 9), ("d", 1, [1.0], 1000, None)]
    df = spark.createDataFrame(rows, "id string, at int, samples array<double>, sample_rate int, pause_ms int")
    got = {r.id: (r.samples, r.sample_rate, r.pieces) for r in S.utterances(df, "id", "at").collect()}
    assert got == {"a": ([0.25, 1.0, 0.0, 0.0, 0.0, 0.5], 1000, 2), "b": ([0.0, 0.0], 1000, 1), "d": ([1.0], 1000, 1)}
    assert S.utterances(df.limit(0), "id", "at").count() == 0


def test_pieces_as_a_stream(spark, tmp_path):
    pieces = spark.createDataFrame([(1, [0.5, 0.5], 1000, 2)], "at int, samples array<double>, sample_rate int, pause_ms int")
    pieces.write.parquet(str(tmp_path / "in"))
    padded = S.with_pause(F.col("samples"), F.col("sample_rate"), F.col("pause_ms")).alias("x")
    stream = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "in")).select("at", padded)
    stream.writeStream.format("memory").queryName("pieces").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert spark.table("pieces").first().x == [0.5, 0.5, 0.0, 0.0]


def test_fingerprint(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.fingerprint(F.col("t"))).collect()] == ["e3b0c44298fc", None]
