"""Exact top-k by inner product as a Voronoi kNN join.

Data are grouped by their nearest pivot. Summaries of the groups (radius, greatest norm, members next to the
pivot) are small and go to every task. From the members in the summaries a query has k real scores at once,
so its k-th best score is known from below; a group can hold a better vector only if q.p + |q| * radius, and
|q| * greatest norm, reach that. Queries are grouped by pivot too, neighbouring groups packed into shares of bounded
size and large ones split. Of the two sides the queries are by far the smaller one, so it is they that are
replicated, to the groups their bounds admit; a block of data goes once to each share that has a query for it, and
to no other. Each block is solved by itself. Bounds are rounded outwards; scores are exact integers.

Equal vectors are one vector with the k + 1 smallest of its ids: more can't be among anyone's k best. They are
cut down in each task before they are dealt out, so a hot vector doesn't meet in one task.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; rows that repeat
an id and a vector count once. Vectors of unequal length are compared in the components that both have.
A component or a score that doesn't fit a long is an error. Ties: the smaller vec_id. Other columns don't matter, whatever their
names. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import staging, workers

BLOCK = 4096


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in column]) if len(column) else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers; by floating point where every partial sum is an exact double. OverflowError where a
    product doesn't fit a long."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(map(abs, exact.ravel())) >= 1 << 63:
        raise OverflowError("a score doesn't fit a long")
    return exact.astype(np.int64)


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component; only vectors that take part, padded with 0 to one length."""
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    far = F.raise_error(F.lit("a component times the scale doesn't fit a long")).cast("long")
    whole = lambda e: F.when(F.abs(e) < 2.0**63, F.floor(e).cast("long")).otherwise(far)
    df = rows.filter(good).select("vec_id", F.transform(x, lambda e: whole(e.cast("double") * scale)).alias("v"))
    width = df.agg(F.max(F.size("v"))).first()[0] or 0
    return df.withColumn("v", F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))))


def top_k(rows: DataFrame, *, k: int = 5, every: int = 50, pivots: int | None = None, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all other rows.
    pivots: how many, where there are as many distinct vectors; a sample of them, by hash. By default a quarter of the root
    of their number, 64 at least and 4,096 at most, so that cells grow more slowly than the data. told, where given, hears how
    many cells there are, and how many pairs of a query and a cell were solved."""
    spark = rows.sparkSession
    workers.ship(spark)
    base = staging.stage(integers(rows), "vectors")
    ids = Window.partitionBy("v").orderBy("vec_id")
    few = base.distinct().withColumn("r", F.row_number().over(ids)).filter(F.col("r") <= k + 1)
    data = staging.stage(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    n = data.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = min(pivots or max(64, min(4096, math.isqrt(n) // 4)), n)
    centre = np.array([r.v for r in data.orderBy(F.xxhash64("v"), "v").select("v").limit(count).collect()], dtype=np.int64).reshape(count, -1)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centre.astype(float) ** 2).sum(1)
        for pdf in batches:
            v = _matrix(pdf.v).astype(float)
            away = np.maximum((v**2).sum(1)[:, None] - 2 * v @ centre.T.astype(float) + half, 0)
            cell = away.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), away=np.sqrt(away[np.arange(len(v)), cell]), norm=np.sqrt((v**2).sum(1)))

    placed = staging.stage(data.mapInPandas(cells, "v array<long>, ids array<long>, cell int, away double, norm double"), "cells")
    near = placed.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("away", "v"))).filter(F.col("r") <= k + 1)
    members = near.select("v", F.size("ids").alias("n")).collect()  # at most pivots * (k + 1) vectors
    bounds = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).orderBy("cell").collect()
    shown, copies = np.array([m.v for m in members], dtype=np.int64).reshape(len(members), -1), np.array([m.n for m in members])
    cell = np.array([b.cell for b in bounds])
    radius, longest = (np.array([b[x] for b in bounds]) * (1 + 1e-9) + 1e-6 for x in ("radius", "norm"))
    blocks = np.array([-(-b.n // BLOCK) for b in bounds])
    asked = base.filter(F.col("vec_id") % every == 0)
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("asker"))
    queries = staging.stage(queries.mapInPandas(cells, "v array<long>, asker long, cell int, away double, norm double").select("v", "asker", F.col("cell").alias("home")), "queries")
    per = {r.home: r["count"] for r in queries.groupBy("home").count().collect()}  # at most one row a pivot
    share_of, room, share = {}, 2 * BLOCK, 0
    for home in sorted(per):
        parts = -(-per[home] // (2 * BLOCK))
        if parts > 1 or per[home] > room:
            share, room = share + (room < 2 * BLOCK), 2 * BLOCK
        share_of[home] = (share, parts)
        share, room = (share + parts, 2 * BLOCK) if parts > 1 else (share, room - per[home])

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for at in range(0, len(big), 512):
                pdf = big.iloc[at : at + 512]
                q = _matrix(pdf.v)
                scores = products(q, shown)
                weight = np.where((q[:, None, :] == shown[None]).all(2), 0, copies)  # not its own copies
                order = np.argsort(-scores, axis=1, kind="stable")
                enough = np.take_along_axis(weight, order, 1).cumsum(1) >= k
                kth = np.where(enough.any(1), np.take_along_axis(scores, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], -np.inf)
                norm = np.sqrt((q.astype(float) ** 2).sum(1))[:, None] * (1 + 1e-9)
                most = np.minimum(q.astype(float) @ centre[cell].T.astype(float) + norm * radius, norm * longest) + 1e-3
                row, col = np.nonzero(most >= kth[:, None])
                times = blocks[col]
                row, col = row.repeat(times), col.repeat(times)
                block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0)
                yield pd.DataFrame({"cell": cell[col].astype(np.int32), "block": block.astype(np.int32), "home": pdf.home.to_numpy()[row], "asker": pdf.asker.to_numpy()[row], "v": pdf.v.to_numpy()[row]})

    block_of = F.element_at(F.create_map(*[F.lit(int(x)) for c, b in zip(cell, blocks, strict=True) for x in (c, b)]), F.col("cell"))
    first, parts = (F.element_at(F.create_map(*[F.lit(x) for home, y in share_of.items() for x in (home, y[i])]), F.col("home")) if share_of else F.lit(0) for i in (0, 1))
    sent = queries.mapInPandas(replicate, "cell int, block int, home int, asker long, v array<long>").withColumn("share", (first + F.pmod(F.xxhash64("asker"), parts)).cast("int")).drop("home")
    sent = staging.stage(sent, "sent")
    routes = staging.stage(sent.select("cell", "block", "share").distinct(), "routes")
    if told is not None:
        told.update(cells=len(cell), pairs=sent.select("asker", "cell").distinct().count())
    mine = placed.select("cell", F.pmod(F.xxhash64("v"), block_of).cast("int").alias("block"), "v", "ids").join(routes, ["cell", "block"])
    key = ["cell", "block", "share"]

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asker": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        owner = np.arange(len(right)).repeat([len(x) for x in right.ids])
        every_id = np.concatenate([np.asarray(x, dtype=np.int64) for x in right.ids])
        order = np.argsort(every_id, kind="stable")
        owner, every_id = owner[order], every_id[order]
        x, found = _matrix(right.v), []
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            scores = products(_matrix(part.v), x)[:, owner]
            best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]  # of equal scores the smaller id
            found.append(pd.DataFrame({"asker": part.asker.to_numpy().repeat(best.shape[1]), "vec_id": every_id[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(found)

    local = sent.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(solve, "asker long, vec_id long, score long")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    top = local.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("asker", "vec_id", "score")
    who = asked.select(F.col("vec_id").alias("query_id"), "v").distinct().join(queries, "v").select("query_id", "asker")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    out = who.join(top, "asker").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
