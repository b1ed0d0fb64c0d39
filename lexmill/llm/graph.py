"""Connected components by contraction; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import staging


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for each node of an edge; root is the smallest node of its component.

    Each round every node points to the neighbour of least hash (or itself), pointers are followed once more,
    and nodes that met become one: a constant share of the nodes goes each round, on chains as on stars.
    Rounds are written to the shared folder. Hubs are cut down to one row a task before they are dealt out.
    """
    work = staging.stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    label = work.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = staging.stage(label.select("node", F.col("node").alias("root")), "labels")
    while not work.isEmpty():
        both = work.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(work.select(F.col("b").alias("u"), F.col("a").alias("v")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least("m", order("u"))["id"].alias("p"))
        to = staging.stage(to, "pointers")
        jump = staging.stage(to.alias("x").join(to.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("p")), "pointers")
        moved = label.join(jump, label.root == jump.u, "left").select("node", F.coalesce("p", "root").alias("root"))
        a = jump.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = jump.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        less = work.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old = (work, label, to, jump)
        label, work = staging.stage(moved, "labels"), staging.stage(less, "edges")
        staging.drop(*old)
    least = label.groupBy("root").agg(F.min("node").alias("least"))
    return staging.stage(label.join(least, "root").select("node", F.col("least").alias("root")), "components")
