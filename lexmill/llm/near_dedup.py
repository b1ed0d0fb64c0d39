"""MinHash near-duplicates by an LSH forest, with links confirmed on full shingle sets.

Documents with equal sets are one class from the start. Each class has 20 signature orders of 6 minhashes.
In each order, classes that share the first 3 values lie in one region; a region of more than `crowd` classes
is entered deeper, by one value at a time, to at most 6. Classes of crowded regions are put into 60 further orders
of 6, the same 120 values dealt anew, which only the last turn below looks at, where two components hold them. Candidates of a class are its next neighbours in the order (their common prefix
is the longest) and the first class of its regions, as long as sizes or 120-bit sketches don't rule a similarity of
0.8 out. What is missed is chance: a pair at exactly 0.8 shares no region of 20 with probability
(1 - 0.8^3)^20 = 6e-7; where all regions it shares are crowded, none of 80 at depth 6 with about 1e-6.

Confirmation goes in three turns. First each class is held against its most alike candidate of smaller id; that
unites nearly all of what belongs together, one comparison a class. Then every candidate pair and every two
classes of a region of at most `crowd` that still lie in different components are held against each other. Last,
in regions crowded at the greatest depth and in those of the further orders, every class outside the largest component is held against all classes of
other components. So any two classes that share a last region end in one component or are compared, and the
texts compared grow with the classes, not with the pairs in a group. A class with very many partners is dealt
out in parts of 128, a region with very many classes by broadcast.

Null or empty text, or without words: n_shingles 0, linked with nothing, kept. A null doc_id: linked with
nothing, component null, kept. Repeated rows of an id: one component. Ties of a region's order: by id. Very long texts are read
whole, one at a time. Other columns don't matter, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import graph, skew, staging, workers
from lexmill.llm.text import U64, mix, shingle_sets, texts

TREES, DEPTH, FIRST = 20, 6, 3
CROWD = 64
#: Further orders of crowded regions' classes.
MORE = 60
#: Of 120 one-bit minhashes, at similarity 0.8, 12 differ; more than 40 with a probability of 3e-11, far under what the
#: forest itself leaves to chance.
MOST_UNEQUAL = 40
#: The same of 120 minhashes of 4 bits: 22.5 differ at similarity 0.8, more than 53 with a probability of 5e-11.
MOST_OTHER = 53
#: Strays whose sets a task holds at once.
HELD = 256
#: Rows of a batch whose texts a task copies at once.
ROWS = 256
_K = TREES * DEPTH
_FAMILY = 128


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * _K + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:_K] | U64(1), seeds[_K:]


_FACTOR, _FLIP = _parameters()


def signature(h: np.ndarray) -> np.ndarray:
    out = np.full(_K, ~U64(0))
    for at in range(0, len(h), 2048):
        np.minimum(out, ((h[at : at + 2048, None] ^ _FLIP) * _FACTOR).min(axis=0), out=out)
    return mix(out)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS at a time: what a task makes of their texts is held for no more of them at once. What tasks of
    other operators have left in the worker goes first."""
    workers.begin("near_dedup")
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top = U64(43)
    turn = np.arange(TREES, dtype=U64) * U64(0xD6E8FEB86659FD93)
    packed = lambda m, at: (((m[:, at] >> top) << U64(42)) | ((m[:, at + 1] >> top) << U64(21)) | (m[:, at + 2] >> top)).view(np.int64)
    for batch in _few(batches):
        ids, n, d1, d2, s1, s2, head, front, tail = batch.column("doc_id"), [], [], [], [], [], [], [], []
        for h in shingle_sets(texts(batch.column("text"))):
            n.append(len(h))
            if not len(h):
                for x in (d1, d2, s1, s2, head, front, tail):
                    x.append(None)
                continue
            digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            sig = signature(h)
            m = sig.reshape(TREES, DEPTH)
            sketch = np.frombuffer(np.packbits(np.append(mix(sig) & U64(1), np.zeros(8, U64)).astype(np.uint8)).tobytes(), np.int64)
            first = mix(mix(mix(m[:, 0] + turn) + m[:, 1]) + m[:, 2])
            for x, v in ((d1, int(digest[0])), (d2, int(digest[1])), (s1, int(sketch[0])), (s2, int(sketch[1])), (head, first.view(np.int64)), (front, packed(m, 0)), (tail, packed(m, 3))):
                x.append(v)
        long, longs = pa.int64(), pa.list_(pa.int64())
        arrays = [ids.cast(long)] + [pa.array(x, t) for x, t in ((n, long), (d1, long), (d2, long), (s1, long), (s2, long), (head, longs), (front, longs), (tail, longs))]
        yield pa.RecordBatch.from_arrays(arrays, names=_SIGNED)


_SIGNED = ["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "head", "front", "tail"]


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 120 values of each signature, from front and tail, in MORE other orders of 6; the ids of all its regions
    of 6 values, 4 bytes each, those of its own orders first; and 4 bits of each value as marks, 64 bytes in all."""
    low = U64((1 << 21) - 1)
    rng = np.random.default_rng(11)
    deal = np.concatenate([rng.permutation(_K) for _ in range(MORE * DEPTH // _K)]).reshape(MORE, DEPTH)
    for batch in batches:
        head, *lists = [np.asarray(batch.column(c).values.slice(batch.column(c).offsets[0].as_py(), batch.num_rows * TREES)).view(np.uint64).reshape(-1, TREES) for c in ("head", "front", "tail")]
        values = np.stack([(x >> U64(shift)) & low for x in lists for shift in (42, 21, 0)], axis=2).reshape(-1, _K)
        out = np.broadcast_to(np.arange(1, MORE + 1, dtype=U64) * U64(0xD6E8FEB86659FD93), (len(values), MORE))
        for i in range(DEPTH):
            out = mix(out + values[:, deal[:, i]])
        orders = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, MORE, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))
        ids = np.concatenate((_region_id(head, lists[1]), _region_id(out, U64(0))), axis=1)
        bits = np.zeros((len(values), 128), np.uint8)
        bits[:, :_K] = values & U64(15)
        binary = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (ids, bits[:, ::2] << 4 | bits[:, 1::2])]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("m"), orders, *binary], names=["rep", "m", "heads", "ids", "marks"])


def _region_id(head: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(head * U64(3) + key).astype(np.uint32)


_OF = ("rep", "s1", "s2", "m")


def _unequal(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) + F.bit_count(F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2")))


def _able(x: str, y: str, percent: int) -> F.Column:
    """False where sizes m or sketches rule the similarity out."""
    less, more = F.least(f"{x}m", f"{y}m"), F.greatest(f"{x}m", f"{y}m")
    return (100 * less >= percent * more) & (_unequal(x, y) <= MOST_UNEQUAL)


def forest(reps: DataFrame, crowd: int = CROWD) -> tuple[list[DataFrame], DataFrame]:
    """reps: rep, s1, s2, head, front, tail. Returns the regions of several classes, a table for each depth, with n and
    the first class (lrep, ls1, ls2) of each. What lies in a region of more than `crowd` classes is in the next table
    too. Also returns the classes that lie in such a region of the first table, with their further orders (heads), the
    ids of their regions and their marks."""
    rows = reps.select(*_OF, F.explode(F.arrays_zip("head", "tail")).alias("x"))
    rows = rows.select(*_OF, F.col("x.head").alias("head"), F.col("x.tail").alias("tail"), F.lit(0).cast("long").alias("key"))
    out = []
    for depth in range(FIRST, DEPTH + 1):
        out.append(_regions(rows, depth))
        if depth < DEPTH:
            rows = out[-1].filter(F.col("n") > crowd).select(*_OF, "head", "tail").withColumn("key", F.shiftrightunsigned("tail", 21 * (DEPTH - depth - 1)))
    some = out[0].filter(F.col("n") > crowd).select("rep").distinct()
    dealt = reps.join(some, "rep").select("rep", "m", "head", "front", "tail").mapInArrow(_dealt_again, "rep long, m long, heads array<long>, ids binary, marks binary")
    return out, staging.stage(dealt, "dealt-again")


def _regions(rows: DataFrame, depth: int) -> DataFrame:
    own = rows.groupBy("head", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_OF)).alias("l")).filter("n > 1")
    own = staging.stage(own.select("head", "key", "n", *[F.col(f"l.{c}").alias(f"l{c}") for c in _OF]), "regions-own")
    found = skew.joined(rows, own, ["head", "key"], _total(own))
    return staging.stage(found.withColumn("depth", F.lit(depth)), "regions")


_REGION = ["head", "depth", "key"]
_BLOCK = [*_REGION, "chunk", "part"]


def leaves(trees: list[DataFrame], crowd: int = CROWD) -> DataFrame:
    """The regions that aren't entered deeper: of at most `crowd` classes, or of the greatest depth."""
    out = trees[-1]
    for df in trees[:-1]:
        out = out.unionByName(df.filter(F.col("n") <= crowd))
    return out.select(*_OF, "tail", "n", *_REGION)


def candidates(trees: list[DataFrame], crowd: int = CROWD, percent: int = 80) -> DataFrame:
    """Returns a < b and how many bits of their sketches differ, once for each pair."""
    near = leaves(trees, crowd).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / crowd)))
    order = Window.partitionBy(*_REGION, "part").orderBy("tail", "rep")
    for j in (1, 2, 3):
        near = near.withColumn(f"p{j}", F.lag(F.struct(*_OF), j).over(order))
    near = near.select(*_OF, F.explode(F.filter(F.array("p1", "p2", "p3"), lambda p: p.isNotNull())).alias("p"))
    near = near.select(*_OF, *[F.col(f"p.{c}").alias(f"p{c}") for c in _OF]).filter(_able("p", "", percent))
    pairs = near.select(F.col("prep").alias("x"), F.col("rep").alias("y"), _unequal("p", "").alias("unequal"))
    for df in trees:
        first = df.filter((F.col("rep") != F.col("lrep")) & _able("l", "", percent))
        pairs = pairs.unionByName(first.select(F.col("lrep").alias("x"), F.col("rep").alias("y"), _unequal("l", "").alias("unequal")))
    pairs = pairs.filter("x <> y")
    return staging.stage(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("unequal").alias("unequal")), "pairs")


def merged(met: DataFrame, found: DataFrame) -> DataFrame:
    """Components met (node, root) after the links found: only those that a link joins are worked on."""
    at = lambda c: met.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    edges = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = graph.components(edges)
    moved = met.join(more.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return staging.stage(moved.unionByName(more.join(met.select("node"), "node", "left_anti").select("node", "root")), "components")


def with_component(classes: DataFrame, met: DataFrame) -> DataFrame:
    return classes.join(met.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("root", "rep")).drop("root")


def unsettled(at: DataFrame, of: tuple[str, ...] = _OF) -> DataFrame:
    """Those rows of with_component() whose region holds classes of several components; c is the component, main the
    region's largest one, n how many classes the region has, strays how many of them lie outside main. Columns `of`
    come along."""
    own = at.groupBy(*_REGION, "c").agg(F.count(F.lit(1)).alias("k")).groupBy(*_REGION)
    own = own.agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("strays")).filter("strays > 0")
    own = staging.stage(own, "several")
    return staging.stage(skew.joined(at.select(*of, "c", *_REGION), own, _REGION, _total(own)), "unsettled")


def _total(facts: DataFrame) -> int:
    return facts.agg(F.sum("n")).first()[0] or 0


def across(some: DataFrame, others: DataFrame, on: list[str], percent: int = 80) -> DataFrame:
    """Pairs a < b of some and others, both in one region and of two components, that sizes and sketches don't rule out."""
    x = some.select(*on, *[F.col(c).alias(f"x{c}") for c in (*_OF, "c")])
    y = others.select(*on, *[F.col(c).alias(f"y{c}") for c in (*_OF, "c")])
    return x.join(y, on).filter((F.col("xc") != F.col("yc")) & _able("x", "y", percent)).select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b"))


def crowded(rows: DataFrame, dealt: DataFrame, met: DataFrame, held, percent: int = 80, most: int = HELD, part: int = 4096) -> DataFrame:
    """Settles crowded regions, whose classes are rows, and those of the further orders, which dealt holds. Returns
    components.

    In each round, up to `most` strays (classes outside their region's largest component) of each region are held
    against all of its classes in other components, until no stray is left untried; `most` grows by 4 each round.
    A region whose strays have all had their turn is settled, whatever unites later: the next round has only the others.
    Two classes of the largest component need no comparison. Regions around one component hold much the same classes,
    so they are taken together where that makes fewer rows (gathered()). Members are dealt out in parts and strays in
    chunks of HELD, twice. First by marks and sizes alone: a task keeps those of one chunk, streams the members of one
    part past them and passes on the rows (never pairs) that have a counterpart they don't rule out. Only these rows
    meet their texts. Then by full sets, of which only links leave a task. Of the regions that two classes share, where
    each is by itself, only the first compares their sets. held(nodes) gives doc_id, text of nodes (doc_id).
    """
    # A class meets its component once, then goes to its regions.
    own = staging.stage(with_component(dealt.select("rep", "m", "marks", "heads"), met), "with-components")
    again = opened(own).select("rep", "m", "marks", "c", F.explode("heads").alias("head"), F.lit(DEPTH + 1).alias("depth"), F.lit(0).cast("long").alias("key"))
    tried, left = None, staging.stage(rows.select("rep", *_REGION).join(own.drop("heads"), "rep").unionByName(again), "crowded")
    while True:
        at = unsettled(left, ("rep", "m", "marks"))
        staging.drop(left)
        whole = at.filter(F.col("strays") > most).isEmpty()
        stray = at.filter("c <> main")
        if tried is not None:
            stray = stray.join(tried, ["rep", *_REGION], "left_anti")
        turn = F.row_number().over(Window.partitionBy(*_REGION).orderBy(F.xxhash64("rep"), "rep"))
        now = staging.stage(stray.withColumn("turn", turn).filter(F.col("turn") <= most), "strays")
        if now.isEmpty():
            return met
        parts = F.ceil(F.col("n") / part).cast("int").alias("parts")
        chunk = lambda c: F.floor((F.col(c) - 1) / HELD).cast("int")
        last = None
        if tried is None:  # every region has strays
            members = at.withColumn("last", F.least("strays", F.lit(most)))
        else:
            last = staging.stage(now.groupBy(*_REGION).agg(F.max("turn").alias("last"), F.max("n").alias("n")), "last")
            members = skew.joined(at.drop("n"), last, _REGION, _total(last))
        own = [*_REGION, "main", "rep", "c", "m", "marks", parts]
        members, strays = gathered(members.select(*own, (chunk("last") + 1).alias("chunks")), now.select(*own, chunk("turn").alias("chunk")), part)
        members = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        strays = strays.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        value = [F.col("rep").alias("node"), "c", "m", "marks"]
        both = members.select(*_BLOCK, F.lit(True).alias("child"), *value).unionByName(strays.select(*_BLOCK, F.lit(False).alias("child"), *value))
        both = both.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "child").mapInArrow(_sieved(percent), both.schema)
        both = staging.stage(both, "sieved")
        nodes = staging.stage(both.select(F.col("node").alias("doc_id")).distinct(), "members")
        if not nodes.isEmpty():
            texts_ = held(nodes).join(nodes, "doc_id", "left_semi").withColumnRenamed("doc_id", "node").join(dealt.select(F.col("rep").alias("node"), "ids"), "node")
            full = both.join(texts_, "node").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "child")
            found = staging.stage(full.select(*_BLOCK, "child", "node", "c", "marks", "ids", "text").mapInArrow(_streamed(percent), "a long, b long").distinct(), "links")
            met = merged(met, found)
        if whole:  # all strays of all regions have had their turn
            staging.drop(at, both, nodes, now, last)
            return met
        done = staging.stage(now.select("rep", *_REGION), "tried")
        tried = done if tried is None else tried.unionByName(done)
        left = staging.stage(with_component(at.filter(F.col("strays") > most).select("rep", "m", "marks", *_REGION), met), "crowded")
        staging.drop(at, both, nodes, now, last)
        most *= 4


#: Cells of the bitmap of heads, at most (4 MB); heads that a bucket of it is to see, and that a task holds.
CELLS, SEEN = 25, 1 << 20


def opened(own: DataFrame) -> DataFrame:
    """own (classes with their component c and their further regions, heads), where classes keep only those heads that
    classes of two components may have: a region of one component settles nothing, and most regions of unlike classes hold
    one class. A head is a cell of a bitmap of at most 4 MB; each task tells the least and greatest component of its cells,
    packed by ranges of cells, and those whose least and greatest differ over all tasks are set. Heads that share a cell
    by chance pass, none is lost, and what is dropped has made no row."""
    n = own.count() * MORE
    if not n:
        return own
    cells = min(CELLS, max(15, (64 * n).bit_length()))
    low = cells - min(cells - 3, max(0, (n // SEEN).bit_length()), 16)  # bits of a cell within its bucket
    heads = own.select(F.transform("heads", lambda h: F.pmod(F.xxhash64(h), F.lit(1 << cells))).alias("cells"), "c")
    told = heads.mapInArrow(_told(low), "bucket long, cell binary, least binary, most binary")
    schema = "bucket long, bits binary"

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, least, most = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("cell", "least", "most"))
        cell, least, most = _extremes(cell, least, most)
        bits = np.zeros(1 << low, np.uint8)
        bits[cell[least != most] - (int(pdf["bucket"].iloc[0]) << low)] = 1
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    table = np.zeros(1 << (cells - 3), np.uint8)
    for r in told.groupBy("bucket").applyInPandas(met, schema).collect():  # 4 MB in all
        table[r.bucket << (low - 3) : (r.bucket + 1) << (low - 3)] = np.frombuffer(r.bits, np.uint8)
    shared = own.sparkSession.sparkContext.broadcast(table)
    placed = own.withColumn("cells", F.transform("heads", lambda h: F.pmod(F.xxhash64(h), F.lit(1 << cells))))

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for h, p in zip(batch.column("heads").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cell = np.array(p, np.int64)
                hit = shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1
                kept.append(list(itertools.compress(h, hit.tolist())))
            names = [c for c in batch.schema.names if c != "cells"]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int64())) if c == "heads" else batch.column(c) for c in names], names=names)

    return placed.mapInArrow(sought, own.schema)


def _extremes(cell: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell once, ascending, with its least and greatest component."""
    order = np.argsort(cell, kind="stable")
    cell, least, most = cell[order], least[order], most[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
    return (cell[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)) if len(cell) else (cell, least, most)


def _told(low: int):
    """Cells (lists) and components of classes as one row for each bucket of cells, for every SEEN cells of a task."""

    def given(held: list) -> pa.RecordBatch:
        cell, least, most = _extremes(np.concatenate([x for x, _ in held]), *[np.concatenate([c for _, c in held])] * 2)
        bucket = cell >> low
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        parts = [[x[i:j].tobytes() for i, j in itertools.pairwise(edge)] for x in (cell, least, most)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), *[pa.array(x, pa.binary()) for x in parts]], names=["bucket", "cell", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column("cells")
            offsets = np.asarray(column.offsets)
            cell = np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.int64)
            held.append((cell, np.repeat(np.asarray(batch.column("c")), np.diff(offsets))))
            size += len(cell)
            if size > SEEN:
                yield given(held)
                held, size = [], 0
        if size:
            yield given(held)

    return run


def gathered(members: DataFrame, strays: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """Rows of regions (members with the number of chunks they meet, strays with their chunk, both with the number of
    parts), where the regions of one main component are one block, of depth 0, if that makes fewer rows. A class is in
    such a block once, not once a region; its strays are dealt into chunks by their hash. Else they stay as they are."""
    size = members.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("rows"), F.approx_count_distinct("rep").alias("some"))
    size = size.join(strays.groupBy("main").agg(F.sum("parts").alias("more"), F.approx_count_distinct("rep").alias("few")), "main")
    size = size.withColumn("cuts", F.ceil(F.col("few") / HELD).cast("int")).withColumn("shares", F.ceil(F.col("some") / part).cast("int"))
    size = staging.stage(size.select("main", "n", "cuts", "shares", (F.expr("some * cuts + few * shares") < F.col("rows") + F.col("more")).alias("one")), "mains")
    region = [F.when(F.col("one"), F.col("main")).otherwise(F.col("head")).alias("head"), *[F.when(F.col("one"), 0).otherwise(F.col(c)).alias(c) for c in ("depth", "key")]]
    parts = F.when(F.col("one"), F.col("shares")).otherwise(F.col("parts")).alias("parts")
    chunks = F.when(F.col("one"), F.col("cuts")).otherwise(F.col("chunks")).alias("chunks")
    chunk = F.when(F.col("one"), F.pmod(F.xxhash64("rep", F.lit(1)), "cuts").cast("int")).otherwise(F.col("chunk")).alias("chunk")
    total, value = _total(size), ["rep", "c", "m", "marks", parts]
    return tuple(skew.joined(x, size, ["main"], total).select(*region, *value, c).distinct() for x, c in ((members, chunks), (strays, chunk)))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) < len(y):
        x, y = y, x
    at = x.searchsorted(y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _held_values(c: list, m: list, marks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(c, np.int64), np.array(m, np.int64), np.frombuffer(b"".join(marks), U64).reshape(-1, 8)


def _counterparts(own: tuple[np.ndarray, np.ndarray, np.ndarray], c: int, m: int, marks: bytes, percent: int) -> np.ndarray:
    """Places in own (components, sizes, marks) of another component that sizes and marks don't rule out."""
    other = own[2] ^ np.frombuffer(marks, U64)
    other |= other >> U64(1)
    other |= other >> U64(2)
    unequal = np.bitwise_count(other & U64(0x1111111111111111)).sum(axis=1)
    return np.flatnonzero((own[0] != c) & (unequal <= MOST_OTHER) & (100 * np.minimum(own[1], m) >= percent * np.maximum(own[1], m)))


def _sieved(percent: int):
    """Rows of a block, strays first; yields those strays and members that have a counterpart in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, strays, own, hit, schema = None, [], None, (), None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)
        for batch in batches:
            schema, out = batch.schema, []
            at = {c: i for i, c in enumerate(schema.names)}
            values = lambda row: (row[at[c]] for c in ("c", "m", "marks"))
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[: len(_BLOCK)] != block:
                    out += itertools.compress(strays, hit)
                    block, strays, own, hit = row[: len(_BLOCK)], [], None, ()
                if not row[at["child"]]:
                    strays.append(row)
                    continue
                if not strays:  # none has the hash of this chunk
                    continue
                if own is None:
                    own, hit = _held_values(*zip(*map(values, strays))), np.zeros(len(strays), bool)
                found = _counterparts(own, *values(row), percent)
                if len(found):
                    hit[found] = True
                    out.append(row)
            yield made(out)
        if any(hit):
            yield made(list(itertools.compress(strays, hit)))

    return run


def _streamed(percent: int):
    """Rows of a block, strays first; yields pairs of a stray and a member of two components that are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, strays, sets, own, places, at = None, [], [], None, None, 0
        for batch in _few(batches):
            left, right = [], []
            columns = [batch.column(c).to_pylist() for c in (*_BLOCK, "child", "node", "c", "marks", "ids")]
            for *key, child, node, c, marks, ids, h in zip(*columns, shingle_sets(texts(batch.column("text"))), strict=True):
                if key != block:
                    block, strays, sets, own, places = key, [], [], None, []
                place = np.frombuffer(ids, np.uint32)
                if not child:
                    strays.append((node, c, len(h), marks))
                    sets.append(h)
                    places.append(place)
                    continue
                if own is None:
                    own, places = _held_values(*list(zip(*strays))[1:]), np.array(places)
                    here = _region_id(*(np.array([key[i]], np.int64).view(np.uint64) for i in (0, 2)))[0]
                    at = int((place == here).argmax())
                m = len(h)
                able = _counterparts(own, c, m, marks, percent)
                if key[1]:  # a region by itself
                    able = able[(places[able] == place).argmax(axis=1) == at]
                for i in able:
                    both = _common(sets[i], h)
                    if 100 * both >= percent * (len(sets[i]) + m - both):
                        left.append(min(strays[i][0], node))
                        right.append(max(strays[i][0], node))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in _few(batches):
            left, right = [], []
            for a, part, child, node, h in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "child", "node")), shingle_sets(texts(batch.column("text"))), strict=True):
                if not child:
                    at, own = (a, part), h
                elif at == (a, part):
                    both = _common(own, h)
                    if 100 * both >= percent * (len(own) + len(h) - both):
                        left.append(a)
                        right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, held: DataFrame, percent: int = 80) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike enough. held: doc_id, text of all nodes."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _FAMILY).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    children = pairs.join(size, "a").select("a", part, F.lit(True).alias("child"), F.col("b").alias("node"))
    parents = size.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("child"), F.col("a").alias("node"))
    rows = children.unionByName(parents).join(held.withColumnRenamed("doc_id", "node"), "node")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "child").select("a", "part", "child", "node", "text")
    return staging.stage(rows.mapInArrow(_compared(percent), "a long, b long"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _likely(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of docs whose id may be among ends, by one bit an id in 2^25: at most 1,024 bitmaps of 4 KB are broadcast,
    whatever the input. More ids let more rows pass; none is lost. It keeps most texts out of the shuffle that follows."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 25))
    bits = ends.select(at("doc_id").alias("at")).groupBy(F.shiftright("at", 15).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("__bits"))
    low = at("doc_id").bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(low, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("bit_get", byte, low.bitwiseAND(7).cast("int")) == 1
    rows = docs.select("doc_id", "text", F.shiftright(at("doc_id"), 15).alias("__bucket"))
    return rows.join(F.broadcast(bits), "__bucket").filter(held).select("doc_id", "text")


def link(docs: DataFrame, percent: int = 80, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    workers.ship(docs.sparkSession)
    signed = staging.stage(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, head array<long>, front array<long>, tail array<long>"), "signatures")
    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # What the first row of a class holds comes along in its aggregate: all rows of a class have equal signatures.
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "s1", "s2", F.col("n_shingles").alias("m"), "head", "front", "tail")).alias("first")
    classes = staging.stage(able.groupBy("d1", "d2").agg(first).select("d1", "d2", "first.*"), "classes")
    reps = classes.drop("d1", "d2")
    trees, dealt = forest(reps, crowd)
    pairs, last = candidates(trees, crowd, percent), leaves(trees, crowd)
    ends = staging.stage(_ends(pairs), "ends")
    held = staging.stage(_likely(docs, ends).join(ends, "doc_id"), "held")

    def texts_of(nodes: DataFrame) -> DataFrame:
        lacking = staging.stage(nodes.join(held, "doc_id", "left_anti"), "lacking")
        return held if lacking.isEmpty() else held.unionByName(_likely(docs, lacking).join(lacking, "doc_id"))

    best = staging.stage(pairs.groupBy("b").agg(F.min(F.struct("unequal", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "best")
    links = confirmed(best, held, percent)
    met = graph.components(links)
    at = lambda c: met.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    open_ = pairs.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    small = unsettled(with_component(last.filter(F.col("n") <= crowd), met))
    open_ = open_.unionByName(across(small, small, _REGION, percent)).distinct().join(best, ["a", "b"], "left_anti")
    open_ = staging.stage(open_, "open")
    more = confirmed(open_, texts_of(_ends(open_)), percent)
    if not more.isEmpty():
        met = merged(met, more)
    roots = crowded(last.filter(F.col("n") > crowd), dealt, met, texts_of, percent)
    ours = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return ours.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END) AS g FROM w),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
r AS (SELECT DISTINCT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.x
"""
