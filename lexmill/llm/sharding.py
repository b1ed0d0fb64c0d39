"""Shards of near equal bytes by a histogram sort.

Rows lie in the order of a key: a hash of their group (equal texts), then a hash of their id, then their place in the
written key table. The shards' boundaries are found before any row moves. Each round counts, task by task, the exact
bytes below up to 63 probes in every boundary's interval, adds the counts up and keeps the one gap that holds the target;
hash keys lie evenly, so each round leaves a 64th. A boundary is settled when its gap holds a single group: it goes to
that group's nearer edge, if this is within `tolerance` of a shard's size of the target. A larger group is entered by
the hash of ids, then by place, and cut at the row edge nearest to the target. Then rows are exchanged once, by ranges.

A hot group, of a third of all bytes say, so is cut as often as shards need it, and other groups are hardly ever cut.
A row larger than a shard can't be cut: the boundaries that fall into it go to its nearer edge, and shards may be empty.

Null text: no bytes, crc32 0, a group of its own. Null ids come first in their group. Repeated rows: each by itself.
Ties of both hashes: by place, so only equal rows change places between runs. Very long texts count whole. Empty table:
empty result. Other columns come along in shard(), whatever their names, and don't matter in the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import ranked, staging, workers

#: Hashes are 60 bits, 15 hexadecimal digits.
TOP = 1 << 60
PROBES = 63


def _key(column: Column) -> Column:
    """A hash from 1 to TOP - 1; null: 0."""
    hashed = F.conv(F.substring(F.md5(F.encode(column.cast("string"), "UTF-8")), 1, 15), 16, 10).cast("long")
    return F.when(column.isNull(), F.lit(0)).otherwise(F.greatest(hashed, F.lit(1)))


@dataclass
class Boundary:
    """A target (bytes below the boundary) and the interval of keys that holds it, with the exact bytes below both ends."""

    target: int
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = TOP
    below: int = 0
    above: int = 0
    at: tuple[int, ...] | None = field(default=None)

    def probes(self) -> np.ndarray:
        """Keys within the interval, evenly."""
        step = max(1, -(-(self.high - self.low) // (PROBES + 1)))
        return np.arange(self.low + step, self.high, step, dtype=np.int64)


def _histogram(keys: list[str], size: str, open_: list[tuple[tuple[int, ...], int, int, np.ndarray]]):
    """Of each open interval (prefix, low, high, probes) and each gap between its probes: bytes, rows, least and greatest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros((2, len(p) + 1), np.int64), np.full(len(p) + 1, TOP), np.full(len(p) + 1, -1)) for *_, p in open_]
        for batch in batches:
            columns, sizes = [np.asarray(batch.column(c)) for c in keys], np.asarray(batch.column(size))
            for (prefix, low, high, probes), (sums, least, most) in zip(open_, total, strict=True):
                key = columns[len(prefix)]
                here = (key >= low) & (key < high)
                for c, v in zip(columns, prefix, strict=False):
                    here &= c == v
                k = key[here]
                gap = probes.searchsorted(k, "right")
                np.add.at(sums[0], gap, sizes[here])
                np.add.at(sums[1], gap, 1)
                np.minimum.at(least, gap, k)
                np.maximum.at(most, gap, k)
        rows = [(i, g, int(s[0][g]), int(s[1][g]), int(x[g]), int(y[g])) for i, (s, x, y) in enumerate(total) for g in np.flatnonzero(s[1]).tolist()]
        names = ["i", "gap", "bytes", "rows", "least", "most"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], names=names)

    return run


def boundaries(rows: DataFrame, keys: list[str], size: str, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The least key (its first 1 to 3 levels) of each shard but the first; rows: three long key columns from 0 to TOP, and size.

    What comes to the driver in a round is a count for each probe: at most 64 * (shards - 1) rows.
    """
    all_bytes = rows.agg(F.sum(size)).first()[0] or 0
    near = int(all_bytes * tolerance / shards)
    found = [Boundary(all_bytes * s // shards, above=all_bytes) for s in range(1, shards)]
    while all_bytes and (open_ := [b for b in found if b.at is None]):
        same: dict[tuple, list[Boundary]] = {}
        for b in open_:
            same.setdefault((b.prefix, b.low, b.high), []).append(b)
        asked = [(*k, v[0].probes()) for k, v in same.items()]
        level = max(len(k[0]) for k in same) + 1
        seen = rows.select(*keys[:level], size).mapInArrow(_histogram(keys[:level], size, asked), "i long, gap long, bytes long, rows long, least long, most long")
        seen = seen.groupBy("i", "gap").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
        gaps: dict[int, list] = {}
        for r in seen.collect():
            gaps.setdefault(r.i, []).append(r)
        for i, owners in enumerate(same.values()):
            for b in owners:
                _narrowed(b, sorted(gaps[i], key=lambda r: r.gap), near)
    return [b.at for b in found if b.at is not None]


def _narrowed(b: Boundary, gaps: list, near: int) -> None:
    """Takes the gap that holds the target; a gap of one key or row settles the boundary or is entered deeper."""
    below = b.below
    for r in gaps:
        if b.target <= below + r.bytes:
            break
        below += r.bytes
    b.low, b.high, b.below, b.above = r.least, r.most + 1, below, below + r.bytes
    if r.least < r.most:
        return
    start, end = b.target - b.below, b.above - b.target
    edge = (*b.prefix, b.low) if start <= end else (*b.prefix, b.low + 1)
    if r.rows == 1 or (not b.prefix and min(start, end) <= near):
        b.at = edge
    else:
        b.prefix, b.low, b.high = (*b.prefix, b.low), 0, TOP


def _reached(at: tuple[int, ...], keys: list[str]) -> Column:
    """Whether the keys are not below the boundary."""
    out = F.col(keys[len(at) - 1]) >= at[-1]
    for v, k in zip(at[-2::-1], keys[len(at) - 2 :: -1], strict=False):
        out = (F.col(k) > v) | ((F.col(k) == v) & out)
    return out


def shard(rows: DataFrame, group: Column, id_: Column, size: Column, shards: int = 24, tolerance: float = 0.01) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (its gapless place in the shard, in key order). group and id_: columns of
    any type, size: bytes of a row. Columns of rows named shard or slot are replaced."""
    workers.ship(rows.sparkSession)
    kept = rows.drop("shard", "slot")
    keys = [staging.free_name(kept, c) for c in ("group_key", "id_key", "place_key")]
    bytes_ = staging.free_name(kept, "bytes")
    keyed = kept.select("*", _key(group).alias(keys[0]), _key(id_).alias(keys[1]), F.monotonically_increasing_id().alias(keys[2]), size.alias(bytes_))
    keyed = staging.stage(keyed, "keys")
    found = boundaries(keyed, keys, bytes_, shards, tolerance)
    of = sum([_reached(at, keys).cast("long") for at in found], F.lit(0).cast("long"))
    return ranked.placed(keyed.withColumn("shard", of), "shard", keys, "slot").withColumn("shard", F.col("shard").cast("int")).select(*kept.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, tolerance: float = 0.01) -> None:
    """Whole documents as Parquet, a folder shard=S each, rows in the order of slot within a file."""
    out = shard(docs, F.col("text"), F.col("doc_id"), _size(), shards, tolerance)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select("doc_id", _size().alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.md5("text").alias("digest"))
    out = shard(facts, F.col("digest"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc[b + 1] is the table of CRC-32 for the byte b.
CRC = """t AS MATERIALIZED (SELECT list(v ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(range(1, 9), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b) AS v FROM range(256) r(b)))"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, beside table t; null stays null."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda v, x: xor(v >> 8, crc[(xor(v, x) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH {CRC},
k AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce({crc_sql("text")}, 0) AS text_crc32,
        CASE WHEN text IS NULL THEN 0 ELSE greatest(CAST('0x' || substr(md5(md5(text)), 1, 15) AS BIGINT), 1) END AS g,
        CASE WHEN doc_id IS NULL THEN 0 ELSE greatest(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), 1) END AS d FROM documents, t),
n AS (SELECT *, row_number() OVER (ORDER BY g, d) AS n FROM k),
c AS (SELECT *, CAST(sum(size) OVER (ORDER BY n) AS BIGINT) AS stop, CAST(sum(size) OVER (ORDER BY g) AS BIGINT) AS g_stop,
        CAST(sum(size) OVER (PARTITION BY g) AS BIGINT) AS g_size, CAST(sum(size) OVER () AS BIGINT) AS whole FROM n),
a AS (SELECT s, whole * s // 24 AS target FROM (SELECT DISTINCT whole FROM c), range(1, 24) r(s)),
e AS (SELECT s, target, c.* , target - (stop - size) <= stop - target AS early, least(target - (g_stop - g_size), g_stop - target) AS off,
        target - (g_stop - g_size) <= g_stop - target AS g_early FROM a JOIN c ON target > stop - size AND target <= stop),
b AS (SELECT s, CASE WHEN off <= CAST(floor(whole * 0.01 / 24) AS BIGINT) THEN CASE WHEN g_early THEN g_stop - g_size ELSE g_stop END
        WHEN early THEN stop - size ELSE stop END AS edge FROM e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM (SELECT c.*, CAST((SELECT count(*) FROM b WHERE edge <= stop - size) AS INTEGER) AS shard FROM c)
"""
