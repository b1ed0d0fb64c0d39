"""Merkle manifest of a table: leaf digests, a tree for each group, a tree over the groups' roots, proofs of every row.

Bottom-up: leaves get gapless places in their group, and each `2 ** 8` consecutive ones become a block, which holds the
eight tree levels above its leaves; the blocks' tops are the leaves of the next blocks, until each group has one node.
These persisted levels are written to the shared folder. Top-down: from the root on, the blocks of a level join their
parent blocks' rows, and each child prepends its own siblings, level by level, to the proof suffix it inherits. So rows
are exchanged twice (by ranges for their places, then by blocks), proofs only once for each block, never for each leaf.
A block is bounded, so a hot group is as many blocks as any other rows; hashes are Spark's own functions throughout.

Null fields are `-` in a leaf. Null groups are a group, the first; groups come in UTF-8 byte order. Null ids come first.
Rows that tie in id: by leaf digest, so that only equal leaves change places. Repeated rows: a leaf each. Very long texts
are hashed whole. Empty table: no root, no rows. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import ranked, sharding, skew, staging

FAN, DEEP = 2, 8
_PATH = "array<struct<left string, right string>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256, in hexadecimal, of each field's UTF-8 byte count, a colon and its value, or `-` for null, one after another."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _parents(nodes: Column) -> Column:
    """Digests of each FAN consecutive nodes, the last ones fewer."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _rounds(n: Column) -> Column:
    """How often n nodes become fewer until one is left, DEEP at most."""
    return F.size(F.filter(F.array(*[F.lit(FAN**j) for j in range(DEEP)]), lambda p: p < n))


def _turns(rounds: Column) -> Column:
    return F.filter(F.array(*[F.lit(j) for j in range(DEEP)]), lambda j: j < rounds)


@dataclass(frozen=True)
class Trees:
    """Blocks of each persisted level, lowest first (grp, block, members, levels, rounds, done: the group ends here), and
    the root of each group (grp, root)."""

    blocks: list[DataFrame]
    roots: DataFrame


def build(nodes: DataFrame) -> Trees:
    """nodes: grp, place (gapless from 0 in each grp), node, and what else is to come along in members."""
    blocks, roots = [], None
    while True:
        size = staging.stage(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
        block = F.expr(f"place div {FAN**DEEP}").alias("block")
        own = nodes.groupBy("grp", block).agg(F.array_sort(F.collect_list(F.struct("place", *[c for c in nodes.columns if c not in ("grp", "place")]))).alias("members"))
        total = size.agg(F.sum("n")).first()[0] or 0
        own = skew.joined(own, size, ["grp"], total).withColumn("rounds", _rounds(F.col("n"))).withColumn("done", F.col("n") <= FAN**DEEP)
        first = F.array(F.transform("members", lambda m: m["node"]))
        levels = F.aggregate(_turns(F.col("rounds")), first, lambda up, _: F.concat(up, F.array(_parents(F.element_at(up, -1)))))
        blocks.append(staging.stage(own.drop("n").withColumn("levels", levels), "tree-level"))
        top = F.element_at(F.element_at("levels", -1), 1)
        ended = blocks[-1].filter("done").select("grp", top.alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = blocks[-1].filter("NOT done").select("grp", F.col("block").alias("place"), top.alias("node"))
        if nodes.isEmpty():
            return Trees(blocks, roots)


def _siblings(i: Column) -> Column:
    """Of the i-th leaf of a block, level by level: the digests left and right of it in its run, joined."""

    def at(j: Column) -> Column:
        nodes, here = F.element_at("levels", j + 1), F.floor(i / F.pow(F.lit(FAN), j)).cast("int")
        first = here - here % FAN
        text = lambda start, n: F.array_join(F.slice(nodes, start + 1, n), "")
        return F.struct(text(first, here - first).alias("left"), text(here + 1, first + FAN - 1 - here).alias("right"))

    return F.transform(_turns(F.col("rounds")), at)


def pushed(trees: Trees, tops: DataFrame) -> DataFrame:
    """The leaves' members with their path from bottom to top. tops: grp, path (above the group's root) and what else is
    to be handed down, for all groups."""
    down = None
    for k in range(len(trees.blocks) - 1, -1, -1):
        here = trees.blocks[k]
        if down is not None:
            down = staging.stage(down.select("grp", F.col("place").alias("block"), *tops.columns[1:]), "proof-suffixes")
        given = here.filter("done").join(tops, "grp")
        if down is not None:
            given = given.unionByName(here.filter("NOT done").join(down, ["grp", "block"]))
        each = given.select("*", F.posexplode("members").alias("i", "member"))
        down = each.select("grp", "member.*", F.concat(_siblings(F.col("i")), "path").alias("path"), *tops.columns[2:])
    return down


@dataclass(frozen=True)
class Manifest:
    groups: Trees
    tops: DataFrame  # grp, path, subroot, root

    def proofs(self) -> DataFrame:
        """A row a leaf: grp, place, node, what was carried, path (array of left and right), subroot, root."""
        return pushed(self.groups, self.tops)


def manifest(rows: DataFrame, fields: list[Column], group: Column, id_: Column, carry: list[Column] | None = None) -> Manifest:
    """The manifest of rows, whose leaves hold fields and lie by id_ in the trees of their group. carry: named columns that
    come along with the leaves."""
    carried = [c.alias(f"carried{i}") for i, c in enumerate(carry or [])]
    leaves = rows.select(group.isNotNull().alias("grouped"), F.coalesce(group.cast("string"), F.lit("")).alias("name"), id_.alias("id"), leaf(fields).alias("node"), *carried)
    leaves = staging.stage(leaves, "leaves")
    names = leaves.groupBy("grouped", "name").agg(F.count(F.lit(1)).alias("n"))
    names = staging.stage(ranked.placed(names.withColumn("all", F.lit(0).cast("long")), "all", ["grouped", "name"], "grp").select("grouped", "name", "n", "grp"), "groups")
    total = names.agg(F.sum("n")).first()[0] or 0
    of = skew.joined(leaves, names, ["grouped", "name"], total).select("grp", "id", "node", *[c for c in leaves.columns if c.startswith("carried")])
    trees = build(ranked.placed(of, "grp", ["id", "node"], "place"))
    over = build(trees.roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), "root").withColumnRenamed("root", "node"))
    top = over.roots.select("grp", F.array().cast(_PATH).alias("path"), "root")
    tops = pushed(over, top).select(F.col("place").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    return Manifest(trees, staging.stage(tops, "tops"))


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, path: str = "path") -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(fields(F.col("n_chars") + 1)))
    proofs = manifest(docs, fields(F.col("n_chars")), F.col("lang"), F.col("doc_id"), [altered]).proofs()
    out = proofs.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.coalesce("carried0", "node")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


ORACLE = f"""
WITH RECURSIVE {sharding.CRC},
d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {sharding.crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS other FROM documents, t),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
u AS (SELECT g, 0 AS k, i, leaf AS h, n FROM l
  UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY g, k, i // 2),
s AS (SELECT g, k, h FROM u WHERE n = 1),
v AS (SELECT 0 AS k, g - 1 AS i, h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM v WHERE n > 1 GROUP BY k, i // 2),
r AS (SELECT h AS root FROM v WHERE n = 1),
p AS (SELECT l.*, s.k AS own, s.h AS subroot, (SELECT max(k) FROM v) AS more FROM l JOIN s USING (g)),
q AS (SELECT p.g, p.i, p.own, p.more, 0 AS k, coalesce(other, leaf) AS f, '' AS proof FROM p
  UNION ALL SELECT q.g, q.i, q.own, q.more, q.k + 1,
    sha256(CASE WHEN (CASE WHEN q.k < own THEN q.i >> q.k ELSE (q.g - 1) >> (q.k - own) END) % 2 = 1 THEN coalesce(x.h, y.h, '') || f ELSE f || coalesce(x.h, y.h, '') END), proof || coalesce(x.h, y.h, '')
  FROM q LEFT JOIN u x ON q.k < own AND x.g = q.g AND x.k = q.k AND x.i = xor(q.i >> q.k, 1)
         LEFT JOIN v y ON q.k >= own AND y.k = q.k - own AND y.i = xor((q.g - 1) >> (q.k - own), 1) WHERE q.k < own + more)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM p JOIN q ON p.g = q.g AND p.i = q.i AND q.k = p.own + p.more, r
"""
