"""op11 to op13 against brute force on hard rows: nulls, empty and long texts, ties, repeated rows, hot groups, clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import alignment, merkle, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n long, place long, bucket int"
TEXTS = [None, "", " ", "a", "the cat sat on the mat. " * 40, "é😀 x" * 50, "<|endoftext|> is text", "double  spaces \n and\ttabs ", "▁low line", "word " * 9000, "\x00nul"]
COPY = "one very hot text that a third of all rows hold, again and again"


@pytest.fixture(scope="module")
def rows():
    out = [(i + 1, t, None if i % 4 == 0 else ("en", "de", "é")[i % 3], None if i % 5 == 0 else "s", None if i % 6 == 5 else len(t or ""), "x", 7, 8, 9) for i, t in enumerate(TEXTS)]
    out += [(100 + i, COPY, "en", "s", len(COPY), None, None, None, None) for i in range(700)]
    out += [(1000 + i, f"text number {i} " * (i % 7 + 1), "en", "s", 5, None, None, None, None) for i in range(900)]
    return [*out, out[4], out[4], *[(None, None, None, None, None, None, None, None, None)] * 150, *[(None, "no id", "en", None, 5, None, None, None, None)] * 2]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def size(text):
    return len((text or "").encode()) + 8


def key(value):
    return 0 if value is None else max(1, int(hashlib.md5(str(value).encode()).hexdigest()[:15], 16))


def shards_by_force(rows, shards=24, tolerance=0.01):
    """Boundaries by walking over all rows in order."""
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (key(digest(r[1])), key(r[0])))
    at = np.concatenate(([0], np.cumsum([size(r[1]) for r in rows])))
    of = [key(digest(r[1])) for r in rows]
    edges = [0, *[i for i in range(1, len(rows)) if of[i] != of[i - 1]], len(rows)]
    cuts = []
    for s in range(1, shards):
        target = int(at[-1]) * s // shards
        near = min(edges, key=lambda i: (abs(int(at[i]) - target), i))
        if abs(int(at[near]) - target) > int(int(at[-1]) * tolerance / shards):
            near = min(range(len(rows) + 1), key=lambda i: (abs(int(at[i]) - target), i))
        cuts.append(near)
    out = []
    for i, r in enumerate(rows):
        s = sum(c <= i for c in cuts)
        out.append((r[0], r[1], s, i - max([0, *[c for c in cuts if c <= i]])))
    return out


def test_sharding(docs, none, rows, folder):
    got = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.op11_sharding(docs.sparkSession, folder).collect())
    assert got == Counter((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slot, None) for i, t, s, slot in shards_by_force(rows))
    # Shards of small rows are even although one text holds a third of them; rows of null id and text are cut too.
    small = docs.filter("coalesce(length(text), 0) < 1000")
    out = sharding.shard(small, F.col("text"), F.col("doc_id"), sharding._size(), 12).withColumn("size", sharding._size()).collect()
    per = Counter()
    for r in out:
        per[r.shard] += r.size
    mean = sum(per.values()) / 12
    assert len(per) == 12 and all(abs(v - mean) < 150 for v in per.values())
    assert sum(len({r.shard for r in out if r.text == t}) > 1 for t in {r.text for r in out}) <= 3
    empty = sharding.shard(none, F.col("text"), F.col("doc_id"), sharding._size())
    assert empty.count() == 0 and empty.columns == [*[c for c in none.columns if c != "shard"], "shard", "slot"]


def test_shards_are_written(docs, rows, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", 6)
    back = docs.sparkSession.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    for s in range(6):
        assert sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_by_force(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_by_force(levels, i):
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append(("" if j > i or j >= len(nodes) else nodes[j], nodes[j] if i < j < len(nodes) else ""))
        i //= 2
    return out


def test_merkle(docs, none, rows, folder):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    lows = lambda v: sorted([r for r in rows if r[2] == v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {v: levels_by_force([leaf(r) for r in lows(v)]) for v in langs}
    over = levels_by_force([trees[v][-1][0] for v in langs])
    want = Counter()
    for g, v in enumerate(langs):
        for i, r in enumerate(lows(v)):
            path = path_by_force(trees[v], i) + path_by_force(over, g)
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None else leaf(r)
            for left, right in path:
                now = sha(left + now + right)
            want[(r[0], leaf(r), trees[v][-1][0], over[-1][0], sha("".join(a + b for a, b in path)), now, now == over[-1][0])] += 1
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.op12_merkle(docs.sparkSession, folder).collect()]
    assert Counter(got) == want and {x[-1] for x in got} == {True, False}
    fields, at = [F.col("text")], (F.col("lang"), F.col("doc_id"))
    assert merkle.manifest(none, fields, *at).proofs().count() == 0
    one = merkle.manifest(docs.filter("doc_id = 3"), fields, *at).proofs().collect()
    assert len(one) == 1 and one[0].path == [] and one[0].node == one[0].subroot == one[0].root


def test_merkle_many_groups(spark):
    """More groups than a block holds, and groups of one to many leaves."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.concat(F.lit("g"), F.col("id") % 700)).alias("lang"), F.lit("t").alias("text"))
    out = merkle.manifest(docs, [F.col("doc_id"), F.col("text")], F.col("lang"), F.col("doc_id")).proofs()
    out = out.withColumn("ok", merkle.folded(F.col("node")) == F.col("root")).agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("roots")).first()
    assert (out.ok, out.n, out.roots) == (3000, 3000, 1)


def aligned_by_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    byte = {chr(x) if x in shown else chr(next(more)): x for x in range(256)}
    docs, holds = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        x = [(i, bytes(byte[c] for c in t)) for e in [a.encode(" " + (text or ""), add_special_tokens=False)] for i, t in zip(e.ids, e.tokens)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            docs.append(None)
            continue
        spans = [[(i, int(e) - len(t), int(e)) for (i, t), e in zip(side, np.cumsum([len(t) for _, t in side]))] for side in (x, y)]
        links, low = [], 0
        for i, s, e in spans[0]:
            while spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        parts = [["", ""] for _ in ends]
        for side in (0, 1):
            g = 0
            for i, _, e in spans[side]:
                while e > ends[g]:
                    g += 1
                parts[g][side] += f"{',' if parts[g][side] else ''}{i}"
        docs.append((len(x), len(y), ends, links, ";".join("|".join(p) for p in parts)))
        holds.update(set(links))
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(best.get(i, 0), n)
    for d in docs:
        yield (0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(holds[p] == best[p[0]] for p in d[3]), sum(holds[p] for p in d[3]), sha(d[4]))


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_alignment(docs, none, rows, buckets):
    got = Counter(tuple(r) for r in alignment.align(docs, buckets=buckets).collect())
    want = Counter((r[0], *f) for r, f in zip(rows, aligned_by_force([r[1] for r in rows])))
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.align(docs, buckets=buckets).columns == ["doc_id", *sums]
    assert got == want
    assert alignment.align(none, buckets=buckets).count() == 0


def test_chunks_and_held_pairs_change_nothing(docs, rows, monkeypatch):
    """Events of a few tokens, and pairs made distinct over and over."""
    coder = alignment.Tokenizers(alignment.load())
    text = rows[4][1] + rows[5][1]
    a, b = coder.encode(text)

    def swept(chunk, held):
        monkeypatch.setattr(alignment, "HELD", held)
        s, m, at = alignment.Summary(0, 0, 0), alignment.Machine(coder.lengths), []
        for side, ids in ((alignment.A, a), (alignment.B, b)):
            ends = np.concatenate(([0], coder.lengths[side - 1][ids].cumsum(dtype=np.int64)))
            at += [(ends[i], side, ids[i : i + chunk]) for i in range(0, len(ids), chunk)]
        most = 0
        for _, side, ids in sorted(at, key=lambda x: x[:2]):
            if (run := m.take(side, ids)) is not None:
                s.add(run)
            most = max(most, *[len(x.ids) for x in m.sides.values()])
        return (s.n_a, s.n_b, s.n_groups, s.n_links, s.digest.hexdigest(), *[x.tolist() for x in s.pairs()]), most

    whole, few = swept(1 << 20, 1 << 20), swept(8, 5)
    assert whole[0] == few[0] and few[1] < 40 < whole[1]


def test_groups(docs, rows):
    got = {}
    for r in alignment.groups(docs.filter("doc_id IN (5, 7)").dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.doc_id, []).append(r)
    coder = alignment.Tokenizers(alignment.load())
    for doc_id, of in got.items():
        a, b = coder.encode(rows[doc_id - 1][1])
        of.sort(key=lambda r: r.start)
        assert [i for r in of for i in r.a_ids] == a.tolist() and [i for r in of for i in r.b_ids] == b.tolist()
        assert of[0].start == 0 and all(x.stop == y.start for x, y in zip(of, of[1:])) and of[-1].stop == size(rows[doc_id - 1][1]) - 7
