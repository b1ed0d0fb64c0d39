"""Alignment of two tokenizers' tokens of the same texts by a sweep over their end events.

Each task encodes its documents with A and B and emits events: the ids of up to CHUNK consecutive tokens of one side with
the byte offset where they start; where a token ends follows from the bytes of the ids before it. Events of both sides are
exchanged by bucket of documents and sorted by (document, offset) within partitions. A machine reads them in that order and
holds only the tokens after the last offset where both sides end: what lies before is cut into groups there and leaves as
groups and links (pairs of tokens whose byte ranges overlap) at once. Of a document it keeps sums and distinct id pairs.

How many documents hold an id pair linked is summed up by task, then by pair. The sums go back to the buckets that hold
the pair (one row for each bucket and pair, however often its documents link it), and meet the bucket's documents there.
A bucket has about 16 MB of text, so neither a pair that every document has nor the number of pairs fills a task.

Null and empty texts, and texts that a tokenizer changes (its tokens' bytes aren't space and text): no tokens, zeros, ''.
Null or repeated ids, repeated rows: each row is a document. Ties of the highest count all count. Very long texts are
encoded whole, their events come in chunks. Empty table: empty result. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import staging, workers

CHUNK = 4096
BUCKET = 16 << 20
ROWS = 256
#: Rows of the result of a sweep whose pairs are held before they are made distinct.
HELD = 1 << 21
_ZSTD = pa.Codec("zstd", compression_level=1)
A, B = 1, 2


def paths() -> tuple[str, str]:
    """Files of the two vocabularies among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabularies:
    """What tasks need of both vocabulary files: A's tokens as bytes, one after another with the length of each (an id without
    a token has none), its pattern, and B's model."""

    tokens: bytes
    sizes: bytes
    pattern: str
    model: bytes


def load(a: str | None = None, b: str | None = None) -> Vocabularies:
    """Both vocabulary files (by default those of paths()), read by the driver. A: byte-level BPE, special tokens left out;
    B: a sentencepiece model."""
    import public_tokenizers

    with open(a or paths()[0], encoding="utf-8") as f, open(b or paths()[1], "rb") as g:
        spec, model = json.load(f), g.read()
    special = {t["content"] for t in spec["added_tokens"]}
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    byte = {chr(b) if b in shown else chr(next(others)): b for b in range(256)}
    known = {i: bytes(map(byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in special}
    tokens = [known.get(i, b"") for i in range(max(known) + 1)]
    return Vocabularies(b"".join(tokens), np.array([len(t) for t in tokens], np.uint16).tobytes(), public_tokenizers.PATTERN, model)


class Tokenizers:
    """A: byte-level BPE by ranks, which are its ids; B: a sentencepiece model."""

    def __init__(self, known: Vocabularies):
        import sentencepiece
        import tiktoken

        sizes = np.frombuffer(known.sizes, np.uint16)
        stop = sizes.cumsum(dtype=np.int64).tolist()
        ranks = {known.tokens[e - n : e]: i for i, (e, n) in enumerate(zip(stop, sizes.tolist(), strict=True)) if n}
        self.a = tiktoken.Encoding("a", pat_str=known.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=known.model)
        self.pieces = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lengths = sizes, np.array([len(x) for x in self.pieces], np.uint16)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of both sides; None where there is nothing to align."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if self.a.decode_bytes(a) != whole or b"".join(map(self.pieces.__getitem__, b)) != whole:
            return None
        return np.array(a, np.uint16), np.array(b, np.uint16)


_known: dict[Vocabularies, Tokenizers] = {}
workers.cache("alignment", _known.clear)


def _tokenizers(known: Vocabularies) -> Tokenizers:
    workers.begin("alignment")
    if known not in _known:
        _known.clear()
        _known[known] = Tokenizers(known)
    return _known[known]


def _packed(x: np.ndarray) -> bytes:
    return _ZSTD.compress(x.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data, n * np.dtype(kind).itemsize, asbytes=True), kind)


_EVENT = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
_EVENTS = "bucket int, row long, at long, side int, doc_id long, n int, ids binary"


def events(docs: DataFrame, known: Vocabularies, buckets: int) -> DataFrame:
    """Of each row of docs (doc_id, text) its opening (side 0, at -1) and the chunks of both sides. row: a number for each
    row of docs, from its place in its partition, the same whenever that is read again."""
    workers.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _tokenizers(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(first, ROWS), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    bucket = (row * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) * buckets >> 32
                    out.append((bucket, row, -1, 0, doc_id, 0, None))
                    for side, ids in zip((A, B), coder.encode(text.as_py()) or (), strict=False):
                        at = 0
                        for i in range(0, len(ids), CHUNK):
                            some = ids[i : i + CHUNK]
                            out.append((bucket, row, at, side, None, len(some), _packed(some)))
                            at += int(coder.lengths[side - 1][some].sum(dtype=np.int64))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _EVENT, strict=True)], schema=_EVENT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _EVENTS)


def buckets_of(docs: DataFrame) -> int:
    """About BUCKET bytes of text each; small tables as many as the session's shuffles, of 1 MB or more."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BUCKET), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 20))


def swept(docs: DataFrame, a: str | None = None, b: str | None = None, buckets: int | None = None) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Events of docs, in the order of the sweep, and the byte lengths of both sides' ids."""
    known = load(a, b)
    n = buckets or buckets_of(docs)
    out = events(docs, known, n).repartitionById(n, "bucket").sortWithinPartitions("bucket", "row", "at", "side")
    return out, Tokenizers(known).lengths


@dataclass
class Side:
    """Tokens of one side that no group has taken yet, and the offset where they start."""

    lengths: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint16))
    ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    start: int = 0

    def add(self, ids: np.ndarray) -> None:
        last = self.ends[-1] if len(self.ends) else self.start
        self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, last + self.lengths[ids].cumsum(dtype=np.int64)))

    def take(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends of the tokens that end at `end` or before."""
        n = int(self.ends.searchsorted(end, "right"))
        ids, ends = self.ids[:n], self.ends[:n]
        starts = np.concatenate(([self.start], ends[:-1])) if n else ends
        self.ids, self.ends, self.start = self.ids[n:], self.ends[n:], end
        return ids, starts, ends


@dataclass(frozen=True)
class Run:
    """Some whole groups of a document: the tokens of each side with byte ranges and the group of each."""

    a: tuple[np.ndarray, np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray, np.ndarray]
    of_a: np.ndarray
    of_b: np.ndarray
    groups: int

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and the B token of each pair whose ranges overlap; tokens without bytes have none."""
        first, last = self.b[2].searchsorted(self.a[1], "right"), self.b[1].searchsorted(self.a[2], "left")
        n = np.maximum(last - first, 0)
        x = np.repeat(np.arange(len(n)), n)
        return x, np.arange(n.sum()) + np.repeat(first - (n.cumsum() - n), n)


class Machine:
    """Takes the chunks of one document in the order of their offsets and yields runs of groups."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.sides = {A: Side(lengths[0]), B: Side(lengths[1])}

    def take(self, side: int, ids: np.ndarray) -> Run | None:
        self.sides[side].add(ids)
        a, b = self.sides[A], self.sides[B]
        if not len(a.ends) or not len(b.ends):
            return None
        both = np.intersect1d(a.ends, b.ends, assume_unique=True)
        if not len(both):
            return None
        x, y = a.take(both[-1]), b.take(both[-1])
        return Run(x, y, both.searchsorted(x[2]), both.searchsorted(y[2]), len(both))


def _documents(lengths: tuple[np.ndarray, np.ndarray], begin, run, end):
    """The sweep as a function of batches: begin(event) gives a document's state, run(state, Run) adds to it, end(state) is
    a row of the result or several; given is (columns of the rows' schema)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        state = machine = None
        workers.begin("sweep")
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "row", "side", "doc_id", "n", "ids")]
            for bucket, row, side, doc_id, n, ids in zip(*columns, strict=True):
                if not side:
                    if state is not None:
                        yield end(state)
                    state, machine = begin(bucket, row, doc_id), Machine(lengths)
                elif (found := machine.take(side, _unpacked(ids, n, np.uint16))) is not None:
                    run(state, found)
        if state is not None:
            yield end(state)

    return rows


@functools.lru_cache(1)
def _names() -> np.ndarray:
    return np.array([f"{i}{after}".encode() for after in ",|;" for i in range(1 << 16)], object)


def spelled(run: Run) -> bytes:
    """`a1,a2|b1;a3|b2,b3;` of the groups of a run."""
    last_a, last_b = (np.searchsorted(of, np.arange(run.groups), "right") for of in (run.of_a, run.of_b))
    n = len(run.of_a)
    ids = np.concatenate((run.a[0], run.b[0])).astype(np.int64)
    ids[last_a - 1] += 1 << 16
    ids[n + last_b - 1] += 2 << 16
    # A token follows all tokens of the other side in the groups before, one of B those of its own group too.
    at = np.concatenate((np.arange(n) + np.concatenate(([0], last_b))[run.of_a], np.arange(len(run.of_b)) + last_a[run.of_b]))
    out = np.empty(len(ids), object)
    out[at] = _names()[ids]
    return b"".join(out.tolist())


workers.cache("sweep", _names.cache_clear)


@dataclass
class Summary:
    bucket: int
    row: int
    doc_id: int | None
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = None
    held: list = field(default_factory=list)
    size: int = 0

    def add(self, run: Run) -> None:
        x, y = run.links()
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(run.a[0]), self.n_b + len(run.b[0]), self.n_groups + run.groups, self.n_links + len(x)
        text = spelled(run)
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(text[:-1])
        self.held.append(np.unique((run.a[0][x].astype(np.uint32) << np.uint32(16)) | run.b[0][y], return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > HELD:
            self.held = [self.pairs()]
            self.size = len(self.held[0][0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of ids, A's in the upper 16 bits, ascending, and how often each is linked."""
        if not self.held:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return _summed(np.concatenate([p for p, _ in self.held]), np.concatenate([n for _, n in self.held]))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (keys[1:] > keys[:-1]).all():
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_SUMMARY = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("pairs", pa.binary()), ("times", pa.binary())])


def summaries(docs: DataFrame, a: str | None = None, b: str | None = None, buckets: int | None = None) -> DataFrame:
    """A row a document: sizes, digest of its groups, its distinct id pairs and how often each is linked (packed)."""
    ordered, lengths = swept(docs, a, b, buckets)

    def end(s: Summary) -> tuple:
        pairs, times = s.pairs()
        packed = _packed(np.diff(pairs, prepend=np.uint32(0))), _packed(times.astype(np.uint32))
        return (s.bucket, s.row, s.doc_id, s.n_a, s.n_b, s.n_groups, s.n_links, s.digest.hexdigest() if s.digest else "", len(pairs), *packed)

    rows = _documents(lengths, Summary, Summary.add, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _by(rows(batches), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)

    schema = "bucket int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary, times binary"
    return ordered.mapInArrow(run, schema)


def _by(rows: Iterator, n: int) -> Iterator[list]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """The groups themselves: doc_id, row, start and stop (bytes of space and text), a_ids, b_ids."""
    ordered, lengths = swept(docs, a, b)
    schema = "doc_id long, row long, start long, stop long, a_ids array<int>, b_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(state: list, r: Run) -> None:
            at = [np.searchsorted(of, np.arange(r.groups + 1)) for of in (r.of_a, r.of_b)]
            start, stop = r.a[1][at[0][:-1]], r.a[2][at[0][1:] - 1]
            for g in range(r.groups):
                state[1].append((*state[0], int(start[g]), int(stop[g]), *[side[0][x[g] : x[g + 1]].tolist() for side, x in zip((r.a, r.b), at, strict=True)]))

        rows = _documents(lengths, lambda _, row, doc_id: ((doc_id, row), []), add, lambda state: state[1])
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
        for found in rows(batches):
            for i in range(0, len(found), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + CHUNK], strict=True), kinds, strict=True)], names=["doc_id", "row", "start", "stop", "a_ids", "b_ids"])

    return ordered.mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a bucket hold each pair; rows of a bucket lie together."""
    at, held, size = None, [], 0
    workers.begin("counts")

    def given() -> pa.RecordBatch:
        pairs, n = _summed(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), at, np.int32)), pa.array(pairs.astype(np.int64)), pa.array(n)], names=["bucket", "pair", "n"])

    for batch in batches:
        for bucket, n, pairs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n_pairs", "pairs")), strict=True):
            if bucket != at and held:
                yield given()
                held, size = [], 0
            at = bucket
            if n:
                held.append((_unpacked(pairs, n, np.uint32).cumsum(dtype=np.uint32), np.ones(n, np.int64)))
                size += n
            if size > HELD:
                held = [_summed(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held]))]
                size = len(held[0][0])
                if size > HELD:  # more distinct pairs than that: they go out as they are
                    yield given()
                    held, size = [], 0
    if held:
        yield given()


_ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: its pairs with their counts, ascending, then its documents."""
    at, parts, table = None, [], None
    workers.begin("counts")
    for batch in batches:
        out = []
        bucket, is_doc = np.asarray(batch.column("bucket")), np.asarray(batch.column("is_doc").cast(pa.int8())).astype(bool)
        edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (is_doc[1:] != is_doc[:-1])))) if len(bucket) else []
        for first, last in zip(edge, [*edge[1:], len(bucket)], strict=True):
            some = batch.slice(first, last - first)
            if bucket[first] != at:
                at, parts, table = bucket[first], [], None
            if not is_doc[first]:
                parts.append([np.asarray(some.column(c)) for c in ("pair", "n", "best")])
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None
            names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times")
            for doc_id, n_a, n_b, n_groups, n_links, sha, n, pairs, times in zip(*(some.column(c).to_pylist() for c in names), strict=True):
                best = total = 0
                if n:
                    place = table[0].searchsorted(_unpacked(pairs, n, np.uint32).cumsum(dtype=np.uint32).astype(np.int64))
                    times = _unpacked(times, n, np.uint32).astype(np.int64)
                    best, total = int(times[table[2][place] == 1].sum()), int((times * table[1][place]).sum())
                out.append((doc_id, n_a, n_b, n_groups, n_links, best, total, sha))
        if out:
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_ALIGNED)


def pair_counts(counted: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (1 where no pair of the same A id has more). counted: bucket, pair, n.
    An A id has at most as many pairs as B has ids."""
    total = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))
    return total.select("pair", "n", (F.col("n") == most).cast("int").alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = staging.stage(summaries(docs, a, b, buckets), "summaries")
    counted = staging.stage(found.select("bucket", "n_pairs", "pairs").mapInArrow(_counted, "bucket int, pair long, n long"), "bucket-pairs")
    counts = staging.stage(pair_counts(counted), "pair-counts")
    facts = counted.select("bucket", "pair").distinct().join(counts, "pair").select("bucket", F.lit(False).alias("is_doc"), "pair", "n", "best")
    both = found.drop("row").withColumn("is_doc", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    n = (found.agg(F.max("bucket")).first()[0] or 0) + 1
    both = both.repartitionById(n, "bucket").sortWithinPartitions("bucket", "is_doc", "pair")
    return both.mapInArrow(_looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
