"""Quality by nearest-neighbour voting in a latent-semantic space.

A text has two blocks of term counts: words, hashed, and what words look like (runs of capitals, small
letters, digits and each sign as one mark; also repetitions of the word before, and the text's length class).
Both are damped, weighted by inverse document frequency and normalised; a truncated singular value
decomposition of the labelled sample gives the latent space. At most 4,096 labelled vectors (`most`, chosen by
a hash of the id among rows not held out) are broadcast; blocks of documents meet all of them in one exact
cosine product, and the 15 nearest vote with their similarity as weight.

Null or empty text: only its length class is known; scored as others are. Null doc_id: scored, not held out.
No labelled rows: score 0.5. Repeated rows: each by itself. Contradicting labels of an id: the larger one. Neighbours that tie
for the last place, to ten digits: those first in the model. Very long texts are read whole. Other columns don't matter, whatever
their names. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import labelled, staging, workers
from lexmill.llm.text import texts

WORDS, LOOKS = 2048, 512
SIZE = WORDS + LOOKS
_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]
_SAME = re.compile(rb"([^A-Za-z0-9])\1+")
_AROUND = b".,;:!?\"'()[]{}<>*#$%&|-_"


class _Terms(dict):
    """word -> word bucket * LOOKS + look bucket."""

    most, longest = 500_000, 200  # longer words aren't kept

    def __missing__(self, word: bytes) -> int:
        look = _SAME.sub(rb"\1", word)
        for pattern, mark in _RUNS:
            look = pattern.sub(mark, look)
        w = xxhash.xxh3_64_intdigest(word.lower().strip(_AROUND)) % WORDS
        i = w * LOOKS + 16 + xxhash.xxh3_64_intdigest(look) % (LOOKS - 16)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = i
        return i


_terms = _Terms()
workers.cache("quality", _terms.clear)


def counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Term places, sorted, and their damped counts: of words the logarithm, of looks the root of the share."""
    words = text.split() if text else []
    n = len(words)
    both = np.fromiter(map(_terms.__getitem__, words), dtype=np.int64, count=n)
    w = np.log1p(np.bincount(both // LOOKS, minlength=WORDS))
    looks = np.bincount(both % LOOKS, minlength=LOOKS).astype(float)
    looks[0] = np.count_nonzero(both[1:] == both[:-1]) * 2
    looks = 4 * np.sqrt(looks / max(n, 1))
    looks[1 + min(int(np.log2(n + 1)), 14)] = 0.5
    all_ = np.concatenate([w, looks])
    at = np.flatnonzero(all_)
    return at, all_[at]


@dataclass(frozen=True)
class NearestNeighbours:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    k: int

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.label):
            return np.full(len(rows), 0.5)
        x = _unit(np.stack([_weighted(at, v, self.idf) @ self.basis[at] for at, v in rows])) if rows else np.empty((0, self.vectors.shape[1]))
        # Ten digits, so that equal texts tie whatever block they are in; of neighbours that tie the first ones count.
        like = np.round(x.astype(float) @ self.vectors.astype(float).T, 10)
        k = min(self.k, like.shape[1])
        last = -np.partition(-like, k - 1, axis=1)[:, k - 1 : k]
        nearer, ties = like > last, like == last
        near = nearer | (ties & (ties.cumsum(axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.maximum(like, 1e-6), 0.0)
        return np.clip((weight @ self.label) / weight.sum(1), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _weighted(at: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = value * idf[at]
    words = at < WORDS
    v[words] /= 2 * max(1e-9, float(np.sqrt((v[words] ** 2).sum())))
    v[~words] /= max(1e-9, float(np.sqrt((v[~words] ** 2).sum())))
    return v


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, rank: int = 48, k: int = 15, seed: int = 3) -> NearestNeighbours:
    n = len(rows)
    if not n:
        return NearestNeighbours(np.ones(SIZE), np.zeros((SIZE, 1), np.float32), np.empty((0, 1), np.float32), y, k)
    seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=SIZE)
    idf = np.log((1 + n) / (1 + seen)) + 1
    x = np.zeros((n, SIZE), np.float32)
    for row, (at, v) in zip(x, rows, strict=True):
        row[at] = _weighted(at, v, idf)
    rank = min(rank, n, SIZE)
    probe = np.random.default_rng(seed).normal(size=(SIZE, min(rank + 16, n, SIZE))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        probe, _ = np.linalg.qr(x.T @ (x @ probe))
    _, _, right = np.linalg.svd(x @ probe, full_matrices=False)
    basis = (probe @ right.T)[:, :rank]
    return NearestNeighbours(idf, basis, _unit(x @ basis), y, k)


def train(docs: DataFrame, labels: DataFrame, most: int = 4096) -> NearestNeighbours:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("quality")
        for b in batches:
            found = [counts(t) for t in texts(b.column("text"))]
            arrays = [pa.array([at.astype(np.int32).tobytes() for at, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *arrays], names=["doc_id", "y", "places", "counts"])

    rows = labelled.sample(docs, labels, "quality", most, featurise, "places binary, counts binary")
    return fit([(np.frombuffer(r.places, np.int32).astype(np.int64), np.frombuffer(r.counts, np.float32).astype(float)) for r in rows], np.array([r.y for r in rows], float))


def scored(docs: DataFrame, model: NearestNeighbours, columns: list[str], name: str = "score") -> DataFrame:
    """The columns asked for, and the score under a name that none of them has; texts needn't be among them to be read."""
    workers.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("quality")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = shared.value.scores([counts(t) for t in texts(part.column(part.num_columns - 1))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[*columns, name])

    return docs.select(*columns, F.col("text").alias(staging.free_name(docs, "whole_text"))).mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return df.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
