"""Toxicity by a factorization machine over hashed terms.

Terms are the words in lower case without punctuation around them, hashed to 2^15 buckets; of those the 2,048
whose presence tells most about the label in the sample are features, and those of pairs that tell more than their terms do. To the linear weights the machine adds
the products of each two terms' factors, so an insult with a group's mention weighs otherwise than either.
Training: Adagrad in numpy on at most 20,000 labelled rows that aren't held out (`most`, chosen by a hash of
the id). Scoring: one pass over whole texts with 2,048 x 9 numbers broadcast.

Null or empty text: the score of no terms. Null doc_id: scored, not held out. No labelled rows, or only one
class: that class's share (0.5 without rows). Repeated rows: each by itself. Labels that contradict each other
for an id count as the larger one. Terms that tie for the last place: those of the smaller bucket. Very long texts are read whole.
Other columns don't matter, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import labelled, workers
from lexmill.llm.text import texts

BUCKETS = 1 << 15
_AROUND = b".,;:!?\"'()[]{}<>*#$%&|-_"


class _Terms(dict):
    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(_AROUND)
        i = self[word] = xxhash.xxh3_64_intdigest(bare) % BUCKETS if bare else -1
        return i


_terms = _Terms()
workers.cache("toxicity", _terms.clear)


def terms(text: bytes | None) -> np.ndarray:
    """Sorted buckets of the terms present."""
    words = text.lower().split() if text else []
    seen = np.zeros(BUCKETS + 1, bool)
    seen[np.fromiter(map(_terms.__getitem__, words), dtype=np.int64, count=len(words))] = True
    return np.flatnonzero(seen[:-1])


@dataclass(frozen=True)
class FactorizationMachine:
    """Over features 0..m-1, present or not. place: bucket -> feature, or m (no feature)."""

    place: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, features: np.ndarray) -> float:
        v = self.factor[features]
        s = v.sum(0)
        return float(self.bias + self.weight[features].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, buckets: np.ndarray) -> float:
        f = self.place[buckets]
        return 1 / (1 + np.exp(-np.clip(self.raw(f[f < len(self.weight)]), -500, 500)))


def _paired(rows: list[np.ndarray], y: np.ndarray, n: np.ndarray, most: int, certain: float = 6.0) -> np.ndarray:
    """Buckets of pairs that tell about the label beyond what their terms tell alone, among the `most` buckets that most
    rows have (in 20 rows or more, and in not nearly all). One product of matrices counts every pair in toxic rows and in
    all; of 2 million pairs that tell nothing, one reaches 6 standard deviations in 250 samples."""
    often = np.argsort(-np.minimum(n, len(rows) - n), kind="stable")[:most]
    often = often[np.minimum(n, len(rows) - n)[often] >= 20]
    place = np.full(BUCKETS, -1, np.int64)
    place[often] = np.arange(len(often))
    both, toxic = (np.zeros((len(often), len(often)), np.float32) for _ in range(2))
    for at in range(0, len(rows), 2048):
        x = np.zeros((len(rows[at : at + 2048]), len(often)), np.float32)
        for row, r in zip(x, rows[at : at + 2048], strict=True):
            row[(p := place[r])[p >= 0]] = 1
        both += x.T @ x
        toxic += (x * y[at : at + 2048, None].astype(np.float32)).T @ x
    share, own = float(y.mean()), n[often]
    alone = (np.diag(toxic) + share) / (own + 1)
    # What both terms would give together if each shifted the odds by itself.
    odds = lambda p: p / (1 - p)
    each = odds(np.clip(alone, 1e-3, 1 - 1e-3)) / odds(share)
    expected = each[:, None] * each[None, :] * odds(share)
    expected /= 1 + expected
    far = np.abs(toxic - both * expected) / np.sqrt(np.maximum(both * expected * (1 - expected), 1.0))
    far[(both < 20) | np.eye(len(often), dtype=bool)] = 0
    return often[(far > certain).any(axis=1)] if len(often) else often


def fit(rows: list[np.ndarray], y: np.ndarray, *, features: int = 2048, factors: int = 8, steps: int = 2500, rate: float = 0.1, l2: float = 3e-3, heed: float = 2.0, seed: int = 7) -> FactorizationMachine:
    """At least `steps` batches of 256 and 20 rounds. A toxic row counts `heed` times: they are few, and half of what marks
    them is rare."""
    share = float(y.mean()) if len(y) else 0.5
    place = np.full(BUCKETS, 0, np.int64)
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return FactorizationMachine(place, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    n = np.bincount(flat, minlength=BUCKETS).astype(float)
    pos = np.bincount(flat, weights=y[of], minlength=BUCKETS)
    z = np.where(n >= 5, np.abs(pos - n * share) / np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / (len(y) + 1)), 1e-9)), 0)
    chosen = np.argsort(-z, kind="stable")[:features]
    chosen = np.union1d(chosen[z[chosen] > 2.5], _paired(rows, y, n, features))
    m = len(chosen)
    place[:] = m
    place[chosen] = np.arange(m)
    rng = np.random.default_rng(seed)
    bias, w, v = np.log(share / (1 - share)), np.zeros(m), rng.normal(0, 0.01, (m, factors))
    gb, gw, gv = 1e-2, np.full(m, 1e-2), np.full((m, factors), 1e-2)
    own = [(f := place[r])[f < m] for r in rows]
    for _ in range(max(20, steps * 256 // len(own))):
        order = rng.permutation(len(own))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            idx = np.concatenate([own[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(own[i]) for i in batch])
            x = v[idx]
            s = np.stack([np.bincount(doc, x[:, f], len(batch)) for f in range(factors)], 1)
            sq = np.bincount(doc, (x * x).sum(1), len(batch))
            out = bias + np.bincount(doc, w[idx], len(batch)) + 0.5 * ((s * s).sum(1) - sq)
            e = 1 / (1 + np.exp(-np.clip(out, -500, 500))) - y[batch]
            e *= np.where(y[batch] > 0, heed, 1.0) / len(batch)
            d = e.sum()
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
            d = np.bincount(idx, e[doc], m) + l2 * w / len(batch)
            gw += d * d
            w -= rate * d / np.sqrt(gw)
            part = e[doc][:, None] * (s[doc] - x)
            d = np.stack([np.bincount(idx, part[:, f], m) for f in range(factors)], 1) + l2 * v / len(batch)
            gv += d * d
            v -= rate * d / np.sqrt(gv)
    return FactorizationMachine(place, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> FactorizationMachine:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("toxicity")
        for b in batches:
            found = [terms(t).astype(np.int32).tobytes() for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "terms"])

    rows = labelled.sample(docs, labels, "toxic", most, featurise, "terms binary")
    return fit([np.frombuffer(r.terms, np.int32).astype(np.int64) for r in rows], np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    workers.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        workers.begin("toxicity")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(terms(t)) for t in texts(b.column("text"))], pa.float64())], names=["doc_id", "score"])

    df = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return df.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
