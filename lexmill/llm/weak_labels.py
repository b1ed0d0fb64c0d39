"""Expectation-maximisation over vote patterns.

Votes are 1 (for), -1 (against) or 0 (abstains). Rows are counted by pattern in Spark first; with J
voters there are at most 3^J patterns, however many rows there are, and only those counts come here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VoteModel:
    """prior: share of positives; hit[j] = P(vote 1 | positive, votes), miss[j] = P(vote 1 | negative, votes)."""

    prior: float
    hit: tuple[float, ...]
    miss: tuple[float, ...]

    def log_odds(self, votes: Sequence[int]) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for v, a, b in zip(votes, self.hit, self.miss, strict=True):
            if v:
                z += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b))
        return z

    def posterior(self, votes: Sequence[int]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.log_odds(votes)))))

    def log_odds_column(self, votes: Sequence[Column]) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, a, b in zip(votes, self.hit, self.miss, strict=True):
            z = z + F.when(v > 0, F.lit(math.log(a / b))).when(v < 0, F.lit(math.log((1 - a) / (1 - b)))).otherwise(F.lit(0.0))
        return z


def fit(patterns: Sequence[tuple[Sequence[int], float]], *, prior: float = 0.8, hit: float = 0.85, miss: float = 0.15, strength: float = 0.02, rounds: int = 60) -> VoteModel:
    """patterns: (votes, rows). The start, and a Beta prior worth `strength` of all rows, say that a vote is 1 with
    probability `hit` for a positive and `miss` for a negative; that also fixes which class is the positive one.
    No rows: the prior itself."""
    total = sum(n for _, n in patterns)
    width = len(patterns[0][0]) if patterns else 0
    model = VoteModel(prior, (hit,) * width, (miss,) * width)
    weight = max(1.0, strength * total)
    for _ in range(rounds):
        good, yes_good, of_good, yes_bad, of_bad = 0.0, [0.0] * width, [0.0] * width, [0.0] * width, [0.0] * width
        for votes, n in patterns:
            p = model.posterior(votes)
            good += p * n
            for j, v in enumerate(votes):
                if v:
                    of_good[j] += p * n
                    of_bad[j] += (1 - p) * n
                    if v > 0:
                        yes_good[j] += p * n
                        yes_bad[j] += (1 - p) * n
        model = VoteModel(
            (good + weight * prior) / (total + weight),
            tuple((y + weight * hit) / (o + weight) for y, o in zip(yes_good, of_good, strict=True)),
            tuple((y + weight * miss) / (o + weight) for y, o in zip(yes_bad, of_bad, strict=True)),
        )
    return model


def fit_logistic(rows: Sequence[tuple[Sequence[float], float, float]], *, l2: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> tuple[float, ...]:
    """rows: (features, soft label, weight), one for each distinct feature pattern. Returns the weights, the last one the bias."""
    if not rows:
        return ()
    width, total = len(rows[0][0]), sum(n for _, _, n in rows) or 1.0
    w = [0.0] * (width + 1)
    speed = [1e-8] * (width + 1)
    for _ in range(rounds):
        g = [l2 * x for x in w[:-1]] + [0.0]
        for x, y, n in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            e = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - y) * n / total
            for i, v in enumerate(x):
                if v:
                    g[i] += e * v
            g[-1] += e
        for i, v in enumerate(g):
            speed[i] += v * v
            w[i] -= rate * v / math.sqrt(speed[i])
    return tuple(w)
