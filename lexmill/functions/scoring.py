"""Edit distances with their parts, and signed consent challenges: what needs Python, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_FAR = 1 << 29


def _banded(r: np.ndarray, h: np.ndarray, k: int) -> tuple[int, int]:
    """Distance of two code lists and the substitutions of the alignment that edits() describes, if the distance is at most
    k; beyond, a greater number. A row of the table is its cells at most k off the diagonal. Substitutions go along with
    the distance, from the cell that the way back would go to, so no earlier row is kept."""
    n, m, width = len(r), len(h), 2 * k + 1
    around = np.concatenate((np.full(k + 1, -1), h, np.full(max(0, n - m) + k + 1, -1)))
    place = np.arange(width, dtype=np.int32)
    cost = np.where((place >= k) & (place - k <= m), place - k, _FAR).astype(np.int32)
    swaps = np.zeros(width, np.int32)
    end = np.array([_FAR], np.int32)
    for i in range(1, n + 1):
        other = (around[i : i + width] != r[i - 1]).astype(np.int32)
        across, down = cost + other, np.concatenate((cost[1:], end)) + 1
        cost = np.minimum.accumulate(np.minimum(across, down) - place) + place
        cost[: max(0, k - i)] = _FAR
        cost[max(0, m - i + k + 1) :] = _FAR
        is_across = cost == across
        swaps = np.where(is_across, swaps + other, np.append(swaps[1:], np.int32(0)))
        along = np.maximum.accumulate(np.where(is_across | (cost == down), place, 0))
        swaps = swaps[along]
    at = m - n + k
    return int(cost[at]), int(swaps[at])


def edits(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a shortest alignment; of equal ones the one that, from the end,
    prefers substitution, then deletion. Memory grows with the distance, time with it times the length: a band around the
    diagonal is widened fourfold until the distance fits into it. A common end is matched by any such alignment."""
    code: dict[str, int] = {}
    r, h = (np.array([code.setdefault(w, len(code)) for w in x], np.int64) for x in (reference, hypothesis))
    least = min(len(r), len(h))
    same = np.flatnonzero(r[::-1][:least] != h[::-1][:least])
    end = int(same[0]) if len(same) else least
    r, h = r[: len(r) - end], h[: len(h) - end]
    n, m, k = len(r), len(h), max(16, abs(len(r) - len(h)))
    while True:
        k = min(k, max(n, m, 1))
        distance, swaps = _banded(r, h, k)
        if distance <= k:
            deleted = (distance - swaps + n - m) // 2
            return swaps, deleted, distance - swaps - deleted
        k *= 4


_SHORT = 512


def edits_of_pairs(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """edits() of many pairs. Those of at most 512 words a side go through whole tables together, row by row, in groups of
    like length and about 32,000 cells a row."""
    out: list[tuple[int, int, int] | None] = [None] * len(pairs)
    short = []
    for at, (r, h) in enumerate(pairs):
        if max(len(r), len(h)) > _SHORT:
            out[at] = edits(r, h)
        else:
            short.append((len(r), len(h), at))
    short.sort()
    while short:
        many = max(1, 32_768 // (1 + max(m for _, m, _ in short[-512:])))
        group, short = short[-many:], short[:-many]
        for (_, _, at), found in zip(group, _tables([pairs[at] for _, _, at in group]), strict=True):
            out[at] = found
    return out


def _tables(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """As _banded, without a band: a row of all pairs' tables at a time. Cells behind a pair's own last column or row change
    nothing of what is taken from it."""
    code: dict[str, int] = {}
    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    r, h = np.full((len(pairs), n.max()), -1, np.int32), np.full((len(pairs), m.max()), -2, np.int32)
    for i, pair in enumerate(pairs):
        for to, words in zip((r, h), pair, strict=True):
            to[i, : len(words)] = [code.setdefault(w, len(code)) for w in words]
    place = np.arange(h.shape[1] + 1, dtype=np.int32)
    cost, swaps = np.tile(place, (len(pairs), 1)), np.zeros((len(pairs), len(place)), np.int32)
    distance, swapped = m.copy(), np.zeros(len(pairs), np.int64)
    for i in range(1, r.shape[1] + 1):
        other = (h != r[:, i - 1 : i]).astype(np.int32)
        across, best = cost[:, :-1] + other, cost + 1
        down = best.copy()
        np.minimum(best[:, 1:], across, out=best[:, 1:])
        best -= place
        cost = np.minimum.accumulate(best, axis=1) + place
        is_across = cost[:, 1:] == across
        own = np.where(cost == down, swaps, -1)
        own[:, 1:] = np.where(is_across, swaps[:, :-1] + other, own[:, 1:])
        # A cell that is reached along its row has the swaps of the last one before it that isn't.
        swaps = np.maximum.accumulate(np.where(own >= 0, place << 16 | own, 0), axis=1) & 0xFFFF
        ends = np.flatnonzero(n == i)
        distance[ends], swapped[ends] = cost[ends, m[ends]], swaps[ends, m[ends]]
    deleted = (distance - swapped + n - m) // 2
    return list(zip(swapped.tolist(), deleted.tolist(), (distance - swapped - deleted).tolist(), strict=True))


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """struct<substitutions, deletions, insertions> of two arrays of strings; null where one is."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rs, hs in batches:
            there = [(list(r), list(h)) for r, h in zip(rs, hs, strict=True) if r is not None and h is not None]
            found = iter(edits_of_pairs(there))
            rows = [(None,) * 3 if r is None or h is None else next(found) for r, h in zip(rs, hs, strict=True)]
            yield pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"]).astype("Int32")

    return F.pandas_udf(run, "substitutions int, deletions int, insertions int")(reference, hypothesis)


def _coded(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _decoded(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def challenge_tokens(body: Column, key: bytes) -> Column:
    """body.signature of a JSON text, both base64url without padding; the signature is HMAC-SHA256 by the key."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if b is None else f"{_coded(b.encode())}.{_coded(hmac.new(key, b.encode(), hashlib.sha256).digest())}" for b in batch], dtype=object)

    return F.pandas_udf(run, "string")(body)


def challenge_bodies(token: Column, key: bytes) -> Column:
    """struct<value, error_code, error_message>: the JSON text of a token, where its signature verifies."""

    def one(token: str) -> tuple[str | None, str | None, str | None]:
        try:
            body, signature = map(_decoded, token.split(".", 1))
            text = body.decode()
        except ValueError:
            return None, "consent_required", "malformed token"
        if not hmac.compare_digest(hmac.new(key, body, hashlib.sha256).digest(), signature):
            return None, "consent_required", "the signature doesn't verify"
        try:
            json.loads(text)
        except ValueError:
            return None, "consent_required", "the body is no JSON"
        return text, None, None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(None,) * 3 if t is None else one(t) for t in batch], columns=["value", "error_code", "error_message"], dtype=object)

    return F.pandas_udf(run, "value string, error_code string, error_message string")(token)
