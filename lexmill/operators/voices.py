"""Voices, consents and callers as tables: each operation returns the new state."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources import shared


def latest(df: DataFrame, owner: str, at: str, key: str, k: int, skip: int = 0) -> DataFrame:
    """Each owner's rows skip+1 to skip+k, newest first."""
    r = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), key))
    return df.withColumn("position", r).filter((F.col("position") > skip) & (F.col("position") <= skip + k))


def with_consent(voices: DataFrame, consents: DataFrame, as_of: Column) -> DataFrame:
    """Voices with the effective status of their consent; usable if active and the voice is enabled."""
    c = consents.select("consent_id", F.col("status").alias("c_status"), "expires_at", "revoked_at")
    df = voices.join(c, "consent_id", "left")
    active = (F.col("c_status") == "verified") & F.col("revoked_at").isNull() & (as_of < F.col("expires_at"))
    return df.withColumn("consent_active", F.coalesce(active, F.lit(False))).withColumn("usable", F.col("consent_active") & (F.col("status") == "enabled"))


def revoked(voices: DataFrame, consent_ids: DataFrame) -> DataFrame:
    """Voices whose consent is among those revoked are disabled."""
    hit = shared.free_name(voices, "gone")
    gone = consent_ids.select("consent_id").distinct().withColumn(hit, F.lit(True))
    df = voices.join(gone, "consent_id", "left")
    return df.withColumn("status", F.when(F.col(hit), "disabled").otherwise(F.col("status"))).drop(hit)


def folded_name(name: str) -> str:
    """Lower case, then NFKD, letters and digits alone: no diacritics, no compatibility forms."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if c.isalnum())


def blocked_names(names: DataFrame, column: str, entries: list[str]) -> DataFrame:
    """Rows whose name holds an entry or is held by one, both folded. The entries are an operator's own list, part of
    the plan. Python, for Spark has no Unicode normalisation."""
    listed = [e for e in map(folded_name, entries) if e]

    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own = [folded_name(n) if n is not None else "" for n in batch]
            yield pd.Series([n != "" and any(e in n or n in e for e in listed) for n in own], dtype=bool)

    return names.filter(F.pandas_udf(hit, "boolean")(F.col(column)))


class TokenBuckets:
    """Two buckets a key, requests and characters; both start full."""

    def __init__(self, per_minute: float, characters_per_minute: float | None = None, burst: float = 1.5):
        self.rates = (per_minute / 60, (characters_per_minute or per_minute * 2000) / 60)
        self.room = tuple(r * 60 * burst for r in self.rates)

    def fresh(self, at: float) -> list[float]:
        return [*self.room, at]

    def check(self, state: list[float], at: float, cost: int) -> tuple[bool, float, float, str | None]:
        """Takes from state (requests, characters, time) what is granted; allowed, retry_after, remaining, reason."""
        gone = max(0.0, at - state[2])
        for i in (0, 1):
            state[i] = min(self.room[i], state[i] + gone * self.rates[i])
        state[2] = at
        want = max(1, cost)
        if state[0] < 1:
            return False, round((1 - state[0]) / self.rates[0], 3), round(state[0], 2), "requests"
        if state[1] < want:
            return False, round((want - state[1]) / self.rates[1], 3), round(state[1], 2), "characters"
        state[0] -= 1
        state[1] -= want
        return True, 0.0, round(state[0], 2), None


def rate_limited(requests: DataFrame, per_minute: float, characters_per_minute: float | None = None) -> DataFrame:
    """Decision for each request (key, ts, cost, request_id). A key's requests are one sequence: they are sorted
    inside their partition and folded as they stream by, so no key's history is held in memory."""
    buckets = TokenBuckets(per_minute, characters_per_minute)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for k, t, cost in zip(pdf["key"], pdf["at"], pdf["cost"], strict=True):
                if k != key or state is None:
                    key, state = k, buckets.fresh(t)
                out.append(buckets.check(state, t, int(cost)))
            yield pd.DataFrame({"key": pdf["key"], "request_id": pdf["request_id"], **{n: [x[i] for x in out] for i, n in enumerate(("allowed", "retry_after_seconds", "remaining", "reason"))}})

    rows = requests.select("key", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("at"), "cost")
    return rows.repartition("key").sortWithinPartitions("key", "at", "request_id").mapInPandas(fold, "key long, request_id long, allowed boolean, retry_after_seconds double, remaining double, reason string")
