"""The limiter of operators/voices.py over a stream: the buckets of each key are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.operators.voices import TokenBuckets

DECISION = "key long, request_id long, allowed boolean, retry_after_seconds double, remaining double, reason string"


def rate_limited(requests: DataFrame, per_minute: float, characters_per_minute: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """Decision for each request (key, ts, cost, request_id) as it comes; a key's requests are taken in time's order
    inside a batch. idle_ms: a key without requests for so long (of processing time) is forgotten, as full buckets
    are what a new key has; choose it longer than the buckets take to fill."""
    buckets = TokenBuckets(per_minute, characters_per_minute)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "request_id"])
        own = list(state.get) if state.exists else buckets.fresh(float(pdf["at"].iloc[0]))
        out = [buckets.check(own, float(t), int(c)) for t, c in zip(pdf["at"], pdf["cost"], strict=True)]
        state.update(tuple(own))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"].to_numpy(), **{n: [x[i] for x in out] for i, n in enumerate(("allowed", "retry_after_seconds", "remaining", "reason"))}})

    rows = requests.select("key", "request_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("at"), "cost")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(fold, DECISION, "requests double, characters double, at double", "append", timeout)
