"""Pieces of utterances in order, from a stream that brings them in any order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.operators.synthesis import with_pause

ORDERED = "utterance long, index long, samples array<float>, sample_rate int, error_code string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """State of an utterance: the index that is due, and the pieces that came before their turn, by index. A piece leaves
    when all before it have left; with the last one the state goes. A piece of an index that has left, or is held already,
    is dropped. An utterance that has waited for `expire_ms` since its last piece came ends with a row of the index it
    waited for and an error; what it still held goes. Without expire_ms none expires."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "index long")
        self.held = handle.getMapState("held", "index long", "samples array<float>, sample_rate int, last boolean")

    def _forget(self) -> None:
        self.due.clear()
        self.held.clear()
        self._no_timer()

    def _no_timer(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        due = self.due.get()[0] if self.due.exists() else 0
        for pdf in rows:
            for index, samples, rate, last in zip(pdf["index"], pdf["samples"], pdf["sample_rate"], pdf["last"], strict=True):
                if index >= due and not self.held.containsKey((int(index),)):
                    self.held.updateValue((int(index),), (None if samples is None else [float(x) for x in samples], int(rate), bool(last)))
        out, ended = [], False
        while not ended and self.held.containsKey((due,)):
            samples, rate, ended = self.held.getValue((due,))
            self.held.removeKey((due,))
            out.append((key[0], due, samples, rate, None))
            due += 1
        if ended:
            self._forget()
        else:
            self.due.update((due,))
            self._no_timer()
            if self.expire_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due.get()[0] if self.due.exists() else 0
        self.due.clear()
        self.held.clear()
        yield _frame([(key[0], due, None, None, "backend_unavailable")])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["utterance", "index", "samples", "sample_rate", "error_code"])
    return out.astype({"utterance": "int64", "index": "int64", "sample_rate": "Int32", "error_code": object})


@contextmanager
def in_order_of_data(spark: SparkSession) -> Iterator[None]:
    """Batches for data alone while the block runs. With timers of processing time Spark would add batches without data
    for ever, and a query that is to end with its input (availableNow) would not."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_order(pieces: DataFrame, expire_ms: int | None = 60_000) -> DataFrame:
    """Each utterance's pieces (utterance, index from 0, samples, sample_rate, pause_ms, last: whether it is the last one)
    in order, with their pauses, each as soon as those before it are there; see InOrder. The session's state store must be
    RocksDB, which this sets. Pieces that lie in files already need no expire_ms: how long a batch takes says nothing of them. A restart from the checkpoint goes on where the stream stopped."""
    pieces.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    whole = pieces.select("utterance", F.col("index").cast("long").alias("index"), with_pause(F.col("samples"), F.col("sample_rate"), F.col("pause_ms")).alias("samples"), F.col("sample_rate").cast("int").alias("sample_rate"), F.coalesce("last", F.lit(False)).alias("last"))
    return whole.filter("index IS NOT NULL").groupBy("utterance").transformWithStateInPandas(statefulProcessor=InOrder(expire_ms), outputStructType=ORDERED, outputMode="Append", timeMode="ProcessingTime")
