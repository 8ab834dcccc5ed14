"""State with timers and expiry of its own (ST4, ST9), on transformWithState.

They need the RocksDB state store: use_rocksdb() sets it for streams started afterwards, run_available() for its own. Timers run by the clock,
so they fire while no row arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.streams import run_to_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """As run_to_table, for streams that keep time by the clock: with timers or a time to live to look after, a run over
    what is available would go on with batches without rows for ever, so there are none. Timers that are due fire with
    the next run that has rows; to have them fire on time, let the stream run on.
    """
    spark = stream.sparkSession
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", PROVIDER: ROCKSDB}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return run_to_table(stream, folder, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LeaseTimers(StatefulProcessor):
    """A lease holds until its time is over, unless it is renewed or released; every change of a key is a row."""

    def __init__(self, key: str, at: str, event: str, lease_ms: int):
        self.key, self.at, self.event, self.lease_ms = key, at, event, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def _row(self, key: tuple, status: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "status": [status]})

    def _forget(self) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values(self.at, kind="stable").iloc[-1][self.event]
        held = self.until.exists()
        self._forget()
        if last == "release":
            yield self._row(key, "released")
            return
        until = timerValues.getCurrentProcessingTimeInMs() + self.lease_ms
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield self._row(key, "renewed" if held else "leased")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield self._row(key, "lease_expired")

    def close(self) -> None:
        pass


def lease_timers(stream: DataFrame, key: str, at: str, event: str, lease_ms: int) -> DataFrame:
    """ST9: (key, status) whenever a lease is taken, renewed, released, or runs out by the clock.

    Of a key's events in one batch the latest counts; events are lease, renew and release.
    """
    schema = f"{key} {dict(stream.dtypes)[key]}, status string"
    return stream.groupBy(key).transformWithStateInPandas(LeaseTimers(key, at, event, lease_ms), schema, "Append", "ProcessingTime")


class IdleCounters(StatefulProcessor):
    """Consecutive failures of a key; what isn't touched for the time to live is forgotten."""

    def __init__(self, key: str, order: list[str], outcome: str, failures: list[str], resets: list[str], limit: int, ttl_ms: int):
        self.key, self.order, self.outcome, self.failures, self.resets, self.limit, self.ttl_ms = key, order, outcome, failures, resets, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "streak long, active boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, active = self.held.get() if self.held.exists() else (0, True)
        for value in pd.concat(list(rows)).sort_values(self.order)[self.outcome]:
            streak = streak + 1 if value in self.failures else 0 if value in self.resets else streak
            active = active and streak < self.limit
        self.held.update((int(streak), bool(active)))
        yield pd.DataFrame({self.key: [key[0]], "failures": [int(streak)], "is_active": [bool(active)]})

    def close(self) -> None:
        pass


def idle_counters(stream: DataFrame, key: str, order: list[str], outcome: str, failures: list[str], resets: list[str], limit: int, ttl_ms: int) -> DataFrame:
    """ST4: as failure_counters, and keys idle for longer than the time to live begin anew."""
    schema = f"{key} {dict(stream.dtypes)[key]}, failures long, is_active boolean"
    processor = IdleCounters(key, order, outcome, failures, resets, limit, ttl_ms)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")
