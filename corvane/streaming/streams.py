"""Structured Streaming twins of the scheduled cycles (ST1-ST9).

Sources are folders of files; runs use availableNow, so a scheduled run takes what is new and stops. State and offsets
live in the run's own folder, data is written before cursors, and sinks are idempotent, so a repeated batch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.sources.committed import Snapshot, TableSet


def file_stream(spark: SparkSession, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files that fit the pattern, with the schema that those there have."""
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def run_to_table(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over what is available into an append-only table, and gives the table."""
    out = f"{folder}/{name}"
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/{name}.offsets")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, folder: str, name: str, act: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/{name}.offsets")
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()


class Versions:
    """A table in numbered versions: readers see the last that is whole, also after a restart."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def last(self) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        return max((int(f.getPath().getParent().getName()) for f in found or []), default=-1)

    def read(self) -> DataFrame:
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{last}")

    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{self.last() + 1}")


def above_high_water(stream: DataFrame, folder: str, column: str, cursor: Versions) -> DataFrame:
    """ST1: rows later than the cursor, which moves to the latest row once the batch is written. Later comers drop.

    The cursor holds (batch, at): a batch met again is judged by the cursor as it was before that batch, so it is
    written with the same rows once more.
    """
    spark, out = stream.sparkSession, f"{folder}/accepted"

    def act(batch: DataFrame, number: int) -> None:
        before = cursor.read().where(F.col("batch") < number).agg(F.max("at").alias("__at"))
        batch = batch.crossJoin(F.broadcast(before)).where(F.col("__at").isNull() | (F.col(column) > F.col("__at"))).drop("__at")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema(stream.schema).parquet(f"{out}/batch={number}").agg(F.max(column).alias("at"))
        held = before.selectExpr(f"{number - 1}L AS batch", "__at AS at").where("at IS NOT NULL")
        cursor.write(held.unionByName(written.selectExpr(f"{number}L AS batch", "at").where("at IS NOT NULL")))

    run_batches(stream, folder, "high-water", act)
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def insert_once(stream: DataFrame, folder: str, keys: list[str], state: Versions) -> DataFrame:
    """ST2, ST6: each batch's unseen keys go into the state, and a batch met again adds nothing."""
    from corvane.operators.merge import insert_if_absent

    def act(batch: DataFrame, number: int) -> None:
        columns = [F.col(c) for c in batch.columns]
        state.write(insert_if_absent(state.read(), batch, keys, columns))

    run_batches(stream, folder, "insert", act)
    return state.read()


def insert_new(stream: DataFrame, folder: str, keys: list[str], tables: TableSet, name: str) -> DataFrame:
    """ST6 by changes: a batch adds its unseen keys as one more part, so what is written follows the batch and not the state."""
    from corvane.operators.merge import first_of

    def act(batch: DataFrame, number: int) -> None:
        fresh = first_of(batch, keys, [F.col(c) for c in batch.columns])
        tables.transact(lambda base: {name: fresh.join(base.table(name).select(*keys), keys, "left_anti")}, (name, number))

    run_batches(stream, folder, name, act)
    return tables.snapshot().table(name)


def stamp_when_written(stream: DataFrame, folder: str, key: str, tables: TableSet, output: Callable[[DataFrame], DataFrame], now: Column) -> None:
    """ST2: rows that have no stamp yet give their output; once that is durable, and only then, they are stamped.

    Output and stamp are two commits, each at most once for a batch: after a break between them the output isn't
    written again, and the stamp follows. Tables: outputs (any columns that output gives), stamps (the key and checked_at).
    """

    def act(batch: DataFrame, number: int) -> None:
        def unseen(base: Snapshot) -> DataFrame:
            return batch.join(base.table("stamps").select(key), key, "left_anti")

        tables.transact(lambda base: {"outputs": output(unseen(base))}, ("outputs", number))
        tables.transact(lambda base: {"stamps": unseen(base).select(key, now.alias("checked_at")).distinct()}, ("stamps", number))

    run_batches(stream, folder, "stamped", act)


def split_late(stream: DataFrame, folder: str, at: str, delay: str, tables: TableSet) -> None:
    """ST8: rows behind the watermark go to a table of their own instead of being lost.

    The watermark of a batch is the latest time of all batches before it less the delay. Tables, changed together:
    accepted and late (the stream's columns), marks (batch, latest).
    """

    def act(batch: DataFrame, number: int) -> None:
        def change(base: Snapshot) -> dict[str, DataFrame]:
            latest = base.table("marks").agg(F.max("latest").alias("__latest"))
            marked = batch.crossJoin(F.broadcast(latest))
            behind = F.coalesce(F.col(at) < F.col("__latest") - F.expr(f"INTERVAL {delay}"), F.lit(False))
            mark = batch.agg(F.max(at).alias("latest")).select(F.lit(number).cast("long").alias("batch"), "latest")
            return {"accepted": marked.where(~behind).drop("__latest"), "late": marked.where(behind).drop("__latest"), "marks": mark}

        tables.transact(change, ("late", number))

    run_batches(stream, folder, "late", act)


def payload_changes(stream: DataFrame, key: str, order: str, payload_hash: str) -> DataFrame:
    """ST3: rows whose payload differs from the last one of their key."""

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        last = state.get[0] if state.exists else None
        before = rows[payload_hash].shift(1)
        before.iloc[0] = last
        state.update((rows[payload_hash].iloc[-1],))
        yield rows.assign(changed=(rows[payload_hash] != before) | before.isna())[[key, order, payload_hash, "changed"]]

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {payload_hash} string, changed boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def failure_counters(stream: DataFrame, key: str, order: list[str], outcome: str, failures: list[str], resets: list[str], limit: int) -> DataFrame:
    """ST4: consecutive failures of each key; on the limit it is inactive for good. One row a key and batch."""

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, active = state.get if state.exists else (0, True)
        for value in pd.concat(list(frames)).sort_values(order)[outcome]:
            streak = streak + 1 if value in failures else 0 if value in resets else streak
            active = active and streak < limit
        state.update((int(streak), bool(active)))
        yield pd.DataFrame({key: [key_[0]], "failures": [int(streak)], "is_active": [bool(active)]})

    schema = f"{key} {dict(stream.dtypes)[key]}, failures long, is_active boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "streak long, active boolean", "append", GroupStateTimeout.NoTimeout)


def breakers(stream: DataFrame, key: str, order: list[str], outcome: str, page_block: list[str], failures: list[str], resets: list[str], limit: int = 10, page_limit: int = 3) -> DataFrame:
    """ST5: the two streaks of each run and whether it has to halt, after each batch."""

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, pages, tripped = state.get if state.exists else (0, 0, False)
        for value in pd.concat(list(frames)).sort_values(order)[outcome]:
            if value in resets:
                streak = pages = 0
            streak += value in failures
            pages += value in page_block
            tripped = tripped or pages >= page_limit
        state.update((int(streak), int(pages), bool(tripped)))
        yield pd.DataFrame({key: [key_[0]], "block_streak": [int(streak)], "page_block_streak": [int(pages)], "should_halt": [bool(tripped or streak >= limit)]})

    schema = f"{key} {dict(stream.dtypes)[key]}, block_streak long, page_block_streak long, should_halt boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "streak long, pages long, tripped boolean", "append", GroupStateTimeout.NoTimeout)


def distinct_within(stream: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """ST6: the first row of each key within the watermark; older state is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def since_checkpoint(stream: DataFrame, at: str, checkpoint: Column) -> DataFrame:
    """ST7: what ended after the last checkpoint."""
    return stream.where(F.col(at) > checkpoint)


def windowed_counts(stream: DataFrame, at: str, size: str, key: str, delay: str) -> DataFrame:
    """ST8: counts by event-time window; windows are final when the watermark has passed them."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(stream: DataFrame, at: str, size: str, slide: str, key: str, delay: str) -> DataFrame:
    """ST8: counts by overlapping windows of the size that begin every slide."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size, slide), key).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, at: str, gap: str, key: str, delay: str) -> DataFrame:
    """ST8: a key's events with no gap as long as that between them are one session; sessions merge as events come in between."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def expiring_leases(stream: DataFrame, key: str, at: str, event: str, minutes: int) -> DataFrame:
    """ST9: a lease that isn't renewed or released in time is reported expired, by event time.

    Events are lease, renew and release; the timer runs by the watermark of the event-time column.
    """

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [key_[0]], "status": ["lease_expired"]})
            return
        rows = pd.concat(list(frames)).sort_values(at)
        last = rows.iloc[-1]
        if last[event] == "release":
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [key_[0]], "status": ["released"]})
            return
        until = int(pd.Timestamp(last[at]).timestamp() * 1000) + minutes * 60_000
        if until <= state.getCurrentWatermarkMs():
            yield pd.DataFrame({key: [key_[0]], "status": ["lease_expired"]})
            return
        state.update((until,))
        state.setTimeoutTimestamp(until)
        yield pd.DataFrame({key: [key_[0]], "status": ["leased"]})

    schema = f"{key} {dict(stream.dtypes)[key]}, status string"
    return stream.withWatermark(at, "0 seconds").groupBy(key).applyInPandasWithState(step, schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)
