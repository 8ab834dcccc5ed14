"""State with timers by the clock, stamps after durable output, late rows."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.sources.committed import TableSet
from corvane.streaming import stateful, streams


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def until(done, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return True
        time.sleep(0.3)
    return False


def test_a_lease_runs_out_without_further_input(rocksdb, tmp_path):
    spark, landed, out = rocksdb, str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, at timestamp, event string"
    land(spark, landed, [(1, datetime(2024, 1, 1), "lease"), (2, datetime(2024, 1, 1), "lease"), (2, datetime(2024, 1, 2), "release"), (3, datetime(2024, 1, 1), "lease")], schema)
    found = stateful.lease_timers(streams.file_stream(spark, landed), "k", "at", "event", 4000)
    run = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "offsets")).trigger(processingTime="1 second").start()
    try:
        seen = lambda: sorted((r.k, r.status) for r in spark.read.schema("k long, status string").parquet(out).collect()) if (tmp_path / "out").exists() else []
        assert until(lambda: len(seen()) >= 3)
        assert (2, "released") in seen() and (1, "leased") in seen()
        assert until(lambda: [s for s in seen() if s[1] == "lease_expired"] == [(1, "lease_expired"), (3, "lease_expired")])
        time.sleep(2)
        assert seen() == [(1, "lease_expired"), (1, "leased"), (2, "released"), (3, "lease_expired"), (3, "leased")]
    finally:
        run.stop()


def test_idle_keys_are_forgotten(rocksdb, tmp_path):
    """Two failures, an idle time beyond the time to live, one more: the streak begins anew, and no state stays."""
    spark, landed = rocksdb, str(tmp_path / "in")
    schema = "k long, seq long, outcome string"

    def run(ttl):
        df = stateful.idle_counters(streams.file_stream(spark, landed), "k", ["seq"], "outcome", ["bad"], ["good"], 5, ttl)
        return sorted((r.k, r.failures) for r in stateful.run_available(df, str(tmp_path), f"ttl-{ttl}").collect())

    land(spark, landed, [(1, 1, "bad"), (1, 2, "bad")], schema)
    assert run(1) == run(3_600_000) == [(1, 2)]
    time.sleep(0.1)
    land(spark, landed, [(1, 3, "bad"), (2, 4, "bad")], schema)
    assert run(1) == [(1, 1), (1, 2), (2, 1)]
    assert run(3_600_000) == [(1, 2), (1, 3), (2, 1)]


def stamped(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "tables"))
    tables.create({"outputs": spark.createDataFrame([], "id long"), "stamps": spark.createDataFrame([], "id long, checked_at timestamp")})
    return tables


def test_a_break_between_output_and_stamp(spark, tmp_path, monkeypatch):
    """The batch is run again: its output isn't written twice, and the stamps follow."""
    landed, tables = str(tmp_path / "in"), stamped(spark, tmp_path)
    land(spark, landed, [(k,) for k in range(10)], "id long")
    now = F.lit("2024-01-15").cast("timestamp")
    go = lambda: streams.stamp_when_written(streams.file_stream(spark, landed), str(tmp_path), "id", tables, lambda rows: rows.where("id % 2 = 0"), now)
    own = TableSet.transact

    def breaks(self, change, batch=None, tries=50):
        if batch and batch[0] == "stamps":
            raise RuntimeError("killed")
        return own(self, change, batch, tries)

    monkeypatch.setattr(TableSet, "transact", breaks)
    with pytest.raises(Exception, match="killed"):
        go()
    held = tables.snapshot()
    assert held.table("outputs").count() == 5 and held.table("stamps").count() == 0
    monkeypatch.setattr(TableSet, "transact", own)
    go()
    held = tables.snapshot()
    assert sorted(r.id for r in held.table("outputs").collect()) == [0, 2, 4, 6, 8]
    assert sorted(r.id for r in held.table("stamps").collect()) == list(range(10))
    land(spark, landed, [(k,) for k in range(8, 12)], "id long")  # two of them have their stamp
    go()
    held = tables.snapshot()
    assert sorted(r.id for r in held.table("outputs").collect()) == [0, 2, 4, 6, 8, 10]
    assert sorted(r.id for r in held.table("stamps").collect()) == list(range(12))


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    landed = str(tmp_path / "in")
    tables = TableSet(spark, str(tmp_path / "tables"))
    tables.create({"seen": spark.createDataFrame([], "id long, v string")})
    sizes = []
    for rows in ([(k, "x") for k in range(3000)], [(k, "y") for k in range(2990, 3010)], [(5, "z")]):
        land(spark, landed, rows, "id long, v string")
        found = streams.insert_new(streams.file_stream(spark, landed), str(tmp_path), ["id"], tables, "seen")
        sizes.append(tables.snapshot().tables["seen"]["parts"][-1][1])
    assert sizes == [3000, 10, 0]
    assert {(r.v, r["count"]) for r in found.groupBy("v").count().collect()} == {("x", 3000), ("y", 10)}


def test_late_rows_are_kept_aside(spark, tmp_path):
    landed, schema = str(tmp_path / "in"), "id long, ts timestamp"
    tables = TableSet(spark, str(tmp_path / "tables"))
    empty = spark.createDataFrame([], schema)
    tables.create({"accepted": empty, "late": empty, "marks": spark.createDataFrame([], "batch long, latest timestamp")})
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[(1, at(0)), (2, at(10))], [(3, at(8)), (4, at(7)), (5, None), (6, at(20))], [(7, at(17)), (8, at(18))]]
    for rows in batches:
        land(spark, landed, rows, schema)
        streams.split_late(streams.file_stream(spark, landed), str(tmp_path), "ts", "2 hours", tables)
    held = tables.snapshot()
    assert sorted(r.id for r in held.table("late").collect()) == [4, 7]
    assert sorted(r.id for r in held.table("accepted").collect()) == [1, 2, 3, 5, 6, 8]
    windows = streams.windowed_counts(streams.file_stream(spark, f"{tables.path}/data/accepted/*"), "ts", "1 hour", "id", "2 hours")
    assert streams.run_to_table(windows, str(tmp_path), "counts").count() > 0


def test_sessions_merge(spark, tmp_path):
    landed, schema = str(tmp_path / "in"), "k long, ts timestamp"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    land(spark, landed, [(1, at(0)), (1, at(20)), (2, at(0))], schema)
    land(spark, landed, [(1, at(10)), (1, at(40)), (9, at(5000))], schema)
    found = streams.run_to_table(streams.session_counts(streams.file_stream(spark, landed), "ts", "15 minutes", "k", "1 hour"), str(tmp_path), "sessions")
    assert sorted((r.k, r.n, r.session_window.start) for r in found.collect()) == [(1, 1, at(40)), (1, 3, at(0)), (2, 1, at(0))]
