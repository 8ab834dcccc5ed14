"""Commits over several tables, claims among workers, chunked writes that go on, and the client's phases."""

from __future__ import annotations

import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import lifecycle
from corvane.sources import committed, sinks
from corvane.sources.committed import Conflict, TableSet

def now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tables(spark, tmp_path):
    held = TableSet(spark, str(tmp_path / "set"))
    numbers = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    held.create({"state": numbers, "log": numbers, "more": numbers, "last": numbers}, {"state": ["id"]})
    return held


def test_keyed_and_growing_tables(spark, tables):
    change = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    tables.transact(lambda base: {"state": change, "log": change})
    held = tables.snapshot()
    assert rows(held.table("state")) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(held.table("log")) == [(1, "a"), (2, "B"), (2, "b"), (3, "c")]
    assert rows(tables.snapshot(0).table("state")) == [(1, "a"), (2, "b")]


def test_a_commit_that_breaks_off_is_never_seen(spark, tables):
    """It fails after the second of four tables; readers see the old state of all four."""
    good = spark.createDataFrame([(9, "z")], "id long, v string")
    bad = good.select("id", F.raise_error(F.lit("broken")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        tables.transact(lambda base: {"state": good, "log": good, "more": bad, "last": good})
    held = tables.snapshot()
    assert held.version == 0
    assert all(rows(held.table(n)) == [(1, "a"), (2, "b")] for n in ("state", "log", "more", "last"))
    written = sum(len(os.listdir(f"{tables.path}/data/{n}")) for n in ("state", "log", "more", "last"))
    tables.sweep()
    assert sum(len(os.listdir(f"{tables.path}/data/{n}")) for n in ("state", "log", "more", "last")) == 4 < written
    assert rows(tables.snapshot().table("state")) == [(1, "a"), (2, "b")]


def test_two_writers_of_one_version(spark, tables):
    base = tables.snapshot()
    change = spark.createDataFrame([(7, "x")], "id long, v string")
    tables.commit(base, {"log": change})
    with pytest.raises(Conflict):
        tables.commit(base, {"state": change})
    assert rows(tables.snapshot().table("state")) == [(1, "a"), (2, "b")]


def test_a_batch_counts_once(spark, tables):
    change = spark.createDataFrame([(7, "x")], "id long, v string")
    first = tables.transact(lambda base: {"log": change}, ("stream", 3))
    assert tables.transact(lambda base: {"log": change}, ("stream", 3)) == first
    assert tables.transact(lambda base: {"log": change}, ("stream", 2)) == first
    assert tables.snapshot().table("log").count() == 3
    tables.transact(lambda base: {"log": change}, ("other", 0))
    assert tables.snapshot().table("log").count() == 4


def test_merging_parts(spark, tables, monkeypatch):
    """Few parts stay, and the parts written follow the changes and not the table."""
    monkeypatch.setattr(committed, "COMPACT", 3)
    written = []
    own = TableSet._write
    monkeypatch.setattr(TableSet, "_write", lambda self, df, name: written.append(own(self, df, name)) or written[-1])
    want = {1: "a", 2: "b"} | {k: "w" for k in range(100, 300)}
    tables.transact(lambda base: {"state": spark.range(100, 300).select("id", F.lit("w").alias("v"))})
    written.clear()
    for k in range(12):
        change = spark.createDataFrame([(k % 5, f"v{k}"), (1000 + k, "n")], "id long, v string")
        want |= {k % 5: f"v{k}", 1000 + k: "n"}
        tables.transact(lambda base: {"state": change, "log": change})
    held = tables.snapshot()
    assert dict(rows(held.table("state"))) == want
    assert held.table("log").count() == 2 + 24
    assert max(len(held.tables[n]["parts"]) for n in ("state", "log")) <= 5
    assert max(n for _, n in written) < 100  # the large part is never written again


@pytest.fixture
def queue(spark, tmp_path):
    made = [(k, k % 7, "matched" if k % 3 else "ready", datetime(2024, 1, 1) + timedelta(minutes=k % 13)) for k in range(120)]
    items = spark.createDataFrame(made, "id long, user_id long, status string, created_at timestamp")
    items = items.select("*", F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("claimed_by"))
    held = TableSet(spark, str(tmp_path / "queue"))
    held.create({"items": items}, {"items": ["id"]})
    return held, made


def test_claims_of_workers_are_disjoint(queue):
    held, made = queue
    got: dict[str, list[int]] = {}

    def work(name):
        got[name] = [r.id for r in lifecycle.claim_committed(held, name, now(), F.col("user_id") % 2, 25).collect()]

    workers = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    every = [i for ids in got.values() for i in ids]
    order = sorted((m for m in made if m[2] == "matched"), key=lambda m: (m[1] % 2, m[3], m[0]))
    assert len(every) == len(set(every)) == len(order) == 80  # 25 + 25 + 25 and the 5 left
    assert sorted(map(len, got.values())) == [5, 25, 25, 25]
    final = {r.id: (r.status, r.claimed_by) for r in held.snapshot().table("items").collect()}
    assert all(final[i] == ("preparing", name) for name, ids in got.items() for i in ids)
    assert all(final[m[0]] == (m[2], None) for m in made if m[2] != "matched")


def submissions(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "submitting", "applied"), (2, "awaiting_review", None), (3, "ready", None), (4, "submitted", "x"), (5, "submitting", None)], "id long, status string, current_stage string"
    ).select("*", F.lit(None).cast("timestamp").alias("applied_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    day = lambda n: datetime(2024, 1, n)
    predictions = spark.createDataFrame(
        [(1, 10, day(1), None, None, None), (1, 11, day(2), None, None, None), (1, 12, day(3), "rejected", day(3), day(3)), (5, 13, day(1), "rejected", day(1), day(1)), (3, 14, day(1), None, None, None)],
        "item_id long, prediction_id long, predicted_at timestamp, actual_outcome_type string, actual_outcome_date timestamp, evaluated_at timestamp",
    )
    held = TableSet(spark, str(tmp_path / "submissions"))
    outcomes = spark.createDataFrame([], "item_id long, outcome_type string, outcome_date timestamp, outcome_source string, confidence double, previous_outcome_type string")
    corrections = spark.createDataFrame([], "item_id long, snapshot_filled string, snapshot_submitted string")
    held.create({"items": items, "outcomes": outcomes, "corrections": corrections, "predictions": predictions}, {"items": ["id"], "predictions": ["prediction_id"]})
    return held


def test_a_submission_changes_four_tables_once(spark, tmp_path):
    held = submissions(spark, tmp_path)
    sent = spark.createDataFrame([(1, "{}", '{"a": 1}'), (1, "{}", '{"a": 1}'), (2, "{}", None), (3, "{}", "{}"), (4, "{}", "{}"), (9, "{}", "{}"), (None, "{}", "{}")], "id long, snapshot_filled string, snapshot_submitted string")
    for _ in range(2):
        held.transact(lambda base: lifecycle.confirm_submissions(base.table("items"), base.table("predictions"), sent, now()))
    final = held.snapshot()
    assert rows(final.table("items").select("id", "status")) == [(1, "submitted"), (2, "submitted"), (3, "ready"), (4, "submitted"), (5, "submitting")]
    assert rows(final.table("outcomes").select("item_id", "previous_outcome_type")) == [(1, "applied"), (2, None)]
    assert rows(final.table("corrections")) == [(1, "{}", '{"a": 1}')]
    assert rows(final.table("predictions").select("prediction_id", "actual_outcome_type")) == [(10, None), (11, "applied_confirmed"), (12, "rejected"), (13, "rejected"), (14, None)]


def test_chunked_write_goes_on(spark, tmp_path):
    """Killed in the third round and run again: each row once, finished rounds untouched, ranks as they were."""
    path = str(tmp_path / "chunks")
    df = spark.range(0, 5003).select((F.col("id") * 7 % 5003).alias("id"), F.lit("x").alias("v"))
    passed: list[int] = []

    def act(some, number):
        if number == 2 and not passed.count(-1):
            passed.append(-1)
            raise RuntimeError("killed")
        passed.append(number)

    with pytest.raises(RuntimeError, match="killed"):
        sinks.write_chunks(df, path, ["id"], 100, 8, act)
    before = {k: os.stat(f"{path}/chunks/{k:04d}/_DONE").st_mtime_ns for k in range(2)}
    found = sinks.write_chunks(df.limit(0), path, ["id"], 100, 8, act)
    assert passed == [0, 1, -1, *range(2, 8)]
    assert before == {k: os.stat(f"{path}/chunks/{k:04d}/_DONE").st_mtime_ns for k in range(2)}
    assert rows(found.select("id", "chunk")) == sorted(((i, i // 100) for i in range(5003)), key=str)
    assert sinks.write_chunks(df, path, ["id"], 100, 8, act).count() == 5003 and passed[-1] == 7 and len(passed) == 9


def test_chunks_of_equal_keys_and_nothing(spark, tmp_path):
    """One key holds nearly all rows: its ranges are several, chunks are still full."""
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("id"))
    found = sinks.write_chunks(df, str(tmp_path / "hot"), ["id"], 250, 3)
    assert {(r.chunk, r["count"]) for r in found.groupBy("chunk").count().collect()} == {(k, 250) for k in range(12)}
    staged = spark.read.parquet(f"{tmp_path}/hot/staged")
    sizes = [r["count"] for r in staged.groupBy(F.shiftrightunsigned("__at", 33)).count().collect()]
    assert max(sizes) < 2000
    assert sinks.write_chunks(df.limit(0), str(tmp_path / "none"), ["id"], 250, 3).count() == 0


def fold(events):
    state, out = lifecycle.Phase(), []
    for at, event, tab in events:
        result, released = state.take(at, event, tab)
        out.append((state.phase, result, released))
    return out


def test_a_run_of_the_client():
    assert fold([(0, "poll", None), (1, "poll", None), (2, "claimed", 5), (3, "loaded", 4), (4, "loaded", 5), (5, "success", 4), (6, "success", 5), (7, "success", 5), (60, "next_job", None), (61, "no_job", None)]) == [
        ("fetching", "fetching", None), ("fetching", "skipped_busy", None), ("tab_open", "job_found", None), ("tab_open", "ok", None), ("filling", "ok", None),
        ("filling", "stale_tab", None), ("post_submit_wait", "ok", None), ("post_submit_wait", "ok", None), ("fetching", "fetching", None), ("idle", "no_job", None),
    ]


def test_time_outs_of_the_client():
    begin = [(0, "poll", None), (0, "claimed", 1), (1, "ready", 1)]
    assert fold([*begin, (600, "poll", None), (601, "poll", None), (602, "poll", None)])[3:] == [("filling", "skipped_not_idle", None), ("idle", "skipped_stale_reset", None), ("fetching", "fetching", None)]
    assert fold([*begin, (500, "heartbeat", 1), (1000, "poll", None)])[-1] == ("filling", "skipped_not_idle", None)
    assert fold([*begin, (10, "needs_review", 1), (1810, "poll", None), (1811, "poll", None)])[4:] == [("awaiting_review", "skipped_not_idle", None), ("idle", "skipped_stale_reset", "review_timeout")]
    assert fold([*begin, (10, "needs_review", 1), (20, "closed", 2), (30, "closed", 1)])[4:] == [("awaiting_review", "ignored", None), ("idle", "ok", "tab_closed_by_user")]
    assert fold([*begin, (10, "submit_clicked", 1), (40, "confirmation", 1)])[-1] == ("post_submit_wait", "ok", None)
    assert fold([*begin, (10, "submit_clicked", 1), (41, "confirmation", 1), (42, "confirmation", 1)])[-1] == ("filling", "ok", None)
    assert fold([(0, "pause", None), (1, "poll", None), (2, "resume", None), (3, "poll", None), (4, "restart", None), (5, "poll", None)])[1:] == [
        ("idle", "skipped_not_idle", None), ("idle", "ok", None), ("fetching", "fetching", None), ("fetching", "ok", None), ("fetching", "skipped_not_idle", None),
    ]
    assert fold([*begin, (2, "skip", None), (3, "skip", None)])[3:] == [("idle", "ok", "user_skipped"), ("idle", "ok", None)]


def test_phases_over_small_batches(spark):
    """A client's log goes over many batches; clients are apart; the order within them is by time."""
    rng = random.Random(2)
    names = ["poll", "claimed", "loaded", "ready", "success", "failed", "heartbeat", "needs_review", "submit_clicked", "confirmation", "closed", "next_job", "no_job", "restart", "odd"]
    log = [(c, k, datetime(2024, 1, 1) + timedelta(seconds=k * 97), rng.choice(names), rng.choice([None, 1, 2])) for c in (1, 2, 3, None) for k in range(200)]
    want = set()
    for c in (1, 2, 3, None):
        own = [e for e in log if e[0] == c]
        want |= {(c, e[1], *f) for e, f in zip(own, fold([(e[2].timestamp(), e[3], e[4]) for e in own]))}
    rng.shuffle(log)
    df = spark.createDataFrame(log, "client long, seq long, at timestamp, kind string, tab int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = lifecycle.phase_machine(df, "client", "at", "seq", "kind", "tab").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(None if r.client is None or r.client != r.client else int(r.client), r.seq, r.phase, r.result, r.released) for r in found} == want and len(found) == len(log)
