"""Streams over the supplied files, run to their end; each must give what the batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.base import Tables, query
from corvane.plans.base import work_folder as _folder
from corvane.sources.committed import TableSet
from corvane.streaming import stateful, streams


def _events(t: Tables) -> DataFrame:
    return streams.file_stream(t.spark, f"{t.folder}/event[s].parquet")


@query("ST1_high_water_mark", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def high_water_mark(t: Tables) -> DataFrame:
    folder = _folder(t, "high-water")
    cursor = streams.Versions(t.spark, f"{folder}/cursor", "batch bigint, at timestamp")
    start = t.spark.sql("SELECT -1L AS batch, TIMESTAMP '2024-01-10' AS at")
    cursor.write(start)
    stream = _events(t).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.above_high_water(stream, folder, "ts", cursor)


@query("ST2_ST6_insert_once", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def insert_once(t: Tables) -> DataFrame:
    folder = _folder(t, "insert")
    state = streams.Versions(t.spark, f"{folder}/state", "event_id bigint, user_id bigint")
    return streams.insert_once(_events(t).select("event_id", "user_id"), folder, ["user_id"], state).select("user_id", "event_id")


@query("ST3_stream_payload_change", """
    WITH h AS (SELECT user_id, event_id, sha256(event_type) AS payload_hash FROM events)
    SELECT *, lag(payload_hash) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM payload_hash AS changed FROM h""")
def stream_payload_change(t: Tables) -> DataFrame:
    rows = _events(t).select("user_id", "event_id", F.sha2("event_type", 256).alias("payload_hash"))
    return streams.run_to_table(streams.payload_changes(rows, "user_id", "event_id", "payload_hash"), _folder(t, "payload"), "changes")


@query("ST4_stream_failure_counter", """
    WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT user_id, arg_max(streak, (ts, event_id))::BIGINT AS failures, max(streak) < 5 AS is_active FROM s GROUP BY user_id""")
def stream_failure_counter(t: Tables) -> DataFrame:
    found = streams.failure_counters(_events(t).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", ["error"], ["purchase"], 5)
    return streams.run_to_table(found, _folder(t, "counter"), "counters")


@query("ST5_stream_breaker", """
    WITH i AS (SELECT *, user_id AS run, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS b FROM i WINDOW w AS (PARTITION BY run, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT run, arg_max(a, (ts, event_id))::BIGINT AS block_streak, arg_max(b, (ts, event_id))::BIGINT AS page_block_streak, max(b) >= 3 OR arg_max(a, (ts, event_id)) >= 10 AS should_halt FROM s GROUP BY run""")
def stream_breaker(t: Tables) -> DataFrame:
    rows = _events(t).select(F.col("user_id").alias("run"), "ts", "event_id", "event_type")
    found = streams.breakers(rows, "run", ["ts", "event_id"], "event_type", ["error"], ["error", "click"], ["purchase", "signup"])
    return streams.run_to_table(found, _folder(t, "breaker"), "breakers")


@query("ST6_stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    rows = _events(t).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.run_to_table(streams.distinct_within(rows, "ts", ["user_id", "event_type"], "10 days"), _folder(t, "distinct"), "rows")
    return found.select("user_id", "event_type")


@query("ST7_since_checkpoint", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-12'")
def since_checkpoint(t: Tables) -> DataFrame:
    rows = streams.since_checkpoint(_events(t), "ts", F.lit("2024-01-12").cast("timestamp")).select("event_id")
    return streams.run_to_table(rows, _folder(t, "since"), "rows")


@query("ST8_windowed_counts", """
    SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def windowed_counts(t: Tables) -> DataFrame:
    """Days that the watermark, an hour behind the latest event, has passed."""
    rows = _events(t).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.run_to_table(streams.windowed_counts(rows, "ts", "1 day", "event_type", "1 hour"), _folder(t, "windows"), "counts")
    return found.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


@query("ST9_expiring_leases", """
    WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'released' ELSE 'leased' END AS status FROM l UNION ALL
    SELECT user_id, 'lease_expired' FROM l WHERE event_type <> 'purchase' AND epoch_ms(ts) + 600000 < (SELECT epoch_ms(max(ts)) FROM events)""")
def expiring_leases(t: Tables) -> DataFrame:
    event = F.when(F.col("event_type") == "purchase", "release").otherwise("lease")
    rows = _events(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"), event.alias("event"))
    return streams.run_to_table(streams.expiring_leases(rows, "user_id", "ts", "event", 10), _folder(t, "leases"), "rows")


@query("ST4_idle_counters", """
    WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT user_id, arg_max(streak, (ts, event_id))::BIGINT AS failures, max(streak) < 5 AS is_active FROM s GROUP BY user_id""")
def idle_counters(t: Tables) -> DataFrame:
    rows = _events(t).select("user_id", "ts", "event_id", "event_type")
    found = stateful.idle_counters(rows, "user_id", ["ts", "event_id"], "event_type", ["error"], ["purchase"], 5, 3_600_000)
    return stateful.run_available(found, _folder(t, "idle"), "counters")


def _batches(t: Tables, folder: str, n: int = 4) -> DataFrame:
    """The events as files that come one after another, dealt by their ids."""
    for k in range(n):
        t.events.where(F.col("event_id") % n == k).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    return streams.file_stream(t.spark, f"{folder}/landed", 1)


@query("ST6_insert_new", "SELECT user_id, arg_min(event_id, (event_id % 4, event_id)) AS event_id FROM events GROUP BY user_id")
def insert_new(t: Tables) -> DataFrame:
    """Four batches; a user's first event of the first batch that has one stays."""
    folder = _folder(t, "insert-new")
    tables = TableSet(t.spark, f"{folder}/tables")
    tables.create({"seen": t.spark.createDataFrame([], "event_id bigint, user_id bigint")})
    return streams.insert_new(_batches(t, folder).select("event_id", "user_id"), folder, ["user_id"], tables, "seen").select("user_id", "event_id")


@query("ST2_stamped_outputs", """
    SELECT event_id, event_type IN ('purchase', 'click') AS matched, true AS stamped FROM events""")
def stamped_outputs(t: Tables) -> DataFrame:
    """Every event is stamped once its match, if it has one, is written."""
    folder = _folder(t, "stamped")
    tables = TableSet(t.spark, f"{folder}/tables")
    tables.create({"outputs": t.spark.createDataFrame([], "event_id bigint, user_id bigint"), "stamps": t.spark.createDataFrame([], "event_id bigint, checked_at timestamp")})
    matches = lambda rows: rows.where("event_type IN ('purchase', 'click')").select("event_id", "user_id")
    streams.stamp_when_written(_batches(t, folder), folder, "event_id", tables, matches, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    held = tables.snapshot()
    found = t.events.select("event_id").join(held.table("outputs").select("event_id", F.lit(True).alias("matched")), "event_id", "left")
    found = found.join(held.table("stamps").select("event_id", F.lit(True).alias("stamped")), "event_id", "left")
    return found.select("event_id", F.coalesce("matched", F.lit(False)).alias("matched"), F.coalesce("stamped", F.lit(False)).alias("stamped"))


@query("ST8_late_rows", """
    WITH b AS (SELECT event_id % 4 AS batch, max(ts) AS latest FROM events GROUP BY ALL)
    SELECT event_id, coalesce(ts < (SELECT max(latest) FROM b WHERE b.batch < events.event_id % 4) - INTERVAL 3 DAY, false) AS late FROM events""")
def late_rows(t: Tables) -> DataFrame:
    """Four batches; rows more than three days behind what came before are kept aside."""
    folder = _folder(t, "late")
    tables = TableSet(t.spark, f"{folder}/tables")
    empty = t.spark.createDataFrame([], "event_id bigint, user_id bigint, event_type string, ts timestamp")
    tables.create({"accepted": empty, "late": empty, "marks": t.spark.createDataFrame([], "batch bigint, latest timestamp")})
    streams.split_late(_batches(t, folder), folder, "ts", "3 days", tables)
    held = tables.snapshot()
    return held.table("accepted").select("event_id", F.lit(False).alias("late")).unionByName(held.table("late").select("event_id", F.lit(True).alias("late")))


@query("ST8_sliding_counts", """
    SELECT w AS window_start, event_type, count(*) AS n FROM events, LATERAL (SELECT unnest(range(0, 4)) AS k),
    LATERAL (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS w)
    WHERE w + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def sliding_counts(t: Tables) -> DataFrame:
    """Days that begin every six hours, as far as the watermark has passed them."""
    rows = _events(t).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.run_to_table(streams.sliding_counts(rows, "ts", "1 day", "6 hours", "event_type", "1 hour"), _folder(t, "sliding"), "counts")
    return found.select(F.col("window.start").alias("window_start"), "event_type", "n")


@query("ST8_sessions", """
    WITH b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 3 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def sessions(t: Tables) -> DataFrame:
    """A user's sessions, parted by three hours without an event, as far as the watermark has passed them."""
    rows = _events(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.run_to_table(streams.session_counts(rows, "ts", "3 hours", "user_id", "1 hour"), _folder(t, "sessions"), "counts")
    return found.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
