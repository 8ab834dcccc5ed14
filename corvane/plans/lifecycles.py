"""The status machine over work items made from orders and events."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import lifecycle
from corvane.plans.base import NOW, Tables, query, work_folder
from corvane.sources.committed import TableSet

#: Items: an order is one, its key decides status, retries and reason, its date the times.
_ITEMS = f"""
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS job_id, 'ats' || (o_orderkey % 3) AS ats,
           (ARRAY['matched', 'preparing', 'ready', 'submitting', 'awaiting_review', 'submitted', 'abandoned'])[1 + o_orderkey % 7] AS status,
           (o_orderkey % 4)::INT AS retry_count,
           CASE o_orderkey % 5 WHEN 0 THEN 'posting_gone' WHEN 1 THEN 'tailor_error: x' WHEN 2 THEN 'timeout' WHEN 3 THEN 'lease_expired' END AS failure_reason,
           o_orderdate AS created_at, TIMESTAMP '{NOW}' - to_minutes((o_orderkey % 25)::INT) AS updated_at,
           CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '{NOW}' - to_minutes((o_orderkey % 9 - 4)::INT) END AS lease_expires_at FROM orders"""


def items(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS id", "o_custkey AS user_id", "o_orderkey AS job_id", "concat('ats', o_orderkey % 3) AS ats",
        "element_at(array('matched', 'preparing', 'ready', 'submitting', 'awaiting_review', 'submitted', 'abandoned'), cast(1 + o_orderkey % 7 AS int)) AS status",
        "cast(o_orderkey % 4 AS int) AS retry_count",
        "CASE o_orderkey % 5 WHEN 0 THEN 'posting_gone' WHEN 1 THEN 'tailor_error: x' WHEN 2 THEN 'timeout' WHEN 3 THEN 'lease_expired' END AS failure_reason",
        "cast(o_orderdate AS timestamp) AS created_at", f"TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 25 AS int), 0) AS updated_at",
        f"CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 9 - 4 AS int), 0) END AS lease_expires_at",
    )


def now():
    return F.lit(NOW).cast("timestamp")


_STATE = ["id", "status", "failure_reason", "retry_count"]


@query("L1_claim", f"""
    WITH i AS ({_ITEMS}), c AS (SELECT id FROM i WHERE status = 'matched' ORDER BY user_id % 2, created_at, id LIMIT 50)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'preparing' ELSE status END AS status FROM i""")
def claim(t: Tables) -> DataFrame:
    return lifecycle.claim(items(t), now(), F.col("user_id") % 2).select("id", "status")


@query("L2_tailored", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status <> 'preparing' THEN status WHEN id % 2 = 0 THEN 'abandoned' ELSE 'ready' END AS status,
    CASE WHEN status = 'preparing' AND id % 2 = 0 THEN 'tailor_error: no text' ELSE failure_reason END AS failure_reason,
    CASE WHEN status = 'preparing' AND id % 2 = 0 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM i""")
def tailored(t: Tables) -> DataFrame:
    return lifecycle.tailored(items(t), F.when(F.col("id") % 2 == 0, "no text")).select(_STATE)


@query("L3_lease", f"""
    WITH i AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'ready' THEN 0 ELSE 1 END, created_at, id) AS k FROM i)
    SELECT id, CASE WHEN k = 1 AND status = 'ready' THEN 'submitting' ELSE status END AS status,
           CASE WHEN k = 1 AND status = 'ready' THEN TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE ELSE lease_expires_at END AS lease_expires_at FROM r""")
def lease(t: Tables) -> DataFrame:
    return lifecycle.lease(items(t), now()).select("id", "status", "lease_expires_at")


@query("L4_renew", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status = 'submitting' THEN TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE ELSE lease_expires_at END AS lease_expires_at FROM i""")
def renew(t: Tables) -> DataFrame:
    return lifecycle.renew(items(t), now()).select("id", "lease_expires_at")


@query("L5_submit", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status IN ('submitting', 'awaiting_review') THEN 'submitted' ELSE status END AS status,
    CASE WHEN status IN ('submitting', 'awaiting_review') THEN TIMESTAMP '{NOW}' END AS applied_at FROM i""")
def submit(t: Tables) -> DataFrame:
    return lifecycle.submit(items(t).withColumn("applied_at", F.lit(None).cast("timestamp")), now()).select("id", "status", "applied_at")


@query("L6_await_review", f"WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status = 'submitting' THEN 'awaiting_review' ELSE status END AS status FROM i")
def await_review(t: Tables) -> DataFrame:
    return lifecycle.await_review(items(t)).select("id", "status")


@query("L7_release", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status <> 'submitting' THEN status WHEN retry_count + 1 > 2 THEN 'abandoned' ELSE 'ready' END AS status,
    CASE WHEN status = 'submitting' THEN 'fill_failed' ELSE failure_reason END AS failure_reason,
    CASE WHEN status = 'submitting' THEN retry_count + 1 ELSE retry_count END AS retry_count FROM i""")
def release(t: Tables) -> DataFrame:
    return lifecycle.release(items(t), F.lit("fill_failed")).select(_STATE)


@query("L8_sweep", f"""
    WITH i AS ({_ITEMS}), f AS (SELECT *, status = 'submitting' AND coalesce(lease_expires_at < TIMESTAMP '{NOW}', false) AS over FROM i)
    SELECT id, CASE WHEN status = 'preparing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE THEN 'matched' WHEN over THEN 'abandoned' ELSE status END AS status,
    CASE WHEN over THEN coalesce(failure_reason, 'lease_expired') ELSE failure_reason END AS failure_reason,
    CASE WHEN over THEN retry_count + 1 ELSE retry_count END AS retry_count FROM f""")
def sweep(t: Tables) -> DataFrame:
    return lifecycle.sweep(items(t), now()).select(_STATE)


@query("L9_cleanup", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN status <> 'abandoned' OR retry_count > 2 OR failure_reason IS NULL THEN status
    WHEN failure_reason LIKE 'tailor_error:%' THEN 'matched' WHEN failure_reason <> 'posting_gone' THEN 'ready' ELSE status END AS status FROM i""")
def cleanup(t: Tables) -> DataFrame:
    return lifecycle.clean_up(items(t)).select("id", "status")


@query("L10_close_inactive", f"""
    WITH i AS ({_ITEMS}) SELECT id, CASE WHEN ats = 'ats0' AND job_id % 11 = 0 AND status NOT IN ('submitted', 'abandoned') THEN 'abandoned' ELSE status END AS status,
    CASE WHEN ats = 'ats0' AND job_id % 11 = 0 AND status NOT IN ('submitted', 'abandoned') THEN 'job_no_longer_active' ELSE failure_reason END AS failure_reason FROM i""")
def close_inactive(t: Tables) -> DataFrame:
    own = items(t)
    jobs = own.select("job_id", "ats", F.lit(True).alias("is_active"))
    dead = own.where("ats = 'ats0' AND job_id % 11 = 0")
    return lifecycle.close_inactive(own, jobs, dead)[0].select("id", "status", "failure_reason")


@query("L11_drain", """
    SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type IN ('view', 'click') THEN 'skipped_blocked' WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'claimed' ELSE 'done' END AS outcome FROM events""")
def drain(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "claimed").otherwise("done")
    return lifecycle.drain(t.events.withColumn("outcome", outcome), F.col("user_id") % 2 == 0).select("event_id", "outcome")


@query("L12_phase_sessions", """
    WITH b AS (SELECT *, CASE WHEN event_type = 'signup' OR lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS begins
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS attempt FROM b""")
def phase_sessions(t: Tables) -> DataFrame:
    found = lifecycle.phase_sessions(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "ts", F.col("event_type") == "signup")
    return found.select("event_id", "user_id", "attempt")


@query("M18_submission_outputs", f"""
    WITH i AS ({_ITEMS}), s AS (SELECT * FROM i WHERE status IN ('submitting', 'awaiting_review'))
    SELECT 'item' AS kind, id, 'submitted' AS value FROM s UNION ALL SELECT 'outcome', id, 'applied_confirmed' FROM s
    UNION ALL SELECT 'correction', id, failure_reason FROM s WHERE failure_reason IS NOT NULL UNION ALL SELECT 'prediction', id, 'evaluated' FROM s""")
def submission_outputs(t: Tables) -> DataFrame:
    return lifecycle.submission_outputs(items(t))


def submission_tables(t: Tables) -> TableSet:
    """The four tables that a submission changes, in a folder of their own: items, outcomes, corrections, predictions."""
    stage = "CASE WHEN id % 3 = 0 THEN 'applied' END AS current_stage"
    own = items(t).selectExpr("id", "user_id", "status", "created_at", "updated_at", "cast(NULL AS timestamp) AS applied_at", stage, "cast(NULL AS string) AS claimed_by")
    actual = "CASE WHEN l_linenumber % 3 = 0 THEN 'rejected' END AS actual_outcome_type"
    predictions = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate")).selectExpr(
        "l_orderkey AS item_id", "l_linenumber AS prediction_id", "cast(l_shipdate AS timestamp) AS predicted_at", actual,
        "cast(NULL AS timestamp) AS actual_outcome_date", "cast(NULL AS timestamp) AS evaluated_at",
    )
    spark = t.spark
    outcomes = spark.createDataFrame([], "item_id bigint, outcome_type string, outcome_date timestamp, outcome_source string, confidence double, previous_outcome_type string")
    corrections = spark.createDataFrame([], "item_id bigint, snapshot_filled string, snapshot_submitted string")
    tables = TableSet(spark, work_folder(t, "submissions"))
    tables.create({"items": own, "outcomes": outcomes, "corrections": corrections, "predictions": predictions}, {"items": ["id"], "predictions": ["item_id", "prediction_id"]})
    return tables


def requests(t: Tables) -> DataFrame:
    sent = "CASE WHEN o_orderkey % 4 = 0 THEN concat('{\"total\": ', o_custkey, '}') END"
    return t.orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", f"{sent} AS snapshot_filled", "CASE WHEN o_orderkey % 8 = 0 THEN o_orderpriority END AS snapshot_submitted")


@query("M18_committed_submission", f"""
    WITH i AS ({_ITEMS}), c AS (SELECT * FROM i WHERE status IN ('submitting', 'awaiting_review') AND id % 2 = 0),
    p AS (SELECT l_orderkey AS item_id, l_linenumber AS k, min(l_shipdate) AS shipped, l_linenumber % 3 = 0 AS closed FROM lineitem GROUP BY ALL),
    s AS (SELECT item_id, arg_max(k, (shipped, k)) AS k FROM p WHERE NOT closed AND item_id IN (SELECT id FROM c) GROUP BY item_id)
    SELECT 'item' AS kind, id, CASE WHEN id IN (SELECT id FROM c) THEN 'submitted' ELSE status END AS value FROM i
    UNION ALL SELECT 'outcome', id, 'applied_confirmed:' || CASE WHEN id % 3 = 0 THEN 'applied' ELSE 'none' END FROM c
    UNION ALL SELECT 'correction', id, '{{"total": ' || user_id || '}}>' || o_orderpriority FROM c JOIN orders ON o_orderkey = id WHERE id % 8 = 0
    UNION ALL SELECT 'prediction', p.item_id, p.k || ':' || CASE WHEN closed THEN 'rejected' WHEN s.k IS NOT NULL THEN 'applied_confirmed' ELSE 'open' END
    FROM p LEFT JOIN s ON s.item_id = p.item_id AND s.k = p.k""")
def committed_submission(t: Tables) -> DataFrame:
    """All four tables after one commit, which a second request doesn't change."""
    tables = submission_tables(t)
    for _ in range(2):
        tables.transact(lambda base: lifecycle.confirm_submissions(base.table("items"), base.table("predictions"), requests(t), now()))
    held = tables.snapshot()
    return (
        held.table("items").selectExpr("'item' AS kind", "id", "status AS value")
        .unionByName(held.table("outcomes").selectExpr("'outcome' AS kind", "item_id AS id", "concat(outcome_type, ':', coalesce(previous_outcome_type, 'none')) AS value"))
        .unionByName(held.table("corrections").selectExpr("'correction' AS kind", "item_id AS id", "concat(snapshot_filled, '>', snapshot_submitted) AS value"))
        .unionByName(held.table("predictions").selectExpr("'prediction' AS kind", "item_id AS id", "concat(prediction_id, ':', coalesce(actual_outcome_type, 'open')) AS value"))
    )


@query("L1_concurrent_claims", f"""
    WITH i AS ({_ITEMS}), c AS (SELECT id FROM i WHERE status = 'matched' ORDER BY user_id % 2, created_at, id LIMIT 90)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'preparing' ELSE status END AS status, id IN (SELECT id FROM c) AS claimed FROM i""")
def concurrent_claims(t: Tables) -> DataFrame:
    """Three workers claim thirty items each at once: together just the first ninety, whoever gets which."""
    own = items(t).select("id", "user_id", "status", "created_at", "updated_at", F.lit(None).cast("string").alias("claimed_by"))
    tables = TableSet(t.spark, work_folder(t, "claims"))
    tables.create({"items": own}, {"items": ["id"]})
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: lifecycle.claim_committed(tables, f"worker-{k}", now(), F.col("user_id") % 2, 30), range(3)))
    return tables.snapshot().table("items").select("id", "status", F.col("claimed_by").isNotNull().alias("claimed"))


#: What an event of the log stands for, by its type and id.
_CLIENT_EVENTS = {
    "signup": ("poll", "poll", "claimed", "next_job"), "view": ("claimed", "loaded", "ready", "confirmation"),
    "click": ("submit_clicked", "heartbeat", "needs_review", "poll", "claimed"), "purchase": ("success", "manual_confirm", "confirmation", "no_job"),
    "error": ("failed", "closed", "restart", "pause", "resume", "resume", "poll", "give_up"),
}
_CLIENT_SQL = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN ({list(names)})[1 + event_id % {len(names)}]" for kind, names in _CLIENT_EVENTS.items()) + " END"


@query("L12_client_phases", f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {_CLIENT_SQL} AS kind, (event_id % 2)::INT AS tab, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (
        SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS k, 'idle' AS phase, NULL::INT AS tab, NULL::TIMESTAMP AS started, false AS paused, false AS busy, NULL::INT AS ctab, NULL::TIMESTAMP AS clicked,
               NULL::VARCHAR AS result, NULL::VARCHAR AS released FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT user_id, event_id, k,
            CASE what WHEN 'reset' THEN 'idle' WHEN 'fetch' THEN 'fetching' WHEN 'found' THEN 'tab_open' WHEN 'none' THEN 'idle' WHEN 'fill' THEN 'filling' WHEN 'done' THEN 'post_submit_wait'
                 WHEN 'review' THEN 'awaiting_review' ELSE phase END,
            CASE what WHEN 'reset' THEN NULL WHEN 'found' THEN own ELSE tab END,
            CASE what WHEN 'reset' THEN NULL WHEN 'found' THEN ts WHEN 'beat' THEN ts WHEN 'review' THEN ts ELSE started END,
            CASE kind WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE paused END,
            CASE WHEN what = 'fetch' THEN true WHEN what IN ('found', 'none') OR kind = 'restart' THEN false ELSE busy END,
            CASE WHEN what = 'click' THEN own WHEN what = 'done' OR late THEN NULL ELSE ctab END,
            CASE WHEN what = 'click' THEN ts WHEN what = 'done' OR late THEN NULL ELSE clicked END,
            CASE WHEN what = 'stale_tab' THEN what WHEN kind IN ('poll', 'next_job') THEN CASE WHEN what = 'fetch' THEN 'fetching' WHEN what = 'reset' THEN 'skipped_stale_reset' ELSE what END
                 WHEN what = 'found' THEN 'job_found' WHEN what = 'none' THEN 'no_job' WHEN what = 'ignored' THEN 'ignored' ELSE 'ok' END,
            CASE WHEN kind = 'poll' AND what = 'reset' AND phase = 'awaiting_review' THEN 'review_timeout' WHEN what = 'reset' AND kind = 'closed' THEN 'tab_closed_by_user'
                 WHEN what = 'reset' AND tab IS NOT NULL AND kind = 'failed' THEN 'failed' WHEN what = 'reset' AND tab IS NOT NULL AND kind = 'give_up' THEN 'user_gave_up_review' END
        FROM (
            SELECT *, kind = 'confirmation' AND coalesce(own = ctab, false) AND coalesce(ts > clicked + INTERVAL 30 SECOND, false) AS late,
                CASE WHEN kind IN ('success', 'failed', 'needs_review', 'heartbeat', 'submit_clicked') AND own IS DISTINCT FROM tab THEN 'stale_tab'
                     WHEN kind IN ('poll', 'next_job') THEN CASE WHEN busy THEN 'skipped_busy'
                         WHEN phase NOT IN ('idle', 'post_submit_wait') AND started IS NOT NULL AND ts > started + CASE phase WHEN 'awaiting_review' THEN INTERVAL 30 MINUTE ELSE INTERVAL 10 MINUTE END THEN 'reset'
                         WHEN paused OR phase <> 'idle' THEN 'skipped_not_idle' ELSE 'fetch' END
                     WHEN kind = 'claimed' THEN CASE WHEN busy THEN 'found' ELSE 'ignored' END
                     WHEN kind = 'no_job' THEN CASE WHEN busy THEN 'none' ELSE 'ignored' END
                     WHEN kind = 'confirmation' AND coalesce(own = ctab, false) AND ts <= clicked + INTERVAL 30 SECOND THEN CASE WHEN phase = 'post_submit_wait' THEN 'ok' ELSE 'done' END
                     WHEN kind IN ('loaded', 'confirmation') THEN CASE WHEN own = tab AND phase = 'tab_open' THEN 'fill' ELSE 'ok' END
                     WHEN kind = 'ready' THEN CASE WHEN own = tab THEN 'fill' ELSE 'ignored' END
                     WHEN kind = 'success' THEN CASE WHEN phase = 'post_submit_wait' THEN 'ok' ELSE 'done' END
                     WHEN kind = 'heartbeat' THEN 'beat' WHEN kind = 'needs_review' THEN 'review' WHEN kind = 'submit_clicked' THEN 'click'
                     WHEN kind IN ('failed', 'give_up', 'manual_confirm') THEN 'reset'
                     WHEN kind = 'closed' THEN CASE WHEN own = tab AND phase = 'awaiting_review' THEN 'reset' ELSE 'ignored' END
                     ELSE 'ok' END AS what
            FROM (SELECT e.user_id, e.event_id, e.k, e.ts, e.kind, e.tab AS own, CASE WHEN e.kind = 'next_job' THEN 'idle' ELSE f.phase END AS phase, f.tab, f.started, f.paused, f.busy, f.ctab, f.clicked
                  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
    SELECT user_id, event_id, phase, result, released FROM f WHERE k > 0""")
def client_phases(t: Tables) -> DataFrame:
    """Each user is a client with two tabs; an event's id decides what the client's event is."""
    named = [F.when(F.col("event_type") == k, F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))) for k, names in _CLIENT_EVENTS.items()]
    log = t.events.select("user_id", "event_id", "ts", F.coalesce(*named).alias("kind"), (F.col("event_id") % 2).cast("int").alias("tab"))
    return lifecycle.phase_machine(log, "user_id", "ts", "event_id", "kind", "tab").select("user_id", "event_id", "phase", "result", "released")
