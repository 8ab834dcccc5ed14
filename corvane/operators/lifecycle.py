"""The status machine of work items, one CASE pass an edge (L1-L12). now is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.sources.committed import Snapshot, TableSet

#: Statuses, and the failure reasons that later edges look at.
STATUSES = ("matched", "preparing", "ready", "submitting", "awaiting_review", "submitted", "abandoned", "notified")
GONE, LEASE_EXPIRED, INACTIVE, TAILOR_ERROR = "posting_gone", "lease_expired", "job_no_longer_active", "tailor_error:"
MAX_RETRIES = 2


def claim(items: DataFrame, now: Column, priority: Column, limit: int = 50) -> DataFrame:
    """The most urgent, then oldest matched items become preparing. One ranking stands for row locks."""
    order = [priority, F.col("created_at"), F.col("id")]
    chosen = items.where("status = 'matched'").orderBy(*order).limit(limit).select("id", F.lit(True).alias("__claimed"))
    joined = items.join(F.broadcast(chosen), "id", "left")
    return joined.withColumn("status", F.when(F.col("__claimed"), "preparing").otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(F.col("__claimed"), now).otherwise(F.col("updated_at"))
    ).drop("__claimed")


def tailored(items: DataFrame, error: Column) -> DataFrame:
    """L2: a preparing item becomes ready, or abandoned with its error and one retry more."""
    own = F.col("status") == "preparing"
    failed = own & error.isNotNull()
    return items.select(
        *(F.col(c) for c in items.columns if c not in ("status", "failure_reason", "retry_count")),
        F.when(failed, "abandoned").when(own, "ready").otherwise(F.col("status")).alias("status"),
        F.when(failed, F.concat(F.lit(f"{TAILOR_ERROR} "), error)).otherwise(F.col("failure_reason")).alias("failure_reason"),
        F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
    )


def lease(items: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Each user's oldest ready item becomes submitting under a lease."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.when(F.col("status") == "ready", 0).otherwise(1), "created_at", "id"))
    own = (F.col("status") == "ready") & (rank == 1)
    return items.withColumn("__own", own).withColumn("status", F.when(F.col("__own"), "submitting").otherwise(F.col("status"))).withColumn(
        "lease_expires_at", F.when(F.col("__own"), now + F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(F.col("lease_expires_at"))
    ).drop("__own")


def renew(items: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """L4: leases of submitting items run anew."""
    own = F.col("status") == "submitting"
    return items.withColumn("lease_expires_at", F.when(own, now + F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(F.col("lease_expires_at")))


def submit(items: DataFrame, now: Column) -> DataFrame:
    """Submitting and awaiting_review become submitted; what is submitted keeps its time."""
    own = F.col("status").isin("submitting", "awaiting_review")
    return items.withColumn("applied_at", F.when(own, F.coalesce("applied_at", now)).otherwise(F.col("applied_at"))).withColumn(
        "status", F.when(own, "submitted").otherwise(F.col("status"))
    )


def await_review(items: DataFrame) -> DataFrame:
    """Submitting becomes awaiting_review. Only submission leads out of it again."""
    return items.withColumn("status", F.when(F.col("status") == "submitting", "awaiting_review").otherwise(F.col("status")))


def release(items: DataFrame, reason: Column) -> DataFrame:
    """A submitting item goes back to ready, or is abandoned after its last retry."""
    own = F.col("status") == "submitting"
    retry = F.col("retry_count") + 1
    return items.select(
        *(F.col(c) for c in items.columns if c not in ("status", "failure_reason", "retry_count")),
        F.when(own & (retry > MAX_RETRIES), "abandoned").when(own, "ready").otherwise(F.col("status")).alias("status"),
        F.when(own, reason).otherwise(F.col("failure_reason")).alias("failure_reason"),
        F.when(own, retry).otherwise(F.col("retry_count")).alias("retry_count"),
    )


def sweep(items: DataFrame, now: Column, stale_minutes: int = 10) -> DataFrame:
    """L8, ST9: stale preparing items are matched again; items whose lease is over are abandoned."""
    stale = (F.col("status") == "preparing") & (F.col("updated_at") < now - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    over = (F.col("status") == "submitting") & (F.col("lease_expires_at") < now)
    return items.select(
        *(F.col(c) for c in items.columns if c not in ("status", "failure_reason", "retry_count")),
        F.when(stale, "matched").when(over, "abandoned").otherwise(F.col("status")).alias("status"),
        F.when(over, F.coalesce("failure_reason", F.lit(LEASE_EXPIRED))).otherwise(F.col("failure_reason")).alias("failure_reason"),
        F.when(over, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
    )


def clean_up(items: DataFrame) -> DataFrame:
    """Abandoned items with retries left are tried again where their failure came from. A null reason makes
    both conditions unknown, so such items stay."""
    own = (F.col("status") == "abandoned") & (F.col("retry_count") <= MAX_RETRIES)
    tailoring = F.col("failure_reason").like(f"{TAILOR_ERROR}%")
    other = ~F.col("failure_reason").eqNullSafe(F.lit(GONE)) & ~tailoring
    status = F.when(own & tailoring, "matched").when(own & other, "ready").otherwise(F.col("status"))
    return items.withColumn("status", status)


def close_inactive(items: DataFrame, jobs: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs found dead become inactive, their open items abandoned."""
    gone = dead.select("job_id", "ats", F.lit(False).alias("__alive")).distinct()
    flag = lambda df: df.join(gone, ["job_id", "ats"], "left")
    next_jobs = flag(jobs).withColumn("is_active", F.coalesce("__alive", "is_active")).drop("__alive")
    open_ = F.col("__alive").isNotNull() & ~F.col("status").isin("submitted", "abandoned")
    next_items = flag(items).withColumn("failure_reason", F.when(open_, INACTIVE).otherwise(F.col("failure_reason"))).withColumn(
        "status", F.when(open_, "abandoned").otherwise(F.col("status"))
    )
    return next_items.drop("__alive"), next_jobs


def drain(items: DataFrame, halted: Column) -> DataFrame:
    """What is pending or claimed when a run halts is skipped."""
    return items.withColumn("outcome", F.when(halted & F.col("outcome").isin("pending", "claimed"), "skipped_blocked").otherwise(F.col("outcome")))


def phase_sessions(log: DataFrame, keys: list[str], order: list[Column], at: str, start: Column, stale_minutes: int = 10) -> DataFrame:
    """A client's events cut into attempts: a start event begins one, and so does a pause that resets a stale phase."""
    w = W.partitionBy(*keys).orderBy(*order)
    pause = F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {stale_minutes} MINUTES")
    begins = F.when(start | F.coalesce(pause, F.lit(True)), 1).otherwise(0)
    return log.withColumn("__begins", begins).withColumn("attempt", F.sum("__begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__begins")


def confirm_submissions(items: DataFrame, predictions: DataFrame, requests: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What confirmed submissions change in four tables, to be committed together.

    A submitting or awaiting item becomes submitted; any other, one submitted before too, is left alone. Its outcome
    is noted, the pair of form snapshots if both were sent, and its latest open prediction is settled. Of repeated requests for
    an item the least counts.
    """
    once = requests.groupBy("id").agg(F.min(F.struct("snapshot_filled", "snapshot_submitted")).alias("__sent"))
    own = items.where(F.col("status").isin("submitting", "awaiting_review")).join(once, "id")
    done = {"status": F.lit("submitted"), "applied_at": now, "updated_at": now}
    confirmed = own.select(*(done[c].alias(c) if c in done else F.col(c) for c in items.columns))
    outcomes = own.select(
        F.col("id").alias("item_id"), F.lit("applied_confirmed").alias("outcome_type"), now.alias("outcome_date"), F.lit("extension_detected").alias("outcome_source"),
        F.lit(1.0).alias("confidence"), F.col("current_stage").alias("previous_outcome_type"),
    )
    both = F.col("__sent.snapshot_filled").isNotNull() & F.col("__sent.snapshot_submitted").isNotNull()
    corrections = own.where(both).select(F.col("id").alias("item_id"), "__sent.snapshot_filled", "__sent.snapshot_submitted")
    mine = predictions.where("actual_outcome_type IS NULL").join(own.select(F.col("id").alias("item_id")), "item_id")
    latest = mine.groupBy("item_id").agg(F.max_by(F.struct(*predictions.columns), F.struct("predicted_at", "prediction_id")).alias("__row")).select("__row.*")
    settled = {"actual_outcome_type": F.lit("applied_confirmed"), "actual_outcome_date": now, "evaluated_at": now}
    evaluated = latest.select(*(settled[c].alias(c) if c in settled else F.col(c) for c in predictions.columns))
    return {"items": confirmed, "outcomes": outcomes, "corrections": corrections, "predictions": evaluated}


def claim_committed(tables: TableSet, worker: str, now: Column, priority: Column, limit: int = 50) -> DataFrame:
    """L1 among several workers: the items that this one has claimed, in no other's hands.

    The most urgent, then oldest matched items become preparing by one commit upon the version they were read from;
    where another worker was first, the choice is made anew without the items that it took.
    """

    def chosen(base: Snapshot) -> dict[str, DataFrame]:
        items = base.table("items")
        some = items.where("status = 'matched'").orderBy(priority, "created_at", "id").limit(limit)
        claimed = {"status": F.lit("preparing"), "updated_at": now, "claimed_by": F.lit(worker)}
        return {"items": some.select(*(claimed[c].alias(c) if c in claimed else F.col(c) for c in items.columns))}

    version = tables.transact(chosen)
    return tables.snapshot(version).table("items").where((F.col("claimed_by") == worker) & (F.col("status") == "preparing"))


#: Minutes after which a phase is stale, and a review; seconds in which a click must lead to a confirmation.
STALE_MINUTES, REVIEW_MINUTES, VERIFY_SECONDS = 10, 30, 30
#: Messages that only the tab of the current item may send.
TAB_SCOPED = ("success", "failed", "needs_review", "heartbeat", "submit_clicked")


@dataclass
class Phase:
    """A client between two events. at is in seconds."""

    phase: str = "idle"
    tab: int | None = None
    started: float | None = None
    paused: bool = False
    busy: bool = False
    clicked_tab: int | None = None
    clicked: float | None = None

    def reset(self) -> None:
        self.phase, self.tab, self.started = "idle", None, None

    def complete(self) -> None:
        if self.phase != "post_submit_wait":
            self.phase, self.clicked_tab, self.clicked = "post_submit_wait", None, None

    def poll(self, at: float) -> tuple[str, str | None]:
        if self.busy:
            return "skipped_busy", None
        waiting = self.phase == "awaiting_review"
        most = REVIEW_MINUTES if waiting else STALE_MINUTES
        if self.phase not in ("idle", "post_submit_wait") and self.started is not None and at - self.started > most * 60:
            self.reset()
            return "skipped_stale_reset", "review_timeout" if waiting else None
        if self.paused or self.phase != "idle":
            return "skipped_not_idle", None
        self.phase, self.busy = "fetching", True
        return "fetching", None

    def take(self, at: float, event: str, tab: int | None) -> tuple[str, str | None]:
        """What the event leads to, and why the current item is released, if it is."""
        own = tab is not None and tab == self.tab
        if event in TAB_SCOPED and not own:
            return "stale_tab", None
        match event:
            case "poll":
                return self.poll(at)
            case "next_job":
                self.phase = "idle"
                return self.poll(at)
            case "claimed" if self.busy:
                self.phase, self.tab, self.started, self.busy = "tab_open", tab, at, False
                return "job_found", None
            case "no_job" if self.busy:
                self.phase, self.busy = "idle", False
                return "no_job", None
            case "restart":
                self.busy = False
            case "loaded" | "confirmation":
                if own and self.phase == "tab_open":
                    self.phase = "filling"
                if event == "confirmation" and tab is not None and tab == self.clicked_tab:
                    if at - self.clicked > VERIFY_SECONDS:
                        self.clicked_tab = self.clicked = None
                    else:
                        self.complete()
            case "ready" if own:
                self.phase = "filling"
            case "success":
                self.complete()
            case "heartbeat":
                self.started = at
            case "needs_review":
                self.phase, self.started = "awaiting_review", at
            case "submit_clicked":
                self.clicked_tab, self.clicked = tab, at
            case "failed" | "skip" | "give_up" | "manual_confirm":
                held = self.tab is not None
                self.reset()
                return "ok", {"failed": "failed", "skip": "user_skipped", "give_up": "user_gave_up_review"}.get(event) if held else None
            case "closed" if own and self.phase == "awaiting_review":
                self.reset()
                return "ok", "tab_closed_by_user"
            case "pause" | "resume":
                self.paused = event == "pause"
            case _:
                return "ignored", None
        return "ok", None


def phase_machine(log: DataFrame, key: str, at: str, order: str, event: str, tab: str) -> DataFrame:
    """Every event with the client's phase after it, what it led to, and why an item was released.

    A client's events are folded in the order of their times (order settles ties), a batch at a time: memory holds one
    batch and one client's state, however long its log. Events: poll, next_job, claimed, no_job, restart, loaded,
    confirmation (a page that confirms, after another address), ready, success, failed, heartbeat, needs_review,
    submit_clicked, closed, skip, give_up, manual_confirm, pause, resume; any other is ignored. Messages of another tab than the
    current item's change nothing.
    """
    columns = [key, order, at, event, tab]
    kinds = dict(log.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, state = object(), Phase()
        for batch in batches:
            made = []
            clients, events, tabs, times = (batch.column(c).to_pylist() for c in (key, event, tab, "__at"))
            for own, kind, where, when in zip(clients, events, tabs, times):
                if own != client:
                    client, state = own, Phase()
                result, release = state.take(when, kind, where)
                made.append((state.phase, result, release))
            more = [pa.array([m[k] for m in made], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], [*columns, "phase", "result", "released"])

    rows = log.select(*columns, F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("__at")).withColumn("__at", F.col("__at") / 1e6)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", phase string, result string, released string"
    return rows.repartition(key).sortWithinPartitions(key, at, order).mapInArrow(fold, schema)


def submission_outputs(items: DataFrame) -> DataFrame:
    """What one confirmed submission writes, in long form: the item, an outcome, a correction if there is one, and
    the prediction it settles. Keys are the item's, so writing them again changes nothing."""
    own = items.where(F.col("status").isin("submitting", "awaiting_review"))
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col("id"), value.alias("value"))
    rows = F.array(
        row("item", F.lit("submitted")), row("outcome", F.lit("applied_confirmed")), row("correction", F.col("failure_reason")), row("prediction", F.lit("evaluated"))
    )
    return own.select(F.inline(rows)).where("value IS NOT NULL")
