"""Processing jobs as keyed state of a stream: leases, retries and dead letters, with timers for what falls due.

Events of a job (job_id, at, seq, kind, worker, max_attempts) are queued, started,
completed or failed. A start takes a lease and counts an attempt; one that finds
another worker's lease still held is refused. A failure goes to the retry queue,
with a time that doubles, or, with no attempt left, to the dead letters. Timers
in event time give a job back whose lease has run out, and offer one again whose
retry is due. ``replay`` is the batch model: state after a log, by a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import next_retry

LEASE_SECONDS, RETRY_SECONDS, MAX_ATTEMPTS = 120, 60, 3
STATE = "status string, queue string, attempts int, max_attempts int, lease_owner string, lease_expires_at timestamp, next_retry_at timestamp"
OUTPUT = f"job_id long, at timestamp, seq long, change string, {STATE}"
#: A stream of jobs keeps its state in this store, which knows timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _fold(kind: Column, at: Column, worker: Column, most: Column, s: Column, lease_seconds: int, base_seconds: int) -> Column:
    """The state after an event."""
    held = (s["status"] == "running") & (s["lease_expires_at"] > at) & ~worker.eqNullSafe(s["lease_owner"])
    none_t, none = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    out = lambda status, queue, attempts, owner=none, lease=none_t, retry=none_t: F.struct(
        status.alias("status"), queue.alias("queue"), attempts.cast("int").alias("attempts"), s["max_attempts"].alias("max_attempts"), owner.alias("lease_owner"), lease.alias("lease_expires_at"), retry.alias("next_retry_at"),
    )
    dead = s["attempts"] >= s["max_attempts"]
    plus = F.timestamp_seconds(F.unix_seconds(at) + lease_seconds)
    queued = out(F.lit("queued"), F.lit("default"), F.lit(0)).withField("max_attempts", F.coalesce(most, F.lit(MAX_ATTEMPTS)))
    started = out(F.lit("running"), F.lit("default"), s["attempts"] + 1, worker, plus)
    failed = out(F.lit("failed"), F.when(dead, "dlq").otherwise("retry"), s["attempts"], retry=F.when(~dead, next_retry(at, s["attempts"], base_seconds)))
    done = out(F.lit("completed"), s["queue"], s["attempts"])
    known = s["status"].isNotNull()
    return (
        F.when(kind == "queued", queued).when(~known, s).when((kind == "started") & ~held & (s["status"] != "completed") & (s["queue"] != "dlq"), started).when((kind == "failed") & (s["status"] == "running"), failed)
        .when((kind == "completed") & (s["status"] == "running"), done).otherwise(s)
    )


def replay(log: DataFrame, lease_seconds: int = LEASE_SECONDS, base_seconds: int = RETRY_SECONDS) -> DataFrame:
    """(job_id, status, queue, attempts, ...): the state of each job after its events in order of (at, seq)."""
    events = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "kind", "worker", "max_attempts"))).alias("events"))
    start = F.lit(None).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>")
    after = F.aggregate("events", start, lambda s, e: _fold(e["kind"], e["at"], e["worker"], e["max_attempts"], s, lease_seconds, base_seconds))
    return events.select("job_id", after.alias("s")).select("job_id", "s.*").where("status is not null")


#: Inside the state times are microseconds, which no time zone can shift.
_HELD = STATE.replace("timestamp", "long")
_EMITTED = f"job_id long, at long, seq long, change string, {_HELD}"
_out = Row(*(c.split()[0] for c in _EMITTED.split(", ")))
_SECOND = 1_000_000


class JobStates(StatefulProcessor):
    """One job's state. A row out for every change, refusal, lapsed lease and due retry."""

    def __init__(self, lease_seconds: int = LEASE_SECONDS, base_seconds: int = RETRY_SECONDS):
        self.lease, self.base = lease_seconds, base_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _HELD)

    def _set(self, state: tuple, before: tuple | None) -> None:
        """The state with the one timer that it waits for; one that has fired isn't set again."""
        due = state[5] or state[6]
        if before is None or due != (before[5] or before[6]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if due:
                self.handle.registerTimer(due // 1000)
        self.job.update(state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = before = tuple(self.job.get()) if self.job.exists() else None
        for e in sorted(rows, key=lambda r: (r.micros, r.seq)):
            new, change = self._after(state, e), e.kind
            if new is None:
                continue
            if new == state and e.kind != "queued":
                change = "refused"
            state = new
            yield _out(key[0], e.micros, e.seq, change, *state)
        if state is not None:
            self._set(state, before)

    def _after(self, s: tuple | None, e: Row) -> tuple | None:
        if e.kind == "queued":
            return ("queued", "default", 0, e.max_attempts or MAX_ATTEMPTS, None, None, None)
        if s is None:
            return None
        status, queue, n, most, owner, until, _ = s
        later = lambda seconds: (e.micros // _SECOND + seconds) * _SECOND
        if e.kind == "started" and status != "completed" and queue != "dlq" and not (status == "running" and until > e.micros and owner != e.worker):
            return ("running", "default", n + 1, most, e.worker, later(self.lease), None)
        if e.kind == "failed" and status == "running":
            dead = n >= most
            return ("failed", "dlq" if dead else "retry", n, most, None, None, None if dead else later(self.base * 2 ** max(0, n - 1)))
        if e.kind == "completed" and status == "running":
            return ("completed", queue, n, most, None, None, None)
        return s

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = tuple(self.job.get())
        yield _out(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000, -1, "lease lapsed" if s[0] == "running" else "retry due", *s)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "0 seconds", lease_seconds: int = LEASE_SECONDS, base_seconds: int = RETRY_SECONDS) -> DataFrame:
    """A stream of changes (OUTPUT) of a stream of job events; set the configuration STORE first.

    Timers fire when the watermark, which lags ``late`` behind the latest event, passes them.
    """
    timed = events.withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    out = timed.groupBy("job_id").transformWithState(JobStates(lease_seconds, base_seconds), _EMITTED, "Append", "EventTime")
    times = {c.split()[0] for c in OUTPUT.split(", ") if c.endswith("timestamp")}
    return out.select(*(F.timestamp_micros(c).alias(c) if c in times else c for c in out.columns))
