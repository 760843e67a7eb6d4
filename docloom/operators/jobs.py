"""Queue, retry, ledger and webhook semantics as batch operators: replaying a batch changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import next_retry


def dedupe_first(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The first row of each key; null keys all stay."""
    w = Window.partitionBy(key).orderBy(order, tie)
    first = rows.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.unionByName(rows.where(F.col(key).isNull()))


def due_retries(jobs: DataFrame, now: str) -> DataFrame:
    """Failed, attempts left, and no later time set."""
    return jobs.where((F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts")) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(now).cast("timestamp"))))


def fail(jobs: DataFrame, base_seconds: int = 60) -> DataFrame:
    """After another failed attempt: to the retry queue with a time, or to the dead letters."""
    n = F.col("attempts") + 1
    dead = n >= F.col("max_attempts")
    return jobs.select("job_id", n.alias("attempts"), F.when(dead, "dlq").otherwise("retry").alias("queue"), F.when(~dead, next_retry("updated_at", n, base_seconds)).alias("next_retry_at"))


def work_queue(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """Queued jobs without a lease, then due retries, oldest first; the first ``limit``."""
    t = F.lit(now).cast("timestamp")
    queued = jobs.where((F.col("status") == "queued") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= t))).withColumn("turn", F.lit(0))
    both = queued.unionByName(due_retries(jobs, now).withColumn("turn", F.lit(1)))
    return both.orderBy("turn", "created_at", "job_id").limit(limit)


def due_webhooks(logs: DataFrame, now: str, limit: int) -> DataFrame:
    """Newest max(50, limit) * 5 are fetched, due ones kept, oldest first, the first ``limit``: the order of the two limits counts."""
    fetched = logs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(max(50, limit) * 5)
    due = fetched.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(now).cast("timestamp")))
    return due.orderBy("created_at", "job_id").limit(limit)


def batch_status(items: DataFrame) -> DataFrame:
    """completed, failed, processing or partial; a batch without items is completed."""
    n, done, failed = F.count("submission_id"), F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    status = F.when(n == 0, "completed").when(failed == n, "failed").when(done + failed == n, F.when(failed > 0, "partial").otherwise("completed")).otherwise("processing")
    return items.groupBy("batch_id").agg(n.alias("items"), status.alias("status"))


def trial_quota(used: DataFrame, clients: DataFrame, limit: int = 50) -> DataFrame:
    rows = clients.join(used.groupBy("client").agg(F.count("*").alias("used")), "client", "left")
    n = F.coalesce("used", F.lit(0))
    return rows.select("client", n.alias("used"), F.greatest(F.lit(limit) - n, F.lit(0)).cast("long").alias("remaining"), (n < limit).alias("allowed"))


def enqueue_webhooks(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """The asked webhooks to add: of each dedupe_key the first by (created_at, id), if it has no log, or none but dead letters."""
    alive = logs.where("status <> 'dead_letter'").select("dedupe_key").distinct()
    return dedupe_first(asked, "dedupe_key", "created_at", "id").join(alive, "dedupe_key", "left_anti")


def deliver(logs: DataFrame, now: str, base_seconds: int = 60) -> DataFrame:
    """Logs (id, status, attempts, max_attempts, next_retry_at) with response_status after an attempt at each that is due.

    A delivered or not yet due log stays as it is. A response of 200 to 299 delivers; else the last attempt
    makes a dead letter, and any other one waits for its retry.
    """
    t, n = F.lit(now).cast("timestamp"), F.col("attempts") + 1
    tried = (F.col("status") != "delivered") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= t))
    ok = F.coalesce(F.col("response_status").between(200, 299), F.lit(False))
    status = F.when(ok, "delivered").when(n >= F.col("max_attempts"), "dead_letter").otherwise("pending")
    again = F.when(~ok & (n < F.col("max_attempts")), next_retry(t, n, base_seconds))
    pick = lambda new, old: F.when(tried, new).otherwise(F.col(old)).alias(old)
    return logs.select("id", pick(status, "status"), pick(n, "attempts"), pick(again, "next_retry_at"))


def is_duplicate_job(key: Column, now: str) -> Column:
    """Whether a document's latest job already does what ``key`` asks: queued, running under a lease, or completed and unchanged since."""
    t = F.lit(now).cast("timestamp")
    done = F.when(F.col("status") == "queued", True).when(F.col("status") == "running", F.col("lease_expires_at") > t).when(F.col("status") == "completed", F.col("updated_at") <= F.col("processed_at"))
    return F.coalesce((F.col("idempotency_key") == key) & done, F.lit(False))


def batch_notices(batches: DataFrame, items: DataFrame) -> DataFrame:
    """(batch_id, event_type, dedupe_key) of terminal batches with a callback, all of whose registered submissions are there and whose last delivery was of another event.

    batches: (batch_id, registered, callback_url, last_event, last_status); items: as of ``batch_status``.
    """
    status = batch_status(items).where("status <> 'processing'")
    event = F.concat_ws(".", F.lit("batch"), "status")
    told = F.coalesce((F.col("last_event") == event) & (F.col("last_status") == "delivered"), F.lit(False))
    due = batches.where("registered > 0 and callback_url is not null").join(status, "batch_id").where((F.col("items") == F.col("registered")) & ~told)
    return due.select("batch_id", event.alias("event_type"), F.concat_ws(":", F.lit("batch"), F.col("batch_id").cast("string"), event).alias("dedupe_key"))
