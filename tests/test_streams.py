"""Keyed job state of a stream against its batch model, and sinks that a batch may be written to again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import jobs as J
from docloom.sources import stored
from docloom.streaming import jobs as S

EVENT = "job_id long, at timestamp, seq long, kind string, worker string, max_attempts int"
T0 = datetime(2026, 1, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(S.STORE[0])
    spark.conf.set(*S.STORE)
    yield spark
    spark.conf.set(S.STORE[0], before)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def batches(rnd, n_jobs=25, n_batches=4):
    """Job logs in micro-batches whose times don't go back."""
    out, seq = [], 0
    for b in range(n_batches):
        rows = []
        for job in range(n_jobs):
            for _ in range(rnd.randrange(4)):
                seq += 1
                kind = "queued" if b == 0 and rnd.random() < 0.5 else rnd.choice(["queued", "started", "started", "failed", "failed", "completed"])
                rows.append((job, at(1000 * b + rnd.randrange(900)), seq, kind, rnd.choice(["a", "b"]), rnd.choice([None, 2, 3])))
        out.append(rows)
    return out


def run_stream(spark, folder, checkpoint, rows_of_batches, **options):
    """All changes that the stream emits, its micro-batches one after the other through one checkpoint."""
    got = []
    for k, rows in enumerate(rows_of_batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{k:03d}")
        events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(folder))
        q = S.job_states(events, **options).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_replayed_log_is_the_batch_model(store, tmp_path):
    spark, rnd = store, random.Random(5)
    log = batches(rnd)
    changes = run_stream(spark, tmp_path / "in", tmp_path / "state", log)
    state = {}
    for r in changes:
        if r.change not in ("lease lapsed", "retry due"):
            state[r.job_id] = r
    rows = [x for b in log for x in b]
    want = {r.job_id: r for r in S.replay(spark.createDataFrame(rows, EVENT)).collect()}
    fields = ("status", "queue", "attempts", "max_attempts", "lease_owner", "lease_expires_at", "next_retry_at")
    assert want and {k: tuple(r[f] for f in fields) for k, r in state.items()} == {k: tuple(r[f] for f in fields) for k, r in want.items()}
    assert {r.change for r in changes} >= {"queued", "started", "failed", "refused", "retry due", "lease lapsed"}
    # a retry comes due when its time has come, once
    last = max(x[1] for x in rows)
    due = {(r.job_id, r.at) for r in changes if r.change == "retry due"}
    assert all((r.status, r.queue, r.next_retry_at) == ("failed", "retry", r.at) for r in changes if r.change == "retry due") and len(due) == sum(r.change == "retry due" for r in changes)
    jobs = S.replay(spark.createDataFrame(rows, EVENT)).withColumnRenamed("max_attempts", "max_attempts")
    waiting = {r.job_id for r in J.due_retries(jobs, str(last - timedelta(seconds=1000))).collect()}
    assert waiting <= {j for j, _ in due}


def test_failures_are_those_of_the_batch(store, tmp_path):
    """A start and a failure are what ``fail`` makes of a job: queue, attempts and time of retry."""
    spark = store
    rows = [(j, at(0), 0, "queued", None, 3) for j in range(4)]
    rows += [(j, at(10 * n + 1), 2 * n, "started", "w", None) for j in range(4) for n in range(1, j + 1)] + [(j, at(10 * n + 5), 2 * n + 1, "failed", "w", None) for j in range(4) for n in range(1, j + 1)]
    got = {r.job_id: r for r in run_stream(spark, tmp_path / "in", tmp_path / "state", [rows]) if r.change == "failed"}
    before = spark.createDataFrame([(j, j - 1, 3, at(10 * j + 5)) for j in range(1, 4)], "job_id long, attempts int, max_attempts int, updated_at timestamp")
    want = {r.job_id: r for r in J.fail(before).collect()}
    assert {k: (r.attempts, r.queue, r.next_retry_at) for k, r in got.items()} == {k: (r.attempts, r.queue, r.next_retry_at) for k, r in want.items()}
    assert [got[j].queue for j in (1, 2, 3)] == ["retry", "retry", "dlq"]


def test_leases(store, tmp_path):
    spark = store
    one = [(1, at(0), 1, "queued", None, None), (1, at(1), 2, "started", "a", None), (1, at(60), 3, "started", "b", None), (1, at(100), 4, "started", "a", None), (2, at(5), 5, "started", "a", None), (2, at(6), 6, "completed", "a", None)]
    two = [(1, at(230), 7, "started", "b", None), (3, at(400), 8, "queued", None, None)]
    three = [(1, at(500), 9, "completed", "b", None), (1, at(501), 10, "failed", "b", None), (3, at(2000), 11, "queued", None, 1)]
    got = [(r.job_id, r.change, r.status, r.attempts, r.lease_owner) for r in run_stream(spark, tmp_path / "in", tmp_path / "state", [one, two, three]) if r.job_id == 1]
    assert got[:5] == [(1, "queued", "queued", 0, None), (1, "started", "running", 1, "a"), (1, "refused", "running", 1, "a"), (1, "started", "running", 2, "a"), (1, "started", "running", 3, "b")]
    # b's lease of 350 lapsed before it was done; what it then says still counts, and a failure after that doesn't
    assert got[5:] == [(1, "lease lapsed", "running", 3, "b"), (1, "completed", "completed", 3, None), (1, "refused", "completed", 3, None)]
    want = {r.job_id: r.status for r in S.replay(spark.createDataFrame(one + two + three, EVENT)).collect()}
    assert want == {1: "completed", 3: "queued"}


def test_replay_of_nothing(spark):
    assert S.replay(spark.createDataFrame([], EVENT)).count() == 0


# sinks

CHILD = "doc long, n int, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def put(spark, path, batch, children, parents, buckets=4):
    stored.write_children(spark.createDataFrame(children, CHILD), spark.createDataFrame([(p,) for p in parents], "doc long"), path, "doc", batch, buckets)


def test_children_are_replaced(spark, tmp_path):
    path = str(tmp_path / "children")
    assert stored.children(spark, path, CHILD).count() == 0
    put(spark, path, 0, [(d, n, "old") for d in range(20) for n in range(2)], range(20))
    put(spark, path, 1, [(3, 0, "new"), (5, None, None), (99, 1, "more")], [3, 4, 5, 99])
    want = [(d, n, "old") for d in range(20) if d not in (3, 4, 5) for n in range(2)] + [(3, 0, "new"), (5, None, None), (99, 1, "more")]
    assert rows_of(stored.children(spark, path, CHILD)) == sorted(want, key=str)
    put(spark, path, 1, [(3, 0, "twice")], [3])  # a batch that is in isn't written again
    assert rows_of(stored.children(spark, path, CHILD)) == sorted(want, key=str)
    put(spark, path, 2, [], range(100))  # all parents without children
    assert stored.children(spark, path, CHILD).count() == 0


@pytest.mark.parametrize("damage", ["before", "between", "after"])
def test_a_write_that_breaks_off_is_made_whole(spark, tmp_path, monkeypatch, damage):
    import pathlib
    import shutil

    path = str(tmp_path / "children")
    put(spark, path, 0, [(d, 0, "old") for d in range(40)], range(40))
    replace = stored.replace_partitions

    def broken(rows, table):
        if damage == "before":
            raise OSError("lost")
        if damage == "after":
            replace(rows, table)
        else:  # partitions are gone, and their new files aren't there
            for p in sorted(pathlib.Path(table).glob("bucket=*"))[:2]:
                shutil.rmtree(p)
        raise OSError("lost")

    monkeypatch.setattr(stored, "replace_partitions", broken)
    with pytest.raises(OSError, match="lost"):
        put(spark, path, 1, [(d, 1, "new") for d in range(30)], range(30))
    monkeypatch.setattr(stored, "replace_partitions", replace)
    put(spark, path, 1, [(d, 1, "new") for d in range(30)], range(30))
    assert rows_of(stored.children(spark, path, CHILD)) == sorted([(d, 1, "new") for d in range(30)] + [(d, 0, "old") for d in range(30, 40)], key=str)


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    rec = lambda b: spark.createDataFrame([(10 * b + k, at(100 * b + k), "a") for k in range(5)], "id long, created_at timestamp, action string")
    for b in (0, 1, 1, 2):  # a batch comes twice
        stored.write_audit(rec(b), path, b)
    assert [r.id for r in stored.audit(spark, path, 7).collect()] == [24, 23, 22, 21, 20, 14, 13]
    stored.prune_audit(spark, path, 7)
    assert [r.id for r in stored.audit(spark, path, 7).collect()] == [24, 23, 22, 21, 20, 14, 13] and stored.audit(spark, path).count() == 10


def test_stream_of_children(spark, tmp_path):
    """Micro-batches go to the sink by their ids, the latest of a parent's children standing."""
    source, path = tmp_path / "in", str(tmp_path / "children")
    for k in range(2):
        spark.createDataFrame([(d, k, f"b{k}") for d in range(k, 4)], CHILD).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(CHILD).option("recursiveFileLookup", "true").parquet(str(source))
        write = lambda df, batch: stored.write_children(df, df.select("doc"), path, "doc", batch, 4)
        stored.sink(write, str(tmp_path / "checkpoint"))(stream).awaitTermination()
    assert rows_of(stored.children(spark, path, CHILD)) == sorted([(0, 0, "b0"), *((d, 1, "b1") for d in (1, 2, 3))], key=str)
    assert stored.children(spark, path, CHILD).where(F.col("v") == "b0").count() == 1
