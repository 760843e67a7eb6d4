"""Places and percentiles by ranges against plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import analytics, intake, ranking


@pytest.mark.parametrize(("n", "ranges"), [(0, 64), (5, 64), (500, 7), (500, 64)])
def test_places(spark, n, ranges, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", ranges)
    rnd = random.Random(n)
    rows = [(rnd.choice([1, 1, 1, rnd.randrange(50)]), f"t{k:04d}", k) for k in range(n)]  # one value has most rows
    df = spark.createDataFrame(rows, "a long, b string, place long").repartition(5)
    got = [(r.a, r.b) for r in ranking.numbered(df, [F.col("a"), F.col("b")], "p").orderBy("p").collect()]
    assert got == sorted((a, b) for a, b, _ in rows)
    assert sorted(r.p for r in ranking.numbered(df, [F.col("a")], "p").collect()) == list(range(n))


def test_bounds_are_of_a_sample_at_most(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLE", 100)
    df = spark.range(10_000).repartition(3)
    parts = ranking.bounds(df, [-F.col("id")])
    assert 10 < len(parts) < ranking.RANGES
    assert [r.p for r in ranking.numbered(df, [-F.col("id")], "p").orderBy(F.desc("id")).collect()] == list(range(10_000))


def test_null_places(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (None, 3), (1, 4)] + [(k, 10 + k) for k in range(10, 200)], "a int, b int")
    got = [(r.a, r.b) for r in ranking.numbered(df, [F.col("a"), F.col("b")], "p").orderBy("p").limit(4).collect()]
    assert got == [(None, 1), (None, 3), (1, 4), (3, 2)]


@pytest.mark.parametrize("size", [1, 3, 400])
def test_latency_of_groups(spark, size):
    rnd = random.Random(size)
    rows = [(True, float(rnd.choice([7, 7, rnd.random() * 1000])), rnd.choice(["a", None, "b"])) for _ in range(size)]
    rows += [(True, None, "a"), (False, 5.0, "a"), (True, float("nan"), "b"), (True, float("inf"), "c")]
    df = spark.createDataFrame(rows, "terminal boolean, latency_ms double, g string").repartition(4)
    want = {}
    for g in {r[2] for r in rows}:
        v = sorted(x for t, x, h in rows if t and h == g and x is not None and math.isfinite(x))
        if v:
            want[g] = tuple(v[math.floor((len(v) - 1) * r)] for r in (0.5, 0.9, 0.99)) + (math.floor(sum(v) / len(v) + 0.5), len(v))
    assert {r.g: (r.p50, r.p90, r.p99, r.mean, r.n) for r in analytics.latency(df, "g").collect()} == want
    v = sorted(x for t, x, _ in rows if t and x is not None and math.isfinite(x))
    one = analytics.latency(df).collect()
    assert len(one) == 1 and (one[0].p50, one[0].n) == (v[(len(v) - 1) // 2], len(v))
    assert [tuple(r) for r in analytics.latency(df.where("false")).collect()] == [(None,) * 5] and analytics.latency(df.where("false"), "g").count() == 0


def test_registry_places(spark):
    kind = "name string, manifest string, place int"
    registry = spark.createDataFrame([(f"n{k}", "old", k) for k in range(300)], kind)
    got = intake.upsert(registry, spark.createDataFrame([("n7", "new", 5), ("z", "new", 0)], kind)).orderBy("place").collect()
    assert [(r.name, r.place) for r in got] == [(x, k) for k, x in enumerate(["n7", "z", *(f"n{k}" for k in range(300) if k != 7)])]
