"""What the operators share: intermediate tables in shared storage, row counts, and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where that is unset and there is one machine (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The rows of df written to shared storage: computed once, and not lost with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``settle`` but as Parquet, which takes less room; rows are read back in any order and partitions."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nobody holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows up to which a table of ids goes to all tasks in a join; above, the join is dealt out. Results are the same.
SENT_ROWS = 1_000_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The table, which should be settled, as the side of a join that is broadcast if its size, counted here, allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


#: Edges a task contracts at a time.
HELD_EDGES = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in place of edges (a, b): every node straight to the least one that they lead to, HELD_EDGES at a time."""
    out: list[tuple[int, int]] = []
    for k in range(0, len(a), HELD_EDGES):
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for v, u in zip(a[k : k + HELD_EDGES].tolist(), b[k : k + HELD_EDGES].tolist(), strict=True):
            x, y = find(v), find(u)
            if x != y:
                up[max(x, y)] = min(x, y)
        out += [(v, r) for v in up if (r := find(v)) != v]
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _contract(batches):
    import pandas as pd

    for f in batches:
        v, u = stars(f["v"].to_numpy(), f["u"].to_numpy())
        yield pd.DataFrame({"v": v, "u": u})


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), for every id on an edge.

    Each task first contracts the edges it has, so a hub arrives once from each;
    ``contracted`` says that whoever made them has done so.
    Then rounds of large-star and small-star steps, each an aggregation and a
    join on a node; rounds grow with the logarithm of the longest chain. Lineage
    is cut in shared storage.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u")
    pairs = settle((pairs if contracted else pairs.mapInPandas(_contract, "v long, u long")).distinct())
    state = F.struct(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))), F.lit(0))).alias("s")
    before = pairs.agg(state).first()["s"]
    while before[0]:
        # every neighbour above a node is tied to the least of its neighbourhood
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).union(pairs.select("u", "v"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # every neighbour below a node, and the node, are tied to the least of them
        root = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(root, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(root.select("v", F.col("m").alias("u")))
        pairs = settle(small.where("v <> u").mapInPandas(_contract, "v long, u long").distinct())
        now = pairs.agg(state).first()["s"]
        if now == before:
            break
        before = now
    return pairs.select(F.col("v").alias("id"), F.col("u").alias("component")).union(pairs.select("u", "u").distinct())
