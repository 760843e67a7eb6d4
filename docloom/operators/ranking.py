"""Places and percentiles over whole tables, without gathering them in one task.

Rows are dealt by bounds between ranges of their order, which a sample gives; a
count of each range says how many rows stand before it, and only inside a range
are rows sorted. The sample decides how even the ranges are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are looked at for bounds, and ranges at most.
SAMPLE, RANGES = 20_000, 64


def bounds(rows: DataFrame, order: list[Column], ranges: int = RANGES) -> list[tuple]:
    """Up to ranges - 1 values of the order that part the rows about evenly, ascending."""
    keys = rows.select(*(c.alias(f"k{n}") for n, c in enumerate(order)))
    n = keys.count()
    # as many rows as are asked for, whatever the table's size
    some = keys.sample(min(1.0, 1.2 * SAMPLE / n), seed=7).limit(SAMPLE) if n > SAMPLE else keys
    seen = sorted((tuple(r) for r in some.toLocalIterator() if None not in tuple(r)), key=lambda t: t)
    return sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if len(seen) > ranges else []


def range_of(order: list[Column], parts: list[tuple]) -> Column:
    """The number of bounds that are not above a row's order; a null goes first."""
    key = F.struct(*(c.alias(f"k{n}") for n, c in enumerate(order)))
    if not parts:
        return F.lit(0)
    listed = F.array(*(F.struct(*(F.lit(v).alias(f"k{n}") for n, v in enumerate(b))) for b in parts))
    return F.size(F.filter(listed, lambda b: b <= key))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in ascending order of whole numbers or texts; equal ones in any order."""
    parts = bounds(rows, order)
    ranged = rows.withColumn("__range", range_of(order, parts))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).select("__range", "__before")  # a row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__in", place).join(F.broadcast(before), "__range").withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__range", "__in", "__before")


def percentiles(counts: DataFrame, by: tuple[str, ...], value: str, count: str, ratios: dict[str, float], parts: list[tuple]) -> DataFrame:
    """(*by, *ratios): sorted[floor((n - 1) * r)] of each group's values, of a table (*by, value, count) of different values.

    Ranges, by bounds on the value, are counted for each group; only rows of the ranges that hold a rank are sorted.
    """
    ranged = counts.select(*by, F.col(value).alias("__v"), F.col(count).alias("__c")).withColumn("__range", range_of([F.col("__v")], parts))
    w = Window.partitionBy(*by)
    per = ranged.groupBy(*by, "__range").agg(F.sum("__c").alias("__n"))  # a row a group and range
    per = per.withColumn("__upto", F.sum("__n").over(w.orderBy("__range"))).withColumn("__all", F.sum("__n").over(w))
    rank = lambda r: F.floor((F.col("__all") - 1) * r)
    holds = lambda r: (F.col("__upto") > rank(r)) & (F.col("__upto") - F.col("__n") <= rank(r))
    asked = F.filter(F.array(*(F.when(holds(r), F.struct(F.lit(k).alias("k"), rank(r).alias("rank"))) for k, r in ratios.items())), lambda x: x.isNotNull())
    wanted = per.select(*by, "__range", (F.col("__upto") - F.col("__n")).alias("__before"), asked.alias("__asked")).where(F.size("__asked") > 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__range")]
    near = ranged.alias("a").join(wanted.alias("b"), same).select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.__range").alias("__range"), "__v", "__c", "__before", "__asked")
    near = near.withColumn("__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v")))
    at = lambda k: F.min(F.when(F.exists("__asked", lambda x: (x["k"] == k) & (F.col("__upto") > x["rank"])), F.col("__v"))).alias(k)
    return near.groupBy(*by).agg(*(at(k) for k in ratios))
