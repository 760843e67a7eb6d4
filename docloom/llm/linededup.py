"""Cross-site line removal, by DataFrame functions alone.

A line that many sites carry is boilerplate. Each line's hash gets a HyperLogLog
sketch of its sites, merged by aggregation in constant space however often the
line comes. Where the estimate stands clear of the threshold it decides; lines
near it get an exact distinct count. Of each such line the first occurrence in
the table stays (least doc_id, then place), so its content isn't lost.

Lines are parts between ``\\n``, compared without blanks, tabs or returns at
their ends; empty ones are never removed. A null site counts as one site. A null
text has no lines and stays null. Rows of one doc_id and text are one document,
treated alike. Lines are known by 128 bits of hash. A text of any length is one row, in
time that follows its lines. Columns n_lines and n_removed of the input are
replaced, others pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r"
#: Sketch size: 2**12 registers, a standard error of 1.6 %.
LG_K = 12
#: The estimate decides beyond this share of the threshold, over six standard errors.
MARGIN = 0.1


def _key(line):
    bare = F.btrim(line, F.lit(BLANKS))
    return bare, F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each non-empty line, with its hashes."""
    rows = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare, h1, h2 = _key(F.col("line"))
    return rows.where(bare != "").select(*keep, "pos", h1, h2)


def widespread(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """(h1, h2): hashes of lines that min_sites distinct sites or more carry."""
    lines = _lines(docs.select(F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"), "text"), "site").drop("pos")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    sites = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = max(1.0, MARGIN * min_sites)
    clear = sites.where(F.col("sites") > min_sites + slack).select("h1", "h2")
    near = sites.where(F.col("sites").between(min_sites - slack, min_sites + slack)).select("h1", "h2")
    pairs = lines.join(near, ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return clear.union(exact)


def remove_widespread(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """docs with text without widespread lines but their first occurrence, and n_lines, n_removed."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest), F.xxhash64("text").alias("__text"))
    lines = _lines(rows.select("doc_id", "__text", "text"), "doc_id", "__text")
    hits = lines.join(widespread(docs, min_sites, site), ["h1", "h2"])
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__text", "pos")
    first = hits.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    gone = hits.join(first, ["h1", "h2"]).where(place != F.col("first"))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("__text").alias("__gone")).agg(F.collect_set("pos").alias("__drop"))
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["__text"] == gone["__gone"]), "left")
    # the places that stay are told by hashing, so that time follows the number of lines; the text is split once a row
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__drop"), lambda i: F.get(lines, i))
    kept = F.transform(F.array(F.split("text", "\n")), left)[0]
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = [F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_removed")]
    return both.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest), *counts)
