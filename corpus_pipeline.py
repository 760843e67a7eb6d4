"""A training corpus from documents: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, linededup, packing, quality, sigtree
from docloom.llm.queries import tokenizer_path
from docloom.llm.shared import checkpoint_dir, load, sent, settle, ship_package, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails them; repeated rows are judged alike, and of an empty table none is left."""
    ship_package(spark)
    return quality.assess(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites carry, each such line staying where it first stands; those left without text go."""
    out = linededup.remove_widespread(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.where(left).withColumn("n_chars", size).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-copies: word 5-shingles, Jaccard 0.8 or more."""
    ship_package(spark)
    groups = settle(sigtree.jaccard_components(docs.select("doc_id", "text"), n=5, percent=80))
    later = settle(groups.where("doc_id <> component_id").select("doc_id").distinct())
    left = docs.select(*COLUMNS).join(sent(later), "doc_id", "left_anti")
    # of rows with one doc_id and one text, one
    twice = sent(settle(groups.groupBy("doc_id").count().where("count > 1").select("doc_id")))
    again = left["doc_id"].eqNullSafe(twice["doc_id"])
    return left.join(twice, again, "left_anti").union(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none whose question and answer were both found.

    Documents without an id go by their texts. Items too short for a score drop nothing. A null or empty text holds nothing; rows of one id go together.
    """
    ship_package(spark)
    rows, items = docs.select(*COLUMNS), load(spark, sf_dir, "benchmark")

    def clean(some: DataFrame, key: Column) -> DataFrame:
        leaks = decontam.find_leaks(some.select(key.alias("doc_id"), "text"), items).where(F.col("kind") == decontam.SCORED)
        gone = settle(leaks.select(F.col("doc_id").alias("key")).distinct())
        return some.withColumn("key", key).join(sent(gone), "key", "left_anti").select(*COLUMNS)

    return clean(rows.where("doc_id is not null"), F.col("doc_id")).union(clean(rows.where("doc_id is null"), F.xxhash64("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, placed in sequences. A null text is packed as an empty one, its end id alone; repeated rows are packed each; an empty table gives no pieces."""
    ship_package(spark)
    pieces = stored(packing.cut_pieces(docs, tokenizer_path()).withColumn("__number", F.monotonically_increasing_id()))  # Parquet takes half the room of a checkpoint
    return packing.place(pieces, number="__number").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Scoring, packing and tokens are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
