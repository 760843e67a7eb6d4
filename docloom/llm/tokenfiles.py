"""Token ids as Parquet list columns that can be read in part.

One row a document: (doc_id, n_tokens, ids). Spark's own writer makes the files,
so they go to any store and a lost task leaves nothing half-written. Row groups
and pages are held small, page indexes are written, and the ids are either
delta-packed (Parquet's second format, without a dictionary) or
dictionary-encoded. doc_id and n_tokens can be read without the ids, and a
range of doc_id opens only the row groups and pages that hold it.

Rows are dealt by ranges of doc_id and sorted in each, so part numbers and rows
ascend with doc_id over the whole folder; a null doc_id comes first. A null text
is written as an empty one: the end id alone. Rows of one doc_id stay separate,
in order of their text's hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import textarrays as ta

END_ID = 2


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with the end id behind it."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(n + 1)


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text), in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer)
        for whole in batches:
            for b in ta.slices(whole, "text"):
                ids, at = with_end(*enc.ids(ta.column(b, "text")), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(ta.lean(run), "doc_id long, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "delta", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 5000) -> None:
    """Token files of docs (doc_id, text) in the new folder ``path``."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(encoding)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    rows = rows.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    options = {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "compression": "zstd",
    }
    encode(rows, tokenizer, end_id).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, part, row): all, or those with first <= doc_id <= last; row is the place in its file."""
    df = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    name = F.col("_metadata.file_name")
    df = df.select("*", F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row"))
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, start): ids before each row in the whole folder, from the n_tokens columns alone."""
    size = read(spark, path).select("part", "row", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    # as many rows as files
    base = parts.withColumn("base", F.sum("all").over(Window.orderBy("part")) - F.col("all")).select("part", "base")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return size.withColumn("inside", inside).join(base, "part").select("part", "row", (F.col("base") + F.col("inside")).alias("start"))


def digests(rows: DataFrame) -> DataFrame:
    """(part, row, doc_id, n_tokens, ids_crc32) of what ``read`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    return rows.select("part", "row", "doc_id", "n_tokens", "ids").mapInArrow(ta.lean(run), "part long, row long, doc_id long, n_tokens long, ids_crc32 long")
