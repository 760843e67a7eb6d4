"""Collocations: phrases whose words come together far more often than apart.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\n-\\r]`` and pieces
into words at blanks and tabs. Every run of 1 to ``max_n`` words becomes a row,
rows are counted by hash aggregation within a language, a phrase's parts are
joined to it by equality, scores are integers in Decimal, phrases that come only
inside a longer one fall to an anti-join, and windows rank the rest.

A phrase of ``min_count`` occurrences has no rarer part, so runs that have one
are left out before they are counted: passes over the text count 64-bit hashes
of words, then of pairs of frequent words, then of triples of frequent pairs, and
a fixed bitmap of those that are frequent goes to the tasks. A bitmap only lets
too much through (hashes that meet, or more frequent pairs than it has bits
for), and phrases are counted as texts in the end, so counts are exact at every
size; past some hundred million frequent pairs it merely saves less.

A null language is ``und``; a null or empty text has no words. Rows of equal
text count each time, and doc_id is not read. Equal scores go by count, then by
the phrase's UTF-8 bytes. Other columns are ignored. An empty table gives an
empty one. A very long text is one row's memory, a multiple of its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import settle

#: 16 MB to every task, whatever the corpus.
FILTER_BITS = 27
#: Runs are told apart by so many bits of their hashes where they are counted for the bitmaps; fewer make smaller shuffles, and let a few more through.
HASH_BITS = 40
#: Runs up to so many words are known to be frequent before they are counted as texts; longer ones have only frequent runs of this length.
KNOWN_WORDS = 3
#: First ranks are taken in so many groups a language, then among those.
RANK_GROUPS = 64

_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *map(ord, ".,;:!?")]] = True


class Runs:
    """Words of a slice of rows, single blanks between them, so that every run of words is one span."""

    def __init__(self, batch: pa.RecordBatch):
        buf, offs = ta.raw(ta.column(batch, "text"))
        small = ta.LOWER[buf]
        gap = _BLANK[small] | _BREAK[small]
        edge = np.ones(len(buf) + 1, bool)
        edge[1:] = False if not len(buf) else np.append(gap[:-1], True)
        edge[offs[:-1]] = True
        start = np.flatnonzero(~gap & edge[:-1])
        last = np.append(gap[1:], True) if len(buf) else gap
        last[offs[1:][offs[1:] > 0] - 1] = True
        end = np.flatnonzero(~gap & last) + 1
        row = np.searchsorted(offs, start, "right") - 1
        codes = batch.column(batch.schema.get_field_index("lang")).fill_null("und").dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        #: Of each word: the number of its language, and a number that only words of its piece have.
        self.lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.piece = np.concatenate([[0], np.cumsum(_BREAK[small])])[start] + row
        size = end - start
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.end = self.start + size
        self.text = np.full(int((size + 1).sum()), 32, np.uint8)
        take = np.arange(int(size.sum()))
        shift = np.cumsum(size) - size
        self.text[take + np.repeat(self.start - shift, size)] = small[take + np.repeat(start - shift, size)]
        self.spans = ta.Spans(self.text)
        salt = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        self.salt = salt[self.lang] * np.uint64(0x9E3779B97F4A7C15)

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from each one on are of one piece."""
        k = len(self.piece) - n + 1
        return self.piece[:k] == self.piece[n - 1 :] if k > 0 else np.zeros(0, bool)

    def hashes(self, n: int) -> np.ndarray:
        """Of the n words from each one on, and of the language."""
        k = max(len(self.start) - n + 1, 0)
        return ta.mix(self.spans.hash(self.start[:k], self.end[n - 1 :]) ^ self.salt[:k]) if k else np.zeros(0, np.uint64)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(59 - len(bits).bit_length())  # as many high bits as there are places
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _each(docs: DataFrame, f: Callable[[Runs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text"):
                yield from f(Runs(b))

    return docs.mapInArrow(ta.lean(run), schema)


def _runs(r: Runs, known: list[np.ndarray], max_n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of 1, 2, ... words: where runs start that are frequent for all that the bitmaps of shorter and equal ones know; ends with none."""
    last = np.ones(len(r.start), bool)
    for n in range(1, max_n + 1):
        k = max(len(r.start) - n + 1, 0)
        last = last[:k] if n == 1 else last[:k] & last[1 : k + 1] & r.within(n)
        if n <= len(known):
            at = np.flatnonzero(last)
            last[at] = _held(known[n - 1], r.hashes(n)[at])
        if not last.any():
            return
        yield n, last


def _frequent(docs: DataFrame, n: int, min_count: int, known: list) -> np.ndarray:
    """The bitmap of hashes that runs of n words have min_count times, of runs that are frequent for all that is known of n - 1 words."""

    def rows(r: Runs) -> Iterator[pa.RecordBatch]:
        found = dict(_runs(r, [k.value for k in known], n)).get(n)
        h = r.hashes(n) >> np.uint64(64 - HASH_BITS)
        seen, c = np.unique(h[found] if found is not None else h[:0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(c)], ["h", "c"])

    often = _each(docs, rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
    place = F.shiftright("h", HASH_BITS - FILTER_BITS)
    words = often.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("b"))
    got = words.toArrow()  # one row a word of the bitmap at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return bits


def counts(docs: DataFrame, max_n: int = 5, min_count: int = 100) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of 1 to max_n words with min_count occurrences, and with words = 0 the words of each language."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    sc = docs.sparkSession.sparkContext
    known: list = []
    for n in range(1, min(max_n, KNOWN_WORDS) + 1):
        known.append(sc.broadcast(_frequent(docs, n, min_count, list(known))))

    def rows(r: Runs) -> Iterator[pa.RecordBatch]:
        total = np.bincount(r.lang, minlength=len(r.langs))
        found = [(np.flatnonzero(total), np.zeros(np.count_nonzero(total), np.int64), pa.array([""] * np.count_nonzero(total)), total[total > 0])]
        for n, run in _runs(r, [k.value for k in known], max_n):
            at = np.flatnonzero(run)
            table = pa.table({"lang": r.lang[at], "phrase": ta.cut_out(r.text, r.start[at], r.end[at + n - 1])})
            same = table.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
            found.append((same["lang"].to_numpy(), np.full(len(same), n), same["phrase"].combine_chunks(), same["count_all"].to_numpy()))
        for lang, n, phrase, c in found:
            yield pa.RecordBatch.from_arrays([pa.array([r.langs[k] for k in lang], pa.string()), pa.array(n, pa.int32()), phrase, pa.array(c, pa.int64())], ["lang", "words", "phrase", "c"])

    counted = _each(docs, rows, "lang string, words int, phrase string, c long").groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f"))
    return counted.where((F.col("f") >= min_count) | (F.col("words") == 0))


def score(a, n, l, r):  # noqa: E741
    """floor(1000 * a * n / (l * r)) of long columns, exactly: products are Decimals of up to 38 digits."""
    whole = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(a) * whole(n), whole(l) * whole(r))


def rank(counted: DataFrame, max_n: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of what ``counts`` gives, which should be settled."""
    total = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = counted.where("words > 0").select("lang", "phrase", "f")
    cand = counted.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    # a longer phrase as frequent makes those of one word less superfluous
    word = F.split("phrase", " ")
    run = lambda first, size: F.array_join(F.slice(word, first, size), " ")
    inner = cand.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(run(F.lit(1), F.col("words") - 1), run(F.lit(2), F.col("words") - 1))).alias("phrase"))
    left = cand.join(inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    cuts = left.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("first"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(total) if counted.where("words = 0").limit(10_001).count() <= 10_000 else total, "lang")
    scored = cuts.withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r", "b.n")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of 2 to max_n words of each language of docs (text, lang)."""
    return rank(settle(counts(docs, max_n, min_count)), max_n, top)
