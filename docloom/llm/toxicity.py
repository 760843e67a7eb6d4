"""Toxicity by two class-conditional bigram Kneser-Ney models.

Expressions are whole words, in small letters, and pairs of them. As in
Kneser-Ney's lower orders, a class counts after how many different words an
expression stands, exactly, so copies of a document don't add up: a pair counts
the different words before it, a word the different words that it follows. Each
class's counts of pairs are discounted, and what is taken off goes to the
class's words; what is taken off those goes to one backoff that both classes
share: the continuation probability of the word over both, and below it an even
one. An expression that neither class has often thus scores alike in both, and
only those that one class has much more of tell them apart. A text's score comes
from the difference of its length-normalised log-likelihoods, over all of it,
over its most telling window, and over the most telling window by the words'
lower order alone, through a logistic curve.

Counts are exact but for words of equal 48-bit hash, and of words before one pair
of equal 32-bit hash. They are gathered in runs: a task sorts the different runs
of three words of its texts and sends, for each bucket of pairs, the words once a
run and the words before them in four bytes each.

The model is two tables keyed by hashes of words and of pairs, and grows with the
corpus. Only rows that differ from what an absent row gives are in it: a word or
pair that no class has more than DISCOUNT of, and that no pair in the table
needs, has nothing left but its share of the backoff, which cancels. A model of at
most SHIPPED_ROWS rows goes whole to the tasks; beyond, texts are dealt out in
chunks and joined to the rows that they ask for. The same function scores both.

A null or empty text has difference 0, and so the score that the curve has
there. Labels other than 0 and 1, and null, are not learned from. A document
labelled twice is learned from as often, which changes no count. Texts are scored
whole, whatever their length; rows of one doc_id are scored each, a null one too,
and other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .quality import _MARK
from .shared import sent, settle, stored

#: Words of a window.
WINDOW = 2
#: Discount of a class's counts, at most: an expression seen so often says nothing of its class. And of the shared counts.
DISCOUNT, SHARED_DISCOUNT = 3, 0.75
#: Rows up to which the model is sent whole, 24 bytes each at most; above, texts are joined to it. Results are the same.
SHIPPED_ROWS = 4_000_000
#: Bytes of text that are scored together where texts are joined to the model, whose runs a task combines, and whose pairs a bucket holds.
CHUNK_BYTES, COMBINED_BYTES, BUCKET_BYTES = 16 << 20, 12 << 20, 24 << 20
#: Labelled rows, at most, that the weights and the offset of the curve are fitted on; counts use all.
CALIBRATION_ROWS = 20_000

#: Of a word: words it follows in toxic and plain texts and in either, and as history, counts and discounts of the pairs it begins, and how many of these are kept.
VALUES = ["toxic", "plain", "either", "toxic_after", "plain_after", "toxic_taken", "plain_taken", "kept"]
COUNTS = ", ".join(f"{v} long" for v in VALUES)
WORD = np.uint64((1 << 48) - 1)
FEATURES = ["whole", "most", "most_lower"]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each row."""
    buf, offs = ta.raw(col)
    start, end, bounds = ta.words(buf, offs)
    small = ta.LOWER[buf]
    bare = end - (_MARK[small[end - 1]] & (end - start > 1)) if len(end) else end
    return ta.Spans(small).hash(start, bare) & WORD, bounds


def previous(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What stands before each word; 0 before the first of a row."""
    before = np.concatenate([np.zeros(1, np.uint64), w[:-1]])[: len(w)]
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    return before


def pair(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ta.mix(before * np.uint64(3) + w)


def _numbers(n: np.ndarray) -> bytes:
    """Counts as bytes of seven bits, the lowest first; the eighth says that more follow."""
    out, at = np.zeros((len(n), 5), np.uint8), np.arange(len(n))
    size = np.zeros(len(n), np.int64)
    n = n.astype(np.int64)
    for k in range(5):
        left = n[at] >> 7
        out[at, k] = (n[at] & 127) | ((left > 0) << 7)
        size[at] = k + 1
        n[at] = left
        at = at[left > 0]
    return out[np.arange(5) < size[:, None]].tobytes()


def _read_numbers(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[:-1] < 128])) if len(x) else np.zeros(0, np.int64)
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return np.add.reduceat((x & 127) << (7 * place), first) if len(x) else x


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _read_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(first: np.ndarray, before: np.ndarray, word: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different (before, word, first) in order, and in which classes each is."""
    order = np.lexsort((first, word, before))
    first, before, word, classes = first[order], before[order], word[order], classes[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (word[1:] != word[:-1]) | (before[1:] != before[:-1])
    at = np.flatnonzero(new)
    return first[at], before[at], word[at], np.bitwise_or.reduceat(classes, at) if len(at) else classes


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


GRAMS = ["bucket", "before", "words", "word", "firsts", "first", "classes"]


def grams(rows: DataFrame, buckets: int) -> DataFrame:
    """The different runs of three words of rows (text, label), and in which classes (1 plain, 2 toxic), packed by bucket of their last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text", COMBINED_BYTES):
                held = []
                for part in ta.slices(b, "text"):
                    w, bounds = words(ta.column(part, "text"))
                    h = previous(w, bounds)
                    f = ta.mix(previous(h, bounds)).astype(np.uint32)
                    k = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8) + np.uint8(1), np.diff(bounds))
                    held.append(_runs(f, h, w, k))
                f, h, w, k = _runs(*map(np.concatenate, zip(*held, strict=True)))
                bucket = (ta.mix(pair(h, w)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                cols: list[list] = [[] for _ in GRAMS]
                for n in np.flatnonzero(np.diff(ends)).tolist():
                    x = order[ends[n] : ends[n + 1]]
                    f_, h_, w_, k_ = f[x], h[x], w[x], k[x]
                    two = _starts(h_, w_)
                    one = _starts(h_[two])
                    for c, v in zip(cols, (n, _six(h_[two][one]), _numbers(np.diff(np.append(one, len(two)))), _six(w_[two]), _numbers(np.diff(np.append(two, len(f_)))), f_.astype("<u4").tobytes(), k_.tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], GRAMS)

    return rows.select("text", "label").mapInArrow(ta.lean(run), "bucket long, " + ", ".join(f"{c} binary" for c in GRAMS[1:]))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in GRAMS[1:]), strict=True):
        per_word, per_first = _read_numbers(row[1]), _read_numbers(row[3])
        h, w = np.repeat(np.repeat(_read_six(row[0]), per_word), per_first), np.repeat(_read_six(row[2]), per_first)
        yield np.frombuffer(row[4], "<u4"), h, w, np.frombuffer(row[5], np.uint8)


PARTS = f"key long, before long, word long, {COUNTS}"


def count(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, pairs): of each word its VALUES, and of each pair that a class has more than DISCOUNT of its counts and words."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for part in _unpacked(b):
                held.append(part)
                n += len(part[0])
                if len(held) > 1 and n > 6_000_000:  # what several tasks sent alike is held once
                    held = [_runs(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
        f, h, w, k = _runs(*map(np.concatenate, zip(*held, strict=True)))
        at = _starts(h, w)
        h, w = h[at], w[at]
        c = np.stack([np.add.reduceat((k >> s & 1).astype(np.int64), at) for s in (1, 0)])
        used, taken = (c > DISCOUNT).any(0), np.minimum(c, DISCOUNT)
        # a pair's share in its word and in its history
        word, back = np.unique(np.concatenate([w, h]), return_inverse=True)
        of_word, of_history = back[: len(w)], back[len(w) :]
        total = lambda i, x: np.bincount(i, x, len(word)).astype(np.int64)
        values = [total(of_word, c[0] > 0), total(of_word, c[1] > 0), total(of_word, np.ones(len(w))), *(total(of_history, x) for x in (c[0], c[1], taken[0], taken[1], used))]
        none = lambda m: pa.nulls(m, pa.int64())
        names = ["key", "before", "word", *VALUES]
        yield pa.RecordBatch.from_arrays([pa.array(ta.signed(word)), none(len(word)), none(len(word)), *map(pa.array, values)], names)
        m = int(used.sum())
        yield pa.RecordBatch.from_arrays([pa.array(ta.signed(x[used])) for x in (pair(h, w), h, w)] + [pa.array(x[used]) for x in c] + [none(m)] * (len(VALUES) - 2), names)
        ta.release()

    parts = stored(grams(rows, 1 + size // BUCKET_BYTES).groupBy("bucket").applyInArrow(meet, PARTS))
    words_ = parts.where("word IS NULL").groupBy("key").agg(*(F.sum(v).alias(v) for v in VALUES))
    return words_, parts.where("word IS NOT NULL").select("key", "before", "word", "toxic", "plain")


def _lower(total: np.ndarray, toxic, plain, either) -> list:
    """p(word) in toxic and in plain texts, by columns."""
    # the last backoff is even over the words seen and one unseen
    shared = (F.greatest(either - SHARED_DISCOUNT, F.lit(0.0)) + float(SHARED_DISCOUNT * total[5] / (total[5] + 1))) / float(total[2])
    return [(n - F.least(n, F.lit(DISCOUNT)) + float(total[3 + k] + 1) * shared) / float(total[k] + 1) for k, n in enumerate((toxic, plain))]


def tables(words_: DataFrame, pairs: DataFrame, total: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(key, lower, backoff) of words and (key, ratio) of pairs: log ratios of toxic to plain, rows that an absent one gives left out."""
    own = _lower(total, F.col("toxic"), F.col("plain"), F.col("either"))
    full = words_.select("*", own[0].alias("own0"), own[1].alias("own1"))
    back = F.log((F.col("toxic_taken") + 1) / (F.col("toxic_after") + 1)) - F.log((F.col("plain_taken") + 1) / (F.col("plain_after") + 1))
    kept = full.where((F.col("toxic") > DISCOUNT) | (F.col("plain") > DISCOUNT) | (F.col("kept") > 0))
    of_word = full.select(F.col("key").alias("word"), "own0", "own1")
    of_history = full.where("kept > 0").select(F.col("key").alias("before"), "toxic_after", "plain_after", "toxic_taken", "plain_taken")
    joined = pairs.withColumnsRenamed({"toxic": "t", "plain": "p"}).join(of_word, "word").join(of_history, "before")
    one = lambda n, c, k: F.log((F.col(n) - F.least(F.col(n), F.lit(DISCOUNT)) + (F.col(f"{c}_taken") + 1) * F.col(f"own{k}")) / (F.col(f"{c}_after") + 1))
    return kept.select("key", (F.log("own0") - F.log("own1")).alias("lower"), back.alias("backoff")), joined.select("key", (one("t", "toxic", 0) - one("p", "plain", 1)).alias("ratio"))


class Lookup:
    """Values by 64-bit key; absent keys give defaults."""

    def __init__(self, key: np.ndarray, defaults: tuple[float, ...], *values: np.ndarray):
        order = np.argsort(key.view(np.uint64))
        self.key = np.append(key.view(np.uint64)[order], ~np.uint64(0))
        self.values = [np.append(v[order], d) for v, d in zip(values, defaults, strict=True)]

    def __call__(self, asked: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.key, asked)
        at[self.key[at] != asked] = len(self.key) - 1
        return [v[at] for v in self.values]


def lookups(words_: pa.Table, pairs: pa.Table, unseen: float) -> tuple[Lookup, Lookup]:
    column = lambda t, c: t.column(c).to_numpy()
    return Lookup(column(words_, "key"), (unseen, 0.0), column(words_, "lower"), column(words_, "backoff")), Lookup(column(pairs, "key"), (np.nan,), column(pairs, "ratio"))


def ratios(before: np.ndarray, w: np.ndarray, found: tuple[Lookup, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """log p(word | word before, toxic) - log p(word | word before, plain), and the same of the lower order, p(word)."""
    lower, back = found[0](w)[0], found[0](before)[1]
    both = found[1](pair(before, w))[0]
    return np.where(np.isnan(both), back + lower, both), lower


def features(bounds: np.ndarray, r: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Difference of the length-normalised log-likelihoods of each row, of its most toxic window, and of that by the lower order."""
    n = np.diff(bounds)
    many = np.maximum(n - WINDOW + 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], many)
    rows = np.flatnonzero(many)
    out = []
    for x in (r, lower):
        total = np.concatenate([[0], np.cumsum(x)])
        whole = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)
        most = np.where(n > 0, whole * np.minimum(n, WINDOW) / WINDOW, 0.0)
        if len(rows):
            most[rows] = np.maximum.reduceat((total[at + WINDOW] - total[at]) / WINDOW, first[rows])
        out += [whole, most]
    return np.stack([*out[:2], out[3]], 1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (offset last) of a logistic regression, by Newton steps with a small ridge."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


@dataclasses.dataclass
class Model:
    words: DataFrame  # key, lower, backoff
    pairs: DataFrame  # key, ratio
    rows: int
    unseen: float
    counts: tuple[DataFrame, np.ndarray] | None = None
    curve: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(3), np.ones(3), np.zeros(4))
    sent: Broadcast | None = None

    def shipped(self) -> Broadcast:
        if self.sent is None:
            self.sent = self.words.sparkSession.sparkContext.broadcast(lookups(self.words.toArrow(), self.pairs.toArrow(), self.unseen))
        return self.sent


def measure(docs: DataFrame, model: Model, shipped_rows: int) -> DataFrame:
    """(id, FEATURES) of docs (id, text)."""
    unseen, schema = model.unseen, ", ".join(["id long", *(f"{f} double" for f in FEATURES)])
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")

    def measured(b: pa.RecordBatch, found: tuple[Lookup, Lookup]) -> pa.RecordBatch:
        w, bounds = words(ta.column(b, "text"))
        f = features(bounds, *ratios(previous(w, bounds), w, found))
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), *(pa.array(x) for x in f.T)], ["id", *FEATURES])

    if model.rows <= shipped_rows:
        sent = model.shipped()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in ta.slices(whole, "text"):
                    yield measured(b, sent.value)

        return docs.mapInArrow(ta.lean(run), schema)

    n = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES
    texts = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("chunk"), "id", "text").repartition("chunk")
    texts = settle(texts)  # a row's chunk is drawn once

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text"):
                w, bounds = words(ta.column(b, "text"))
                h, chunk = previous(w, bounds), np.repeat(b.column(0).to_numpy(), np.diff(bounds))
                for of_pair, k in ((False, np.concatenate([w, h])), (True, pair(h, w))):
                    c = np.concatenate([chunk] * (1 if of_pair else 2))
                    order = np.lexsort((k, c))
                    c, k = c[order], k[order]
                    at = _starts(c, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(ta.signed(k[at])), pa.array(np.full(len(at), of_pair))], ["chunk", "key", "of_pair"])

    def scored(text: pa.Table, rows: pa.Table) -> pa.Table:
        is_pair = rows.column("of_pair")
        found = lookups(rows.filter(pc.invert(is_pair)), rows.filter(is_pair), unseen)
        out = [measured(b, found) for whole in text.to_batches() for b in ta.slices(whole, "text")]
        return pa.Table.from_batches(out, pa.schema([("id", pa.int64()), *((f, pa.float64()) for f in FEATURES)]))

    none = F.lit(None).cast("double")
    table = model.words.select("key", F.lit(False).alias("of_pair"), "lower", "backoff", none.alias("ratio")).union(model.pairs.select("key", F.lit(True), none, none, "ratio"))
    rows = texts.mapInArrow(ta.lean(asked), "chunk long, key long, of_pair boolean").distinct().join(table, ["key", "of_pair"])
    return texts.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(scored, schema)


def train(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS, shipped_rows: int = SHIPPED_ROWS) -> Model:
    """From rows (doc_id, text, label 0 or 1), all of them; they are read more than once."""
    rows = rows.where(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    words_, pairs = count(rows)
    words_ = stored(words_)
    sums = words_.agg(*(F.sum(c) for c in ("toxic", "plain", "either")), *(F.sum(F.least(c, F.lit(DISCOUNT))) for c in ("toxic", "plain")), F.count_if(F.col("either") > 0)).first()
    total = np.array([x or 0 for x in sums], float)
    unseen = 0.0
    if total[0] and total[1]:
        unseen = float(np.log((total[3] + 1) / (total[0] + 1)) - np.log((total[4] + 1) / (total[1] + 1)))
        of_words, of_pairs = map(stored, tables(words_, pairs, total))
    else:  # nothing to tell the classes by
        of_words = rows.sparkSession.createDataFrame([], "key long, lower double, backoff double")
        of_pairs = rows.sparkSession.createDataFrame([], "key long, ratio double")
    model = Model(of_words, of_pairs, of_words.count() + of_pairs.count(), unseen, (words_, total))
    n = rows.count()
    some = rows
    if n > calibration_rows:  # ids are sorted without their texts
        ids = settle(rows.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(calibration_rows).distinct())
        some = rows.join(sent(ids), "doc_id", "left_semi")
    x = measure(some.select(F.col("label").alias("id"), "text"), model, shipped_rows).toArrow()
    if x.num_rows:
        model.curve = fit_curve(np.column_stack([x.column(f).to_numpy() for f in FEATURES]), x.column("id").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, shipped_rows: int = SHIPPED_ROWS) -> DataFrame:
    """(doc_id, score) of docs (doc_id, text)."""
    mean, spread, w = model.curve
    got = measure(docs.select(F.col("doc_id").alias("id"), "text"), model, shipped_rows)
    z = sum((F.lit(float(a)) * (F.col(c) - float(m)) / float(s) for c, a, m, s in zip(FEATURES, w, mean, spread)), F.lit(float(w[-1])))
    return got.select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
