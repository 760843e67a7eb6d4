"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

The items are indexed; every passage of every document is a query. A score is
BM25 as a share of the item's score against itself, so that one threshold serves
short and long items. Items go by classes of length, each twice as long as the one
before: the passages of a class are windows of twice its greatest length with
steps of half that, so each item lies whole in one window at least, and a long
item doesn't widen those of short ones. An item of any length is one item, held
where a window reaches the threshold for all of it.

WAND's upper bounds prune in two steps. Terms common among the items add up to
less than the threshold for every item even all together; so a window can only
score above it through rarer terms, and windows whose rarer terms can't lift any
item that far are left out at once, by numpy over the whole slice. The others
walk the posting lists with block maxima. Nothing above the threshold is lost:
``tests/llm`` compares with scoring every pair.

A hit counts when the window also holds enough of the item's question and of its
answer, as word pairs in order. Where the items have no answer column, an
item's last sentence is its answer, or the last third of a single sentence.

Null or empty texts and items match nothing. Items of less than four words say
too little for a score: they are not indexed but found as runs of their words,
exactly, and reported as of another kind, without score or overlaps. Rows with one doc_id stay
separate hits, a null one too; item ids twice are two items. A text of any length
is searched whole, and other columns are ignored. The items are what is sent to
the tasks: MAX_INDEX_WORDS words of them at a time, a pass over the texts for each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import settle

K1, B = 1.2, 0.75
BLOCK = 16
#: Bytes are words' own, but ASCII marks and controls, which part words.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Items of less words are found as they stand.
SHORT = 4
#: Words of the items that are sent to the tasks at a time; one item at least.
MAX_INDEX_WORDS = 1_000_000
#: The least step of windows.
LEAST_STEP = 8


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PLAIN).split()


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item that has no columns for them."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1 and len(tokens(parts[-1])) >= 2:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = max(1, len(words) - max(2, len(words) // 3))
    return " ".join(words[:at]), " ".join(words[at:])


def frequencies(items: list[list[bytes]]) -> Stats:
    return len(items), sum(map(len, items)) / max(len(items), 1), Counter(t for w in items for t in set(w))


def step_of(words: int) -> int:
    """The step of windows, and greatest length, of the class of items of so many words."""
    return max(LEAST_STEP, 1 << (words - 1).bit_length())


def pairs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(words, words[1:])) or {tuple(words)} - {()}


Stats = tuple[int, float, dict[bytes, int]]


class Index:
    """Posting lists in item order with block maxima; impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple[int, str, str]], threshold: float, stats: Stats | None = None):
        """stats: number, mean length and document frequencies of all items, where these are some of them."""
        words = [tokens(q) + tokens(a) for _, q, a in items]
        keep = [k for k, w in enumerate(words) if len(w) >= SHORT]
        self.items = [items[k] for k in keep]
        words = [words[k] for k in keep]
        self.question = [pairs(tokens(q)) for _, q, _ in self.items]
        self.answer = [pairs(tokens(a)) for _, _, a in self.items]
        self.threshold, n = threshold, len(words)
        of, mean, df = stats or frequencies(words)
        self.term = {t: k for k, t in enumerate(sorted({t for w in words for t in w}))}
        self.posts: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for i, w in enumerate(words):
            score = {t: math.log(1 + (of - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(score.values())
            for t, s in score.items():
                self.posts[self.term[t]].append((i, s / own))
        self.best = [max(s for _, s in p) for p in self.posts]
        self.blocks = [[(p[min(k + BLOCK, len(p)) - 1][0], max(s for _, s in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for p in self.posts]
        self.docs = [[i for i, _ in p] for p in self.posts]
        # common terms: together below half the threshold for every item
        common, mass = set(), np.zeros(n)
        for t in sorted(range(len(self.posts)), key=lambda t: -len(self.posts[t])):
            after = mass.copy()
            for i, s in self.posts[t]:
                after[i] += s
            if after.max(initial=0) >= threshold / 2:
                break
            common.add(t)
            mass = after
        self.need = threshold - mass
        rare = [t for t in range(len(self.posts)) if t not in common]
        self.rare_first = np.full(len(self.posts) + 1, -1)
        self.rare_count = np.zeros(len(self.posts) + 1, np.int64)
        flat = [(i, s) for t in rare for i, s in self.posts[t]]
        at = 0
        for t in rare:
            self.rare_first[t], self.rare_count[t] = at, len(self.posts[t])
            at += len(self.posts[t])
        self.rare_item = np.array([i for i, _ in flat], np.int64)
        self.rare_impact = np.array([s for _, s in flat])

    def possible(self, terms: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Windows in which rare terms can lift some item to the threshold; terms once a window."""
        count = self.rare_count[terms]
        at = np.repeat(self.rare_first[terms], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair = np.repeat(window, count) * np.int64(len(self.items)) + self.rare_item[at]
        uniq, inv = np.unique(pair, return_inverse=True)
        got = np.bincount(inv, self.rare_impact[at], len(uniq))
        ok = got >= self.need[uniq % len(self.items)] - 1e-9 if len(uniq) else np.zeros(0, bool)
        return np.unique(uniq[ok] // len(self.items))

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """All items that score the threshold or more, by block-max WAND."""
        lists = [[0, t] for t in query if self.docs[t]]  # place in the list, term
        found, floor = [], self.threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                total += self.best[t]
                if total >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.docs[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            bound, ends = 0.0, []
            for at, t in lists[: pivot + 1]:
                k = bisect.bisect_left(self.blocks[t], item, at // BLOCK, key=lambda b: b[0])
                if k < len(self.blocks[t]):
                    bound += self.blocks[t][k][1]
                    ends.append(self.blocks[t][k][0] + 1)
            if bound >= floor:
                if self.docs[lists[0][1]][lists[0][0]] == item:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += self.posts[x[1]][x[0]][1]
                        x[0] += 1
                    if score >= floor:
                        found.append((item, score))
                else:
                    self._advance(lists[:pivot], item)
            else:
                # no item before the end of these blocks, or of the next list's place, can reach it
                to = min(ends, default=item + 1)
                if pivot + 1 < len(lists):
                    to = min(to, self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]])
                self._advance(lists[: pivot + 1], max(to, item + 1))
            lists = [x for x in lists if x[0] < len(self.docs[x[1]])]
        return found

    def _advance(self, lists: list[list[int]], item: int) -> None:
        for x in lists:
            x[0] = bisect.bisect_left(self.docs[x[1]], item, x[0])

    def overlap(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Share of the question's and of the answer's word pairs that the passage has."""
        have = pairs(words) | {(w,) for w in words}
        share = lambda p: len(p & have) / len(p) if p else 0.0
        return share(self.question[item]), share(self.answer[item])


#: kind is SCORED, or RUN for an item too short for a score.
SCORED, RUN = "scored", "run"
HIT = "doc_id long, item_id long, kind string, score double, question double, answer double, word long"


def indexes(items: list[tuple[int, str, str]], threshold: float, stats: Stats | None = None) -> list[tuple[int, Index]]:
    """An index for each class of lengths, with its step."""
    words = [tokens(q) + tokens(a) for _, q, a in items]
    stats = stats or frequencies([w for w in words if len(w) >= SHORT])
    of = defaultdict(list)
    for item, w in zip(items, words, strict=True):
        if len(w) >= SHORT:
            of[step_of(len(w))].append(item)
    return [(step, Index(of[step], threshold, stats)) for step in sorted(of)]


def matches(docs: DataFrame, items: list[tuple[int, str, str]], threshold: float, question: float, answer: float, prune: bool = True, stats: Stats | None = None) -> DataFrame:
    """Hits of these items: the best window of each (row, item)."""
    sent = docs.sparkSession.sparkContext.broadcast(indexes(items, threshold, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        # a word's number among all, and its number in each index
        number = {t: k for k, t in enumerate({t: None for _, x in known for t in x.term})}
        local = []
        for _, x in known:
            local.append(np.full(len(number) + 1, -1, np.int64))
            local[-1][[number[t] for t in x.term]] = list(x.term.values())
        get = number.get
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                rows = []
                texts = batch.column(1)
                for r in range(batch.num_rows if known else 0):
                    words = tokens(texts[r].as_py() or "")
                    ids = np.array([get(w, -1) for w in words], np.int64)
                    for n, (step, index) in enumerate(known):
                        rows += [(r, n, *x) for x in passages(words, local[n][ids], step, index)]
                best: dict[tuple[int, int, int], tuple] = {}
                for x in rows:
                    if x[:3] not in best or x[3] > best[x[:3]][3]:
                        best[x[:3]] = x
                got = list(best.values())
                cols = [batch.column(0).take(pa.array([x[0] for x in got], pa.int64())), pa.array([known[x[1]][1].items[x[2]][0] for x in got], pa.int64())]
                cols += [pa.array([SCORED] * len(got), pa.string())] + [pa.array([float(x[k]) for x in got], pa.float64()) for k in (3, 4, 5)] + [pa.array([x[6] for x in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "kind", "score", "question", "answer", "word"])

    def passages(words: list[bytes], ids: np.ndarray, step: int, index: Index) -> Iterator[tuple]:
        """(item, score, question, answer, word) of the windows of a text in which an item is."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        # each place lies in two windows: the one that starts in its step, and the one before
        win = np.concatenate([at // step, np.maximum(at // step - 1, 0)])
        key = np.unique(win * np.int64(len(index.term)) + np.concatenate([ids[at]] * 2))
        win, term = key // len(index.term), key % len(index.term)
        for w in (index.possible(term, win) if prune else np.unique(win)).tolist():
            for item, score in index.search(term[np.searchsorted(win, w) : np.searchsorted(win, w, "right")].tolist()):
                q, a = index.overlap(item, words[w * step : w * step + 2 * step])
                if q >= question and a >= answer:
                    yield item, score, q, a, w * step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(ta.lean(run), HIT)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """(doc_id, item_id, kind, score, question, answer, word): every item that a document's text holds, a row for each (row, item).

    benchmark has item_id and text, or item_id, question and answer.
    """
    if "question" in benchmark.columns and "answer" in benchmark.columns:
        items = benchmark.select(F.col("item_id").cast("long"), "question", "answer")
        split = lambda r: (r[1] or "", r[2] or "")
    else:
        items = benchmark.select(F.col("item_id").cast("long"), "text")
        split = lambda r: halves(r[1] or "")

    out, table = None, None
    shards = _shards(items, split)
    mine = next(shards)
    while mine is not None:
        after = next(shards, None)
        if after and table is None:
            table = _frequencies(items, split)
        hits = matches(docs, mine, threshold, question, answer, stats=table and _stats(table, mine))
        short = defaultdict(list)
        for i, q, a in mine:
            if 0 < len(w := tokens(q) + tokens(a)) < SHORT:
                short[tuple(w)].append(i)
        if short:
            hits = hits.union(runs(docs, dict(short)))
        out = hits if out is None else out.union(hits)
        mine = after or None
    return out


def _frequencies(items: DataFrame, split) -> DataFrame:
    """(term, n, length): in how many indexed items each word is; number and words of all of them under a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df, n, length = Counter(), 0, 0
            for r in zip(*(c.to_pylist() for c in b.columns)):
                w = [t for half in split(r) for t in tokens(half)]
                if len(w) >= SHORT:
                    df.update(set(w))
                    n, length = n + 1, length + len(w)
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([length] + [0] * len(df), pa.int64())], ["term", "n", "length"])

    return settle(items.mapInArrow(ta.lean(run), "term binary, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))


def _stats(table: DataFrame, items: list[tuple[int, str, str]]) -> Stats:
    """What an index of these items needs of the frequencies among all."""
    terms = {t for _, q, a in items for t in tokens(q) + tokens(a)}
    asked = table.sparkSession.createDataFrame([(bytearray(t),) for t in sorted(terms)], "term binary")
    total = table.where("term IS NULL").first()
    return total["n"], total["length"] / max(total["n"], 1), {bytes(r["term"]): r["n"] for r in table.join(asked, "term", "left_semi").collect()}


def runs(docs: DataFrame, short: dict[tuple[bytes, ...], list[int]]) -> DataFrame:
    """Hits of short items: where their words first stand on end in a row."""
    sizes = sorted({len(w) for w in short})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, item, word = [], [], []
            for r, text in enumerate(b.column(1)):
                words, seen = tokens(text.as_py() or ""), {}
                for n in sizes:
                    for k, w in enumerate(zip(*(words[x:] for x in range(n)))):
                        if w in short:
                            seen.setdefault(w, k)
                for i, k in {i: k for w, k in seen.items() for i in short[w]}.items():
                    at.append(r), item.append(i), word.append(k)
            none = pa.nulls(len(at), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array([RUN] * len(at), pa.string()), none, none, none, pa.array(word, pa.int64())], ["doc_id", "item_id", "kind", "score", "question", "answer", "word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(ta.lean(run), HIT)


def _shards(items: DataFrame, split) -> Iterator[list[tuple[int, str, str]]]:
    held, size = [], 0
    for r in items.toLocalIterator():
        q, a = split(r)
        n = len(q.split()) + len(a.split())
        if held and size + n > MAX_INDEX_WORDS:
            yield held
            held, size = [], 0
        held.append((r[0], q, a))
        size += n
    yield held
