"""Language by rank-order profiles: a text's most frequent character n-grams against each language's, by out-of-place distance.

n-grams are of one to three letters, in small letters, with one blank for any
run of other characters; they are packed exactly, 21 bits a character. Equal
counts rank by the n-gram's own value, so profiles don't hang on the order of
rows. A null text, or one without a letter, is ``und`` with score 0. Languages
are learned from whole texts; repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta

PROFILE = 400
MAX_LANGUAGES = 10_000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letters(text: str) -> np.ndarray:
    """Code points in small letters, blanks for all else, none twice in a row, one at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letter_table()[c], c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    blank = c == 32
    return c[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)


def ngram_keys(c: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3, a blank alone apart."""
    two = c[:-1] | (c[1:] << np.uint64(21))
    return np.concatenate([c[c != 32], two, two[:-1] | (c[2:] << np.uint64(42))]) if len(c) > 1 else c[:0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent."""
    key, n = counted(keys)
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        key, n = key[n >= least], n[n >= least]
    return key[np.lexsort((key, -n))][:size]


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The ranked n-grams of each language of docs (text, lang); rows without a language say nothing.

    At most MAX_LANGUAGES languages, which is checked, of ``size`` n-grams each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text", 8 << 20):
                parts: dict[str, list[np.ndarray]] = {}
                for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    parts.setdefault(lang, []).append(ngram_keys(letters(t.as_py() or "")))
                for lang, p in parts.items():
                    key, n = counted(np.concatenate(p))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(ta.signed(key)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = docs.select("text", "lang").where("lang is not null").mapInArrow(ta.lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["gram"])
        if len(out) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: is this column a language?")
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        every = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.grams = every
        self.rank = np.full((len(self.names), len(every) + 1), -1)
        for k, name in enumerate(self.names):
            p = np.array(profiles[name], np.int64).view(np.uint64)
            self.rank[k, np.searchsorted(every, p)] = np.arange(len(p))

    def distances(self, text: str) -> np.ndarray:
        """Mean out-of-place distance to each language, as a share of the worst."""
        own = ranked(ngram_keys(letters(text)), self.size)
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        there = self.rank[:, np.where(known, at, len(self.grams))]
        apart = np.where(there < 0, self.size, np.abs(there - np.arange(len(own))))
        return apart.sum(1) / max(len(own), 1) / self.size


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text): score is the lead over the next language, 0 to 1."""
    model = Profiles(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letter_table()
        for b in batches:
            names, scores = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                if not model.names or not table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                    names.append("und")
                    scores.append(0.0)
                    continue
                d = model.distances(text)
                order = np.argsort(d, kind="stable")
                names.append(model.names[order[0]])
                nxt = d[order[1]] if len(d) > 1 else 1.0
                scores.append(float(np.clip(1 - d[order[0]] / nxt, 0, 1)) if nxt > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(run), "doc_id long, lang_pred string, score double")
