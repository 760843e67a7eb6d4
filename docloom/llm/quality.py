"""Quality rules: how far a document's make-up lies from its language's.

Two histograms of a document, of character classes and of its language's common
words, are compared with the same histograms over all documents of that
language, by Jensen-Shannon distance (square root of the divergence, base 2).
The classes are compared only above a minimum length, where that says something.
The more words, the less of their distance is chance, so its limit falls with
the root of their number.

Nulls: a null or empty text has no words and fails the base rules; a document of
null language, or of a language with less than ``min_reference_words`` words in
all, is held against the closest of the references there are; a language without
a list of common words, against its own counts of all listed words. Repeated rows are
scored alike, row by row. Other columns pass through ``assess`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this from have or by had not but what all were when we there can an your which their if do will each how them then she many some so these would into has more her two him see could no make than been its who now people my over did down only way find use may other",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux mais comme cette on leur nous elle été tout ses ont même sans peut ces aussi sa deux être fait bien entre où si dont",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque",
    "it": "di e il la che in un a per è una sono con non del da si le dei al come i della più ha nel ma lo anche alla gli dal se questo delle su ed nella",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft hij ze wordt door over",
}

#: Character classes: letter small, letter capital, digit, blank, line end, sentence mark, quote or bracket, symbol, other script.
CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?-"]] = 5
_CLASS[[ord(c) for c in "'\"()[]"]] = 6
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 8, 255
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True

DEFAULTS = {
    "min_words": 50,
    "max_repeat_percent": 50,
    "class_distance": 0.3,
    "class_min_chars": 200,
    "word_distance": 0.1,
    "word_spread": 2.0,
    "word_min_words": 50,
    "min_reference_words": 1000,
}


def _word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(ta.Spans(b).hash(np.array([0]), np.array([len(b)]))[0])


def _vocabulary(common: dict[str, str]) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """Sorted hashes of all listed words, and for each language where its own are in them."""
    own = {k: np.array(sorted({_word_hash(w) for w in v.split()}), np.uint64) for k, v in common.items()}
    every = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]))
    return list(own), every, {k: np.searchsorted(every, v) for k, v in own.items()}


def histograms(col: pa.Array, vocabulary: np.ndarray):
    """Base counts of each row, its character classes, and how often it has each listed word."""
    buf, offs = ta.raw(col)
    n = len(offs) - 1
    start, end, bounds = ta.words(buf, offs)
    lead = (buf & 0xC0) != 0x80
    base = {
        "n_words": np.diff(bounds),
        "word_chars": ta.per_row(lead & ~ta.WS[buf], offs),
        "n_symbols": ta.per_row(_SYMBOL[buf], offs),
    }
    spans = ta.Spans(buf)
    # lines: a line ends at \n or at the end of its row
    cut = buf == 10
    begins = np.unique(np.concatenate([offs[:-1][offs[:-1] < offs[1:]], np.flatnonzero(cut) + 1]))
    begins = begins[begins < len(buf)]
    row = np.searchsorted(offs, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], len(buf)), offs[row + 1])
    ends = ends - ((ends > begins) & cut[np.maximum(ends - 1, 0)])
    ink = np.concatenate([[0], np.cumsum(~ta.WS[buf])])
    has = ink[ends] > ink[begins]
    row, lines = row[has], spans.hash(begins[has], ends[has])
    seen, where = np.unique(ta.mix(lines + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    base["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[where], minlength=n)
    # words inside three-word windows that the row has twice
    h = spans.hash(start, end)
    tri, first = ta.ngrams(h, bounds, 3)
    of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = ta.mix(tri + of * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    at = at + (bounds[:-1] - first[:-1])[of[at].astype(np.int64)]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    base["n_repeat_words"] = ta.per_row(covered, bounds)
    # character classes, one for each code point
    cls = _CLASS[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3)
    cls[latin] = np.where(buf[latin + 1] < 0x9F, 1, 0)
    classes = np.stack([ta.per_row(cls == k, offs) for k in range(CLASSES)], 1)
    # listed words: small letters, without a closing mark
    small = ta.LOWER[buf]
    bare = end - (_MARK[small[end - 1]] & (end - start > 1)) if len(end) else end
    hw = ta.Spans(small).hash(start, bare)
    pos = np.minimum(np.searchsorted(vocabulary, hw), max(len(vocabulary) - 1, 0))
    hit = vocabulary[pos] == hw if len(vocabulary) else np.zeros(len(hw), bool)
    of = np.repeat(np.arange(n), np.diff(bounds))[hit]
    counts = np.bincount(of * len(vocabulary) + pos[hit], minlength=n * len(vocabulary)).reshape(n, -1)
    return base, classes, counts


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to counts q, 0 to 1; without counts on a side, 0."""
    sp, sq = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    a, b = p / np.maximum(sp, 1), np.broadcast_to(q / np.maximum(sq, 1), p.shape)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(a > 0, a * np.log2(a / m), 0).sum(-1) / 2 + np.where(b > 0, b * np.log2(b / m), 0).sum(-1) / 2
    return np.where((sp[..., 0] > 0) & (sq[..., 0] > 0), np.sqrt(np.clip(d, 0, 1)), 0.0)


def references(docs: DataFrame, common: dict[str, str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, slot, n): counts over all documents of each language; a few hundred rows a language."""
    vocabulary = _vocabulary(common or COMMON_WORDS)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in ta.slices(whole, "text"):
                base, classes, counts = histograms(ta.column(b, "text"), vocabulary)
                rows = np.concatenate([base["n_words"][:, None], classes, counts], 1)
                codes = b.column(b.schema.get_field_index("lang")).dictionary_encode()
                idx = codes.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    total[name] = total.get(name, 0) + rows[idx == k].sum(0)
        for name, t in total.items():
            slot = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot, pa.int32()), pa.array(t[slot], pa.int64())], ["lang", "slot", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    return rows.mapInArrow(ta.lean(run), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


#: More languages than any register has; beyond it the references aren't shipped to executors.
MAX_LANGUAGES = 10_000


def assess(docs: DataFrame, common: dict[str, str] | None = None, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.

    ``limits`` overrides DEFAULTS; a text of n words may have a word_distance of ``word_distance + word_spread / sqrt(n)``. The references are a table of at most
    MAX_LANGUAGES languages times a few hundred counts, a checked bound.
    """
    o = DEFAULTS | limits
    names, vocabulary, own = _vocabulary(common or COMMON_WORDS)
    width = 1 + CLASSES + len(vocabulary)
    found: dict[str, np.ndarray] = {}
    ref = references(docs, common, text, lang)
    for r in ref.toLocalIterator():
        found.setdefault(r["lang"], np.zeros(width, np.int64))[r["slot"]] = r["n"]
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: is this column a language?")
    refs = {k: v for k, v in found.items() if v[0] >= o["min_reference_words"]}

    def words_apart(base, counts, at, k):
        # the words listed for the language, or all where it has no list; and all the others as one more
        mine = own.get(k, np.arange(len(vocabulary)))
        v = refs[k][1 + CLASSES :][mine]
        rest = base["n_words"][at, None] - counts[at][:, mine].sum(1, keepdims=True)
        return js_distance(np.concatenate([counts[at][:, mine], rest], 1), np.append(v, refs[k][0] - v.sum()))

    def judge(base, classes, counts, langs):
        n = len(langs)
        cd, wd = np.full(n, 0.0), np.full(n, 0.0)
        far = {k: js_distance(classes, v[1 : 1 + CLASSES]) for k, v in refs.items()}
        nearest = min_over(list(far.values()), n)
        for k in set(langs):
            at = np.flatnonzero(np.array([x == k for x in langs]))
            cd[at] = far[k][at] if k in far else nearest[at]
            wd[at] = words_apart(base, counts, at, k) if k in refs else min_over([words_apart(base, counts, at, x) for x in refs], len(at))
        cd = np.where(classes.sum(1) >= o["class_min_chars"], cd, 0.0)
        return cd, np.where(base["n_words"] >= o["word_min_words"], wd, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, text):
                base, classes, counts = histograms(ta.column(b, text), vocabulary)
                cd, wd = judge(base, classes, counts, b.column(b.schema.get_field_index(lang)).to_pylist())
                bad = (base["n_words"] < o["min_words"]) | (100 * base["n_repeat_words"] > o["max_repeat_percent"] * base["n_words"])
                kept = ~bad & (cd <= o["class_distance"]) & (wd <= o["word_distance"] + o["word_spread"] / np.sqrt(np.maximum(base["n_words"], 1)))
                new = [*(pa.array(base[k], pa.int64()) for k in ADDED[:5]), pa.array(bad), pa.array(cd), pa.array(wd), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest_of), *new], [*rest_of, *ADDED])

    rest_of = [c for c in docs.columns if c not in ADDED]
    kinds = [f"`{c}` {t}" for c, t in docs.dtypes if c not in ADDED]
    kinds += [f"{c} long" for c in ADDED[:5]] + ["base_failed boolean", "class_distance double", "word_distance double", "kept boolean"]
    return docs.select(*(f"`{c}`" for c in rest_of)).mapInArrow(ta.lean(run), ", ".join(kinds))


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def min_over(rows: list[np.ndarray], n: int) -> np.ndarray:
    return np.min(rows, 0) if rows else np.zeros(n)
