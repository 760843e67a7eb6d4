"""Similarity join on word n-gram sets with signature trees.

A signature is a bitmap of a set's hashed shingles. A tree node holds the OR of
the signatures below it, the bits all of them have, and the range of their set
sizes; from these follows the largest overlap that any pair of two nodes can
have. Two trees (or one with itself) are walked together, and a pair of nodes
is left as soon as that overlap can't reach the threshold. Pairs of leaves that
are left are compared exactly.

One tree can't hold a corpus: an OR over thousands of documents has every bit
set and prunes nothing. So the upper level of the hierarchy is by pieces of
the sets themselves. For sets of one size class that may differ in at most k
shingles, the hash range is dealt into k + 1 pieces; two linked sets are equal
in one piece at least. Sets with an equal piece, through any chain of such
sets, form a cell, and only inside a cell can there be links. Cells hold a few
documents each, and each one's tree is walked in a task. A cell above
``cell_shingles`` is parted once more, by shingles in order of document frequency
(``split_cells``); so a passage ties none that have enough besides that no other
has, and chains of such documents don't grow with the corpus. What
still is larger, a group of near-copies as a rule, is dealt into blocks by size
class, and within a class by hash: each block is joined with itself, then the roots of what was linked in a
class of several blocks are dealt and joined again until they fit one block; at
last the members that ended outside the cell's largest group meet the blocks of
their own and the adjacent classes, the only ones whose sizes can reach the
threshold. So a group of near-copies of any size costs work in proportion to
its members, no pair is lost, and no task holds more than two blocks. What
grows faster than such a cell is the meeting of its different texts: a class of
m blocks has up to m * m / 2 of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import components, free_shuffles, sent, settle, stars, stored

FANOUT = 8


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each row, A-Z in small letters; with fewer words, of the whole sequence."""
    buf, offs = ta.raw(col)
    start, end, bounds = ta.words(buf, offs)
    h = ta.Spans(ta.LOWER[buf]).hash(start, end)
    g, first = ta.ngrams(h, bounds, n)
    out = []
    for i in range(len(offs) - 1):
        s = g[first[i] : first[i + 1]]
        if not len(s) and bounds[i + 1] > bounds[i]:
            s = h[bounds[i] : bounds[i + 1]]
            s = ta.mix((s * np.arange(3, 2 * len(s) + 3, 2, dtype=np.uint64)).sum(keepdims=True) + np.uint64(len(s)))
        out.append(np.unique(s))
    return out


def size_class(n: int, percent: int) -> int:
    """Sets that may link lie in the same or the next class."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def class_top(c: int, percent: int) -> int:
    """No set of class c is larger."""
    return int(math.exp((c + 1) * math.log(100 / percent)) + 1e-6) + 1


def pieces(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the set's pieces, for its own class and the one below; linked sets share one at least.

    A piece without shingles says nothing, and most sets have some. So there are
    a few pieces more than needed: of two linked sets more than ``spare`` pieces
    are equal, and if either has no more empty ones than that, one that is equal
    has shingles. Only sets with more empty pieces give those too.
    """
    c = size_class(len(s), percent)
    out = []
    for cls in {c, max(c - 1, 0)}:
        # sets of class cls and cls + 1: |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|)
        most = class_top(cls, percent) + class_top(cls + 1, percent)
        k = (100 - percent) * most // (100 + percent) + 1
        spare = -(-k // 10)
        k += spare
        part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as s is
        first = np.append(np.searchsorted(part, np.arange(k, dtype=np.uint64)), len(s))
        total = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(s))])
        value = ta.mix(total[first[1:]] - total[first[:-1]] + ta.mix(np.arange(k, dtype=np.uint64) + np.uint64((cls + 1) << 32)))
        full = first[1:] > first[:-1]
        out.append(value[full] if k - full.sum() <= spare else value)
    return np.concatenate(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(ta.signed(ta.mix(s).sum(keepdims=True))[0]), int(ta.signed(np.bitwise_xor.reduce(ta.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), keepdims=True))[0])


def scan(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): the set's size and its fingerprint in 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text"):
                sets = shingle_sets(ta.column(b, "text"), n)
                prints = [fingerprint(s) for s in sets]
                cols = [[len(s) for s in sets], [f[0] for f in prints], [f[1] for f in prints]]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_shingles", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(run), "doc_id long, n_shingles long, f1 long, f2 long")


#: Text whose pieces a task sums up before they are shuffled.
COMBINED_BYTES = 8 << 20
#: Shingles whose pieces one task of the reducing side sorts, on average.
BUCKET_SHINGLES = 3_000_000


def shared_pieces(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Contracted edges (a, b) between documents (id, text) that share a piece; see ``_ties``."""

    def keys(part: pa.RecordBatch, seen: set) -> Iterator[tuple[int, np.ndarray]]:
        for i, s in zip(part.column(0).to_pylist(), shingle_sets(ta.column(part, "text"), n), strict=True):
            if len(s) and (f := fingerprint(s)) not in seen:  # equal sets of a task give theirs once
                seen.add(f)
                yield i, pieces(s, percent)

    return _ties(docs.select("id", "text").where("id is not null"), keys, buckets)


def _ties(rows: DataFrame, keys, buckets: int) -> DataFrame:
    """Edges (a, b) between rows (id, text, ...) that lead wherever shared keys lead, contracted in each bucket of keys; an edge may come more than once.

    keys(part, seen) gives ids and their keys for a slice of rows. A task gives each
    key once for all the rows it combines, and edges between those; so a key that
    a large group shares reaches the shuffle a few times. Keys are shuffled in
    runs, a row for each bucket of them, with the id named once a run, and of a
    key the KEY_BYTES bytes that its bucket doesn't say. Two keys taken for one
    only tie rows that need not be, which are compared as all others are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text", COMBINED_BYTES):
                seen, of, ids = set(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for part in ta.slices(b, "text"):
                    for i, k in keys(part, seen):
                        of.append(k)
                        ids.append(np.full(len(k), i, np.int64))
                yield pa.RecordBatch.from_arrays(_combined(np.concatenate(of), np.concatenate(ids), buckets), _RUNS)

    return _meet(rows.mapInArrow(ta.lean(cut), _RUNS_SCHEMA))


_RUNS = ["bucket", "ids", "many", "keys"]
_RUNS_SCHEMA = "bucket long, ids array<long>, many array<int>, keys binary"


def _combined(p: np.ndarray, i: np.ndarray, buckets: int) -> list[pa.Array]:
    """Columns _RUNS of keys p of ids i: each key once, and edges between the ids that share it."""
    least, new, order = _least(p, i)
    a, c = least[~new], i[order][~new]
    edges = np.unique(np.stack([a[a != c], c[a != c]], 1), axis=0)
    # an edge is a key of its own, which its two ends share
    tie = ta.mix(ta.mix(edges[:, 0].astype(np.uint64)) + edges[:, 1].astype(np.uint64))
    p, i = np.concatenate([p[order][new], tie, tie]), np.concatenate([i[order][new], edges[:, 0], edges[:, 1]])
    return _packed((p % np.uint64(buckets)).astype(np.int64), i, [], [_short(p // np.uint64(buckets))])


def _packed(bucket: np.ndarray, i: np.ndarray, of_runs: list[np.ndarray], values: list[np.ndarray]) -> list[pa.Array]:
    """Entries as a row for each bucket: its number, the ids of its runs, how many entries each has, what else is the same in all of a run, and the bytes of values (a row each) on end."""
    order = np.lexsort((i, bucket))
    i, bucket = i[order], bucket[order]
    row = np.flatnonzero(np.diff(bucket, prepend=-1))
    run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(i, prepend=0) != 0))
    in_row = pa.array(np.append(np.searchsorted(run, row), len(run)).astype(np.int32))
    lists = [i[run], np.diff(np.append(run, len(i))).astype(np.int32), *(x[order][run] for x in of_runs)]
    return [pa.array(bucket[row]), *(pa.ListArray.from_arrays(in_row, pa.array(x)) for x in lists), *(pa.array([k.tobytes() for k in np.split(v[order], row[1:])][: len(row)], pa.binary()) for v in values)]


def _unpacked(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """What the runs of packed rows say, by name, once for each entry."""
    many = np.concatenate([c.flatten().to_numpy() for c in rows.column("many").chunks])
    return [np.repeat(np.concatenate([c.flatten().to_numpy() for c in rows.column(k).chunks]), many) for k in names]


def _meet(runs: DataFrame) -> DataFrame:
    """Edges (a, b), contracted in each bucket, between the ids of runs that share a key."""

    def meet(bucket: pa.Table) -> pa.Table:
        (i,) = _unpacked(bucket, "ids")
        least, _, order = _least(_long(b"".join(bucket.column("keys").to_pylist())), i)
        edges = np.unique(np.stack([i[order], least], 1)[least != i[order]], axis=0)
        a, b = stars(edges[:, 0], edges[:, 1])
        ta.release()
        return pa.table({"a": a, "b": b})

    return runs.groupBy("bucket").applyInArrow(meet, "a long, b long")


#: Bytes of a key that are shuffled. A bucket holds some BUCKET_SHINGLES keys, of which two in all are alike by chance.
KEY_BYTES = 5


def _short(keys: np.ndarray) -> np.ndarray:
    """The low bytes of each key, a row each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _long(short: bytes) -> np.ndarray:
    """Keys of their low bytes on end."""
    out = np.zeros((len(short) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(short, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def _least(key: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of (key, i): the least i of each entry's key, whether the entry is its key's first, and the order."""
    order = np.lexsort((i, key))
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return i[order][np.flatnonzero(new)][np.cumsum(new) - 1], new, order


def split_cells(members: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(id, cell) of members (cell, id, text): smaller cells, by shingles in order of how many members of the cell have them.

    In any one order of all shingles, two linked sets share one that is left of
    either without its last ceil(percent * len / 100) - 1. The order puts frequent
    ones last, so members tied by a passage that many have, but by no rarer
    shingle, part; those without a partner drop out. Shingles that one member
    alone has come first and tie nothing, so they end where they are counted:
    back to their sets go those that several have, with their number, however
    few. Each shingle is shuffled once, KEY_BYTES of it, and no text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, "text", COMBINED_BYTES):
                ids, cells = (b.column(k).to_numpy() for k in (0, 2))
                sets = [s for part in ta.slices(b, "text") for s in shingle_sets(ta.column(part, "text"), n)]
                size = np.array([len(s) for s in sets])
                p = ta.mix(np.concatenate(sets) + np.repeat(ta.mix(cells.view(np.uint64)), size))
                bucket = (p % np.uint64(buckets)).astype(np.int64)
                cols = _packed(bucket, np.repeat(ids, size), [np.repeat(size, size).astype(np.int32)], [_short(p // np.uint64(buckets))])
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "ids", "many", "sizes", "keys"])

    def count(rows: pa.Table) -> pa.Table:
        of = rows.column("bucket")[0].as_py()
        i, size = _unpacked(rows, "ids", "sizes")
        key = _long(b"".join(rows.column("keys").to_pylist()))
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
        times = np.diff(np.append(new, len(key)))
        times = np.repeat(times, times)
        shared = order[times > 1]
        times = np.minimum(times[times > 1], 65535).astype("<u2")  # an order, in which few are as frequent
        back = (ta.mix(i[shared].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        cols = _packed(back, i[shared], [size[shared]], [_short(key[shared]), times.view(np.uint8).reshape(-1, 2)])
        ta.release()
        return pa.table([*cols, pa.array(np.full(len(cols[0]), of))], ["back", "ids", "many", "sizes", "keys", "times", "bucket"])

    def choose(rows: pa.Table) -> pa.Table:
        i, size = _unpacked(rows, "ids", "sizes")
        keys = rows.column("keys").to_pylist()
        of = np.repeat(rows.column("bucket").to_numpy().astype(np.uint64), [len(k) // KEY_BYTES for k in keys])
        key = _long(b"".join(keys)) * np.uint64(buckets) + of
        order = np.lexsort((key, np.frombuffer(b"".join(rows.column("times").to_pylist()), "<u2"), i))
        i, key, size = i[order], key[order], size[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        there = np.diff(np.append(first, len(i)))
        # of several sets under one id the least says how many go
        left = there + 1 - -(-percent * np.minimum.reduceat(size, first).astype(np.int64) // 100)
        keep = np.arange(len(i)) - np.repeat(first, there) < np.repeat(left, there)
        cols = _combined(key[keep], i[keep], buckets)
        ta.release()
        return pa.table(cols, _RUNS)

    counted = members.select("id", "text", "cell").mapInArrow(ta.lean(cut), "bucket long, ids array<long>, many array<int>, sizes array<int>, keys binary")
    shared = counted.groupBy("bucket").applyInArrow(count, "back long, ids array<long>, many array<int>, sizes array<int>, keys binary, times binary, bucket long")
    rare = shared.groupBy("back").applyInArrow(choose, _RUNS_SCHEMA)
    return components(_meet(rare), contracted=True).withColumnRenamed("component", "cell")


class SignatureTree:
    """Nodes over sets in order of size: bitmaps' OR and AND, and the size range; leaves are sets."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.sets, self.order = sets, order
        leaf = np.zeros((len(order), bits // 8), np.uint8)
        for r, i in enumerate(order):
            at = (sets[i] >> np.uint64(7)) % np.uint64(bits)
            leaf[r] = np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(bool))
        size = np.array([len(sets[i]) for i in order])
        self.levels = [(leaf.view(np.uint64), leaf.view(np.uint64), size, size)]
        while len(self.levels[-1][2]) > 1:
            any_, all_, low, high = self.levels[-1]
            first = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(any_, first), np.bitwise_and.reduceat(all_, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def may_link(a, i: np.ndarray, b, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set below node i of a and some set below node j of b can reach the threshold.

    A bit that all sets of one node have and no set of the other has stands for
    a shingle outside the overlap, in each set of the one.
    """
    low_a, high_a, low_b, high_b = a[2][i], a[3][i], b[2][j], b[3][j]
    lost_a, lost_b = popcount(a[1][i] & ~b[0][j]), popcount(b[1][j] & ~a[0][i])
    over = np.minimum(high_a - lost_a, high_b - lost_b)
    # the union is at least either set, and both less the overlap
    union = np.maximum(np.maximum(low_a, low_b), low_a + low_b - over)
    return 100 * over >= percent * np.maximum(union, 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Groups:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def _bits(sets: list[np.ndarray]) -> int:
    largest = max(map(len, sets), default=1)
    return min(1 << 14, max(256, 1 << (4 * largest - 1).bit_length()))


#: Roots are dealt again while this share of them was joined; what then is left apart is compared exactly.
SHRINK = 0.2
#: Pairs of nodes looked at together.
WAVE = 1 << 12


def tree_join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, groups: Groups, percent: int) -> list[tuple[int, int]]:
    """Links between rows of left and right (None: inside left) that join groups, by walking the two trees together.

    Node pairs wait on a stack, so what is held is bounded by depth times a wave.
    """
    bits = _bits(sets)
    size = np.array([len(s) for s in sets])
    # near-copies stand side by side: by size, then by the least shingle
    least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    arrange = lambda rows: rows[np.lexsort((least[rows], size[rows]))]
    a = SignatureTree(sets, arrange(left), bits)
    b = a if right is None else SignatureTree(sets, arrange(right), bits)
    found = []
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    stack = [(la, np.zeros(1, np.int64), lb, np.zeros(1, np.int64))]
    while stack:
        la, i, lb, j = stack.pop()
        if len(i) > WAVE:
            stack.append((la, i[WAVE:], lb, j[WAVE:]))
            i, j = i[:WAVE], j[:WAVE]
        ok = may_link(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            for x, y in zip(a.order[i].tolist(), b.order[j].tolist(), strict=True):
                gx, gy = groups.find(x), groups.find(y)
                if gx != gy and linked(sets[x], sets[y], percent):
                    groups.join(gx, gy)
                    found.append((x, y))
            continue
        if la >= lb:
            i, j = np.repeat(i * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(i)), np.repeat(j, FANOUT)
            ok = i < len(a.levels[la - 1][2])
            la, i, j = la - 1, i[ok], j[ok]
        if lb > la:
            i, j = np.repeat(i, FANOUT), np.repeat(j * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(j))
            ok = j < len(b.levels[lb - 1][2])
            lb, i, j = lb - 1, i[ok], j[ok]
        if a is b and la == lb:  # each pair once
            ok = i < j if la == 0 else i <= j
            i, j = i[ok], j[ok]
        if len(i):
            stack.append((la, i, lb, j))
    return found


def _sets_of(texts: pd.Series, n: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for b in ta.slices(batch, "text"):
        out += shingle_sets(ta.column(b, "text"), n)
    return out


def _join_blocks(place: DataFrame, texts: DataFrame, n: int, percent: int, inside: bool = True) -> DataFrame:
    """Links (a, b) inside each block of place (id, block, label, side), between different labels; texts (id, text).

    side 0: against all of the block, or without ``inside`` against side 1 alone; side 1: only against side 0.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["side", "id"], kind="stable").reset_index(drop=True)
        sets = _sets_of(block["text"], n)
        groups = Groups(len(block))
        for rows in block.groupby("label").indices.values():
            for k in rows[1:]:
                groups.join(groups.find(int(rows[0])), groups.find(int(k)))
        one, two = np.flatnonzero(block["side"] == 0), np.flatnonzero(block["side"] == 1)
        links = tree_join(sets, one, None, groups, percent) if inside else []
        if len(one) and len(two):
            links += tree_join(sets, one, two, groups, percent)
        ids = block["id"].tolist()
        del block, sets
        ta.release()
        return pd.DataFrame({"a": pd.Series([ids[x] for x, _ in links], dtype="int64"), "b": pd.Series([ids[y] for _, y in links], dtype="int64")})

    return texts.join(sent(settle(place)), "id").groupBy("block").applyInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, cell_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Two documents link when 100 * |x & y| >= percent * |x | y| over their n-word
    shingle sets; component_id is the least doc_id that links lead to. A null or
    empty text, or one without words, has no shingles and links with nothing.
    Rows with one doc_id twice are one document for links, and stay two rows.
    A null doc_id stays a row with its n_shingles and a null component_id.
    ``cell_shingles`` bounds what a task holds; a longer document is alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.withColumnRenamed("doc_id", "id")
    seen = settle(scan(docs, n))
    # equal sets are one node, under their least doc_id
    own = seen.where("n_shingles > 0 and doc_id is not null")
    nodes = own.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"))
    by_set = settle(own.join(nodes, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "id").distinct())
    nodes = by_set.select("id", "n_shingles").distinct()
    # documents that stand for no set of their own need no pieces
    copies = settle(by_set.select(F.col("doc_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti"))
    buckets = lambda sized: 1 + (sized.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_SHINGLES
    near = components(shared_pieces(texts.join(sent(copies), "id", "left_anti"), n, percent, buckets(nodes)), contracted=True).withColumnRenamed("component", "cell")
    members = settle(nodes.join(near, "id"))
    del near
    free_shuffles(docs.sparkSession)
    # the text of each member, once; a doc_id with several texts has several nodes
    texts = texts.join(sent(settle(members.select("id").distinct())), "id", "left_semi")
    again = sent(settle(seen.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))))  # only these can come twice with one text
    texts = stored(texts.join(again, "id", "left_anti").union(texts.join(again, "id", "left_semi").dropDuplicates(["id", "text"])))
    cells = _sized(members, percent, cell_shingles)
    if cells.where("k > 1").limit(1).count():
        split = cells.where("k > 1")
        large = texts.join(sent(settle(split.select("cell", "id").distinct())), "id")
        parted = split_cells(large, n, percent, buckets(split))
        parted = split.select("id", "n_shingles").join(parted, "id").union(cells.where("k = 1").select("id", "n_shingles", "cell"))
        cells = _sized(parted, percent, cell_shingles)
        del large, parted, split
        free_shuffles(docs.sparkSession)
    # a cell of several blocks is dealt by size class, and a class by hash
    part = F.when(F.col("k") > 1, F.col("cls") * CLASS_STEP + F.pmod(F.xxhash64("id", F.lit(1)), "kc")).otherwise(F.lit(0))
    cells = settle(cells.withColumn("part", part))
    place = cells.select("id", F.struct("cell", "part").alias("block"), F.col("id").alias("label"), F.lit(0).alias("side")).distinct()
    links = settle(_join_blocks(place, texts, n, percent))
    free_shuffles(docs.sparkSession)
    if cells.where("k > 1").limit(1).count():
        links = _join_large_cells(cells.where("k > 1"), texts, links, n, percent, cell_shingles)
    # a doc_id may carry several sets: all of them are one document
    twice = by_set.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    whole = components(links.union(twice))
    out = seen.select("doc_id", "n_shingles").join(whole, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sized(members: DataFrame, percent: int, cell_shingles: int) -> DataFrame:
    """Members (id, n_shingles, cell) of cells of two or more, with the blocks that their cell (k) and their size class in it (kc) needs."""
    members = members.withColumn("cls", _sql_class("n_shingles", percent))
    many = lambda: F.ceil(F.sum("n_shingles") / cell_shingles).cast("int")
    size = members.groupBy("cell").agg(many().alias("k"), F.count_distinct("id").alias("members")).where("members > 1").drop("members")
    of_class = members.groupBy("cell", "cls").agg(many().alias("kc"))
    return settle(members.join(size, "cell").join(of_class, ["cell", "cls"]))


def _labelled(place: DataFrame, links: DataFrame) -> DataFrame:
    return place.join(components(links), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


#: A block's number is its size class times this, and its place among the blocks of that class.
CLASS_STEP = 1 << 32


def _sql_class(size: str, percent: int):
    """size_class of a column."""
    return F.floor(F.log(F.col(size)) / math.log(100 / percent) + 1e-9)


def _join_large_cells(cells: DataFrame, texts: DataFrame, links: DataFrame, n: int, percent: int, cell_shingles: int) -> DataFrame:
    """Links across the blocks of cells that have several. Only ids, labels and blocks are kept; texts come in where sets are compared."""
    cells = cells.select("id", "n_shingles", "cell", "cls", "kc", "part")
    block = F.struct("cell", "part").alias("block")
    # roots of what is linked in a class of several blocks, dealt again, until they fit one block or few of them still join
    for salt in range(2, 40):
        roots = _labelled(cells.where("kc > 1"), links).where("id = label")
        k = roots.groupBy("cell", "cls").agg(F.ceil(F.sum("n_shingles") / cell_shingles).cast("int").alias("kk"))
        dealt = F.col("cls") * CLASS_STEP + F.pmod(F.xxhash64("id", F.lit(salt)), "kk")
        roots = settle(roots.join(k, ["cell", "cls"]).withColumn("part", dealt))
        if not roots.limit(1).count():
            break
        new = settle(_join_blocks(roots.select("id", block, "label", F.lit(0).alias("side")).distinct(), texts, n, percent))
        links = links.union(new)
        if not roots.where("kk > 1").limit(1).count() or new.count() < SHRINK * roots.count():
            break
    now = settle(_labelled(cells, links).select("cell", "part", "id", "label").distinct())
    most = now.groupBy("cell", "label").agg(F.count("*").alias("c")).groupBy("cell").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    now = settle(now.join(most, "cell").withColumn("odd", F.col("label") != F.col("main")).drop("main"))
    # members outside a cell's largest group meet the blocks whose sizes may link; two of them in the later block alone
    there = now.groupBy("cell", "part").agg(F.bool_or("odd").alias("has_odd"), F.bool_or(~F.col("odd")).alias("has_main"))
    mine = there.where("has_odd").select("cell", F.col("part").alias("mine"))
    near = F.abs(F.shiftright("part", 32) - F.shiftright("mine", 32)) <= 1
    met = there.join(mine, "cell").where(near & (F.col("part") != F.col("mine")))
    met = met.withColumn("all", F.col("has_odd") & (F.col("part") > F.col("mine"))).where("all or has_main")
    met = settle(met.select("cell", "part", "mine", "all", F.struct("cell", "part", "mine").alias("block")))
    one = now.where("odd").withColumnRenamed("part", "mine").join(met, ["cell", "mine"]).select("id", "block", "label", F.lit(0).alias("side"))
    two = now.join(met, ["cell", "part"]).where("all or not odd").select("id", "block", "label", F.lit(1).alias("side"))
    return settle(links.union(_join_blocks(one.unionByName(two), texts, n, percent, inside=False)))
