"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

A gene is a whole bin. Crossover puts well-filled bins of one parent into
the other, takes out the bins that hold any of their pieces, and best-fits
what those held besides. Pieces are dealt into shards of a few thousand; each
shard is solved on several islands, a task each, and after each epoch an
island's best packing migrates to the next island. A shard at its lower bound
rests. Shards are independent, so work grows with the pieces alone.

A document of any length is cut in the task that reads it; null texts are the end
id alone, and an empty table packs into nothing.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textarrays as ta
from .shared import sent, settle
from .tokenfiles import END_ID, with_end


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text), each document's ids with the end id behind.

    A document above capacity is cut into pieces of capacity; the first takes the
    rest. A null text is an empty one: a piece of the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer)
        for whole in batches:
            for b in ta.slices(whole, "text"):
                ids, at = with_end(*enc.ids(ta.column(b, "text")), end_id)
                size = np.diff(at)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                rest = size - (many - 1) * capacity
                start = np.where(piece > 0, rest[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, rest[row])
                first = at[row] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist(), strict=True)]
                out = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:  # the pieces lie on end
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(run), kinds)


class Bins:
    """Bins by the room they have left; best fit is the least room that holds the piece."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.bins, self.mask = capacity, {}, [], 0

    def add(self, items: list[int], room: int) -> None:
        self._file(len(self.bins), room)
        self.bins.append(items)

    def _file(self, k: int, room: int) -> None:
        self.rooms.setdefault(room, []).append(k)
        self.mask |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        left = self.mask >> size
        if not left:
            self.add([item], self.capacity - size)
            return
        room = size + (left & -left).bit_length() - 1
        at = self.rooms[room]
        k = at.pop()
        if not at:
            self.mask ^= 1 << room
        self.bins[k].append(item)
        self._file(k, room - size)


def fill(bins: list[list[int]], size: list[int]) -> float:
    """Sum of squared fills: of packings with as many bins, the less even one leaves more usable room."""
    return sum(sum(map(size.__getitem__, b)) ** 2 for b in bins)


def descending(size: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    order = sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rng.random()))
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, size[i])
    return bins.bins


def crossover(one: list[list[int]], two: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of one with some of the well-filled bins of two."""
    full = [b for b in two if sum(map(size.__getitem__, b)) >= 0.995 * capacity]
    taken = rng.sample(full, len(full) // 2) if full else []
    inside = {i for b in taken for i in b}
    child, displaced = Bins(capacity), []
    for b in taken:
        child.add(b[:], capacity - sum(map(size.__getitem__, b)))
    for b in one:
        if inside.isdisjoint(b):
            child.add(b[:], capacity - sum(map(size.__getitem__, b)))
        else:
            displaced += [i for i in b if i not in inside]
    for i in sorted(displaced, key=lambda i: -size[i]):
        child.best_fit(i, size[i])
    return child.bins


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Without its emptiest bins and a few others, whose pieces are best-fitted anew."""
    order = sorted(range(len(bins)), key=lambda k: sum(map(size.__getitem__, bins[k])))
    gone = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 20)))
    out = Bins(capacity)
    for k, b in enumerate(bins):
        if k not in gone:
            out.add(b[:], capacity - sum(map(size.__getitem__, b)))
    for i in sorted((i for k in gone for i in bins[k]), key=lambda i: -size[i] * (1 + 0.05 * rng.random())):
        out.best_fit(i, size[i])
    return out.bins


def evolve(size: list[int], capacity: int, elites: list[list[list[int]]], seed: int, generations: int, population: int = 6) -> list[list[int]]:
    """The best packing an island finds from the elites it is given."""
    rng = random.Random(seed)
    bound = math.ceil(sum(size) / capacity)
    rank = lambda b: (len(b), -fill(b, size))
    pool = [*elites, descending(size, capacity, rng, 0.0 if not elites and seed % 8 == 0 else 0.1)]
    if min(map(len, pool)) <= bound:
        return min(pool, key=rank)
    while len(pool) < population:
        pool.append(descending(size, capacity, rng, 0.3 * rng.random()))
    for _ in range(generations):
        pool.sort(key=rank)
        if len(pool[0]) <= bound:
            break
        one, two = rng.sample(pool[: max(2, population // 2)], 2)
        child = crossover(one, two, size, capacity, rng)
        pool[-1] = mutate(child, size, capacity, rng) if rng.random() < 0.5 else child
    return min(pool, key=rank)


def _bins_of(assignment: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(assignment):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _assigned(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _epoch(capacity: int, epoch: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for shard, island, sizes, elites in f[["shard", "island", "sizes", "elites"]].itertuples(index=False):
                size = [int(x) for x in sizes]
                given = [_bins_of(list(map(int, e))) for e in elites] if elites is not None else []
                best = evolve(size, capacity, given, (shard * 8 + island) * 100 + epoch * 8 if epoch else shard * 8 + island, generations)
                rows.append((shard, island, len(best), _assigned(best, len(size))))
            yield pd.DataFrame(rows, columns=["shard", "island", "bins", "assignment"])

    return run


def place(pieces: DataFrame, capacity: int = 1024, shard_pieces: int = 4000, islands: int = 3, epochs: int = 2, generations: int = 12, number: str | None = None) -> DataFrame:
    """Every row of pieces with sequence_id and offset. pieces has length and should be settled; other columns are carried along.

    ``number`` names a column of different numbers, which is left out of the result; a table
    that was stored with one may be read back in any order. Without it rows go by their place.

    Pieces of full length are sequences of their own, with negative numbers, and
    are neither grouped nor shuffled; of the others numbers and lengths are dealt
    out, and the rows themselves meet their places in one join. Repeated rows,
    ties and null ids go by their place in the table, so they spread over the
    shards. Columns named sequence_id or offset are replaced.
    """
    row = number or "row"
    while not number and row in pieces.columns:
        row += "_"
    pieces = pieces.drop("sequence_id", "offset")
    pieces = pieces if number else pieces.withColumn(row, F.monotonically_increasing_id())
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col(row)).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    shards = max(1, -(-n // shard_pieces))
    of = F.array_sort(F.collect_list(F.struct("length", F.col(row).alias("row"))))
    dealt = settle(short.groupBy(F.pmod(F.xxhash64(row), F.lit(shards)).alias("shard")).agg(of.alias("of")))
    sizes = dealt.select("shard", F.col("of.length").alias("sizes"))
    state = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes").withColumn("elites", F.lit(None).cast("array<array<int>>"))
    kinds = "shard long, island int, bins int, assignment array<int>"
    # an island is a task's work of some tenths of a second; few enough of them get a task each
    tasks = min(shards * islands, max(256, shards * islands // 16))
    for epoch in range(epochs):
        found = settle(state.repartition(tasks, "shard", "island").mapInPandas(_epoch(capacity, epoch, generations), kinds))
        if epoch + 1 < epochs:
            own = found.select("shard", "island", F.col("assignment").alias("e"))
            migrant = found.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("assignment").alias("e"))
            elites = own.union(migrant).groupBy("shard", "island").agg(F.collect_list("e").alias("elites"))
            state = sizes.join(elites, "shard")
    best = found.groupBy("shard").agg(F.min_by("assignment", F.struct("bins", "island")).alias("assignment"))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, rows, lengths, assignment in f[["shard", "rows", "lengths", "assignment"]].itertuples(index=False):
                used: dict[int, int] = {}
                offset = []
                for s, x in zip(map(int, assignment), map(int, lengths), strict=True):
                    offset.append(used.get(s, 0))
                    used[s] = offset[-1] + x
                yield pd.DataFrame({row: rows, "sequence_id": (int(shard) << 32) + np.asarray(assignment, np.int64), "offset": np.array(offset, np.int64)})

    both = dealt.select("shard", F.col("of.row").alias("rows"), F.col("of.length").alias("lengths")).join(best, "shard")
    places = settle(both.mapInPandas(lay, f"{row} long, sequence_id long, offset long"))
    return short.join(sent(places), row).unionByName(full).drop(row)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the sequences themselves, of placed pieces with ids."""
    row = F.struct("offset", "doc_id", "piece", "length", "ids")
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    spans = F.transform("r", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"]))
    return got.select("sequence_id", F.flatten("r.ids").alias("ids"), spans.alias("documents"))
