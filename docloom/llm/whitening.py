"""Whitened embeddings: projected on the principal components of all different vectors, each to variance one.

An entry c becomes the integer x = floor(256 * c). The different x vectors are
the fit list, n of them, with sums S; y = n * x - S is a centred vector without
rounding. Sums of products of y's are exact: every task slices y into limbs of
LIMB bits, multiplies limbs as float64 matrices whose sums stay below 2^53, and
recombines the products as big integers; these travel as digits of 32 bits that
Spark sums. Only the d x d sums of a dimension reach the driver, whatever the
number of rows, and are decomposed there; rows are projected where they lie.

Rows whose vector is null or has a null or non-finite entry are left out. Vectors
of each length are a space of their own, with a fit of their own. An entry beyond
a long's range is the range's end. Repeated rows and equal vectors are fitted
once and each returned; null ids stay. A component without variance projects to
0. and is left out of ``identity_error``. ``deviation`` is null where it passes a
long. Empty vectors and empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import stored

LIMB = 20
#: Rows of one product: 2^20 * 2^20 * 2^13 = 2^53.
BLOCK = 1 << 13
#: Digits of 32 bits that a sum of products travels in; the last has the sign.
DIGITS = 8
_MASK = (1 << 32) - 1


def quantised(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(*keep, x array<long>) of the rows with a vector of finite entries."""
    v = F.col(vector)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(v.isNotNull()).where(~odd)
    return kept.select(*keep, F.transform(v, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("x"))


def _blocks(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and int64 matrix of each length of vectors, BLOCK rows at a time."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offs)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        for k in range(0, len(rows), BLOCK):
            at = rows[k : k + BLOCK]
            yield d, at, flat[offs[at][:, None] + np.arange(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: int64 where all of it fits, else Python integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def gram(y: np.ndarray) -> np.ndarray:
    """Y'Y of up to BLOCK rows of integers, exactly, as Python integers."""
    limbs, rest = [], y
    while True:
        if np.all((rest >= -(1 << LIMB)) & (rest < (1 << LIMB))):
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[i:], i):
            p = (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
            out += p if i == j else p + p.T
    return out


def _digits(total: np.ndarray) -> list[np.ndarray]:
    flat = total.ravel()
    return [np.array([(v >> (32 * k)) & _MASK if k < DIGITS - 1 else v >> (32 * k) for v in flat], np.int64) for k in range(DIGITS)]


def _whole(row, names: list[str]) -> int:
    return sum(int(row[c]) << (32 * k) for k, c in enumerate(names))


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and S by length; sums are taken as Decimals."""
    each = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).orderBy("d", "i").toLocalIterator():
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def products_of(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The sum of y y' over the fit list, by length, as Python integers."""
    names = [f"g{k}" for k in range(DIGITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _blocks(b, "x"):
                g = gram(centred(x, *sums[d]))
                total[d] = total[d] + g if d in total else g
        for d, g in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, _digits(g[i, j]))], ["d", "i", "j", *names])

    parts = fit.mapInArrow(ta.lean(run), "d int, i int, j int, " + ", ".join(f"{c} long" for c in names))
    out: dict[int, np.ndarray] = {d: np.zeros((d, d), object) for d in sums}
    for r in parts.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in names)).toLocalIterator():
        out[r["d"]][r["i"], r["j"]] = out[r["d"]][r["j"], r["i"]] = _whole(r, names)
    return out


def components(g: np.ndarray, n: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) of g / n^3, their eigenvalues and shares of the trace; each vector's largest entry is positive."""
    from fractions import Fraction

    v = np.array([[float(Fraction(int(e), n**3)) for e in row] for row in g], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    trace = float(Fraction(int(sum(g.diagonal())), n**3))
    flat = e <= max(e[0], 0) * len(v) * np.finfo(float).eps
    e = np.where(flat, 0.0, e)
    return u, e, e / trace if trace else np.zeros(len(e))


class Fit:
    """What projects vectors, by their length."""

    def __init__(self, vectors: DataFrame, top: int):
        self.top = top
        fit = stored(vectors.select("x").distinct())
        self.sums = sums_of(fit)
        products = products_of(fit, self.sums)
        self.parts = {d: components(products[d], n, top) for d, (n, _) in self.sums.items()}
        self.error = self._identity_error(fit)

    def whiten(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred integers and whitened coordinates of rows of length d."""
        n, sums = self.sums[d]
        u, e, _ = self.parts[d]
        y = centred(x, n, sums)
        scale = np.divide(1.0, np.sqrt(e), out=np.zeros(len(e)), where=e > 0)
        return y, (y.astype(np.float64) / n) @ (u * scale)

    def _identity_error(self, fit: DataFrame) -> dict[int, float]:
        """The largest entry of the fit list's whitened covariance minus the identity, by length."""
        names = [f"w{k}" for k in range(self.top)]
        whiten = self.whiten

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, _, x in _blocks(b, "x"):
                    w = whiten(d, x)[1]
                    cols = [pa.array(w[:, k]) if k < w.shape[1] else pa.nulls(len(w), pa.float64()) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), d), pa.int32()), *cols], ["d", *names])

        self.error: dict[int, float] = {}
        both = [(i, j) for i in range(self.top) for j in range(i, self.top)]
        rows = fit.mapInArrow(run, "d int, " + ", ".join(f"{c} double" for c in names))
        out: dict[int, float] = {}
        for r in rows.groupBy("d").agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in both)).toLocalIterator():
            live = self.parts[r["d"]][1] > 0
            out[r["d"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in both if j < len(live) and live[i] and live[j]), default=0.0)
        return out


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): the first ``top`` components of each row that has a vector of finite entries."""
    vectors = quantised(rows, vector, F.col(key).cast("long").alias("key"))
    fit = Fit(vectors, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("key"))
            for d, at, x in _blocks(b, "x"):
                y, w = fit.whiten(d, x)
                n, k = fit.sums[d][0], w.shape[1]
                wide = y if y.dtype == object or not y.size or float(np.abs(y).max()) ** 2 * d < 2**62 else y.astype(object)
                square = (wide * wide).sum(1)
                deviation = pa.array([int(s) if s < 1 << 63 else None for s in square], pa.int64())
                again = np.repeat(np.arange(len(at)), k)
                cols = [ids.take(pa.array(at[again])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(again), n), pa.int64()), deviation.take(pa.array(again)), pa.array(w.ravel())]
                cols += [pa.array(np.tile(fit.parts[d][2], len(at))), pa.array(np.full(len(again), fit.error[d]))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return vectors.mapInArrow(ta.lean(run), f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
