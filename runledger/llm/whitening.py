"""Whitening of integer-valued embeddings with exact, bit-sliced cross-products.

Every entry c becomes the integer x = floor(scale * c). The fit list holds each distinct vector once. For it,
each task cuts its rows into slices, shifts every dimension to start at 0 and packs each bit plane of each
dimension across the rows into 64-bit words. The popcount of two planes' AND, weighted by 2 ** (p + q), sums up
to the exact cross-product of two dimensions. Spark adds the tasks' shares up as limbs of 40 bits, so nothing is
rounded, however many rows there are; the driver gets one number a pair of dimensions, centres them as integers
(n * C - S * S'), and only then divides and calls ``eigh``. Vectors of different lengths are fitted apart.

Defined results: rows whose vector is null, empty or holds null or non-finite entries go; entries whose x is beyond
a 64-bit integer take its end; a deviation beyond a 64-bit integer is null; repeated rows and ids get the same
numbers; null ids are kept; for a component without variance (its eigenvalue below 1e-14 of the trace) whitened is
null, and explained is too when all vectors are the same; identity_error takes in components with variance only; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import columns, stored

SCALE, COMPONENTS = 256, 4
#: Rows of a slice whose planes are packed at once, and bits of a limb.
ROWS, LIMB = 4096, 40
_SHARES = "dim int, line int, limb int, share array<long>"


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers) of each length of the column ``x``, in slices."""
    column = batch.column("x")
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield part, flat[ends[part][:, None] + np.arange(dim)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            low, high = ends.get(x.shape[1], (x[0], x[0]))
            ends[x.shape[1]] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    for dim, (low, high) in ends.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], ["dim", "line", "low", "high"])


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of unsigned integers (rows x dimensions), packed across rows: (dimensions * bits) x words."""
    rows, dim = y.shape
    out = np.zeros((dim, bits, -(-rows // 64) * 8), np.uint8)
    for bit in range(bits):
        out[:, bit, : -(-rows // 8)] = np.packbits(((y >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T, axis=1)
    return out.view(np.uint64).reshape(dim * bits, -1)


def cross_products(y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums, upper triangle of cross-products) of unsigned integers as Python's."""
    dim, sliced = y.shape[1], planes(y, bits)
    kind = np.int64 if 2 * bits + len(y).bit_length() < 63 else object  # what the sums fit in
    weight = np.array([1 << b for b in range(bits)], kind)
    sums = np.bitwise_count(sliced).sum(axis=1, dtype=np.int64).reshape(dim, bits).astype(kind) @ weight
    out = np.zeros((dim, dim), object)
    for d in range(dim):
        own = np.zeros(dim - d, kind)
        for bit in range(bits):
            common = np.bitwise_count(sliced[d * bits + bit] & sliced[d * bits :]).sum(axis=1, dtype=np.int64)
            own = own + (1 << bit) * (common.reshape(dim - d, bits).astype(kind) @ weight)
        out[d, d:] = own
    return sums.astype(object), out


def _scatter(batches: Iterator[pa.RecordBatch], lows: dict[int, np.ndarray], bits: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Shares of the number of rows (line -2), the sums (line -1) and each line of cross-products, in limbs."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            dim = x.shape[1]
            sums, cross = cross_products(x.astype(np.uint64) - lows[dim].astype(np.uint64), bits[dim])  # right modulo 2 ** 64
            n, s, c = totals.get(dim, (0, 0, 0))
            totals[dim] = [n + len(x), s + sums, c + cross]
    for dim, (n, sums, cross) in totals.items():
        lines = [(-2, [n]), (-1, list(sums)), *((d, list(cross[d])) for d in range(dim))]
        rows = []
        for line, values in lines:
            for limb in range(-(-max(int(v).bit_length() for v in values) // LIMB)):
                rows.append((dim, line, limb, [(int(v) >> (LIMB * limb)) & ((1 << LIMB) - 1) for v in values]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["dim", "line", "limb", "share"])


@dataclass
class Model:
    """What a length's whitening needs: rows, integer sums, eigenvalues falling, unit eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    low: np.ndarray
    high: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit integers where these hold it, else as Python's."""
        most = max(abs(self.n * int(v) - s) for end in (self.low, self.high) for v, s in zip(end, self.sums, strict=True))
        largest = max([most, *(abs(s) for s in self.sums), *(abs(self.n * int(v)) for end in (self.low, self.high) for v in end)])
        kind = np.int64 if largest < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        live = self.live
        out = np.full((len(centred), len(self.values)), np.nan)
        with np.errstate(all="ignore"):
            out[:, live] = (centred.astype(float) / self.n) @ self.vectors[:, live] / np.sqrt(self.values[live])
        return out

    @property
    def live(self) -> np.ndarray:
        return np.flatnonzero(self.values > 1e-14 * self.trace)


def _project(batches: Iterator[pa.RecordBatch], models: dict[int, Model], errors: dict[int, float | None]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _matrices(batch):
            model = models[x.shape[1]]
            centred, k = model.centred(x), len(model.values)
            exact = np.abs(centred).max(initial=0)
            squares = centred if int(exact) ** 2 * x.shape[1] < 1 << 63 else centred.astype(object)
            deviation = [int(v) if int(v) < 1 << 63 else None for v in (squares * squares).sum(axis=1)]
            white = model.whitened(centred).reshape(-1)
            explained = np.tile(model.values / model.trace if model.trace else np.full(k, np.nan), len(rows))
            out = [
                pa.array(np.repeat(batch.column("vec_id").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(object), k), pa.int64(), from_pandas=True),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(white), model.n)),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()), pa.array(white, mask=np.isnan(white)), pa.array(explained, mask=np.isnan(explained)),
                pa.array([errors[x.shape[1]]] * len(white), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def _moments(batches: Iterator[pa.RecordBatch], models: dict[int, Model], means: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened values, or of the products of those less their means."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            model = models[x.shape[1]]
            w = model.whitened(model.centred(x))[:, model.live]
            own = w.sum(axis=0) if means is None else ((w - means[x.shape[1]]).T @ (w - means[x.shape[1]])).reshape(-1)
            totals[x.shape[1]] = totals.get(x.shape[1], 0) + own
    for dim, values in totals.items():
        n = len(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)], ["dim", "line", "value"])


def _moment_sums(fit: DataFrame, models: dict[int, Model], means: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
    found = fit.mapInArrow(partial(_moments, models=models, means=means), "dim int, line int, value double")
    out = {dim: np.zeros(len(m.live) if means is None else len(m.live) ** 2) for dim, m in models.items()}
    for r in found.groupBy("dim", "line").agg(F.sum("value").alias("value")).collect():
        out[r["dim"]][r["line"]] = r["value"]
    return out


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of the distinct vectors ``x`` (array<long>) of fit."""
    ends: dict[int, dict[int, tuple[int, int]]] = {}
    for r in fit.mapInArrow(_ranges, "dim int, line int, low long, high long").groupBy("dim", "line").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        ends.setdefault(r["dim"], {})[r["line"]] = r["low"], r["high"]
    lows = {dim: np.array([e[d][0] for d in range(dim)]) for dim, e in ends.items()}
    highs = {dim: np.array([e[d][1] for d in range(dim)]) for dim, e in ends.items()}
    bits = {dim: max(1, max((int(b) - int(a)).bit_length() for a, b in zip(lows[dim], highs[dim], strict=True))) for dim in ends}
    shares = fit.mapInArrow(partial(_scatter, lows=lows, bits=bits), _SHARES).select("dim", "line", "limb", F.posexplode("share").alias("at", "share"))
    exact: dict[tuple[int, int, int], int] = {}
    for r in shares.groupBy("dim", "line", "limb", "at").agg(F.sum("share").alias("share")).toLocalIterator():
        key = r["dim"], r["line"], r["at"]
        exact[key] = exact.get(key, 0) + (r["share"] << (LIMB * r["limb"]))
    models = {}
    for dim in ends:
        n, shifted = exact[dim, -2, 0], [exact.get((dim, -1, d), 0) for d in range(dim)]
        v = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                v[i, j] = v[j, i] = (n * exact.get((dim, i, j), 0) - shifted[i] * shifted[j]) / (n * n)
        trace = sum(n * exact.get((dim, i, i), 0) - shifted[i] ** 2 for i in range(dim)) / (n * n)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        models[dim] = Model(n, [s + n * int(low) for s, low in zip(shifted, lows[dim], strict=True)], np.maximum(values[order], 0), vectors[:, order], trace, lows[dim], highs[dim])
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row of vectors (vec_id,
    embedding), a row for each of the first ``components`` components."""
    own = columns(vectors, vec_id="vec_id", embedding="embedding")
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = stored(own.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x")), "whiten-rows")
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    models = fit_models(fit, components)
    means = {dim: s / models[dim].n for dim, s in _moment_sums(fit, models, None).items()}
    errors: dict[int, float | None] = {}
    for dim, s in _moment_sums(fit, models, means).items():
        live = len(models[dim].live)
        errors[dim] = float(np.abs(s.reshape(live, live) / models[dim].n - np.eye(live)).max()) if live else None
    return rows.mapInArrow(partial(_project, models=models, errors=errors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
