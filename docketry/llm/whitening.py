"""Whitened vectors: spectra kept by rank-one updates and merged, then one distributed Rayleigh-Ritz step."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.codes import finite
from docketry.llm.common import written

SCALE = 64
COMPONENTS = 32
FAN = 8  # spectra that one task merges
OUT_ROWS = 1024  # input rows whose result is made at once
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z ** 2 / (d - x))`` for rising ``d`` and ``z`` without zeros.

    Returns the roots, one above every ``d``, and ``d[j] - root[i]`` without cancellation: each root is sought
    as a distance from the nearer pole, by rational steps inside a shrinking bracket.
    """
    k, z2 = len(d), z * z
    total = z2.sum()
    if k == 1:
        return d + total, np.array([[-total]])
    at = np.arange(k)
    gap = np.append(np.diff(d), total)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        half = 1 + (z2 / (d - (d[:-1] + gap[:-1] / 2)[:, None])).sum(axis=1)
        upper = np.append(half < 0, False)  # the root is nearer to the pole above it
        delta = d - d[at + upper][:, None]
        low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
        high[-1] = total
        one = np.minimum(at, k - 2)  # the two poles of the rational model
        shift = (low + high) / 2
        below = np.tril(np.ones((k, k), bool))
        below[-1, -1] = False
        for _ in range(80):
            t = delta - shift[:, None]
            w = z2 / t
            f = 1 + w.sum(axis=1)
            done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(w).sum(axis=1))
            low, high = np.where(f < 0, shift, low), np.where(f < 0, high, shift)
            done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            w /= t
            slope = w.sum(axis=1)
            slope_low = np.where(below, w, 0).sum(axis=1)
            a1, a2 = t[at, one], t[at, one + 1]
            c = f - a1 * slope_low - a2 * (slope - slope_low)
            a = (a1 + a2) * f - a1 * a2 * slope
            b = a1 * a2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            root[-1] = -root[-1]  # beyond both poles it is the other zero of the model
            step = np.where(np.where(at == k - 1, -a, a) <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = shift + step
            inside = np.isfinite(new) & (new > low) & (new < high)
            shift = np.where(done, shift, np.where(inside, new, (low + high) / 2))
    return d[at + upper] + shift, delta - shift[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of ``basis diag(values) basis' + v v'``.

    Directions that ``v`` hardly touches keep their pair, and of equal eigenvalues all but one are turned away from
    ``v``; the secular equation is solved for the rest. Its weights are then taken anew from the roots (Gu and Eisenstat),
    which keeps the vectors orthogonal.
    """
    z = basis.T @ v
    norm = np.sqrt(z @ z)
    limit = 8 * EPS * max(values[-1], norm * norm)
    if norm == 0:
        return values, basis
    active = np.flatnonzero(np.abs(z) * norm > limit)
    if not len(active):
        return values, basis
    values, basis = values.copy(), basis.copy()
    if (np.diff(values[active]) <= 4 * limit).any():
        kept, last = [], int(active[0])
        for j in active[1:].tolist():
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if abs((values[j] - values[last]) * c * s) <= limit:
                basis[:, [last, j]] = basis[:, [last, j]] @ np.array([[c, s], [-s, c]])
                values[last], values[j] = c * c * values[last] + s * s * values[j], s * s * values[last] + c * c * values[j]
                z[last], z[j] = 0.0, r
            else:
                kept.append(last)
            last = j
        active = np.array([*kept, last])
        order = np.argsort(values[active], kind="stable")
        active = active[order]
    d = values[active]
    roots, apart = secular_roots(d, z[active])
    k = len(d)
    ratio = d[:, None] - d
    np.fill_diagonal(ratio, 1.0)
    ratio = -apart / ratio
    ratio[np.arange(k), np.arange(k)] = -apart[np.arange(k), np.arange(k)]
    weight = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[active])
    turn = weight / apart
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    basis[:, active] = basis[:, active] @ turn.T
    values[active] = roots
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number and sums of some vectors, and the eigenpairs of their scatter about their own mean."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.sums, self.values, self.basis = n, sums, values, basis

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.eye(width))

    def add(self, row: np.ndarray) -> None:
        """One vector more: a rank-one update with its difference from the mean so far."""
        if self.n:
            self._turn((row - self.sums / self.n) * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.sums = self.sums + row

    def merge(self, other: Spectrum) -> None:
        """The vectors of both: an update for the difference of the means and one for every eigenpair of the other."""
        if self.n and other.n:
            self._turn((other.sums / other.n - self.sums / self.n) * np.sqrt(self.n * other.n / (self.n + other.n)))
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self._turn(np.sqrt(value) * vector)
        self.n += other.n
        self.sums = self.sums + other.sums

    def _turn(self, v: np.ndarray) -> None:
        if len(v):
            self.values, self.basis = rank_one(self.values, self.basis, v)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of whole numbers as a matrix; short rows end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def spectra(vectors: DataFrame, width: int) -> DataFrame:
    """``place, n, sums, values, basis``: a spectrum for every task that holds vectors (``vec_id, y``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for batch in batches:
            for row in _rows(batch.column(0), width):
                own.add(row)
        if own.n:
            yield _packed(own)

    return vectors.select("y").mapInArrow(run, "n long, sums array<long>, values array<double>, basis array<double>")


def _packed(own: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([own.n]), *(pa.array([x.reshape(-1).tolist()]) for x in (own.sums, own.values, own.basis))]
    return pa.RecordBatch.from_arrays(columns, ["n", "sums", "values", "basis"])


def merged(states: DataFrame, width: int, fan: int = FAN) -> Spectrum:
    """All spectra as one: rounds in which every task merges ``fan`` of them; the last one's single row comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for r in batch.to_pylist():
                one = Spectrum(r["n"], np.array(r["sums"], np.int64), np.array(r["values"]), np.array(r["basis"]).reshape(width, width))
                if own is None:
                    own = one
                else:
                    own.merge(one)
        if own:
            yield _packed(own)

    states = written(states, "spectra")
    left = states.count()
    while left > 1:
        left = -(-left // fan)
        states = written(states.repartition(left).mapInArrow(run, states.schema), "spectra")
        left = min(left, states.count())
    r = states.first()
    return Spectrum(r.n, np.array(r["sums"], np.int64), np.array(r["values"]), np.array(r.basis).reshape(width, width))


def second_moments(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray, n: int) -> np.ndarray:
    """Mean of ``p p'`` over all vectors, with ``p`` the centred vector times ``turn``; tasks send one triangle each."""
    k = turn.shape[1]
    width = len(mean)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            p = (_rows(batch.column(0), width) - mean) @ turn
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((k, k))
    for r in vectors.select("y").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def whitened(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, fan: int = FAN,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for every vector and component.

    Rows whose vector is null or holds a null, infinite or undefined entry go; of the others every entry becomes
    ``floor(scale * entry)``, and shorter vectors end in zeros. (An offset common to all entries
    changes no column, so none is added.) The fit reads all vectors. Components
    without variance have no whitened value and no rows, so one vector alone, or only equal ones, give none. Repeated rows
    count each, ids may be null or repeated, other columns are ignored. ``deviation`` is a whole number of up to 38
    digits. Only matrices of the vector's width reach the driver.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    whole = F.transform(df[vector_col], lambda c: F.floor(c.cast("double") * scale).cast("long"))
    vectors = df.where(finite(df[vector_col])).select(df[id_col].alias("vec_id"), whole.alias("y"))
    out = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    width = vectors.agg(F.max(F.size("y"))).first()[0] or 0
    if not width:
        return df.sparkSession.createDataFrame([], out)
    fit = merged(spectra(vectors, width), width, fan)
    n, sums, mean = fit.n, fit.sums, fit.sums / fit.n
    basis = np.linalg.qr(fit.basis)[0]
    values, turn = np.linalg.eigh(second_moments(vectors, mean, basis, n))  # Rayleigh-Ritz over the merged spectrum's vectors
    order = np.argsort(-values, kind="stable")
    values, basis = np.maximum(values[order], 0), (basis @ turn)[:, order]
    share = values / values.sum() if values.sum() else values
    k = min(components, int((values > width * EPS * values[0] * 64).sum()))
    if not k:
        return df.sparkSession.createDataFrame([], out)
    to_white = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(second_moments(vectors, mean, to_white, n) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, OUT_ROWS):
                batch = whole_batch.slice(first, OUT_ROWS)
                rows = _rows(batch.column(1), width)
                white = (rows - mean) @ to_white
                apart = n * rows.astype(object) - sums if n * np.abs(rows).max(initial=1) > 1 << 28 else n * rows - sums
                total = (apart * apart).sum(axis=1).tolist()
                at = pa.array(np.repeat(np.arange(len(rows)), k))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n)),
                        pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)).take(at), pa.array(white.reshape(-1)),
                        pa.array(np.tile(share[:k], len(rows))), pa.array(np.full(m, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, out)
