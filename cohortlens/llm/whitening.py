"""Whitening of embeddings by a covariance in two passes.

1. Each entry c, as double, becomes the integer floor(256 * c); a vector becomes the bytes of its
   integers in the narrower of two widths, and these are written once. The fit list holds each
   distinct vector of integers once: copies, however many, meet in partial aggregates.
2. First pass: n and the sums by dimension, exact (tasks sum in 64 bits, Spark sums up tasks' sums
   as decimals). Second pass: tasks add centred outer products by matrix products, treeAggregate
   merges their matrices (d x d doubles each, whatever the size of the table), and the driver
   takes the symmetric eigendecomposition.
3. The projection, d x k doubles, goes to every task. A third pass measures the covariance of the
   whitened fit list against the identity.

Vectors that are null, empty or hold null or non-finite entries are dropped; so are those of
another length than the most frequent one (ties: the shortest), as no projection holds for
both. Entries beyond 2**22 in size count as that much. Ids may be null or repeated: each row gives its
own results. Components with an eigenvalue of no more than 1e-12 of the trace (constant
dimensions, a single vector) have null ``whitened`` and take no part in ``identity_error``, which is
null without any; ``explained`` is null if all vectors are equal. Equal eigenvalues leave their
components free to turn. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, reduced
from cohortlens.llm.vectors import matrices

SCALE = 256
#: Largest size of an integer entry.
LIMIT = 1 << 30
COMPONENTS = 4
#: Share of the trace up to which an eigenvalue counts as none.
NOTHING = 1e-12


def to_integers(m: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(scale * m), -LIMIT, LIMIT).astype(np.int64)


def _encode(x: np.ndarray) -> list[bytes]:
    """The bytes of each row in the narrower of two widths that holds it, so that equal rows have equal bytes."""
    narrow = np.abs(x).max(axis=1) < 1 << 15
    return [v.astype("<i2" if small else "<i4").tobytes() for v, small in zip(x, narrow)]


def _decode(col: pa.Array, d: int) -> np.ndarray:
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)
    out, size = np.empty((len(col), d), dtype=np.int64), np.diff(off)
    for width in (2, 4):
        rows = np.flatnonzero(size == width * d)
        if len(rows):
            out[rows] = np.ascontiguousarray(data[off[rows][:, None] + np.arange(width * d)]).view(f"<i{width}")
    return out


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, d (length) and x (bytes of the integers) of each usable row of ``id, vec``."""
    id_type = rows.schema["id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, m in matrices(batch.column(1)):
                x = pa.array(_encode(to_integers(m, scale)), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), m.shape[1], np.int32)), x], names=["id", "d", "x"])

    return rows.mapInArrow(apply, f"id {id_type}, d int, x binary")


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, the exact sums by dimension) of the fit list."""

    def apply(batches):
        n, total = 0, np.zeros(d, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _decode(batch.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["n", "s"])

    parts = fit.mapInArrow(apply, "n bigint, s array<bigint>").select(F.posexplode(F.concat(F.array("n"), "s")).alias("i", "v"))
    got = {r.i: int(r.v) for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return got.get(0, 0), [got.get(i + 1, 0) for i in range(d)]


def _products(fit: DataFrame, d: int, centre: np.ndarray, project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of outer products, of the centred (and projected) vectors of the fit list."""
    k = d if project is None else project.shape[1]

    def apply(batches):
        out = np.zeros((k + 1, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                y = _decode(batch.column(0).slice(i, 4096), d) - centre
                if project is not None:
                    y = y @ project
                out[:k] += y.T @ y
                out[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["m"])

    add = lambda a, b: a + b
    parts = fit.mapInArrow(apply, "m binary").rdd.map(lambda r: np.frombuffer(r.m).reshape(k + 1, k))
    total = parts.treeAggregate(np.zeros((k + 1, k)), add, add, depth=3)
    return total[k], total[:k]


class Model:
    """n, sums, eigenvalues of all components (falling), projection onto the first ones, and what the third pass measured."""

    def __init__(self, n: int, s: list[int], values: np.ndarray, project: np.ndarray, used: int):
        self.n, self.s, self.values, self.project, self.used = n, s, values, project, used
        self.centre = np.array([v / n for v in s])
        self.identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        trace = float(self.values.sum())
        return [float(v) / trace if trace > 0 else None for v in self.values[: self.project.shape[1]]]


def fit_model(fit: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of a fit list (column x, each vector once); None if it is empty."""
    n, s = sums(fit, d)
    if not n:
        return None
    centre = np.array([v / n for v in s])
    _, outer = _products(fit, d, centre)
    values, vectors = np.linalg.eigh(outer / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(components, d)
    used = int((values[:k] > NOTHING * values.sum()).sum())
    project = np.zeros((d, k))
    project[:, :used] = vectors[:, :used] / np.sqrt(values[:used])
    model = Model(n, s, values, project, used)
    if used:
        total, outer = _products(fit, d, centre, project[:, :used])
        mean = total / n
        model.identity_error = float(np.abs(outer / n - np.outer(mean, mean) - np.eye(used)).max())
    return model


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - s) ** 2 for each row, exact: in 64 bits where that holds it, else in Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(v) for v in s), default=0)
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - np.array(s, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return ((x.astype(object) * n - np.array(s, dtype=object)) ** 2).sum(axis=1).tolist()


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """rows: id, vec. For each usable row and component (from 1): id, component, n, deviation (decimal, exact), whitened, explained, identity_error."""
    rows = reduced(rows, "id", "vec")
    known = materialize(integers(rows, scale), "integers")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = known.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0].d if lengths else 0
    known = known.filter(F.col("d") == d)
    model = fit_model(materialize(known.select("x").distinct(), "fit-list"), d, components) if d else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, explained = model.project.shape[1], model.explained

    def apply(batches):
        for batch in batches:
            m = batch.num_rows
            x = _decode(batch.column(1), d)
            w = (x - model.centre) @ model.project
            w[:, model.used :] = np.nan
            each = np.repeat(np.arange(m), k)
            dev = pa.array([Decimal(v) for v in deviations(x, model.n, model.s)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    dev.take(pa.array(each)),
                    pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return known.select("id", "x").mapInArrow(apply, schema)
