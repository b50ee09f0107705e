"""Embedding whitening with eigenvectors found by spectrum slicing.

Vectors become whole numbers, floor(scale * c). The fit list holds each distinct one once. Its
sums are exact; the covariance is summed from vectors centred at the rounded mean, whose
products are whole numbers and thus exact in doubles in any order, and the rest of the mean is
taken off at the end. Only sums leave the tasks: as many numbers as a covariance has.

Slicing: an LDL^T factorization of the covariance minus a shift has as many positive pivots as
there are eigenvalues above the shift. Bisection on that count encloses each leading eigenvalue
alone; from there Rayleigh quotient iteration converges cubically, and counts just above and
just below its result certify that it is the eigenvalue of that number. Eigenvalues closer than
rounding share an interval, and their vectors are kept orthogonal to each other.

Defined cases: rows whose vector is null, or holds a null, a NaN, an infinity or an entry whose
scaled value is beyond 2^53, are dropped. Vectors of each length are a space of their own. Rows
without an id stay, as do repeated rows; both count once in the fit list like others. Components
whose eigenvalue is no more than rounding are not given, so a space of one distinct vector gives
no rows, and neither does an empty table. A deviation beyond a long is null. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.shared import stored

SCALE = 256
COMPONENTS = 4
_EPS = np.finfo(float).eps
_PIVOT = (1 + 17 ** 0.5) / 8
_LONG = 1 << 63
#: Vectors that are multiplied with the components at once.
_ROWS = 256


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Usable rows as (key, x), x of longs."""
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 53) / scale))
    return table.filter(F.col(vector).isNotNull() & usable).select(
        F.col(id_column).alias("key"), F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"),
    )


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed the shift: positive pivots of LDL^T.

    Pivots are single entries or blocks of two, chosen so that the factors do not grow; a block
    is taken only where it has one eigenvalue of each sign.
    """
    m = matrix - shift * np.eye(len(matrix))
    count = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while len(m):
        size = 1
        if len(m) > 1:
            r = 1 + int(np.abs(m[1:, 0]).argmax())
            most, own = abs(m[r, 0]), abs(m[0, 0])
            if most == 0 and own == 0:
                m = m[1:, 1:]
                continue
            if own < _PIVOT * most:
                others = np.abs(m[r])
                others[r] = 0
                reach = others.max()
                if own * reach < _PIVOT * most * most:
                    if abs(m[r, r]) >= _PIVOT * reach:
                        swap(0, r)
                    else:
                        swap(1, r)
                        size = 2
        pivot, side = m[:size, :size], m[size:, :size]
        count += 1 if size == 2 else int(pivot[0, 0] > 0)
        if size == 2:
            m = m[2:, 2:] - side @ np.linalg.solve(pivot, side.T)
        else:
            m = m[1:, 1:] - np.outer(side / pivot[0, 0], side) if pivot[0, 0] else m[1:, 1:]
    return count


def _iterated(matrix: np.ndarray, start: float, found: list[np.ndarray], seed: int, norm: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from a shift, orthogonal to the vectors found before."""
    def project(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in found:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    v = project(np.random.default_rng(seed).standard_normal(len(matrix)))
    shift, best, value = start, np.inf, start
    out = v
    for step in range(40):
        try:
            solved = np.linalg.solve(matrix - shift * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(matrix - (shift + _EPS * norm) * np.eye(len(matrix)), v)
        if not np.isfinite(solved).all():
            break
        v = project(solved)
        rho = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - rho * v))
        if rest < best:
            best, value, out = rest, rho, v
        elif step > 3:
            break
        shift = start if step < 1 else rho
    return value, out


def leading(matrix: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The greatest eigenvalues above rounding, falling, with unit eigenvectors."""
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    least = _EPS * size * norm
    out: list[tuple[float, np.ndarray]] = []
    for j in range(1, count + 1):
        if above(matrix, least) < j:
            break
        low, high = least, norm * (1 + 4 * _EPS)
        n_low, n_high = above(matrix, low), 0
        near = 8 * _EPS * norm
        while True:
            alone = n_low == j and n_high == j - 1
            if alone or high - low <= near:
                value, v = _iterated(matrix, (low + high) / 2, [u for _, u in out], j, norm)
                slack = max(near, _EPS * size * norm)
                certified = above(matrix, value + slack) < j <= above(matrix, value - slack)
                if certified or high - low <= near:
                    out.append((value, v))
                    break
            middle = (low + high) / 2
            n = above(matrix, middle)
            if n >= j:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
    return out


@dataclass
class Space:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One row a vector, one column a component; each row by itself, whatever it is batched with."""
        mean = np.array([s / self.n for s in self.sums])
        out = np.empty((len(x), len(self.values)))
        for low in range(0, len(x), _ROWS):
            out[low : low + _ROWS] = ((x[low : low + _ROWS] - mean)[:, None, :] * self.vectors[None]).sum(axis=2)
        return out / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null beyond a long."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach * reach * max(x.shape[1], 1) < _LONG else object
        apart = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(d) if d < _LONG else None for d in (apart * apart).sum(axis=1)] if x.shape[1] else [0] * len(x)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(length, row numbers, their vectors, batch) for each length in each batch; vectors are never null."""
    for batch in batches:
        column = batch.column(batch.schema.names.index("x"))
        sizes = np.diff(column.offsets.to_numpy())
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for length in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == length)
            at = (ends[rows] - length)[:, None] + np.arange(length)
            yield length, rows, flat[at].astype(np.int64), batch


def _products(centres: dict[int, np.ndarray]):
    """Sums over a task of z and z z^T, z the vector less its centre: row i of the matrix, and the vector as row -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for length, _, x, _ in _by_length(batches):
            z = (x - centres[length]).astype(float)
            total = held.setdefault(length, np.zeros((length + 1, length)))
            total[:length] += z.T @ z
            total[length] += z.sum(axis=0)
        for length, total in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(length + 1, length, np.int32)), pa.array(np.r_[np.arange(length), -1].astype(np.int32)), pa.array(list(total), pa.list_(pa.float64())),
            ], names=["length", "i", "row"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of the rows of one place; one row a task of the stage before."""
    rows = np.stack([np.asarray(r, float) for r in table.column("row").to_pylist()])
    return pa.table({"length": table.column("length").slice(0, 1), "i": table.column("i").slice(0, 1), "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def _whitened_products(spaces: dict[int, Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for length, _, x, _ in _by_length(batches):
            w = np.column_stack([spaces[length].whitened(x), np.ones(len(x))])
            held[length] = held.get(length, 0) + w.T @ w
        for length, total in held.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, length, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["length", "i", "j", "total"])

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """A space for each length of vector; what comes to the driver are its sums, never vectors."""
    distinct = stored(vectors.select("x").distinct(), "whitening-fit")
    counts = {r["length"]: r["n"] for r in distinct.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).collect()}
    each = distinct.select(F.size("x").alias("length"), F.posexplode("x").alias("i", "value"))
    sums = each.groupBy("length", "i").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s")).orderBy("length", "i").collect()
    totals = {length: [int(r["s"]) for r in sums if r["length"] == length] for length in counts}
    centres = {length: np.array([round(s / counts[length]) for s in total], np.int64) for length, total in totals.items()}

    partial = distinct.mapInArrow(_products(centres), "length int, i int, row array<double>")
    rows = partial.groupBy("length", "i").applyInArrow(_added, "length int, i int, row array<double>").collect()
    spaces: dict[int, Space] = {}
    for length, n in counts.items():
        placed = {r["i"]: np.array(r["row"], float) for r in rows if r["length"] == length}
        matrix = np.array([placed[i] for i in range(length)], float).reshape(length, length)
        rest = placed.get(-1, np.zeros(length))
        covariance = (matrix - np.outer(rest, rest) / n) / n
        found = leading((covariance + covariance.T) / 2, components)
        spaces[length] = Space(n, totals[length], np.array([e for e, _ in found]), np.array([v for _, v in found]).reshape(len(found), length), float(np.trace(covariance)))

    whole = distinct.mapInArrow(_whitened_products(spaces), "length int, i int, j int, total double")
    cells = whole.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect()
    for length, space in spaces.items():
        k = len(space.values)
        total = np.zeros((k + 1, k + 1))
        for cell in cells:
            if cell["length"] == length:
                total[cell["i"], cell["j"]] = cell["total"]
        mean = total[:k, k] / space.n
        space.error = float(np.abs(total[:k, :k] / space.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return spaces


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    vectors = whole_vectors(table, id_column, vector, scale)
    spaces = fit(vectors, components)
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, rows, x, batch in _by_length(batches):
            space = spaces[length]
            k = len(space.values)
            many = np.repeat(np.arange(len(rows)), k)
            deviations = pa.array(space.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.names.index("key")).take(pa.array(rows[many])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(many), space.n)), deviations.take(pa.array(many)), pa.array(space.whitened(x).ravel()),
                pa.array(np.tile(space.values / space.trace, len(rows)) if k else np.zeros(0)), pa.array(np.full(len(many), space.error)),
            ], names=names)

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.mapInArrow(run, f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
