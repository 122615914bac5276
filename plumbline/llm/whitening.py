"""Whitened leading components of integer vectors, by Jacobi-Davidson iterations.

The covariance is never formed. Spark multiplies it with a few directions at a time: every
task centres its vectors, multiplies, and returns one small matrix. The driver holds
directions only, a bounded number of vectors of one row's length.

Rayleigh-Ritz on a growing subspace gives approximate components. For each one that is not
exact yet, the correction equation, projected away from the locked and the current
components, is solved roughly by MINRES; all of them share Spark's passes. The corrections
extend the subspace. Components whose residual is down to rounding are locked, until all
wanted ones are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import prepare, stored

#: Bytes of vectors in one cell of the stored fit list.
CELL_BYTES = 1 << 16
#: Steps of MINRES for one correction, and what it may leave of the residual.
INNER_STEPS = 6
INNER_REST = 0.05
#: Directions of the subspace, as a multiple of the wanted components, before a restart.
SUBSPACE = 10
#: Residuals count as zero below this many rounding errors of the largest eigenvalue.
ROUNDING = 16
OUTER_STEPS = 300
RESTARTS = 4

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """Sums of the fit list, its leading components in columns, and what they explain."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def orthonormal(directions: np.ndarray, against: np.ndarray) -> np.ndarray:
    """``directions`` made orthonormal to ``against`` and each other; dependent ones go."""
    kept: list[np.ndarray] = []
    for column in directions.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        column = column / size
        for _ in range(3):
            basis = np.column_stack([against, *kept]) if kept or against.size else None
            if basis is not None:
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-8:
                break
            column = column / size
        else:
            kept.append(column)
    return np.column_stack(kept) if kept else np.empty((len(directions), 0))


class _Minres:
    """MINRES for (P (A - shift) P) t = -residual, P taking out the directions ``away``.

    The short recurrences, turned inside out: the caller multiplies ``direction`` by A and
    hands the product in, so that many systems share a pass over the data. Of the
    search directions and their images the last two are kept.
    """

    def __init__(self, residual: np.ndarray, away: np.ndarray, shift: float):
        self._away, self._shift = away, shift
        self._left = self._projected(-residual)
        self._size = np.linalg.norm(self._left)
        self._recent: list[tuple[np.ndarray, np.ndarray]] = []
        self.solution = np.zeros_like(residual)
        self.direction = self._left / self._size if self._size > 0 else self._left
        self.over = self._size == 0

    def _projected(self, vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            vector = vector - self._away @ (self._away.T @ vector)
        return vector

    def take(self, product: np.ndarray) -> None:
        """``product`` is A times ``direction``."""
        search = self.direction
        image = self._projected(product - self._shift * search)
        before = np.linalg.norm(image)
        for old_search, old_image in self._recent:
            part = image @ old_image
            search, image = search - part * old_search, image - part * old_image
        size = np.linalg.norm(image)
        if size <= 1e-12 * before or size == 0:
            self.over = True
            return
        search, image = search / size, image / size
        step = self._left @ image
        self.solution = self.solution + step * search
        self._left = self._left - step * image
        self._recent = [(search, image), *self._recent[:1]]
        self.direction = image
        self.over = np.linalg.norm(self._left) <= INNER_REST * self._size


def jacobi_davidson(product: Product, length: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and eigenvectors of a symmetric operator, falling.

    ``product`` applies it to the columns of a matrix; it has no eigenvalue below zero.
    The residuals of what is found are checked with a last product of their own; where
    rounding in the subspace has spoilt one, the search starts again from there. Fails if
    the residuals do not come down to rounding.
    """
    wanted = min(wanted, length)
    chance = np.random.default_rng(0)
    start = np.empty((length, 0))
    for _ in range(RESTARTS):
        more = chance.standard_normal((length, min(length, wanted + 2)))
        vectors = _search(product, length, wanted, np.column_stack([start, more]))
        products = product(vectors)
        small = vectors.T @ products
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        vectors, products = vectors @ turned, products @ turned
        if (np.linalg.norm(products - vectors * values, axis=0) <= 4 * _rounding(values[0], length)).all():
            return values, vectors
        start = vectors
    raise ArithmeticError("the components did not reach double precision")


def _rounding(largest: float, length: int) -> float:
    """Residuals up to this size are rounding."""
    return ROUNDING * np.finfo(float).eps * max(largest, np.finfo(float).tiny) * np.sqrt(length)


def _search(product: Product, length: int, wanted: int, start: np.ndarray) -> np.ndarray:
    """Orthonormal leading eigenvectors by Rayleigh-Ritz, corrections, restarts and locking."""
    limit = min(length, max(SUBSPACE * wanted, wanted + 8))
    locked, values = np.empty((length, 0)), []
    space = orthonormal(start, locked)
    images = product(space)
    for _ in range(OUTER_STEPS):
        small = space.T @ images
        ritz, turned = np.linalg.eigh((small + small.T) / 2)
        ritz, turned = ritz[::-1], turned[:, ::-1]
        missing = wanted - len(values)
        # a Ritz vector beyond the wanted ones may still turn out to be one
        first = turned[:, : min(missing + 1, turned.shape[1])]
        vectors, products = space @ first, images @ first
        top = max([*values, ritz[0], 0.0])
        residuals = products - vectors * ritz[: first.shape[1]]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        whole = space.shape[1] + locked.shape[1] >= length
        done = 0
        while done < min(missing, len(sizes)) and (sizes[done] <= _rounding(top, length) or whole):
            done += 1
        if done:
            # lock them, and go on with what the subspace has besides
            locked = np.column_stack([locked, vectors[:, :done]])
            values += [float(value) for value in ritz[:done]]
            space, images = space @ turned[:, done:], images @ turned[:, done:]
            ritz, vectors, residuals = ritz[done:], vectors[:, done:], residuals[:, done:]
            missing -= done
            if missing == 0:
                break
        if space.shape[1] + residuals.shape[1] > limit:
            keep = min(space.shape[1], max(wanted + 2, limit // 3))
            if not done:
                space, images = space @ turned, images @ turned
            space, images = space[:, :keep], images[:, :keep]
        found = _corrections(product, ritz, vectors, residuals, locked)
        fresh = orthonormal(found, np.column_stack([locked, space]))
        if not fresh.shape[1] or not space.shape[1]:
            # nothing to correct: a new start besides what is known
            more = np.random.default_rng(len(values) + 1).standard_normal((length, wanted + 1))
            fresh = orthonormal(more, np.column_stack([locked, space]))
        if not fresh.shape[1]:
            raise ArithmeticError("the subspace cannot grow, and components are missing")
        space = np.column_stack([space, fresh])
        images = np.column_stack([images, product(fresh)])
    else:
        raise ArithmeticError("the components did not reach double precision")
    return locked


def _corrections(product: Product, ritz, vectors, residuals, locked) -> np.ndarray:
    """Rough solutions of the projected correction equations, all in the same passes."""
    solvers = []
    for i in range(residuals.shape[1]):
        solvers.append(_Minres(residuals[:, i], np.column_stack([locked, vectors]), ritz[i]))
    for _ in range(INNER_STEPS):
        open_ones = [solver for solver in solvers if not solver.over]
        if not open_ones:
            break
        products = product(np.column_stack([solver.direction for solver in open_ones]))
        for solver, column in zip(open_ones, products.T):
            solver.take(column)
    return np.column_stack([solver.solution for solver in solvers])


def integer_vectors(embeddings: DataFrame, embedding: str = "embedding", factor: int = 256) -> Column:
    """``floor(factor * entry)`` of every entry as long; null for a vector that is left out.

    Left out are null vectors, empty ones and those with an entry that is null, NaN or
    infinite. An entry beyond a long fails the job.
    """
    entries = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(
        entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return F.when(
        finite & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * F.lit(float(factor))).cast("bigint"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many vectors in one binary cell, which tasks read without taking lists apart."""
    for batch in batches:
        matrix = _matrix(batch["x"])
        step = max(1, CELL_BYTES // max(8, 8 * matrix.shape[1]))
        for low in range(0, len(matrix), step):
            some = np.ascontiguousarray(matrix[low : low + step], dtype="<i8")
            yield pa.record_batch(
                {
                    "length": pa.array([some.shape[1]], pa.int32()),
                    "vectors": pa.array([some.tobytes()], pa.binary()),
                }
            )


class FitList:
    """The distinct vectors, stored in cells, and passes over them.

    A pass has one narrow stage. Its tasks are as many as the cluster has cores, times
    two, whatever the size of the list; each reads its cells one after the other and returns a
    small array. So the driver gets as much as there are cores.
    """

    def __init__(self, vectors: DataFrame):
        context = vectors.sparkSession.sparkContext
        self._cells = stored(vectors.distinct().mapInArrow(_cells, "length int, vectors binary"))
        self._tasks = 2 * context.defaultParallelism
        lengths = self._cells.agg(F.min("length"), F.max("length")).first()
        if lengths[0] != lengths[1]:
            raise ValueError("vectors differ in length")
        self.length = lengths[0] or 0

    def _sum(self, part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
        """The sum of ``part`` over all cells' matrices, task by task in a fixed order."""

        exact = kind is np.int64
        wide = np.int64 if exact else np.longdouble

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                for length, raw in zip(batch["length"].to_pylist(), batch["vectors"]):
                    matrix = np.frombuffer(raw.as_buffer(), dtype="<i8").reshape(-1, length)
                    # extended precision: many cells are added up
                    found = part(matrix).astype(wide)
                    total = found if total is None else total + found
                    if exact and np.abs(total).max() >= 2**62:
                        raise OverflowError("the vectors' sums are too large for longs")
            if total is not None:
                yield pa.record_batch(
                    {
                        "task": pa.array([TaskContext.get().partitionId()], pa.int32()),
                        "part": pa.array([np.asarray(total, kind).tobytes()], pa.binary()),
                    }
                )

        rows = self._cells.coalesce(self._tasks).mapInArrow(run, "task int, part binary").collect()
        if not rows:
            return None
        parts = [np.frombuffer(row.part, kind) for row in sorted(rows, key=lambda r: r.task)]
        if exact:
            # exact whatever the tasks' sums add up to
            return np.array([sum(int(x) for x in column) for column in zip(*parts)], dtype=object)
        return np.sum([p.astype(wide) for p in parts], axis=0).astype(kind)

    def counts(self) -> tuple[int, np.ndarray]:
        """How many vectors there are, and the exact sum of each dimension."""
        totals = self._sum(lambda x: np.concatenate([[len(x)], checked_sum(x)]), np.int64)
        return (0, np.zeros(0, dtype=object)) if totals is None else (int(totals[0]), totals[1:])

    def sum_of_squares(self, centre: Callable[[np.ndarray], np.ndarray]) -> float:
        return float(self._sum(lambda x: np.array([np.square(centre(x)).sum()]), np.float64)[0])

    def product(self, centre: Callable[[np.ndarray], np.ndarray], directions: np.ndarray) -> np.ndarray:
        """Centred vectors, transposed, times centred vectors, times ``directions``."""

        def part(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return (y.T @ (y @ directions)).ravel()

        return self._sum(part, np.float64).reshape(directions.shape)

    def moments(self, whitened: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """The covariance of ``whitened``, centred before it is multiplied."""
        mean = self._sum(lambda x: whitened(x).sum(axis=0), np.float64) / n

        def part(x: np.ndarray) -> np.ndarray:
            w = whitened(x) - mean
            return (w.T @ w).ravel()

        return self._sum(part, np.float64).reshape(len(mean), len(mean)) / n


def checked_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as longs; fails rather than wrap around."""
    if x.size and int(np.abs(x.astype(np.float64)).max()) * len(x) >= 2**62:
        raise OverflowError("entries are too large to be summed as longs")
    return x.sum(axis=0, dtype=np.int64)


def centred(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n in double precision: the difference n * x - S is exact where longs hold it."""
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    # what the whole part leaves, below 1, so that neither difference loses digits
    part = np.array([(int(s) % n) / n for s in sums])

    def run(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - part

    return run


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The leading components of the distinct ``x`` of ``vectors``; None without a row.

    Components whose eigenvalue is zero to double precision are left out: nothing along
    them can be whitened.
    """
    listed = FitList(vectors.select("x"))
    n, sums = listed.counts()
    if n == 0:
        return None
    centre = centred(n, sums)
    trace = listed.sum_of_squares(centre) / n
    empty = Whitening(n, sums, np.empty((listed.length, 0)), np.empty(0), trace, 0.0)
    if listed.length == 0 or trace == 0:
        return empty
    values, found = jacobi_davidson(
        lambda directions: listed.product(centre, directions) / n, listed.length, components
    )
    positive = values > len(sums) * np.finfo(float).eps * values[0]
    values, found = values[positive], found[:, positive]
    scaled = found / np.sqrt(values)
    error = listed.moments(lambda x: centre(x) @ scaled, n) - np.eye(len(values))
    return Whitening(n, sums, found, values, trace, float(np.abs(error).max()))


def exact_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per row the sum over dimensions of (n * x - S) ** 2, with integers throughout."""
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most**2 * max(1, x.shape[1]) < 2**62:
        return (np.square(n * x - sums.astype(np.int64))).sum(axis=1).tolist()
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]


def whiten(
    embeddings: DataFrame,
    components: int = 4,
    identifier: str = "vec_id",
    embedding: str = "embedding",
    factor: int = 256,
) -> DataFrame:
    """A row per remaining row of ``embeddings`` and component, numbered from 1.

    ``(identifier, component, n, deviation, whitened, explained, identity_error)``. Vectors
    are taken as whole numbers, see ``integer_vectors``. The fit list has each distinct
    vector once: ``n`` of them, with sums S. ``deviation`` is the exact sum of
    (n * x - S) ** 2, a decimal of 38 digits; ``whitened`` is x - S/n along the component
    over the root of its eigenvalue; ``explained`` the eigenvalue's share of all variance;
    ``identity_error`` the largest entry of the whitened fit list's covariance minus the identity.

    Rows left out by ``integer_vectors`` give nothing, and neither does a table without
    any other. Vectors of different lengths fail the job. There are as many components
    as directions in which the list varies, at most; without any, no row is returned. Components of
    equal eigenvalues are some orthonormal ones of their plane. A missing identifier is
    kept, repeated rows are each answered and fitted once, other columns are left out.
    """
    spark = prepare(embeddings.sparkSession)
    vectors = embeddings.select(
        F.col(f"`{identifier}`").alias("id"),
        integer_vectors(embeddings, embedding, factor).alias("x"),
    ).where(F.col("x").isNotNull())
    kind = T.StructType(
        [
            T.StructField(identifier, embeddings.schema[identifier].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    model = fit(vectors, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], kind)
    return vectors.mapInArrow(_whitened_rows(model, kind), kind)


def _whitened_rows(model: Whitening, kind: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        from pyspark.sql.pandas.types import to_arrow_schema

        centre = centred(model.n, model.sums)
        scaled = model.components / np.sqrt(model.eigenvalues)
        count = len(model.eigenvalues)
        explained = model.eigenvalues / model.trace
        schema = to_arrow_schema(kind)
        for batch in batches:
            x = _matrix(batch["x"])
            rows = len(x)
            number = np.repeat(np.arange(rows), count)
            deviations = exact_deviations(x, model.n, model.sums)
            columns = [
                batch["id"].take(pa.array(number)),
                pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()),
                pa.array(np.full(rows * count, model.n), pa.int64()),
                pa.array([Decimal(deviations[i]) for i in number], pa.decimal128(38, 0)),
                pa.array((centre(x) @ scaled).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * count, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
