"""Exact nearest neighbours between blocks of vectors, the nearest blocks first.

Vectors belong to the cell of their nearest pivot. A cell's corpus rows are packed into
blocks of bounded size, one table row each, that know the smallest and largest angle of
their vectors to the pivot; queries are packed in the same way. By the triangle
inequality on angles a block of queries and a block of the corpus are at least

    max(angle of the pivots - both farthest, nearest of one - (angle of the pivots + farthest of the other))

apart. Blocks of queries work in rounds. In each they visit the next cells in the order of
that bound, four times as many as in the round before, as long as a cell may hold
anything better than what the worst of their queries has. What is found tightens the
queries' own bounds, block after block, so later blocks are searched for fewer of them.

What is exploded and planned are numbers of blocks and cells; vectors travel packed.
Blocks of queries next to each other form teams, a few for each core, and a block of the
corpus that any of a team visits travels to the team once a round. So what moves grows with
the corpus times the number of teams, however small the blocks are. A task holds the queries
of one team, at most ``TEAM_VALUES`` values and ``TEAM_BLOCKS`` blocks, and streams what
these visit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.nearest import (
    CHUNK_VALUES,
    DECIMALS,
    SLACK,
    angles,
    keep_best,
    lower_limit,
    unit_matrix,
    unit_rows,
)
from plumbline.operators.lookup import lookup
from plumbline.session import materialise

MAX_PIVOTS = 4096
#: Vector values of all pivots, which every task gets.
PIVOT_VALUES = 8_000_000
#: Blocks of a cell that one task hands out; a larger cell's are dealt out to several.
DEALT_BLOCKS = 16
#: Cells a block of queries visits in one round, as a multiple of the round before.
GROWTH = 4
#: Teams of blocks of queries for each core of the cluster.
TEAMS_PER_CORE = 2
#: Vector values of a team's queries, and its blocks, at most.
TEAM_VALUES = 8_000_000
TEAM_BLOCKS = 1024
#: Pairs that are compared in double precision at once, and candidates kept between sightings.
PAIRS = 1 << 16
CANDIDATES_KEPT = 4_000_000

PLACED = "id bigint, embedding array<float>, cell int, angle double"
BLOCKS = (
    "cell int, block bigint, dealt int, nearest double, farthest double, rows int, "
    "ids binary, vectors binary"
)
MATCHES = "query_id bigint, rank int, corpus_id bigint, similarity double"
CANDIDATES = "query_id bigint, corpus_id bigint"
_STATE = (
    "block bigint, team int, cell int, nearest double, farthest double, done int, bound double, "
    "pending boolean, ids binary, vectors binary, similarities binary, found binary"
)
_VISITS = "block bigint, team int, cell int, dealt int, turn int, distance double, low double, high double, reach double"


def choose_pivots(corpus: DataFrame, rows: int, length: int, rows_per_block: int) -> np.ndarray:
    """Some corpus rows by a hash of their id; any will do, since they only steer the search.

    Pivots near each other follow each other, since the blocks of a team are neighbours.
    """
    count = min(MAX_PIVOTS, max(1, PIVOT_VALUES // length), max(1, math.ceil(rows / rows_per_block)))
    chosen = corpus.orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    pivots = np.unique(unit_rows(chosen["embedding"]), axis=0)
    return pivots[_in_halves(pivots, np.arange(len(pivots)))]


def _in_halves(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` cut at the median of their widest dimension, and each half in the same way."""
    if len(rows) <= 2:
        return rows
    rows = rows[np.argsort(points[rows, points[rows].var(axis=0).argmax()], kind="stable")]
    middle = len(rows) // 2
    return np.concatenate([_in_halves(points, rows[:middle]), _in_halves(points, rows[middle:])])


def in_cells(vectors: DataFrame, pivots) -> DataFrame:
    """``id, embedding`` with the number of the nearest pivot and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, cell, angle = unit_rows(batch["embedding"]), [], []
            step = max(1, CHUNK_VALUES // len(pivots.value))
            for start in range(0, len(units), step):
                to_pivots = units[start : start + step] @ pivots.value.T
                cell.append(to_pivots.argmax(axis=1))
                angle.append(np.arccos(np.clip(to_pivots.max(axis=1), -1.0, 1.0)))
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "embedding": batch["embedding"],
                    "cell": pa.array(np.concatenate(cell), pa.int32()),
                    "angle": pa.array(np.concatenate(angle)),
                }
            )

    return vectors.mapInArrow(run, PLACED)


def packed(placed: DataFrame, rows_per_block: int, codes: bool = False) -> DataFrame:
    """Rows of ``in_cells`` as ``BLOCKS`` of about ``rows_per_block`` rows, read twice.

    A cell with more rows is cut by a hash of the ids. Blocks are numbered within a call.
    With ``codes`` the vectors are 8-bit codes, see ``coded``.
    """
    # at most one row per pivot
    counts = {row.cell: row["count"] for row in placed.groupBy("cell").count().collect()}
    if not counts:
        return placed.sparkSession.createDataFrame([], BLOCKS)
    rows, start = [], 0
    for cell, count in sorted(counts.items()):
        parts = math.ceil(count / rows_per_block)
        rows.append((cell, start, parts))
        start += parts
    cells = placed.sparkSession.createDataFrame(rows, "cell int, _start bigint, _parts int")

    def pack(table: pa.Table) -> pa.Table:
        angle = table["angle"].to_numpy()
        if codes:
            content = coded(unit_rows(table["embedding"]))
        else:
            vectors = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            content = vectors.astype("<f4").tobytes()
        return pa.table(
            {
                "cell": pa.array([table["cell"][0].as_py()], pa.int32()),
                "block": pa.array([table["block"][0].as_py()], pa.int64()),
                "dealt": pa.array([table["part"][0].as_py() // DEALT_BLOCKS], pa.int32()),
                "nearest": pa.array([angle.min()]),
                "farthest": pa.array([angle.max()]),
                "rows": pa.array([len(angle)], pa.int32()),
                "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()]),
                "vectors": pa.array([content]),
            }
        )

    return (
        placed.join(F.broadcast(cells), "cell")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        .withColumn("block", F.col("_start") + F.col("part"))
        .drop("_start", "_parts")
        .groupBy("block")
        .applyInArrow(pack, BLOCKS)
    )


def coded(units: np.ndarray) -> bytes:
    """Unit rows as a scale, an error and a signed byte for each value.

    The error is the distance of what the codes stand for from the row, rounded up. So the
    similarity of any unit vector to the row is off by no more (Cauchy-Schwarz).
    """
    scale = (np.abs(units).max(axis=1, initial=0.0) / 127).astype("<f4")
    divisor = np.where(scale > 0, scale, 1).astype(np.float64)[:, None]
    values = np.clip(np.rint(units / divisor), -127, 127).astype(np.int8)
    error = np.linalg.norm(units - values * scale.astype(np.float64)[:, None], axis=1)
    error = np.nextafter((error * (1 + 1e-6) + 1e-9).astype("<f4"), np.float32(np.inf))
    return scale.tobytes() + error.astype("<f4").tobytes() + values.tobytes()


def decoded(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """What the codes stand for, and the error of each row."""
    scale = np.frombuffer(raw, "<f4", rows).astype(np.float64)
    error = np.frombuffer(raw, "<f4", rows, 4 * rows).astype(np.float64)
    values = np.frombuffer(raw, np.int8, offset=8 * rows).reshape(rows, -1)
    return values * scale[:, None], error


@dataclass(frozen=True)
class Cells:
    """The pivots, and of each one's cell the nearest and farthest angle of a corpus row.

    ``dealt`` says into how many parts the cell's blocks are dealt out.
    """

    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    dealt: np.ndarray

    def order(self, cell: int, near: float, far: float):
        """Cells with rows in the order of their bound to queries of ``cell``.

        The queries' angles to its pivot are from ``near`` to ``far``. Returns the cells,
        the angles of their pivots to this one, and the bounds.
        """
        filled = np.flatnonzero(np.isfinite(self.nearest))
        distance = angles(self.pivots[cell : cell + 1], self.pivots[filled])[0]
        low = np.maximum(np.maximum(distance - far, near - distance), 0.0)
        bound = np.maximum(low - self.farthest[filled], self.nearest[filled] - distance - far)
        bound = np.maximum(bound, 0.0)
        turn = np.lexsort((distance, bound))
        return filled[turn], distance[turn], bound[turn]


def reach(similarity):
    """The angle up to which something may still be as similar."""
    return np.arccos(np.clip(similarity - SLACK, -1.0, 1.0)) + 1e-6


def cells_of(blocks: DataFrame, pivots: np.ndarray) -> Cells:
    """Ranges of the cells, from the blocks' small columns: one row per pivot at most."""
    nearest, farthest = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    dealt = np.zeros(len(pivots), dtype=int)
    ranges = blocks.groupBy("cell").agg(F.min("nearest"), F.max("farthest"), F.max("dealt") + 1)
    for cell, *measures in ranges.collect():
        nearest[cell], farthest[cell], dealt[cell] = measures
    return Cells(pivots, nearest, farthest, dealt)


def search(
    queries: DataFrame,
    blocks: DataFrame | Callable[[list[int]], DataFrame],
    cells: Cells,
    k: int,
    rows_per_block: int,
    codes: bool = False,
) -> DataFrame:
    """``MATCHES`` of ``queries`` (``id, embedding``) among ``blocks``, k per query at most.

    With ``codes``, ``blocks`` hold codes, and ``query_id, corpus_id`` of all rows that may
    be among the k are returned. ``blocks`` is a stored table, or a function that gives the blocks of the listed cells.
    One checkpoint per round; there are about log(cells) / log(``GROWTH``) rounds at most.
    """
    spark = queries.sparkSession
    pivots = spark.sparkContext.broadcast(cells.pivots)
    known = spark.sparkContext.broadcast(cells)
    placed = materialise(in_cells(queries, pivots))
    opened = materialise(packed(placed, rows_per_block).mapInArrow(_first_state(k, codes), _STATE))
    values = rows_per_block * cells.pivots.shape[1]
    per_team = blocks_per_team(opened.count(), values, _teams(spark))
    opened = opened.withColumn("team", F.floor(F.col("block") / per_team).cast("int"))
    finished, quota = [], 1
    while not opened.isEmpty():
        opened = materialise(_round(opened, blocks, known, k, quota, codes))
        finished.append(opened.where(~F.col("pending")))
        opened = opened.where("pending")
        quota *= GROWTH
    if not finished:
        return spark.createDataFrame([], CANDIDATES if codes else MATCHES)
    states = finished[0]
    for table in finished[1:]:
        states = states.unionByName(table)
    if codes:
        return states.select("ids", "found").mapInArrow(_candidates, CANDIDATES)
    return states.select("ids", "similarities", "found").mapInArrow(_matches(k), MATCHES)


def _teams(spark: SparkSession) -> int:
    return TEAMS_PER_CORE * spark.sparkContext.defaultParallelism


def blocks_per_team(blocks: int, values: int, teams: int) -> int:
    """How many blocks of ``values`` vector values a task takes to make at most ``teams``."""
    most = max(1, min(TEAM_BLOCKS, TEAM_VALUES // values))
    return max(1, min(most, math.ceil(blocks / teams)))


def _round(
    opened: DataFrame, blocks, known, k: int, quota: int, codes: bool = False
) -> DataFrame:
    """The state of blocks of queries after their next ``quota`` cells."""
    visits = (
        opened.select("block", "team", "cell", "nearest", "farthest", "done", "bound")
        .mapInArrow(_next_visits(known, quota), _VISITS)
        .groupBy("team", "cell", "dealt")
        .agg(*[F.min(c).alias(c) for c in ("turn", "low")], *[F.max(c).alias(c) for c in ("high", "reach")])
    )
    if callable(blocks):
        visits = materialise(visits)
        visited = [row.cell for row in visits.select("cell").distinct().collect()]
        blocks = blocks(visited)
    least = F.greatest(F.col("low") - F.col("c.farthest"), F.col("c.nearest") - F.col("high"))
    # by number: which team, which cell, in which turn; the block's content joins last
    fetched = (
        visits.alias("v")
        .join(
            blocks.alias("c"),
            (F.col("v.cell") == F.col("c.cell"))
            & (F.col("v.dealt") == F.col("c.dealt"))
            & (least <= F.col("reach")),
        )
        .select(
            F.col("v.team").alias("team"),
            F.col("v.turn").alias("turn"),
            F.col("v.cell").alias("cell"),
            *[F.col(f"c.{name}").alias(name) for name in ("nearest", "farthest", "ids", "vectors")],
        )
    )
    rows = opened.withColumn("turn", F.lit(-1)).unionByName(fetched, allowMissingColumns=True)
    return (
        rows.repartitionById(_teams(opened.sparkSession), F.col("team"))
        .sortWithinPartitions("team", "turn")
        .select("turn", *opened.columns)
        .mapInArrow(_visited(known, k, quota, codes), _STATE)
    )


def _first_state(k: int, codes: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.num_rows
            rows = batch["rows"].to_pylist()
            yield pa.record_batch(
                {
                    "block": batch["block"],
                    "team": batch["block"].cast(pa.int32()),
                    **{name: batch[name] for name in ("cell", "nearest", "farthest")},
                    "done": pa.array([0] * blocks, pa.int32()),
                    "bound": pa.array([-2.0] * blocks),
                    "pending": pa.array([True] * blocks),
                    "ids": batch["ids"],
                    "vectors": batch["vectors"],
                    "similarities": pa.array([np.full(n * k, -2.0).tobytes() for n in rows]),
                    "found": pa.array([b"" if codes else np.zeros(n * k, "<i8").tobytes() for n in rows]),
                }
            )

    return run


def _next_visits(known, quota: int):
    """Per block of queries its next cells that its worst query may still need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_VISITS)
        for batch in batches:
            for row in batch.to_pylist():
                near, far, done = row["nearest"], row["farthest"], row["done"]
                limit = float(reach(row["bound"]))
                cell, distance, bound = known.value.order(row["cell"], near, far)
                stop = min(done + quota, int(np.searchsorted(bound, limit, side="right")))
                if stop <= done:
                    continue
                cell, distance = cell[done:stop], distance[done:stop]
                parts = known.value.dealt[cell]
                first = np.cumsum(parts) - parts
                columns = {
                    "turn": np.arange(done, stop),
                    "cell": cell,
                    "distance": distance,
                    "low": np.maximum(np.maximum(distance - far, near - distance), 0.0),
                    "high": distance + far,
                }
                columns = {name: np.repeat(column, parts) for name, column in columns.items()}
                columns["dealt"] = np.arange(parts.sum()) - np.repeat(first, parts)
                alike = {"block": row["block"], "team": row.get("team", row["block"]), "reach": limit}
                columns |= {name: np.full(len(columns["cell"]), value) for name, value in alike.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[field.name], field.type) for field in schema], schema=schema
                )

    return run


class _Team:
    """Blocks of queries and the best they have found.

    Similarities are worked out in single precision and, where these are within ``slack`` of
    what a query has, again in double precision. The dot product of unit vectors of n values
    is off by less than (n + 4) / 2**24 in any order of adding up.
    """

    def __init__(self, rows: list[dict], cells: Cells, k: int, quota: int):
        self.rows, self.cells, self.k, self.quota = rows, cells, k, quota
        self.counts = np.array([len(row["ids"]) // 8 for row in rows])
        self.starts = np.cumsum(self.counts) - self.counts
        total = int(self.counts.sum())
        self.units = _units(b"".join(row["vectors"] for row in rows), total)
        self.single = self.units.astype(np.float32)
        self.slack = (self.units.shape[1] + 8) / 2**23
        self.similarities = np.frombuffer(b"".join(row["similarities"] for row in rows)).reshape(total, k).copy()
        self.limit = reach(self.similarities[:, -1])
        self.cell, self.near, self.far = (np.array([row[n] for row in rows]) for n in ("cell", "nearest", "farthest"))
        self.planned = np.zeros((len(rows), len(cells.pivots)), dtype=bool)
        for number, row in enumerate(rows):
            order, _, _ = cells.order(row["cell"], row["nearest"], row["farthest"])
            self.planned[number, order[row["done"] : row["done"] + quota]] = True
        self.take_found([row["found"] for row in rows])

    def take_found(self, raw: list[bytes]) -> None:
        self.found = np.frombuffer(b"".join(raw), "<i8").reshape(self.similarities.shape).copy()

    def found_bytes(self) -> list[bytes]:
        return [part.tobytes() for part in np.split(self.found, self.starts[1:])]

    def opened(self, vectors: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of a block, and how far off similarities to them may be, for all or for each."""
        return _units(vectors, rows), np.float32(self.slack)

    def may(self, cell: int, near: float, far: float) -> np.ndarray:
        """Numbers of the queries that visit a cell and for which a block may hold something better."""
        pivot = self.cells.pivots[cell : cell + 1]
        apart = angles(self.cells.pivots[self.cell], pivot)[:, 0]
        low = np.maximum(apart - self.far, self.near - apart)
        least = np.maximum(low - far, near - (apart + self.far))
        visiting = self.planned[:, cell] & (least <= np.maximum.reduceat(self.limit, self.starts))
        rows = np.flatnonzero(np.repeat(visiting, self.counts))
        if not len(rows):
            return rows
        apart = angles(self.units[rows], pivot)[:, 0]
        return rows[np.maximum(apart - far, near - apart) <= self.limit[rows]]

    def visit(self, cell: int, near: float, far: float, ids: bytes, vectors: bytes) -> None:
        """Search a block for the queries that it may hold something for."""
        may = self.may(cell, near, far)
        if not len(may):
            return
        ids = np.frombuffer(ids, "<i8")
        block, error = self.opened(vectors, len(ids))
        single = block.astype(np.float32).T
        step = max(1, CHUNK_VALUES // 4 // len(ids))
        for start in range(0, len(may), step):
            rows = may[start : start + step]
            about = self.single[rows] @ single
            limit = self.similarities[rows, -1] - SLACK
            lacking = np.flatnonzero(limit < -1.5)
            if len(lacking):
                limit[lacking] = lower_limit(about[lacking] - error, self.k) - SLACK
            if np.ndim(error):
                reached = about + error >= limit.astype(np.float32)[:, None]
            else:
                reached = about >= (limit - error).astype(np.float32)[:, None]
            row, column = np.divmod(np.flatnonzero(reached), len(ids))
            if len(row):
                self.take(rows[row], column, about[row, column].astype(np.float64), error, ids, block)

    def take(self, rows, columns, about, error, ids, block) -> None:
        """Pairs of queries and rows of a block that may be among the best."""
        parts = [slice(start, start + PAIRS) for start in range(0, len(rows), PAIRS)]
        exact = [np.einsum("ij,ij->i", self.units[rows[part]], block[columns[part]]) for part in parts]
        touched, has = self.touched(rows)
        similarities = np.concatenate([np.round(np.concatenate(exact), DECIMALS) + 0.0, self.similarities[touched][has]])
        found = np.concatenate([ids[columns], self.found[touched][has]])
        rows, similarities, found, rank = keep_best(
            np.concatenate([rows, touched[np.nonzero(has)[0]]]), similarities, found, self.k
        )
        self.similarities[rows, rank - 1] = similarities
        self.found[rows, rank - 1] = found
        self.limit[touched] = reach(self.similarities[touched, -1])

    def touched(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        touched = np.unique(rows)
        return touched, self.similarities[touched] > -2.0

    def states(self) -> list[dict]:
        bounds = np.minimum.reduceat(self.similarities[:, -1], self.starts)
        found = self.found_bytes()
        similarities = np.split(self.similarities, self.starts[1:])
        states = []
        for number, row in enumerate(self.rows):
            bound, done = float(bounds[number]), row["done"] + self.quota
            _, _, least = self.cells.order(row["cell"], row["nearest"], row["farthest"])
            states.append(
                {
                    **row,
                    "done": done,
                    "bound": bound,
                    "pending": done < len(least) and bool(least[done] <= reach(bound)),
                    "similarities": similarities[number].tobytes(),
                    "found": found[number],
                }
            )
        return states


_CANDIDATE = np.dtype([("row", "<i4"), ("id", "<i8"), ("most", "<f8")])


class _CodedTeam(_Team):
    """Blocks of queries that visit codes.

    In the place of similarities it keeps the k largest of what rows have at least, and as
    found every row that may have as much as the k-th of those.
    """

    def take_found(self, raw: list[bytes]) -> None:
        self.parts = [np.frombuffer(part, _CANDIDATE).copy() for part in raw]
        for part, start in zip(self.parts, self.starts):
            part["row"] += start
        self.taken = 0

    def live(self) -> np.ndarray:
        found = np.concatenate(self.parts)
        return found[found["most"] >= self.similarities[found["row"], -1] - SLACK]

    def found_bytes(self) -> list[bytes]:
        found = self.live()
        found = found[np.argsort(found["row"], kind="stable")]
        block = np.searchsorted(self.starts, found["row"], side="right") - 1
        found["row"] -= self.starts[block].astype(np.int32)
        return [part.tobytes() for part in np.split(found, np.searchsorted(block, np.arange(1, len(self.rows))))]

    def opened(self, vectors: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
        block, error = decoded(vectors, rows)
        return block, (error + self.slack).astype(np.float32)

    def take(self, rows, columns, about, error, ids, block) -> None:
        part = np.empty(len(rows), _CANDIDATE)
        part["row"], part["id"], part["most"] = rows, ids[columns], about + error[columns]
        self.parts.append(part)
        self.taken += len(part)
        least = about - error[columns]
        better = least > self.similarities[rows, -1]
        rows, least = rows[better], least[better]
        touched, has = self.touched(rows)
        rows = np.concatenate([rows, touched[np.nonzero(has)[0]]])
        least = np.concatenate([least, self.similarities[touched][has]])
        rows, least, _, rank = keep_best(rows, least, np.zeros(len(rows)), self.k)
        self.similarities[rows, rank - 1] = least
        self.limit[touched] = reach(self.similarities[touched, -1])
        if self.taken > CANDIDATES_KEPT:
            self.parts, self.taken = [self.live()], 0


def _units(raw: bytes, rows: int) -> np.ndarray:
    return unit_matrix(np.frombuffer(raw, "<f4").astype(np.float64).reshape(rows, -1))


def _schema(columns: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in columns.split(", "))])


def _visited(known, k: int, quota: int, codes: bool):
    """The blocks of queries of each team, followed by the blocks these visit, in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kind = _schema(_STATE), _CodedTeam if codes else _Team
        members: list[dict] = []
        team: _Team | None = None

        def formed() -> _Team:
            return team or kind(members, known.value, k, quota)

        for batch in batches:
            for i, turn in enumerate(batch["turn"].to_pylist()):
                if turn < 0:
                    row = {name: batch[name][i].as_py() for name in schema.names}
                    if members and members[0]["team"] != row["team"]:
                        yield pa.RecordBatch.from_pylist(formed().states(), schema=schema)
                        members, team = [], None
                    members.append(row)
                else:
                    team = formed()
                    team.visit(*(batch[n][i].as_py() for n in ("cell", "nearest", "farthest", "ids", "vectors")))
        if members:
            yield pa.RecordBatch.from_pylist(formed().states(), schema=schema)

    return run


def _matches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, similarities, found in zip(*(batch[i].to_pylist() for i in range(3))):
                ids = np.frombuffer(ids, "<i8")
                similarities = np.frombuffer(similarities).reshape(len(ids), k)
                rows, ranks = np.nonzero(similarities > -2.0)
                yield pa.record_batch(
                    {
                        "query_id": pa.array(ids[rows], pa.int64()),
                        "rank": pa.array(ranks + 1, pa.int32()),
                        "corpus_id": pa.array(np.frombuffer(found, "<i8").reshape(len(ids), k)[rows, ranks]),
                        "similarity": pa.array(similarities[rows, ranks]),
                    }
                )

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, found in zip(*(batch[i].to_pylist() for i in range(2))):
            found = np.frombuffer(found, _CANDIDATE)
            yield pa.record_batch(
                {
                    "query_id": pa.array(np.frombuffer(ids, "<i8")[found["row"]], pa.int64()),
                    "corpus_id": pa.array(found["id"].copy(), pa.int64()),
                }
            )


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            both = unit_rows(batch["asking"]) * unit_rows(batch["known"])
            yield pa.record_batch(
                {
                    "query_id": batch["query_id"],
                    "corpus_id": batch["corpus_id"],
                    "similarity": pa.array(np.round(both.sum(axis=1), DECIMALS) + 0.0),
                }
            )


def by_codes(
    spark: SparkSession,
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    rows: int,
    length: int,
    rows_per_block: int,
) -> DataFrame:
    """``query_id, corpus_id, similarity`` of all pairs that may be among a query's k.

    Blocks visit each other as 8-bit codes, a quarter of the bytes. Only a row that is
    within the error of a query's k-th match is compared by its floats, which join the
    candidates by id.
    """
    found = one_search(spark, queries, corpus, k, rows, length, rows_per_block, codes=True)
    pairs = materialise(found)
    known = corpus.select(F.col("id").alias("corpus_id"), F.col("embedding").alias("known"))
    asking = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("asking"))
    return (
        lookup(pairs, known, "corpus_id", "query_id", "inner")
        .join(asking, "query_id")
        .mapInArrow(_exact, "query_id bigint, corpus_id bigint, similarity double")
    )


def one_search(
    spark: SparkSession,
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    rows: int,
    length: int,
    rows_per_block: int,
    codes: bool = False,
) -> DataFrame:
    """``search`` in a corpus that is packed for this call alone."""
    pivots = choose_pivots(corpus, rows, length, rows_per_block)
    if not len(pivots):
        return spark.createDataFrame([], CANDIDATES if codes else MATCHES)
    placed = materialise(in_cells(corpus, spark.sparkContext.broadcast(pivots)))
    blocks = materialise(packed(placed, rows_per_block, codes))
    return search(queries, blocks, cells_of(blocks, pivots), k, rows_per_block, codes)
