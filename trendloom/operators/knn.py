"""Exact k nearest neighbours by Euclidean distance, in two rounds.

Base rows go to the nearest of about ``sqrt(rows)`` pivots, sampled in proportion to density, so
that cells are of like size; copies of a vector beyond the number wanted are left out first.
Every row is turned to the principal axes of a sample and keeps its first ``COARSE`` coordinates
and the norm of the rest: distances in this short form never exceed the true ones.

Round one compares each query with its own cell only and takes the k-th distance there as a
bound.  Round two sends the query to every other cell that may hold a row within the bound: the
cell's ball, the plane between the two pivots and the box around the cell's short forms each give
a least distance, and the largest of the three decides.  A query is sent once to each of a few regions of cells.  Queries and base rows travel in blocks
of one cell; a task compares two blocks by matrix products, the short forms first, and computes
the distance itself only for rows that can be among the k.  Pivots, radii and boxes are
shared with all tasks; their number is limited by ``PIVOT_BYTES`` and further rows only make
cells larger, never results different.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import cut_lineage

SAMPLE = 4096  # rows from which axes and pivots are taken, more only if there are more pivots
PIVOT_BYTES = 32 << 20
BLOCK_ROWS = 1024
CELL_ROWS = 512  # a cell holds about as many rows at least, so small tables have few cells
FLUSH_BYTES = 8 << 20
COARSE = 16
REGIONS = 16  # a query is sent to as many places at most
PARTS = 8  # tasks of a region
SLACK = 1e-9  # relative; bounds are widened by it, so rounding never hides a neighbour


@dataclass(frozen=True)
class Axes:
    """Principal axes, and the pivots in the coordinates of the rows."""

    mean: np.ndarray
    turn: np.ndarray
    pivots: np.ndarray

    def coarse(self, x: np.ndarray) -> np.ndarray:
        """First coordinates on the axes, and the norm of the others as one more."""
        turned = (x - self.mean) @ self.turn
        return np.column_stack((turned[:, :COARSE], np.linalg.norm(turned[:, COARSE:], axis=1)))


@dataclass(frozen=True)
class Cells:
    """Size, radius and box of every cell; an empty cell has no rows and is never visited."""

    size: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, up to rounding, by one product."""
    out = a @ b.T
    out *= -2
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(out, 0, out=out)


def _rounding(a: np.ndarray, b: np.ndarray) -> float:
    """What a squared distance of ``_squares`` can be off by."""
    largest = max(float(np.einsum("ij,ij->i", a, a).max(initial=0)), float(np.einsum("ij,ij->i", b, b).max(initial=0)))
    return 1e-12 * largest + 1e-300


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in few batches of about ``FLUSH_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= FLUSH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _over(run):
    """``run`` with its output gathered into few batches."""
    return lambda batches: _gathered(run(batches))


def distinct_vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(rep, vec): one row per distinct vector, named by its smallest id."""
    return df.groupBy(F.col(vector).alias("vec")).agg(F.min(row_id).alias("rep"))


def _few_copies(df: DataFrame, copies: int) -> DataFrame:
    """(id, rep, vec) with at most ``copies`` rows per distinct vector, smallest ids first.

    Copies lie at one distance and go by id, so no further one can be a neighbour.
    The rank filter is applied before the shuffle as well.
    """
    same = Window.partitionBy("vec").orderBy("id")
    kept = df.select("id", "vec", F.row_number().over(same).alias("_nth")).filter(F.col("_nth") <= copies)
    return kept.select("id", F.min("id").over(Window.partitionBy("vec")).alias("rep"), "vec")


def _axes(base: DataFrame) -> tuple[int, Axes | None]:
    """Number of rows, and axes and pivots from rows in the order of a hash of their id; None without rows."""

    def sample(n: int) -> np.ndarray:
        picked = base.select(F.xxhash64("id").alias("h"), "id", "vec").orderBy("h", "id").limit(n).select("vec").toArrow()
        flat = picked["vec"].combine_chunks()
        return flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))

    rows = sample(SAMPLE)
    if len(rows) == 0:
        return 0, None
    count = len(rows) if len(rows) < SAMPLE else base.count()
    most = max(1, PIVOT_BYTES // (8 * (rows.shape[1] + 2 * COARSE + 4)))
    n_pivots = max(1, min(most, math.isqrt(count), count // CELL_ROWS))
    if n_pivots > len(rows):
        rows = sample(n_pivots)
    mean = rows.mean(axis=0)
    _, turn = np.linalg.eigh((rows - mean).T @ (rows - mean))
    return count, Axes(mean, turn[:, ::-1].copy(), np.unique(rows[:n_pivots], axis=0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(df: DataFrame, axes: Broadcast, names: list[str], rows: int) -> DataFrame:
    """Rows of one cell in blocks of at most ``rows``: the columns ``names`` as arrays, coordinates as bytes.

    The last block of a cell carries the cell's size, radius and box.
    """
    kinds = {n: df.schema[n].dataType.simpleString() for n in names}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = axes.value.pivots
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("vec"))
                cell = _squares(x, pivots).argmin(axis=1).astype(np.int32)
                far = np.linalg.norm(x - pivots[cell], axis=1)
                columns = [pa.array(cell), pa.array(far), *(part.column(n) for n in names), part.column("vec")]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "far", *names, "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        of, size, total, radius, low, high = None, 0, 0, 0.0, np.inf, -np.inf

        def block(last: bool) -> pa.RecordBatch:
            nonlocal held, size, total, radius, low, high
            table = pa.concat_tables(held)
            x = _matrix(table["vec"])
            short = axes.value.coarse(x)
            total, radius = total + len(x), max(radius, float(table["far"].to_numpy().max()))
            low, high = np.minimum(low, short.min(axis=0)), np.maximum(high, short.max(axis=0))
            row = {
                "cell": pa.array([of], pa.int32()), **{n: _listed(table[n]) for n in names},
                "coords": pa.array([x.tobytes()]), "short": pa.array([short.tobytes()]), "size": pa.array([total if last else None], pa.int64()),
                "radius": pa.array([radius if last else None], pa.float64()),
                "low": pa.array([low.tolist() if last else None], pa.list_(pa.float64())),
                "high": pa.array([high.tolist() if last else None], pa.list_(pa.float64())),
            }
            held, size = [], 0
            if last:
                total, radius, low, high = 0, 0.0, np.inf, -np.inf
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cells)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                if begin == end:
                    continue
                if held and cells[begin] != of:
                    yield block(True)
                of = int(cells[begin])
                while begin < end:
                    if size == rows:
                        yield block(False)
                    take = min(rows - size, end - begin)
                    held.append(pa.Table.from_batches([batch.slice(begin, take)]))
                    size, begin = size + take, begin + take
        if held:
            yield block(True)

    listed = ", ".join(f"{n} {k}" for n, k in kinds.items())
    placed = df.select(*names, "vec").mapInArrow(place, f"cell int, far double, {listed}, vec array<double>")
    placed = placed.repartition("cell").sortWithinPartitions("cell", "far")
    arrays = ", ".join(f"{n} array<{k}>" for n, k in kinds.items())
    stats = "size bigint, radius double, low array<double>, high array<double>"
    packed = placed.mapInArrow(_over(pack), f"cell int, {arrays}, coords binary, short binary, {stats}")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _listed(column: pa.ChunkedArray) -> pa.ListArray:
    values = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cells(blocks: DataFrame, pivots: int) -> Cells:
    """Size, radius and box of every cell, from the last block of each."""
    found = blocks.filter("size IS NOT NULL").select("cell", "size", "radius", "low", "high").toArrow()
    at = found["cell"].to_numpy()
    size, radius = np.zeros(pivots, np.int64), np.zeros(pivots)
    size[at], radius[at] = found["size"].to_numpy(), found["radius"].to_numpy()
    low, high = (np.zeros((pivots, _matrix(found["low"]).shape[1])) for _ in range(2))
    low[at], high[at] = _matrix(found["low"]), _matrix(found["high"])
    return Cells(size, radius, low, high)


def least_distances(axes: Axes, cells: Cells, home: int, x: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): for queries of one home cell and every cell, a distance below which no row of
    the cell lies, and one within which all its rows lie."""
    squares = _squares(x, axes.pivots)
    away = np.sqrt(squares)
    between = np.sqrt(_squares(axes.pivots[home:home + 1], axes.pivots))[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (squares - squares[:, home:home + 1]) / (2 * between)
    plane[:, between == 0] = 0
    box = np.zeros_like(squares)
    for k in range(short.shape[1]):
        s = short[:, k:k + 1]
        box += np.maximum(np.maximum(cells.low[:, k] - s, s - cells.high[:, k]), 0) ** 2
    return np.maximum(np.maximum(away - cells.radius, plane), np.sqrt(box)), away + cells.radius


def _bounds(most: np.ndarray, size: np.ndarray, wanted: int) -> np.ndarray:
    """Per query a distance within which ``wanted`` rows lie, from whole cells."""
    order = np.argsort(most, axis=1)
    reached = np.cumsum(size[order], axis=1) >= wanted
    first = reached.argmax(axis=1)
    bound = most[np.arange(len(most)), order[np.arange(len(most)), first]]
    return np.where(reached.any(axis=1), bound, np.inf)


def _from_bytes(value: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(value).reshape(rows, -1)


def home_bounds(queries: DataFrame, blocks: DataFrame, wanted: int) -> DataFrame:
    """(block, bounds): the ``wanted``-th distance of each query of a block inside its own cell, as bytes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _from_bytes(row["coords"], row["n"]), _from_bytes(row["b_coords"], row["b_n"])
                d = _squares(a, b) + _rounding(a, b)
                if d.shape[1] > wanted:
                    d = np.partition(d, wanted - 1, axis=1)[:, :wanted]
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "n": [row["n"]], "d": [d.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces of a block follow each other; the best of those seen so far are kept
        of, best = None, None

        def result() -> pa.RecordBatch:
            full = best.shape[1] >= wanted
            bound = np.sqrt(np.partition(best, wanted - 1, axis=1)[:, wanted - 1]) if full else np.full(len(best), np.inf)
            return pa.RecordBatch.from_pydict({"block": [of], "bounds": [bound.tobytes()]})

        for batch in batches:
            for block, n, d in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "d"))):
                piece = _from_bytes(d, n)
                if block != of:
                    if best is not None:
                        yield result()
                    of, best = block, piece
                    continue
                best = np.hstack((best, piece))
                if best.shape[1] > wanted:
                    best = np.partition(best, wanted - 1, axis=1)[:, :wanted]
        if best is not None:
            yield result()

    right = blocks.select("cell", F.size("id").alias("b_n"), F.col("coords").alias("b_coords"))
    pairs = queries.select("block", "cell", F.size("query").alias("n"), "coords").join(right, "cell").select("block", "n", "coords", "b_n", "b_coords")
    pieces = pairs.mapInArrow(_over(compare), "block bigint, n bigint, d binary")
    return pieces.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, bounds binary")


def _regions(cells: Cells) -> np.ndarray:
    """Region of every cell: neighbouring numbers, of about equal rows together."""
    before = np.cumsum(cells.size) - cells.size
    return np.minimum(before * REGIONS // max(1, int(cells.size.sum())), REGIONS - 1).astype(np.int32)


def _visits(queries: DataFrame, bounds: DataFrame, shared: Broadcast, wanted: int) -> DataFrame:
    """(visit, region, cells, query, coords, short, bounds): for every block and region the cells to look in, and the queries that must.

    A query travels once to a region, not once to each cell, so what is shuffled grows with the rows only.
    """
    kind = queries.schema["query"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, cells = shared.value
        regions = _regions(cells)
        for batch in batches:
            ids = batch.column("query")
            for k, row in enumerate(batch.select(["block", "cell", "coords", "short", "bounds"]).to_pylist()):
                names = ids[k].values
                x, short = _from_bytes(row["coords"], len(names)), _from_bytes(row["short"], len(names))
                least, most = least_distances(axes, cells, row["cell"], x, short)
                bound = _bounds(most, cells.size, wanted)
                if row["bounds"] is not None:
                    bound = np.minimum(bound, np.frombuffer(row["bounds"]))
                bound = bound * (1 + SLACK) + np.sqrt(_rounding(x, axes.pivots))
                visit = (least <= bound[:, None]) & (cells.size > 0)
                asked = np.flatnonzero(visit.any(axis=0))
                for region in np.unique(regions[asked]):
                    there = asked[regions[asked] == region]
                    who = np.flatnonzero(visit[:, there].any(axis=1))
                    yield pa.RecordBatch.from_pydict({
                        "visit": [row["block"]], "region": pa.array([region], pa.int32()),
                        "cells": pa.array([there.tolist()], pa.list_(pa.int32())),
                        "query": _listed(pa.chunked_array([names.take(pa.array(who))])),
                        "coords": [x[who].tobytes()], "short": [short[who].tobytes()], "bounds": [bound[who].tobytes()],
                    })

    asked = queries.join(bounds, "block", "left").select("block", "cell", "query", "coords", "short", "bounds")
    schema = f"visit bigint, region int, cells array<int>, query {kind}, coords binary, short binary, bounds binary"
    return asked.mapInArrow(_over(route), schema)


def _kept(i: np.ndarray, d: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, distance) among the ``wanted`` least of their query, ties included; queries that have as many, and the last distance."""
    order = np.lexsort((d, i))
    i, d = i[order], d[order]
    first = np.searchsorted(i, i)
    last = first + wanted - 1
    full = (last < len(i)) & (i[np.minimum(last, len(i) - 1)] == i) if len(i) else np.zeros(0, bool)
    limit = np.where(full, d[np.minimum(last, len(d) - 1)], np.inf) if len(i) else d
    mine = np.flatnonzero(full)
    return order[d <= limit], i[mine], limit[mine]


def _best_rows(x, short, bound, y, y_short, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, distance): rows of ``y`` that can be among the ``wanted`` nearest of a row of ``x``."""
    limit = bound[:, None] ** 2
    near = _squares(short, y_short) <= limit + _rounding(short, y_short)
    left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if len(left) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y = x[left], y[right]
    off = _rounding(x, y)
    d = _squares(x, y)
    d[(d > limit[left] + off) | ~near[np.ix_(left, right)]] = np.inf
    if d.shape[1] > wanted:
        d[d > np.partition(d, wanted - 1, axis=1)[:, wanted - 1:wanted] + 2 * off] = np.inf
    i, j = np.nonzero(np.isfinite(d))
    apart = x[i] - y[j]
    return left[i], right[j], np.sqrt(np.einsum("ij,ij->i", apart, apart))


def nearest(
    queries: DataFrame, base: DataFrame, k: int, row_id: str = "id", vector: str = "vec", exclude_self: bool = False
) -> DataFrame:
    """(query, id, rep, distance, rank) of the ``k`` nearest base rows of every query row.

    Ties go by id.  ``rep`` names the distinct vector of the neighbour.  ``queries`` holds
    (row_id, vector) with unique ids; ``exclude_self`` leaves out the base row with the id of the
    query.  Rows without a vector are neither asked for nor found.
    """
    wanted = k + 1 if exclude_self else k
    query_kind, kind = (df.schema[row_id].dataType.simpleString() for df in (queries, base))
    found = f"query {query_kind}, id {kind}, rep {kind}, distance double"
    spark = base.sparkSession
    whole = F.col(vector).cast("array<double>").alias("vec")
    itself = queries is base
    base = base.filter(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), whole)
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(row_id).alias("query"), whole)
    rows, axes = _axes(base)
    if axes is None:
        return spark.createDataFrame([], f"{found}, rank int")
    shared_axes = spark.sparkContext.broadcast(axes)
    blocks = cut_lineage(_blocks(_few_copies(base, wanted), shared_axes, ["id", "rep"], BLOCK_ROWS))
    cells = _cells(blocks, len(axes.pivots))
    shared = spark.sparkContext.broadcast((axes, cells))
    if itself and cells.size.sum() == rows:  # no copy was left out: the base blocks hold all queries
        parts = blocks.select("cell", F.col("id").alias("query"), "coords", "short", "block")
    else:
        parts = cut_lineage(_blocks(asked, shared_axes, ["query"], BLOCK_ROWS).select("cell", "query", "coords", "short", "block"))
    visits = _visits(parts, home_bounds(parts, blocks, wanted), shared, wanted)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks that one visit meets follow each other: the best of those seen so far are kept, and tighten the bound
        of, bound, held, i, d = None, None, None, None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held, pa.array(d)], ["query", "id", "rep", "distance"])

        for batch in batches:
            lists = [batch.column(c) for c in ("query", "id", "rep")]
            places = zip(batch.column("visit").to_pylist(), batch.column("region").to_pylist())
            rows = batch.select(["coords", "short", "bounds", "b_coords", "b_short"]).to_pylist()
            for n, (place, row) in enumerate(zip(places, rows)):
                query, ids, reps = (column[n].values for column in lists)
                if place != of:
                    if held is not None:
                        yield result()
                    of, bound, held = place, np.frombuffer(row["bounds"]).copy(), None
                x, short = _from_bytes(row["coords"], len(query)), _from_bytes(row["short"], len(query))
                y, y_short = _from_bytes(row["b_coords"], len(ids)), _from_bytes(row["b_short"], len(ids))
                at, j, far = _best_rows(x, short, bound, y, y_short, wanted)
                rows_found = [query.take(pa.array(at)), ids.take(pa.array(j)), reps.take(pa.array(j))]
                if held is not None:
                    rows_found = [pa.concat_arrays(pair) for pair in zip(held, rows_found)]
                    at, far = np.concatenate((i, at)), np.concatenate((d, far))
                keep, full, limit = _kept(at, far, wanted)
                held, i, d = [column.take(pa.array(keep)) for column in rows_found], at[keep], far[keep]
                bound[full] = np.minimum(bound[full], limit * (1 + SLACK))
        if held is not None:
            yield result()

    where = spark.createDataFrame(pa.table([pa.array(range(len(cells.size)), pa.int32()), pa.array(_regions(cells))], ["cell", "region"]))
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")  # few regions, many tasks
    right = blocks.join(F.broadcast(where), "cell").select(
        "region", part, "cell", "id", "rep", F.col("coords").alias("b_coords"), F.col("short").alias("b_short")
    )
    visits = visits.withColumn("part", F.pmod("visit", F.lit(PARTS)).cast("int"))
    pairs = visits.join(right, ["region", "part"]).filter(F.array_contains("cells", F.col("cell"))).drop("cells", "cell", "part")
    near = pairs.mapInArrow(_over(best), found)
    if exclude_self:
        near = near.filter(F.col("id") != F.col("query"))
    order = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def local_outlier_scores(base: DataFrame, new: DataFrame, k: int, row_id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, score, is_base): local outlier factor minus 1.5, every row scored as if new.

    All quantities depend on the vector only, so they are computed once per distinct vector and
    joined back to the rows.  A base row is its own neighbour when scored and not when its
    density is fitted: one search for k + 1 neighbours gives both, as the smallest id of a
    vector's copies comes first among its own neighbours.
    """
    base = base.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    new = new.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    size = base.limit(k + 1).count()
    k = max(1, min(k, size - 1))
    rows = base.select(F.lit(True).alias("is_base"), "id", "vec").unionByName(new.select(F.lit(False).alias("is_base"), "id", "vec"))
    key = F.concat(F.when(F.col("is_base"), "b:").otherwise("n:"), F.col("id").cast("string"))
    own = F.min(F.when(F.col("is_base"), F.col("id"))).alias("own")
    asked = cut_lineage(rows.groupBy("vec").agg(F.min(key).alias("id"), own))
    near = nearest(asked.select("id", "vec"), base, k + 1)
    near = cut_lineage(near.join(asked.select(F.col("id").alias("query"), "own"), "query"))
    fitted = near.filter("own IS NOT NULL AND id <> own").select(F.col("own").alias("of"), "rep", "distance")
    reach = fitted.groupBy("of").agg(F.max("distance").alias("k_distance")).withColumnRenamed("of", "rep")

    # A density is one over the mean reach distance, so a ratio of densities is one of means.
    mean = F.avg(F.greatest("distance", "k_distance")) + 1e-10
    density = fitted.join(reach, "rep").groupBy("of").agg((1 / mean).alias("rep_lrd")).withColumnRenamed("of", "rep")
    around = near.filter(F.col("rank") <= k).join(reach, "rep").join(density, "rep")
    scores = around.groupBy("query").agg((F.avg("rep_lrd") * mean - 1.5).alias("score"))
    by_vector = asked.join(scores, asked["id"] == scores["query"]).select("vec", "score")
    return rows.join(by_vector, "vec").select("id", "score", "is_base")
