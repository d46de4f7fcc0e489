"""Truncated singular value decomposition of a table of feature vectors, by blocks.

Randomised subspace iteration: a random basis of ``width`` columns is multiplied by the matrix and
its transpose again and again, and made orthonormal in between.  The basis (features x width) is a
table of blocks of ``COLUMNS`` features; it is never held whole by the driver or by a task.  Rows
are dealt into blocks of about ``ROWS``; a task holds one row block as sparse entries, meets the
basis blocks one after the other and sums its product.  The tall QR is a tree of small ones:
each task stacks its blocks onto a triangle of width x width, and only triangles meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import cut_lineage

ROWS = 16_384
COLUMNS = 4096
ENTRIES = 1 << 15  # entries multiplied at once
TRIANGLES = 16
OVERSAMPLING = 10
ROUNDS = 5
SMALLEST = 1e-12  # directions whose square is weaker than this share of the strongest are no directions
BLOCK = "block int, matrix binary"


@dataclass(frozen=True)
class Basis:
    """Orthonormal directions, strongest first: table (block, matrix) of ``COLUMNS`` features each."""

    blocks: DataFrame
    features: int
    width: int
    values: tuple[float, ...]  # singular values


class RowBlock:
    """Sparse rows of one block, their product with the basis, and what came with the rows."""

    def __init__(self, width: int):
        self.indices, self.values, self.lengths, self.rows, self.width = [], [], [], [], width
        self.product: np.ndarray | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        for name, held in (("indices", self.indices), ("values", self.values)):
            held.append(batch.column(name).flatten().to_numpy(zero_copy_only=False))
        self.lengths.append(pa.compute.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False))
        self.rows.append(batch.column("row"))

    def sort(self) -> None:
        lengths = np.concatenate(self.lengths)
        owner, column, value = np.repeat(np.arange(len(lengths)), lengths), np.concatenate(self.indices), np.concatenate(self.values)
        order = np.lexsort((owner, column // COLUMNS))
        self.owner, self.column, self.value = owner[order], column[order], value[order]
        self.product = np.zeros((len(lengths), self.width))

    def entries(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place in the block, value) of the entries in one block of columns, in pieces, by row."""
        begin, end = np.searchsorted(self.column // COLUMNS, [block, block + 1])
        for at in range(begin, end, ENTRIES):
            part = slice(at, min(at + ENTRIES, end))
            yield self.owner[part], self.column[part] - block * COLUMNS, self.value[part]

    def multiply(self, block: int, matrix: np.ndarray) -> None:
        for owner, at, value in self.entries(block):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            self.product[owner[first]] += np.add.reduceat(value[:, None] * matrix[at], first, axis=0)

    def transposed(self) -> Iterator[tuple[int, np.ndarray]]:
        """(block, matrix): the transposed rows times the product, for every block of columns with entries."""
        for block in np.unique(self.column // COLUMNS).tolist():
            out = np.zeros((COLUMNS, self.width))
            for owner, at, value in self.entries(block):
                order = np.argsort(at, kind="stable")
                owner, at, value = owner[order], at[order], value[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                out[at[first]] += np.add.reduceat(value[:, None] * self.product[owner], first, axis=0)
            yield block, out


def _sparse(df: DataFrame, features: str, carry: list[str], n_blocks: int) -> DataFrame:
    """(part, row, indices, values): rows dealt into blocks, the columns ``carry`` in ``row``."""
    u = F.unwrap_udt(features)
    dense = F.transform(u["values"], lambda _, i: i.cast("int"))
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    return df.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int").alias("part"), row.alias("row"),
        F.when(u["type"] == 1, dense).otherwise(u["indices"]).alias("indices"), u["values"].alias("values"),
    )


def _with_basis(rows: DataFrame, n_blocks: int, basis: DataFrame, width: int, finish: Callable[[RowBlock], Iterator], schema: str) -> DataFrame:
    """``finish`` of every row block after its product with the basis."""
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("row", "indices", "values")}
    spread = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part")
    right = basis.select(spread, F.col("block"), "matrix", *none.values())
    left = rows.select("part", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("matrix"), "row", "indices", "values")
    placed = left.union(right).repartition("part").sortWithinPartitions("part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None

        def end() -> Iterator[pa.RecordBatch]:
            if held is not None and held.lengths:
                if held.product is None:
                    held.sort()
                yield from finish(held)

        for batch in batches:
            parts, blocks = batch.column("part").to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(parts)) + 1
            for begin, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
                if begin == stop:
                    continue
                if part != parts[begin]:
                    yield from end()
                    part, held = parts[begin], RowBlock(width)
                n_rows = int((blocks[begin:stop] < 0).sum())
                if n_rows:
                    held.add(batch.slice(begin, n_rows))
                for k in range(begin + n_rows, stop):
                    if not held.lengths:
                        break
                    if held.product is None:
                        held.sort()
                    matrix = np.frombuffer(batch.column("matrix")[k].as_buffer()).reshape(COLUMNS, width)
                    held.multiply(int(blocks[k]), matrix)
        yield from end()

    return placed.mapInArrow(run, schema)


def _block(number: int, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int32()), "matrix": [np.ascontiguousarray(matrix).tobytes()]})


def _summed(parts: DataFrame) -> DataFrame:
    """Sum of the matrices of each block, read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None
        for batch in batches:
            for block, matrix in zip(batch.column("block").to_pylist(), batch.column("matrix")):
                found = np.frombuffer(matrix.as_buffer())
                if block == of:
                    total += found
                    continue
                if of is not None:
                    yield _block(of, total)
                of, total = block, found.copy()
        if of is not None:
            yield _block(of, total)

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, BLOCK)


def _triangle(blocks: DataFrame, width: int) -> np.ndarray:
    """R of the QR of all blocks stacked: tasks reduce theirs, few triangles reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for matrix in batch.column("matrix"):
                r = np.linalg.qr(np.vstack((r, np.frombuffer(matrix.as_buffer()).reshape(-1, width))), mode="r")
        if len(r):
            yield _block(0, r)

    once = blocks.mapInArrow(run, BLOCK).repartition(TRIANGLES).mapInArrow(run, BLOCK)
    found = [np.frombuffer(r["matrix"]).reshape(-1, width) for r in once.collect()]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def _turned(blocks: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every block times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, b in zip(batch.column("block").to_pylist(), batch.column("matrix")):
                yield _block(block, np.frombuffer(b.as_buffer()).reshape(COLUMNS, -1) @ matrix)

    return blocks.mapInArrow(run, BLOCK)


def _start(df: DataFrame, features: int, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                yield _block(block, np.random.default_rng((seed, block)).standard_normal((COLUMNS, width)))

    return df.sparkSession.range(-(-features // COLUMNS)).mapInArrow(run, BLOCK)


def principal_directions(df: DataFrame, features: str, k: int, seed: int = 42, rounds: int = ROUNDS) -> Basis:
    """The ``k`` strongest right singular vectors of the vectors in ``features`` (one fewer than features at most).

    Fewer if the matrix has a lower rank; none for an empty or zero matrix.  A matrix of rank up to
    ``k`` + ``OVERSAMPLING`` is met exactly; else the error falls with the gap behind these, to the power of ``rounds``.
    """
    first = df.select(features).first()
    size = len(first[0]) if first else 1
    k = max(1, min(k, size - 1))
    width = min(k + OVERSAMPLING, size)
    n_blocks = max(1, -(-df.count() // ROWS))
    rows = cut_lineage(_sparse(df, features, [], n_blocks))
    basis = _start(df, size, width, seed)

    def transposed(held: RowBlock) -> Iterator[pa.RecordBatch]:
        for block, matrix in held.transposed():
            yield _block(block, matrix)

    def products(held: RowBlock) -> Iterator[pa.RecordBatch]:
        yield _block(0, np.linalg.qr(held.product, mode="r"))

    for _ in range(rounds):
        sums = cut_lineage(_summed(_with_basis(rows, n_blocks, basis, width, transposed, BLOCK)))
        _, s, vt = np.linalg.svd(_triangle(sums, width))
        # squares of the singular values of the rows: the same relative limit on these
        kept = s > (s[0] * SMALLEST if len(s) else 0)
        if not kept.any():
            return Basis(sums.limit(0), size, 0, ())
        basis, width = _turned(sums, vt.T[:, :len(s)][:, kept] / s[kept]), int(kept.sum())
    basis = cut_lineage(basis)
    _, s, vt = np.linalg.svd(_triangle(_with_basis(rows, n_blocks, basis, width, products, BLOCK), width))
    k = min(k, len(s))
    return Basis(cut_lineage(_turned(basis, vt.T[:, :k])), size, k, tuple(s[:k].tolist()))


def projected(df: DataFrame, features: str, basis: Basis, output: str = "z") -> DataFrame:
    """The other columns of ``df`` with the products of the rows and the directions, as an array of doubles."""
    carry = [c for c in df.columns if c not in (features, output)]
    if basis.width == 0:
        return df.select(*carry, F.array().cast("array<double>").alias(output))
    n_blocks = max(1, -(-df.count() // ROWS))
    rows = _sparse(df, features, carry, n_blocks)
    kind = rows.schema["row"].dataType.simpleString()

    def finish(held: RowBlock) -> Iterator[pa.RecordBatch]:
        row, out = pa.chunked_array(held.rows).combine_chunks(), held.product
        ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["row", "z"])

    found = _with_basis(rows, n_blocks, basis.blocks, basis.width, finish, f"row {kind}, z array<double>")
    return found.select("row.*", F.col("z").alias(output))
