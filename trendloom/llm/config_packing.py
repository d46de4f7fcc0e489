"""Packing token pieces into sequences by a configuration program.

A configuration is a set of lengths that fit into one sequence.  The program asks for as few
configurations as possible that together cover the length histogram.  It is solved by
multiplicative weights in rounds: a length's worth is its size times a weight that grows as it
falls behind, and a knapsack dynamic program finds what fits best beside every length that has
pieces left, the longest first.  Configurations are used a whole number of times, so nothing is
left for a later rounding, and rounds go on until every piece is placed.

Only the histogram (at most one entry per length) is handled on the driver.  The pieces stay
where they are: each gets its number among the pieces of its length, and a table of
configurations says which sequence and place has that number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import running_offsets, save, sized, tidy
from trendloom.llm.tokenized import AT_ONCE, Cached

CAPACITY = 2048
END_ID = 0
FAVOUR = 1.2  # long pieces are harder to place: worth is the length to this power


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """[room]: the length (ascending, by position) to take next in the set of most worth, -1 to leave one token free."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = best[c - lengths[:fit[c]]] + worth[:fit[c]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    return choice


def configuration(lengths: np.ndarray, choice: np.ndarray, first: int, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Copies of each length (by position) beside one ``first``, none more often than it is left.

    Room that the knapsack's set leaves, because it asks for more copies than there are, goes to the longest that fit.
    """
    copies = {first: 1}
    c = room = capacity - int(lengths[first])
    while c > 0:
        k = int(choice[c])
        if k < 0 or copies.get(k, 0) >= left[k]:
            c -= 1
        else:
            copies[k] = copies.get(k, 0) + 1
            c -= int(lengths[k])
            room -= int(lengths[k])
    k = int(np.searchsorted(lengths, room, side="right")) - 1
    while k >= 0:
        n = min(room // int(lengths[k]), int(left[k]) - copies.get(k, 0))
        if n > 0:
            copies[k] = copies.get(k, 0) + n
            room -= n * int(lengths[k])
        k = min(k, int(np.searchsorted(lengths, room, side="right"))) - 1
    return copies


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(copies of each length, sequences)]: all pieces of the histogram, in few sequences."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    left, packed = demand.copy(), []
    while left.any():  # a round uses a configuration with the longest at least, so it places pieces
        behind = np.flatnonzero(left)
        own, rest = lengths[behind], left[behind]
        choice = knapsack(own, own**FAVOUR * np.exp(rest / demand[behind]), capacity)
        for first in range(len(own) - 1, -1, -1):
            if not rest[first]:
                continue
            copies = configuration(own, choice, first, rest, capacity)
            times = min(int(rest[k]) // n for k, n in copies.items())
            for k, n in copies.items():
                rest[k] -= n * times
            packed.append(({int(own[k]): n for k, n in copies.items()}, times))
        left[behind] = rest
    return packed


@dataclass
class Places:
    """Where the pieces of each length go, by their number among them.

    Sorted by (length, first number); one entry per configuration and length.  A configuration is used
    until one of its lengths cannot go on, so their number follows the lengths, not the pieces.
    """

    key: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    SHIFT = 48

    @classmethod
    def of(cls, packed: list[tuple[dict[int, int], int]]) -> Places:
        rows, sequence, used = [], 0, {}
        for copies, times in packed:
            at = 0
            for length, n in sorted(copies.items(), reverse=True):
                rows.append(((length << cls.SHIFT) | used.get(length, 0), sequence, times, at))
                used[length] = used.get(length, 0) + n * times
                at += n * length
            sequence += times
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), (), ()))))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length << self.SHIFT) | number
        at = np.searchsorted(self.key, wanted, side="right") - 1
        inside = wanted - self.key[at]
        copy, which = inside // np.maximum(self.times[at], 1), inside % np.maximum(self.times[at], 1)
        return self.base[at] + which, self.offset[at] + copy * length


def _cut(kind: pa.DataType, tokenizer: str, end_id: int, capacity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        table, end = Cached(tokenizer, False), end_id.to_bytes(2, "little")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in sized(batches, 1, AT_ONCE):
            keys = batch.column(0).to_pylist()
            columns = [[], [], [], [], [], []]
            for key, raw in zip(keys, table.encode_column(batch.column(1)).to_pylist()):
                ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start:start + capacity]
                    for c, x in zip(columns, (key, piece, start, len(own), zlib.crc32(own.tobytes()), int(seen[len(own)]))):
                        c.append(x)
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]),
                 pa.array(np.full(len(columns[0]), part, np.int32))],
                names=["id", "piece", "start", "length", "ids_crc32", "local", "part"],
            )

    return run


def pack_texts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
               capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every text.

    A text's ids and the end id are cut into pieces of ``capacity`` only where longer; a null text
    has the end id alone.  Pieces are placed gaplessly from 0 in each sequence.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    cut_texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _cut(to_arrow_type(kind), tokenizer, end_id, capacity),
        f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, local long, part int",
    )
    pieces, _ = save(cut_texts)
    counts, _ = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places.of(solve(histogram, capacity))
    before = running_offsets(counts, ["length"], "part", "n", "before").drop("n")

    @tidy
    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("before").to_numpy() + batch.column("local").to_numpy()
            sequence, offset = places.find(length, number)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = pieces.join(before, ["part", "length"]).mapInArrow(
        place, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", key) if key != "id" else placed
