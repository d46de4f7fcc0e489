"""Global order without a global sort: dense numbering, rank cuts, percentiles.

Each of these would put the whole table into one task if written as an
unpartitioned window.  Here only counts per coarse bucket are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import cut_lineage

DIGIT_BITS = 16


def running_total(counts: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the preceding rows of a small table of counts."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def number_rows(df: DataFrame, file: str, block: str | None, row: str, name: str = "row_no") -> DataFrame:
    """Dense 0-based number by file and place in it, without moving a row.

    Inside a file (a block of it, if files are split) ``row`` rises by one from row to row.  So a row
    needs only its block's first value and offset: a table with one row per file or block, which is
    as large as the listing of the files and is sent to the scan's own partitions.
    """
    keys = [file] if block is None else [file, block]
    parts = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(row).alias("_first"))
    offsets = running_total(parts, keys, "_n", "_offset").drop("_n")
    numbered = df.join(F.broadcast(offsets), keys)
    return numbered.withColumn(name, F.col("_offset") + F.col(row) - F.col("_first")).drop("_offset", "_first")


def number_in_order(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Dense 0-based number in the order of columns that are unique together.

    The rows are sorted by range and written once with their place in their partition; only
    counts per partition are ordered as a whole.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(placed.withColumns({"_part": F.spark_partition_id(), "_at": place}))
    offsets = running_total(placed.groupBy("_part").count(), ["_part"], "count", "_offset").drop("count")
    numbered = placed.join(F.broadcast(offsets), "_part")  # a row for each partition of the sort
    return numbered.withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


# --- ranks of 64-bit integers ----------------------------------------------------------------

@dataclass
class _Range:
    """Values between ``low`` and ``high``, ``skip`` of the whole table before them."""

    low: int
    high: int
    skip: int


def values_at(
    df: DataFrame, column: str, ranks: Sequence[int], low: int = -(1 << 63), high: int = (1 << 63) - 1
) -> dict[int, tuple[int, int]]:
    """rank -> (value, rows before the first of this value) of 0-based ranks in a column of longs.

    ``low`` and ``high`` are bounds of the values, if they are known.

    Radix selection: one pass counts the rows of each value of the leading ``DIGIT_BITS`` bits that the open
    range leaves, and every rank goes on in its bucket.  A bucket of one value ends the search for its
    ranks, so four passes do at most, and fewer for repeated values.  Every pass serves all ranks.
    """
    found: dict[int, tuple[int, int]] = {}
    open_ranks = {r: _Range(low, high, 0) for r in set(ranks)}
    while open_ranks:
        ranges = list({(x.low, x.high): x for x in open_ranks.values()}.values())
        shifts = [max(0, (x.high - x.low).bit_length() - DIGIT_BITS) for x in ranges]
        number = F.coalesce(*[F.when(F.col(column).between(x.low, x.high), F.lit(i)) for i, x in enumerate(ranges)])
        bits = F.element_at(F.array(*[F.lit(s) for s in shifts]), F.col("_range") + 1)
        counts = (
            df.select(F.col(column).alias("_k"), number.alias("_range")).filter("_range IS NOT NULL")
            .groupBy("_range", F.call_function("shiftright", "_k", bits).alias("_digit"))
            .agg(F.count("*").alias("n"), F.min("_k").alias("low"), F.max("_k").alias("high"))
            .orderBy("_range", "_digit").collect()
        )
        if not counts:
            raise ValueError("a rank of an empty table")
        at = {(x.low, x.high): i for i, x in enumerate(ranges)}
        for rank, inside in list(open_ranks.items()):
            skip = inside.skip
            buckets = [c for c in counts if c["_range"] == at[inside.low, inside.high]]
            for c in buckets:
                if rank < skip + c["n"] or c is buckets[-1]:
                    break
                skip += c["n"]
            if c["low"] == c["high"]:
                found[rank] = (c["low"], skip)
                del open_ranks[rank]
            else:
                open_ranks[rank] = _Range(c["low"], c["high"], skip)
    return found


def first_rows(df: DataFrame, levels: Sequence[Column], n: int) -> Column:
    """Predicate that holds for exactly the first ``n`` rows in the order of ``levels``.

    ``levels`` are columns of longs and at the end one of strings or longs, nulls last; together they are unique.  Each level's
    boundary is found by counting, among the rows that tie on the levels before; the last one only
    orders rows that tie on all others.
    """
    if n <= 0:
        return F.lit(False)
    keys = [f"_k{i}" for i in range(len(levels))]
    rest = df.select(*[c.alias(k) for c, k in zip(levels, keys)])
    bounds: list = []
    for i, key in enumerate(keys):
        total, known, low, high = rest.agg(F.count("*"), F.count(key), F.min(key), F.max(key)).first()
        if n >= total:
            if not bounds:
                return F.lit(True)
            break
        if n >= known:
            bound, n = None, n - known
        elif i + 1 < len(keys):
            bound, before = values_at(rest.filter(F.col(key).isNotNull()), key, [n], low, high)[n]
            n -= before
        else:
            bound, n = rest.select(key).orderBy(F.asc_nulls_last(key)).offset(n).limit(1).first()[0], 0
        bounds.append(bound)
        if n == 0:
            break
        rest = rest.filter(F.col(key).eqNullSafe(F.lit(bound)))

    def lexicographic(i: int) -> Column:
        level, bound = levels[i], bounds[i]
        less = level.isNotNull() if bound is None else F.coalesce(level < F.lit(bound), F.lit(False))
        if i + 1 == len(bounds):
            return less
        return less | (level.eqNullSafe(F.lit(bound)) & lexicographic(i + 1))

    return lexicographic(0)


def _images(df: DataFrame, column: str) -> DataFrame:
    """(k): longs in the order of the doubles in ``column``; nulls are left out, NaN is the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)  # one NaN, and one zero
            yield pa.RecordBatch.from_arrays([pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))], ["k"])

    return df.select(F.col(column).cast("double")).filter(F.col(column).isNotNull()).mapInArrow(run, "k bigint")


def _double(image: int) -> float:
    bits = np.int64(image)
    return float((bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64))


def percentiles(df: DataFrame, column: str, pcts: Sequence[float]) -> list[float | None]:
    """Exact, linearly interpolated percentiles of ``column``; None without values.

    The values are written once as longs of the same order, and all ranks are found in the same passes.
    """
    images = cut_lineage(_images(df, column))
    n, low, high = images.agg(F.count("*"), F.min("k"), F.max("k")).first()
    if n == 0:
        return [None] * len(pcts)
    places = [(n - 1) * p / 100 for p in pcts]
    ranks = {min(int(x) + step, n - 1) for x in places for step in (0, 1)}
    at = {r: _double(v) for r, (v, _) in values_at(images, "k", sorted(ranks), low, high).items()}
    out = []
    for x in places:
        low, high = at[int(x)], at[min(int(x) + 1, n - 1)]
        out.append(low if low == high or x == int(x) else low + (high - low) * (x - int(x)))
    return out


def percentile(df: DataFrame, column: str, pct: float, name: str = "threshold") -> DataFrame:
    """One-row table with the exact percentile of ``column``, null without values."""
    value = percentiles(df, column, [pct])[0]
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias(name))


def largest(df: DataFrame, order: Sequence[Column], n: int, value: str) -> DataFrame:
    """The ``n`` first rows by ``value`` descending, then ``order``."""
    return df.orderBy(F.desc(value), *order).limit(n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
