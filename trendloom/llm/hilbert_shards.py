"""Sharding along a Hilbert curve (DataFrame functions only).

Metadata dimensions are quantised, each row gets its index on the Hilbert curve through that
grid, the rows are sorted by it and cut into runs of equal count.  Neighbours on the curve are
neighbours in every dimension, so a shard covers a small box and a reader prunes shards by any
of the dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import running_offsets, save

BITS = 5


def category(value: Column, bits: int = BITS) -> Column:
    """Cell of a value without an order: equal values meet, null is a value."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\0null"))), F.lit(1 << bits)).cast("int")


def magnitude(value: Column, bits: int = BITS) -> Column:
    """Cell of an amount on a logarithmic scale, two cells per doubling; null and negatives in cell 0."""
    level = F.floor(2 * F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + F.lit(1.0)))
    return F.least(level, F.lit((1 << bits) - 1)).cast("int")


def _steps(dims: int) -> tuple[list[int], list[int]]:
    """For every (state, corner): the corner's place on the curve and the next state.

    A state is an entry corner and a direction; the rule is the usual one for Hilbert curves
    in any number of dimensions, with Gray codes and rotations.
    """
    mask = (1 << dims) - 1

    def left(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ones(i: int) -> int:
        return (i & ~(i + 1)).bit_length()

    place_of = {gray(i): i for i in range(1 << dims)}
    places, following = [], []
    for entry in range(1 << dims):
        for turn in range(dims):
            for corner in range(1 << dims):
                w = place_of[left(corner ^ entry, dims - (turn + 1) % dims)]
                enter = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                way = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w)
                places.append(w)
                following.append((entry ^ left(enter, turn + 1)) * dims + (turn + way % dims + 1) % dims)
    return places, following


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a grid cell on the Hilbert curve, as a fold over the bit levels."""
    dims = len(cells)
    places, following = (F.array(*[F.lit(x) for x in t]) for t in _steps(dims))

    def step(acc: Column, level: Column) -> Column:
        corner = sum((F.bit_get(c, level).cast("int") * F.lit(1 << k) for k, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * F.lit(1 << dims) + corner
        return F.struct(
            (acc["h"] * F.lit(1 << dims) + F.get(places, at)).cast("long").alias("h"), F.get(following, at).alias("state")
        )

    levels = F.array(*[F.lit(k) for k in reversed(range(bits))])
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state")), step)["h"]


def shard_rows(df: DataFrame, cells: dict[str, Column], key: str, n_shards: int, bits: int = BITS) -> DataFrame:
    """``df`` with the cells, ``hilbert``, ``shard`` and ``slot``; shard sizes differ by one row at most.

    Rows go in the order of (hilbert, key); rows equal in both take any order.  The global rank
    is a range-partitioned sort, written once, plus the row counts of the partitions before: a
    hot cell is split by the key, and only one row per partition meets in a single task.
    An empty table gives an empty table; columns of ``df`` named like a result are replaced.
    """
    placed = df.withColumns(cells)
    placed = placed.withColumn("hilbert", hilbert_index([F.col(c) for c in cells], bits))
    placed, _ = save(placed)
    ranked = placed.repartitionByRange("hilbert", key).sortWithinPartitions("hilbert", key)
    ranked, _ = save(ranked.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = running_offsets(parts, [], "_part", "_n", "_before").crossJoin(parts.agg(F.sum("_n").alias("_all")))
    rank = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    whole, larger = F.floor(F.col("_all") / n_shards), F.pmod(F.col("_all"), F.lit(n_shards))
    edge = larger * (whole + 1)
    shard = F.when(F.col("_r") < edge, F.floor(F.col("_r") / (whole + 1))).otherwise(
        larger + F.floor((F.col("_r") - edge) / F.greatest(whole, F.lit(1)))
    )
    start = F.col("shard") * whole + F.least(F.col("shard").cast("long"), larger)
    return (
        ranked.join(parts, "_part").withColumn("_r", rank)
        .withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_r") - start).cast("long"))
        .drop("_part", "_id", "_n", "_before", "_all", "_r")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents along the curve through (source, lang, size): id, size, checksum, cells, shard, slot.

    A null text has no bytes and checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cells = {
        "source_cell": category(F.col("source")), "lang_cell": category(F.col("lang")), "size_cell": magnitude(F.col("size")),
    }
    return shard_rows(facts, cells, "doc_id", n_shards).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )
