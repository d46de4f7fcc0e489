"""Blocks of rows, written tables, components and running offsets shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.session import checkpoint_dir

LAST_ID = (1 << 63) - 1
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared checkpoint folder; return the reread table and its path.

    A written table survives lost executors and is computed once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return save(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``save`` wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, b"" for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that few of a batch's texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def offsets(items: pa.StringArray | pa.BinaryArray) -> np.ndarray:
    """Where each item's bytes start in their buffer, and where the last one's end."""
    if not len(items):
        return np.zeros(1, np.int32)
    return np.frombuffer(items.buffers()[1], np.int32)[items.offset:items.offset + len(items) + 1]


def sized(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes in the column of number ``text`` (one longer row stands alone)."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


# --- memory of a worker ---------------------------------------------------------------------------

def release() -> None:
    """Return freed memory to the system (where its C library can): a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that returns its memory when it ends, and that of the task before when it starts."""

    def tidied(batches: Iterator[pa.RecordBatch]):
        release()
        yield from run(batches)
        release()

    return tidied


# --- blocks -----------------------------------------------------------------------------------

def block_id(number: int) -> int:
    """Unique in a job: a partition holds fewer than 2**32 blocks."""
    return (TaskContext.get().partitionId() << 32) | number


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Consecutive rows cut into tables of about ``limit`` bytes of text (one longer row stands alone)."""
    held, size = [], 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text).cast(pa.binary())), 0).to_pylist()
        at = 0
        for k, n in enumerate(lengths):
            if size and size + n > limit:
                held.append(batch.slice(at, k - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, k
            size += n + 16
        held.append(batch.slice(at))
    if held and sum(len(b) for b in held):
        yield pa.Table.from_batches(held)


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def write_blocks(docs: DataFrame, text: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): the rows of ``docs`` in compressed blocks of bounded size, written once.

    Later steps exchange small facts keyed by block and meet the texts again by a join on
    ``block``: a few wide rows instead of one row a document.
    """

    @tidy
    def run(batches):
        for number, rows in enumerate(in_blocks(batches, text, limit)):
            yield pa.RecordBatch.from_pydict({"block": [block_id(number)], "payload": [pack(rows)]})

    return save(docs.mapInArrow(run, "block long, payload binary"), "uncompressed")[0]


# --- running offsets ---------------------------------------------------------------------------

def running_offsets(df: DataFrame, by: list[str], order: str, amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of its group before it.

    For tables with one row per partition of a job (and per group), never for data rows.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))


# --- components ---------------------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node reachable.

    Alternates the large-star and small-star steps: every node's neighbours are linked to the
    smallest of them, until the links form stars.  The minimum per node is an aggregate with
    map-side combining; it is written, and the links meet it in a plain join of two scans, so that
    adaptive execution can split a hub.  No group is gathered.
    """
    links = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        # every u is now above its v
        least = cut(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(least, "u")
        small = small.select("u", F.col("low").alias("v")).union(small.select(F.col("v").alias("u"), F.col("low").alias("v")))
        links = cut(small.filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
