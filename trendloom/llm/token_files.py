"""Token-id files: frequency-ranked ids in byte-aligned code with separate control bytes.

Ids are replaced by their rank by frequency, so that frequent ones take one byte.  A document is
two byte strings: control bytes, two bits per id with the number of its bytes less one, and the
bytes of the ranks, least significant first.  Readers look a control byte up in a table of 256
rows and gather all ranks of a document at once.

A folder holds the table of ranks and the documents in parts; parts and the documents in them are
in ascending key order, and a document says how many ids of its part are before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import drop, offsets, running_offsets, save, sized, small, tidy
from trendloom.llm.tokenized import AT_ONCE, Cached

END_ID = 2
# Fixed by the format: bytes of each of the four ids of a control byte.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_documents(ranks: np.ndarray, edges: np.ndarray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """(control bytes, data bytes) of each document's ranks, which begin and end at ``edges``."""
    size = 1 + (ranks > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        size += ranks > limit
    n = np.diff(edges)
    last = np.cumsum(-(-n // 4))
    codes = np.zeros(4 * int(last[-1]) if len(n) else 0, np.uint8)
    codes[_filled(n, last)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    most = int(size.max(initial=1))
    raw = ranks.astype("<u2" if most <= 2 else "<u4").view(np.uint8).reshape(-1, 2 if most <= 2 else 4)[:, :most]
    data = raw[np.arange(most) < size[:, None]]
    return _binary(np.concatenate(([0], last)), control), _binary(np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[edges], data)


def decode_documents(control: pa.BinaryArray, data: pa.BinaryArray, n: np.ndarray) -> np.ndarray:
    """Ranks of neighbouring documents in a row; ``n``: how many each has."""
    bounds = offsets(control)
    size = SIZES[_bytes(control)].reshape(-1)[_filled(n, bounds[1:] - bounds[0])]
    start = np.cumsum(size) - size
    raw = np.concatenate((_bytes(data), np.zeros(4, np.uint8)))
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, raw[start + k], np.uint8(0)).astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of one document's ranks."""
    control, data = encode_documents(ranks, np.array([0, len(ranks)]))
    return control[0].as_py(), data[0].as_py()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return decode_documents(pa.array([control], pa.binary()), pa.array([data], pa.binary()), np.array([n]))


def _filled(n: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the four places of each control byte are taken; a document's control bytes end at ``last``."""
    filled = np.ones(4 * int(last[-1]) if len(last) else 0, bool)
    for k in range(1, 4):
        filled[4 * last[-n % 4 >= k] - k] = False
    return filled


def _bytes(items: pa.BinaryArray) -> np.ndarray:
    bounds = offsets(items)
    data = items.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)


def _binary(edges: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str, leading_space: bool, end_id: int) -> DataFrame:
    """(id, ids): ids of every whole text as little-endian 16-bit integers, then the end id."""
    kind = df.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        table = Cached(tokenizer, leading_space)
        end = pa.scalar(end_id.to_bytes(2, "little"))
        for batch in sized(batches, 1, AT_ONCE):
            ids = pc.binary_join_element_wise(table.encode_column(batch.column(1)), end, b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch]):
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["token", "n"])


def _encode(rank_of: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        part, before = TaskContext.get().partitionId(), 0
        for batch in small(batches):
            ids = batch.column("ids")
            edges = offsets(ids).astype(np.int64) // 2  # of ids of two bytes each
            edges -= edges[0]
            starts, n = before + edges[:-1], np.diff(edges)
            before += int(edges[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("id"), pa.array(starts), pa.array(n),
                 *encode_documents(rank_of[_bytes(ids).view("<u2")], edges)],
                names=["part", "id", "before", "n", "control", "data"],
            )

    return run


def write_ids(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", leading_space: bool = True,
              end_id: int = END_ID) -> None:
    """Encode all of ``df`` into the folder ``path``; a null text has the end id only, null keys come first.

    The table of ranks has at most one row per vocabulary entry (fewer than 65,536).
    """
    spark = df.sparkSession
    plain, scratch = save(token_ids(df, key, text, tokenizer, leading_space, end_id))
    counts = plain.mapInArrow(_frequencies, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r.token for r in sorted(counts.collect(), key=lambda r: (-r.n, r.token))]
    ranks = [(k, t) for k, t in enumerate(tokens)]
    spark.createDataFrame(ranks, "rank int, token int").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[tokens] = np.arange(len(tokens), dtype=np.uint32)
    kind = plain.schema["id"].dataType.simpleString()
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id")
    coded = ordered.mapInArrow(_encode(rank_of), f"part int, id {kind}, before long, n long, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{path}/documents")
    drop(spark, scratch)


def read_ids(spark: SparkSession, path: str, reduce=None, schema: str = "ids binary") -> DataFrame:
    """(id, start, n_tokens, ...) of every document of the folder.

    start: ids of all documents before it.  ``reduce`` turns a document's ids (numpy) into a row
    of the further columns in ``schema``; by default they are all its ids, as little-endian
    unsigned 32-bit integers.
    """
    token_of = np.zeros(1 << 16, np.uint32)
    for r in spark.read.parquet(f"{path}/ranks").collect():
        token_of[r.rank] = r.token
    files = spark.read.parquet(f"{path}/documents")
    reduce = reduce or (lambda ids: (ids.astype("<u4").tobytes(),))
    kind = files.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(",")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            n = batch.column("n").to_numpy()
            ids, edges = token_of[decode_documents(batch.column("control"), batch.column("data"), n)], np.cumsum([0, *n])
            rows = [reduce(ids[start:end]) for start, end in zip(edges[:-1].tolist(), edges[1:].tolist())]
            extra = [pa.array(list(x)) for x in zip(*rows)] if rows else [pa.array([])] * len(names)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in ("part", "id", "before", "n")), *extra], names=["part", "id", "before", "n", *names]
                )

    parts = files.groupBy("part").agg(F.sum("n").alias("m"))
    parts = running_offsets(parts, [], "part", "m", "offset").drop("m")
    decoded = files.mapInArrow(run, f"part int, id {kind}, before long, n long, {schema}")
    return decoded.join(F.broadcast(parts), "part").select(  # a row per written part, of part numbers only
        "id", (F.col("offset") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), *names
    )


def checksum(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
