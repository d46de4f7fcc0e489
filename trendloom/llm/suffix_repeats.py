"""Repeated passages of at least 50 words, by prefix-partitioned suffix trees.

Every word position starts a suffix; two documents share a window of 50 words exactly where two
suffixes share a path of that depth.  Suffixes are cut at depth 50 and carried as three edge
labels, fingerprints of the words 1-16, 17-32 and 33-50.  The trees are cut into ranges of
label prefixes: a range boundary is as long a prefix as is needed to bound a range's size, so a
common prefix is divided further down and a rare one shares its range with others.  Inside a
range the suffixes are in lexicographic order and one scan over the depths shared by neighbours
meets the internal nodes; nodes of depth 50 over more than one document are the repeats.

Most suffixes have no counterpart.  They are left out by a lossless filter: equal windows have
the same smallest 32-word shingle, so a window is kept only if its smallest shingle is smallest
in a window of a different text too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm import words as W
from trendloom.llm.common import LAST_ID, cut, tidy, unpack, utf8, write_blocks

WINDOW = 50
ANCHOR = 32
LABELS = (0, 16, 32, 50)  # depths at which a suffix is labelled
BLOCK_BYTES = 1 << 20  # of text; what a worker holds for a block is some thirty times as much (measured at 4 MB)


def _ids(rows: pa.Table, key: str) -> np.ndarray:
    """Keys as integers; a row without one comes after all others."""
    return rows.column(key).fill_null(LAST_ID).to_numpy().astype(np.int64)


def _longs(items: pa.ListScalar, field: str | None = None) -> np.ndarray:
    """A list of integers (or of one field of its structs), without making Python objects."""
    if not items.is_valid:
        return np.zeros(0, np.int64)
    values = items.values if field is None else items.values.field(field)
    return values.to_numpy(zero_copy_only=False)


def _text_hash(texts: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts], dtype=np.uint64)


def _suffixes(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, smallest shingle, number of the text) of every window."""
    start = np.flatnonzero(words.doc[:max(0, len(words.doc) - WINDOW + 1)] == words.doc[WINDOW - 1:])
    if not len(start):
        return start, np.zeros(0, W.U), start
    n = len(words.hashes) - ANCHOR + 1
    at = np.arange(n)
    shingle = W.range_hashes(words.hashes, at, at + ANCHOR, W.WORD_BASE)
    smallest, span = shingle, 1  # over ``span`` shingles from each position
    while span < WINDOW - ANCHOR + 1:
        step = min(span, WINDOW - ANCHOR + 1 - span)
        smallest = np.minimum(smallest[:-step], smallest[step:])
        span += step
    return start, smallest[start], words.doc[start]


def _anchors(key: str, text: str):
    """(block, shingle, low, high): smallest shingles of a block with the text hashes they are in,
    and (block, text hash, key) of every text with a window."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                rows = unpack(payload.as_py())
                texts = utf8(rows.column(text))
                ids, hashes = _ids(rows, key), _text_hash(texts)
                _, small, doc = _suffixes(W.split(texts))
                long_enough = np.unique(doc)
                order = np.argsort(small, kind="stable")
                small, owner = small[order], hashes[doc[order]]
                first = np.flatnonzero(np.concatenate(([True], small[1:] != small[:-1]))) if len(small) else []
                low = np.minimum.reduceat(owner, first) if len(first) else owner
                high = np.maximum.reduceat(owner, first) if len(first) else owner
                kinds = np.concatenate((np.zeros(len(first), np.int32), np.ones(len(long_enough), np.int32)))
                value = np.concatenate((small[first] if len(first) else small, hashes[long_enough])).view(np.int64)
                none = np.full(len(long_enough), LAST_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), block)), pa.array(kinds), pa.array(value),
                     pa.array(np.concatenate((low.view(np.int64), ids[long_enough]))),
                     pa.array(np.concatenate((high.view(np.int64), none)))],
                    names=["block", "kind", "value", "low", "high"],
                )

    return run


def _row_mark(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for a key and a text: rows of one key can have different texts."""
    return W.mix(ids.view(np.uint64) ^ W.mix(hashes.view(np.uint64)))


def _candidates(rows: pa.Table, key: str, text: str, copies: pa.Scalar):
    """Words, keys and the texts of a block that have an equal text under a smaller key."""
    texts = utf8(rows.column(text))
    ids = _ids(rows, key)
    copy = np.isin(_row_mark(ids, _text_hash(texts)), _row_mark(_longs(copies, "id"), _longs(copies, "hash")))
    return texts, ids, copy, W.split([b"" if c else t for t, c in zip(texts, copy)])


def _leaves(key: str, text: str):
    """Distinct suffixes of a block that may repeat: labels, smallest and largest key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                rows = unpack(batch.column("payload")[k].as_py())
                _, ids, _, words = _candidates(rows, key, text, batch.column("copies")[k])
                start, small, doc = _suffixes(words)
                shared = _longs(batch.column("shared")[k]).view(np.uint64)
                keep = np.isin(small, shared)
                start, owner = start[keep], ids[doc[keep]]
                if not len(start):
                    continue
                labels = [W.range_hashes(words.hashes, start + a, start + b, W.WORD_BASE) for a, b in zip(LABELS, LABELS[1:])]
                order = np.lexsort((*labels[::-1],))
                labels, owner = [x[order] for x in labels], owner[order]
                new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in labels], axis=0)))
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), block)), *[pa.array(x[first].view(np.int64)) for x in labels],
                     pa.array(np.minimum.reduceat(owner, first)), pa.array(np.maximum.reduceat(owner, first))],
                    names=["block", "a", "b", "c", "low", "high"],
                )

    return run


def shared_depth(labels: list[np.ndarray]) -> np.ndarray:
    """Depth (words) that each suffix shares with the one before it; -1 for the first."""
    n = len(labels[0])
    depth = np.full(n, -1)
    if n:
        depth[1:] = 0
        same = np.ones(n - 1, bool)
        for x, at in zip(labels, LABELS[1:]):
            same &= x[1:] == x[:-1]
            depth[1:][same] = at
    return depth


def _deep_nodes(batches: Iterator[pa.RecordBatch]):
    """(block, a, b, c, low) of every leaf below a node of depth 50 with an earlier document.

    Sorted suffixes; a fall of the shared depth below 50 closes the open deep node.  The leaves
    of one node are distinct blocks, so what is carried between batches is bounded by their number.
    """
    held: pa.Table | None = None

    def close(rows: pa.Table, depth: np.ndarray):
        first = np.flatnonzero(depth < WINDOW)
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        earliest = np.minimum.reduceat(low, first)[np.cumsum(depth < WINDOW) - 1]
        keep = pa.array(high > earliest)
        out = rows.set_column(rows.schema.get_field_index("low"), "low", pa.array(earliest)).filter(keep)
        return out.select(["block", "a", "b", "c", "low"]).combine_chunks().to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not len(rows):
            continue
        depth = shared_depth([rows.column(c).to_numpy() for c in ("a", "b", "c")])
        last = int(np.flatnonzero(depth < WINDOW)[-1])
        held = rows.slice(last)
        if last:
            yield from close(rows.slice(0, last), depth[:last])
    if held is not None and len(held):
        yield from close(held, np.concatenate(([-1], np.full(len(held) - 1, WINDOW))))


def _name(labels: list[np.ndarray]) -> np.ndarray:
    return W.mix(labels[0] ^ W.mix(labels[1] ^ W.mix(labels[2])))


def _removal(key: str, text: str, name: str, results: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(len(batch)):
                rows = unpack(batch.column("payload")[at].as_py())
                shared = _longs(batch.column("shared")[at]).view(np.uint64)
                texts, ids, copy, words = _candidates(rows, key, text, batch.column("copies")[at])
                value = _longs(batch.column("repeats")[at], "name").view(np.uint64)
                low = _longs(batch.column("repeats")[at], "low")
                order = np.argsort(value)
                value, low = value[order], low[order]
                covered = np.zeros(len(words.hashes) + 1, np.int64)
                start, small, doc = _suffixes(words)
                if len(value):
                    near = np.isin(small, shared)
                    start, doc = start[near], doc[near]
                    labels = [W.range_hashes(words.hashes, start + a, start + b, W.WORD_BASE) for a, b in zip(LABELS, LABELS[1:])]
                    names = _name(labels)
                    place = np.minimum(np.searchsorted(value, names), len(value) - 1)
                    gone = (value[place] == names) & (ids[doc] > low[place])
                    np.add.at(covered, start[gone], 1)
                    np.add.at(covered, start[gone] + WINDOW, -1)
                removed = np.cumsum(covered[:-1]) > 0
                first = words.first
                n_words, n_removed, kept = [], [], []
                for k, t in enumerate(texts):
                    all_words = t.split()
                    flags = removed[first[k]:first[k] + words.counts[k]]
                    if copy[k] and len(all_words) >= WINDOW:
                        left = []
                    elif copy[k] or not flags.any():
                        left = all_words
                    else:
                        left = [w for w, f in zip(all_words, flags.tolist()) if not f]
                    n_words.append(len(all_words))
                    n_removed.append(len(all_words) - len(left))
                    kept.append(b" ".join(left))
                extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                if name is None:
                    extra[2] = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                table = pa.Table.from_arrays([*rows.columns, *extra], schema=results)
                yield from table.combine_chunks().to_batches(max_chunksize=1000)

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", kept: str | None = "kept_text") -> DataFrame:
    """``df`` with n_words, n_removed and the text that is left (or its SHA-256 as kept_sha256).

    A word goes if a window of 50 words over it, as the input has it, also starts in a row with a
    smaller key; what is left is joined by single spaces.  A null text has no words.  A row
    without a key comes after all others; rows of one key, or without any, do not remove each other.  Texts of fewer
    than 50 words lose nothing.  Equal texts are met first: all but the one with the smallest key
    go whole, and only that one enters the trees.
    """
    schema = df.schema
    result = kept or "kept_sha256"
    for c in ("n_words", "n_removed", result):
        if c.lower() in {x.lower() for x in df.columns}:
            raise ValueError(f"the input has a column named {c}")
    blocks = write_blocks(df, text, BLOCK_BYTES)
    facts = cut(blocks.mapInArrow(_anchors(key, text), "block long, kind int, value long, low long, high long"))
    # texts that occur more than once: all rows but the first
    same = facts.filter("kind = 1").select("block", F.col("value").alias("hash"), F.col("low").alias("id"))
    first = cut(same.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last"))
    copies = same.join(first, "hash").filter("id > first").groupBy("block").agg(F.collect_set(F.struct("id", "hash")).alias("copies"))
    # smallest shingles met in different texts
    small = facts.filter("kind = 0").select("block", "value", "low", "high")
    met = small.groupBy("value").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("value")
    shared = small.select("block", "value").join(met, "value").groupBy("block").agg(F.collect_list("value").alias("shared"))
    wanted = cut(shared.join(copies, "block", "full"))

    leaves = blocks.join(wanted.filter("shared is not null"), "block").mapInArrow(
        _leaves(key, text), "block long, a long, b long, c long, low long, high long"
    )
    leaves = cut(leaves)
    tree = leaves.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    nodes = tree.mapInArrow(_named_nodes, "block long, name long, low long")
    repeats = nodes.groupBy("block").agg(F.collect_list(F.struct("name", "low")).alias("repeats"))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    out = StructType([*schema.fields]).add("n_words", LongType()).add("n_removed", LongType()).add(result, StringType())
    ready = blocks.join(wanted, "block", "left").join(repeats, "block", "left")
    return ready.mapInArrow(_removal(key, text, kept, to_arrow_schema(out)), out)


@tidy
def _named_nodes(batches: Iterator[pa.RecordBatch]):
    """``_deep_nodes`` with the name of each node, in one worker."""
    for batch in _deep_nodes(batches):
        labels = [batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b", "c")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), pa.array(_name(labels).view(np.int64)), batch.column("low")], names=["block", "name", "low"]
        )
