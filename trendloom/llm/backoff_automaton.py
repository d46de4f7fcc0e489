"""Language-model scores from a weighted backoff automaton.

States are histories of at most one token: the empty one (root), the start of a text, and every
token of the training texts.  A state has an arc for every token seen after its history, weighted
with the smoothed log-probability; any other token takes the failure arc, whose weight is added,
to the root, which has an arc for every token and one for unknown ones.  A text is scored by one
walk from left to right that carries the state and adds up the weights.

The smoothing gives a history m(h) pseudo-tokens spread like the root's add-one distribution, a
few of them and as many as the history was seen (frequent histories meet new tokens too):

    P(w | h) = (c(h, w) + m(h) * P(w)) / (c(h) + m(h)),    m(h) = FEW + SHARE * c(h)
    P(w) = (c(w) + 1) / (N + V + 1)

so the failure arc of h weighs log(m(h) / (c(h) + m(h))), and the weights of a state sum to one.

The automaton has as many arcs as the corpus has distinct token pairs, so no task can hold it.
Texts are kept in blocks; a block gets the counts of the tokens and pairs it has itself, which is
all of the automaton that its walks can reach.  Counts move as sorted runs of hashes, one per
block and hash range, summed where the ranges meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm import words as W
from trendloom.llm.common import block_id, cut, in_blocks, utf8

FOLDS = 7
HELD = 2
BLOCK_BYTES = 12 << 20
FEW, SHARE = 20.0, 1.0  # pseudo-tokens of a history
END = np.uint64(0xE703E703E703E703)
START = np.uint64(0x57A2757A2757A275)
PAIR_BITS = 56
# entries of one range and kind: bounds the memory of the task that sums them
RANGE_ENTRIES = 2_000_000


def fold(key: object, folds: int) -> int:
    """crc32 of the key as text, modulo the number of folds; a null key counts as an empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def spread(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def pair_keys(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(history * W.U(0x9FB21C651E98DF25) + token) >> W.U(64 - PAIR_BITS)


def _encode(key: str, text: str):
    """A block: keys, tokens per text, sorted distinct token hashes, and each token's place among them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for number, rows in enumerate(in_blocks(batches, text, BLOCK_BYTES)):
            words = W.split([t.lower() for t in utf8(rows.column(text))])
            n = words.counts + 1
            tokens = np.full(int(n.sum()), END)
            ends = np.cumsum(n) - 1
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside] = words.hashes
            names, places = np.unique(tokens, return_inverse=True)
            held = np.array([fold(k, FOLDS) == HELD for k in rows.column(key).to_pylist()], np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_id(number)]), pa.array([squeeze(n.astype(np.int64))], pa.binary()),
                 pa.array([squeeze(held)], pa.binary()), pa.array([squeeze(names)], pa.binary()),
                 pa.array([squeeze(places.astype(np.uint32))], pa.binary()),
                 pa.array([rows.column(key).to_pylist()], pa.list_(rows.schema.field(key).type))],
                names=["block", "counts", "held", "names", "places", "ids"],
            )

    return run


def _block(row: dict):
    """(tokens per text, held out, token hashes, place of each token, place of its history; -1: the start)."""
    n, held = spread(row["counts"], np.int64), spread(row["held"], np.uint8).astype(bool)
    names, places = spread(row["names"], np.uint64), spread(row["places"], np.uint32).astype(np.int64)
    history = np.concatenate(([-1], places[:-1]))
    history[(np.cumsum(n) - n)] = -1
    return n, held, names, places, history


def _pairs(names: np.ndarray, places: np.ndarray, history: np.ndarray) -> np.ndarray:
    return pair_keys(np.where(history < 0, START, names[history]), names[places])


def _count(ranges: int):
    """Sorted keys of a block and their counts in its training texts, cut by hash range.

    kind 0: tokens; kind 1: pairs.  Keys are sent as differences.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                n, held, names, places, history = _block(row)
                trained = np.repeat(~held, n)
                keys = [names, None]
                counts = [np.bincount(places, weights=trained, minlength=len(names)).astype(np.int64), None]
                keys[1], at = np.unique(_pairs(names, places, history), return_inverse=True)
                counts[1] = np.bincount(at, weights=trained, minlength=len(keys[1])).astype(np.int64)
                for kind in (0, 1):
                    top = (keys[kind] >> W.U((64 if kind == 0 else PAIR_BITS) - 31)).astype(np.int64)
                    edges = np.searchsorted(top * ranges >> 31, np.arange(ranges + 1))
                    for r in range(ranges):
                        lo, hi = edges[r], edges[r + 1]
                        if hi > lo:
                            part = keys[kind][lo:hi]
                            gaps = np.diff(part, prepend=W.U(0))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row["block"]]), pa.array([kind], pa.int32()), pa.array([r], pa.int32()),
                                 pa.array([squeeze(gaps)], pa.binary()), pa.array([squeeze(counts[kind][lo:hi])], pa.binary())],
                                names=["block", "kind", "range", "gaps", "counts"],
                            )

    return run


def _sum(frame: pd.DataFrame) -> pd.DataFrame:
    """Total counts of a range's keys, handed back to every block in the order of its own keys."""
    keys = [np.cumsum(spread(x, np.uint64), dtype=np.uint64) for x in frame["gaps"]]
    counts = np.concatenate([spread(x, np.int64) for x in frame["counts"]])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    back = [squeeze(total[x]) for x in np.split(at, cuts)]
    out = frame[["block", "kind", "range"]].copy()
    out["totals"] = back
    # each range's own sums, on one of its rows
    out["tokens"], out["types"] = 0, 0
    out.iloc[0, out.columns.get_loc("tokens")] = int(total.sum())
    out.iloc[0, out.columns.get_loc("types")] = int((total > 0).sum())
    return out


def _walk(tokens: int, types: int, few: float, share: float):
    """Scores of a block's texts from its part of the automaton."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                n, held, names, places, history = _block(row)
                parts = {(p["kind"], p["range"]): p["totals"] for p in row["parts"]}
                arrays = [[spread(parts[k], np.int64) for k in sorted(parts) if k[0] == kind] for kind in (0, 1)]
                seen = np.concatenate(arrays[0])
                pairs = np.concatenate(arrays[1])
                _, pair = np.unique(_pairs(names, places, history), return_inverse=True)
                # root: one arc per token
                root = np.log10((seen + 1.0) / (tokens + types + 1.0))
                # states: occurrences as a history; the end is followed by nothing
                starts = int(seen[names == END].sum())
                occurs = np.where(history < 0, starts, seen[history]).astype(np.float64)
                pseudo = few + share * occurs
                fail = np.log10(pseudo / (occurs + pseudo))
                base = root[places]
                times = pairs[pair]
                arc = np.log10((times + pseudo * np.power(10.0, base)) / (occurs + pseudo))
                step = np.where(times > 0, arc, fail + base)
                first = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"]), pa.array(held), pa.array(n), pa.array(np.add.reduceat((seen > 0)[places].astype(np.int64), first)),
                     pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(step, first))],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", few: float = FEW, share: float = SHARE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose crc32(key as text) modulo 7 is not 2 (a null key counts as an empty
    text); A-Z is lower-cased, a text's tokens are its words and one end.  A null text is empty.
    Without training rows every token is unknown and the scores come from the one unseen type.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    blocks = cut(rows.mapInArrow(
        _encode("id", "text"),
        f"block long, counts binary, held binary, names binary, places binary, ids array<{kind}>",
    ))
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0]
    # a token's place takes one byte or more when packed; at most one pair per token
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-size // RANGE_ENTRIES))
    chunks = blocks.select("block", "counts", "held", "names", "places").withColumn("ids", F.lit(None)).mapInArrow(
        _count(ranges), "block long, kind int, range int, gaps binary, counts binary"
    )
    parts = cut(chunks.groupBy("kind", "range").applyInPandas(
        _sum, "block long, kind int, range int, totals binary, tokens long, types long"
    ))
    tokens, types = parts.filter("kind = 0").agg(F.sum("tokens"), F.sum("types")).first()
    own = parts.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "totals")).alias("parts"))
    scored = blocks.join(own, "block").mapInArrow(
        _walk(tokens or 0, types or 0, few, share),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens or 0).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
