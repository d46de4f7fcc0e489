"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

A text leaks an item if one of its windows of as many words has a weighted similarity of at least
0.8 with it: sum of the smaller over sum of the larger counts of their five-word shingles (texts
and items of fewer words: the whole sequence).  A text shorter than the item is judged whole.  Words
are lower-cased in A-Z.

Only windows that share a shingle with an item of their size can be similar; they get SimHash
fingerprints.  Eight blocks of eight bits are looked up in tables that hold, for each block value,
the items within three bits of it: by the pigeonhole principle this finds every item within 24
bits.  Candidates are then verified on the words themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trendloom.llm import words as W
from trendloom.llm.common import cut, small, tidy, utf8

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS, BLOCK_BITS = 8, 8
PART = 2000  # items whose tables a task holds at once
FILTER_BITS = 22
AT_ONCE = 1024


def shingle_size(n_words: int) -> int:
    return min(SHINGLE, n_words)


def shingles(words: list[bytes]) -> Counter:
    k = shingle_size(len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def fingerprints(values: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; repeats weigh as often as they occur."""
    out = []
    for at in range(0, len(values), AT_ONCE):
        part = np.ascontiguousarray(values[at:at + AT_ONCE]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2, bitorder="little")
        ones = bits.reshape(len(part), part.shape[1], 64).sum(axis=1, dtype=np.int32)
        out.append(np.packbits(2 * ones > part.shape[1], axis=1, bitorder="little").view("<u8")[:, 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def near_tables(prints: np.ndarray) -> np.ndarray:
    """[block, value, item]: the item's block differs from the value in at most RADIUS / BLOCKS bits."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    tables = []
    for b in range(BLOCKS):
        own = (prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
        tables.append(np.bitwise_count(values[:, None] ^ own[None, :]) <= RADIUS // BLOCKS)
    return np.array(tables)


def within_radius(prints: np.ndarray, items: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of all pairs within RADIUS bits, from the blocks' tables."""
    rows, cols = [], []
    for at in range(0, len(prints), AT_ONCE):
        part = prints[at:at + AT_ONCE]
        met = np.zeros((len(part), len(items)), bool)
        for b in range(BLOCKS):
            met |= tables[b][((part >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)]
        r, c = np.nonzero(met)
        keep = np.bitwise_count(part[r] ^ items[c]) <= RADIUS
        rows.append(r[keep] + at)
        cols.append(c[keep])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


@dataclass
class Index:
    """Tables of at most PART items."""

    ids: list
    words: list[list[bytes]]
    counts: list[Counter] = field(default_factory=list)
    by_size: dict[int, np.ndarray] = field(default_factory=dict)
    prints: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    # shingle length -> (sorted hash, size of an item that holds it), pairs
    shared: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[object, bytes]]) -> Index:
        split = [(i, t.lower().split()) for i, t in items]
        index = cls([i for i, w in split if w], [w for _, w in split if w])
        index.counts = [shingles(w) for w in index.words]
        sizes = np.array([len(w) for w in index.words])
        pairs: dict[int, set] = {}
        for n in sorted(set(sizes.tolist())):
            k = shingle_size(n)
            own = np.flatnonzero(sizes == n)
            hashes = W.windows(W.split([b" ".join(index.words[i]) for i in own]), k)[0].reshape(len(own), n - k + 1)
            index.by_size[n], index.prints[n] = own, fingerprints(hashes)
            index.tables[n] = near_tables(index.prints[n])
            pairs.setdefault(k, set()).update((int(h), n) for h in hashes.ravel())
        for k, found in pairs.items():
            order = sorted(found)
            hashes = np.array([h for h, _ in order], np.uint64)
            index.shared[k] = hashes, np.array([n for _, n in order])
            index.filters[k] = np.zeros(1 << FILTER_BITS, bool)
            index.filters[k][hashes >> np.uint64(64 - FILTER_BITS)] = True
        return index

    def leaks(self, texts: list[bytes]) -> list[dict[int, tuple[float, int]]]:
        """Per text: item number -> (best similarity, first word of the first such window)."""
        lowered = [t.lower() for t in texts]
        words = W.split(lowered)
        first = words.first
        found: list[dict] = [{} for _ in texts]
        spelled: dict[int, list[bytes]] = {}
        starts: dict[int, list[np.ndarray]] = {}
        short: dict[int, set[int]] = {}  # size -> texts of fewer words
        hashed = {}
        for k, (hashes, sizes) in self.shared.items():
            values, at = W.windows(words, k)
            hashed[k] = np.zeros(len(words.hashes), np.uint64)
            hashed[k][at] = values
            maybe = self.filters[k][values >> np.uint64(64 - FILTER_BITS)]
            values, at = values[maybe], at[maybe]
            lo, hi = np.searchsorted(hashes, values), np.searchsorted(hashes, values, side="right")
            while (lo < hi).any():  # one step per size that holds the shingle
                live = lo < hi
                values, at, lo, hi = values[live], at[live], lo[live], hi[live]
                n = sizes[lo]
                lo = lo + 1
                for size in np.unique(n).tolist():
                    hit = at[n == size]
                    begin = np.unique(hit[:, None] - np.arange(size - k + 1)[None, :])
                    starts.setdefault(size, []).append(begin)
                    near = np.unique(words.doc[hit])
                    n_shingles = words.counts[near] - k + 1
                    # all of the text's shingles in the item's: the most that they can have in common
                    enough = (words.counts[near] < size) & (n_shingles >= SIMILARITY * (size - k + 1) - 1e-9)
                    short.setdefault(size, set()).update(near[enough].tolist())

        def verify(size: int, length: int, some: np.ndarray) -> None:
            """Compare windows of ``length`` words, from the positions ``some``, with the items of ``size`` words."""
            nonlocal spelled
            k = shingle_size(size)
            prints = fingerprints(hashed[k][some[:, None] + np.arange(length - k + 1)[None, :]])
            rows, cols = within_radius(prints, self.prints[size], self.tables[size])
            for b, item in zip(some[rows].tolist(), self.by_size[size][cols].tolist()):
                doc = int(words.doc[b])
                if doc not in spelled:
                    spelled = {doc: lowered[doc].split()}
                place = b - int(first[doc])
                value = similarity(shingles(spelled[doc][place:place + length]), self.counts[item])
                if value >= SIMILARITY and (item not in found[doc] or (-value, place) < (-found[doc][item][0], found[doc][item][1])):
                    found[doc][item] = (value, place)

        for size, docs in short.items():
            docs = np.array(sorted(docs), np.int64)
            for length in np.unique(words.counts[docs]).tolist():
                verify(size, length, first[docs[words.counts[docs] == length]])
        for size, parts in starts.items():
            begin = np.unique(np.concatenate(parts))
            begin = begin[(begin >= 0) & (begin + size <= len(words.hashes))]
            begin = begin[words.doc[begin] == words.doc[begin + size - 1]]
            for at in range(0, len(begin), AT_ONCE):
                verify(size, size, begin[at:at + AT_ONCE])
        return found


def indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """The items in parts of at most PART: what is sent to tasks at once has a fixed number of items."""
    held = []
    for row in items.select(key, text).orderBy(key, text).toLocalIterator():
        held.append((row[0], (row[1] or "").encode()))
        if len(held) == PART:
            yield Index.of(held)
            held = []
    if held:
        yield Index.of(held)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """(key, item_key, similarity, first_word, n_words), one row per text and item that it leaks.

    The best window counts, the first of equals.  Null and empty texts and items leak nothing;
    repeated items are reported each.  Item keys may be null.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found_type = to_arrow_type(items.schema[item_key].dataType)
    schema = f"id {kind}, item {item_kind}, similarity double, first_word long, n_words long"
    parts = []
    for index in indexes(items, item_key, item_text):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], index=index):
            for part in small(batches):
                out = [
                    (i, index.ids[item], value, place, len(index.words[item]))
                    for i, hits in zip(part.column(0).to_pylist(), index.leaks(utf8(part.column(1))))
                    for item, (value, place) in sorted(hits.items())
                ]
                if out:
                    ids, found, *rest = zip(*out)
                    frame = [pa.array(ids, part.column(0).type), pa.array(found, found_type), *(pa.array(c) for c in rest)]
                    yield pa.RecordBatch.from_arrays(frame, names=["id", "item", "similarity", "first_word", "n_words"])

        parts.append(rows.mapInArrow(run, schema) if not parts else cut(rows.mapInArrow(run, schema)))
    if not parts:
        out = docs.sparkSession.createDataFrame([], schema)
    else:
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
    return out.select(F.col("id").alias(key), F.col("item").alias(item_key), "similarity", "first_word", "n_words")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, as they are."""
    for index in indexes(items, item_key, item_text):

        @tidy
        def clean(batches: Iterator[pa.RecordBatch], index=index):
            for part in small(batches):
                yield part.filter(pa.array([not hits for hits in index.leaks(utf8(part.column(text)))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
