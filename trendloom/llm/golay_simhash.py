"""SimHash near-duplicates, found with keys from the perfect Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Every 23-bit word lies within
three bits of exactly one codeword of the binary Golay code, so a segment has one codeword index
(12 bits), and a segment with one wrong bit has at most six.  With three wrong bits in all,
either one segment is right and another has at most one wrong bit, or each has exactly one:
seven patterns of keys find every pair, and the pairs are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import components, cut, small, tidy, utf8

SHINGLE = 3
SEED = 42
RADIUS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


# --- fingerprints ----------------------------------------------------------------------------

def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a text's shingles of lower-cased words, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # A-Z, and 0x20 and 0x09-0x0D, in bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        values = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-size])).tolist()
        digest = xxhash.xxh64_intdigest
        values = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = np.array(values[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            found = np.array([fingerprint(t) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# --- keys ------------------------------------------------------------------------------------

def _remainders() -> np.ndarray:
    """Check bits of each of the 4096 messages: message * x^11 modulo the generator."""
    x = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def _errors(checks: np.ndarray) -> np.ndarray:
    """The one pattern of at most three wrong bits behind each of the 2048 syndromes."""
    one = np.int64(1) << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    patterns = np.unique(np.concatenate(([0], three)))
    table = np.zeros(1 << 11, np.int64)
    table[checks[patterns >> 11] ^ (patterns & 0x7FF)] = patterns
    return table


CHECKS = _remainders()
ERRORS = _errors(CHECKS)


def decode(x: np.ndarray) -> np.ndarray:
    """Index (message) of the codeword within three bits of each 23-bit word."""
    return (x ^ ERRORS[CHECKS[x >> 11] ^ (x & 0x7FF)]) >> 11


def nearby(x: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of all words within one bit of x, a row each; repeats become -1."""
    flips = np.concatenate((np.zeros(1, np.int64), np.int64(1) << np.arange(bits)))
    found = np.sort(decode(x[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _pattern_keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, key, probe): one home key per pattern, several probe keys.

    u and v within three bits share a home key of u and a probe key of v.
    """
    fp = fp.view(np.uint64)
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    home = [decode(p) for p in parts]
    near = [nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows = np.arange(len(fp))
    pattern = 0
    for a in range(3):
        for b in range(3):
            if a == b:
                continue
            base = (pattern << 34) | (parts[a] << 12)
            yield rows, base | home[b], False
            r, c = np.nonzero(near[b] >= 0)
            yield r, base[r] | near[b][r, c], True
            pattern += 1
    odd = np.bitwise_count(parts[2]).astype(np.int64) & 1
    yield rows, (pattern << 34) | (odd << 24) | (home[0] << 12) | home[1], False
    r, c = np.nonzero(near[0] >= 0)
    for k in range(near[1].shape[1]):
        second = near[1][r, k]
        keep = second >= 0
        rk = r[keep]
        yield rk, (pattern << 34) | ((1 - odd[rk]) << 24) | (near[0][rk, c[keep]] << 12) | second[keep], True


def _emit(probe: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            node, fp = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, keys, kind in _pattern_keys(fp):
                if kind == probe and len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), node.take(pa.array(rows)), pa.array(fp[rows])], names=["key", "node", "fp"]
                    )

    return run


def close_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): nodes of ``classes`` (node, fp; fp unique) whose fingerprints differ in 1 to 3 bits.

    The keys, some seventy rows a class, are joined by merge at every size: Spark takes them for as small as the classes
    and would send them whole through the driver.
    """
    kind = classes.schema["node"].dataType.simpleString()
    schema = f"key long, node {kind}, fp long"
    source = classes.select("node", "fp")
    home = source.mapInArrow(_emit(False), schema)
    probe = source.mapInArrow(_emit(True), schema).select("key", F.col("node").alias("other"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    met = home.join(probe.hint("merge"), (home["key"] == probe["key"]) & (F.col("fp") < F.col("fp2")) & near)
    return met.select(F.col("node").alias("u"), F.col("other").alias("v"))


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``df``.

    component_id is the smallest key reachable over fingerprints at most three bits apart.  Rows
    of one fingerprint are a class and are joined back only at the end; a null or wordless text
    has fingerprint zero and links like any other.  Rows without a key link with nothing and
    have no component.  Columns besides the two are not read.
    """
    marked = cut(fingerprints(df, key, text))
    classes = cut(marked.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    groups = components(close_pairs(classes))
    found = classes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = marked.join(found, "fp", "left")
    return out.select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
