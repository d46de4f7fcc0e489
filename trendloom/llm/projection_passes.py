"""Near-duplicate vectors by sorted projection passes.

Every pass draws random hyperplanes, concatenates the hashes that they give a vector, sorts the
vectors by that string and compares each with a bounded window of followers.  Rows that share the
first bits of a pass's string are a run; a run that is longer than the window is compared whole
instead, in pairs of chunks.  So a pass meets every pair that shares these bits, however crowded a
place is, and the number of bits alone says how many passes miss a pair at the threshold with a
probability of at most MISS.  How many bits make the least work is counted over all vectors.
Verified links of all passes are united.  Passes can miss links inside a crowd of close vectors, so the members
of each component are compared once more, chunk by chunk, which makes the counts of links whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import components, cut

MISS = 0.001
WINDOWS = (32, 64, 128, 256, 512, 1024)
LEAST_PASSES = 16
SHIPPING = 400  # comparisons that cost as much as sending a vector through the shuffle of a pass
TRIALS = 16  # passes that ``hit_rates`` sorts its vectors into
KEY_BITS = 64
RUN_BITS = 24  # at most, of a run's prefix
CHUNK = 256
RUN_CHUNK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all vectors of the column have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> F.Column:
    """Not null, not empty, every component finite, at least one not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def hit_rates(x: np.ndarray, n: int, threshold: float, windows: tuple[int, ...] = WINDOWS, seed: int = 7) -> np.ndarray:
    """[window, vector]: chance that one pass over ``n`` vectors, of which the unit rows of ``x`` are a
    sample, puts a sampled vector and one at the threshold of it into one window.

    They are in one window if they share a prefix that no more than a window of rows have.  Rows linked
    with the vector do not count: they are in its component, and so is what is linked with them.
    """
    rng = np.random.default_rng([seed, 1])
    same_bit = 1 - np.arccos(min(1.0, threshold)) / np.pi
    rates = np.zeros((len(windows), len(x)))
    other = x @ x.T < threshold
    scale = n / max(1, len(x))
    for _ in range(TRIALS):
        bits = x @ rng.standard_normal((x.shape[1], KEY_BITS)) > 0
        share, counts = other.copy(), []
        for m in range(KEY_BITS):
            counts.append(share.sum(axis=1))
            if not counts[-1].any():
                break
            share &= bits[:, m][:, None] == bits[:, m][None, :]
        sharing = np.array(counts, np.float64)  # [prefix bits, vector]
        # below 8 sampled rows the counts are continued at the rate at which they fell before
        bits_known = (sharing >= 8).sum(axis=0)
        last = np.maximum(bits_known - 1, 0)
        at_last = sharing[last, np.arange(len(x))]
        fall = np.where(last > 0, (at_last / np.maximum(sharing[0], 1)) ** (1 / np.maximum(last, 1)), 0.5)
        fall = np.clip(fall, 0.5, 0.98)
        for k, w in enumerate(windows):
            # the first prefix length with at most a window of rows
            more = np.log(np.maximum(np.maximum(at_last, 1) * scale / w, 1)) / -np.log(fall)
            length = np.where(at_last * scale > w, last + more, (sharing * scale > w).sum(axis=0))
            rates[k] += same_bit ** np.minimum(length, KEY_BITS) / TRIALS
    return rates


def plan(x: np.ndarray, n: int, threshold: float, seed: int = 7) -> tuple[int, int]:
    """(passes, window) of least work with which windows alone let the densest of some vectors meet one at the threshold.

    For callers who look at their own vectors; ``near_vectors`` takes nothing from it, as it compares long runs whole.
    """
    if not len(x) or threshold >= 1:
        return LEAST_PASSES, WINDOWS[0]
    worst = hit_rates(x, n, threshold, seed=seed).min(axis=1)
    needed = [max(LEAST_PASSES, int(np.ceil(np.log(MISS) / np.log1p(-min(h, 0.999))))) for h in worst]
    return min(zip(needed, WINDOWS), key=lambda c: c[0] * (c[1] + SHIPPING))


def passes_for(bits: int, threshold: float) -> int:
    """Passes that miss a pair at the threshold with a probability of at most MISS, if each compares all rows that share ``bits`` bits."""
    together = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(together, 0.999)))))


def _run_counts(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(pass, dim, prefix, n): rows of every run of all vectors."""
    counted = classes.select("dim", "node", "vector").mapInArrow(_keys(passes, bits, seed, counts=True), "pass int, dim int, prefix int, n long")
    return counted.groupBy("pass", "dim", "prefix").agg(F.sum("n").alias("n"))


def _bits_of_least_work(classes: DataFrame, threshold: float, seed: int) -> tuple[int, float]:
    """(bits, comparisons a row): the length of a run's prefix with the least work, by the runs of all vectors in one pass.

    Whatever the length, the passes of ``passes_for`` meet the same share of pairs.
    """
    longest = cut(_run_counts(classes, 1, RUN_BITS, seed))
    lengths = longest.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(RUN_BITS))))
    prefix = F.expr(f"shiftright(prefix, {RUN_BITS} - bits)").alias("prefix")
    sizes = lengths.groupBy("bits", "dim", prefix).agg(F.sum("n").cast("double").alias("n"))
    work = {r["bits"]: (r["rows"], r["pairs"]) for r in sizes.groupBy("bits").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}
    if not work:
        return 0, 0.0
    bits = min(work, key=lambda m: passes_for(m, threshold) * (SHIPPING * work[m][0] + work[m][1]))
    return bits, work[bits][1] / work[bits][0]


def _keys(passes: int, bits: int, seed: int, counts: bool = False):
    """Rows of (pass, key, prefix, dim, node, vector) for every class of equal vectors, or the number of rows per (pass, dim, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in sorted(set(batch.column("dim").to_pylist())):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                x = _matrix(part.column("vector"))
                width = KEY_BITS // 8
                if dim not in planes:
                    drawn = np.random.default_rng([seed, dim])
                    planes[dim] = [drawn.standard_normal((dim, KEY_BITS)) for _ in range(passes)]
                for p in range(passes):
                    packed = np.packbits(x @ planes[dim][p] > 0, axis=1)
                    prefix = (packed[:, :4].copy().view(">u4")[:, 0] >> np.uint32(32 - bits) if bits else np.zeros(len(part))).astype(np.int32)
                    if counts:
                        found, n = np.unique(prefix, return_counts=True)
                        same = [pa.array(np.full(len(found), v, np.int32)) for v in (p, dim)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(found), pa.array(n.astype(np.int64))], names=["pass", "dim", "prefix", "n"])
                        continue
                    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(part), [None, pa.py_buffer(packed.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), p, np.int32)), key.cast(pa.binary()), pa.array(prefix), part.column("dim"),
                         part.column("node"), part.column("vector")],
                        names=["pass", "key", "prefix", "dim", "node", "vector"],
                    )

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _window_links(x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j <= i + window, of rows with a cosine of at least ``threshold``."""
    found_a, found_b = [], []
    for at in range(0, len(x), 256):
        rows = x[at:at + 256]
        i, j = np.nonzero(rows @ x[at:at + 256 + window].T >= threshold)
        keep = (j > i) & (j <= i + window)
        found_a.append(i[keep] + at)
        found_b.append(j[keep] + at)
    return np.concatenate(found_a or [np.zeros(0, int)]), np.concatenate(found_b or [np.zeros(0, int)])


def _compare(window: int, threshold: float):
    """Links (u, v) of a sorted partition: each row's to the first node of its run of links."""

    def run(batches: Iterator[pa.RecordBatch]):
        tail: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if tail is None else pa.concat_tables([tail, rows])
            tail = rows.slice(max(0, len(rows) - window))
            place = pd.DataFrame({"p": rows.column("pass").to_numpy(), "d": rows.column("dim").to_numpy()})
            edges = np.flatnonzero((place != place.shift()).any(axis=1).to_numpy())
            node = rows.column("node").to_numpy()
            for lo, hi in zip(edges, [*edges[1:], len(rows)]):
                a, b = _window_links(_matrix(rows.column("vector").slice(lo, hi - lo)), window, threshold)
                root = roots(hi - lo, a, b)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                if len(moved):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[lo:hi][moved]), pa.array(node[lo:hi][root[moved]])], names=["u", "v"]
                    )

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition sorted by ``keys``, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        frame = rows.select(keys).to_pandas()
        starts = np.flatnonzero((frame != frame.shift()).any(axis=1).to_numpy()) if len(frame) else []
        for lo, hi in zip(starts, [*starts[1:], len(frame)]):
            key = tuple(frame.iloc[lo])
            if held and key != last:
                yield last, pa.concat_tables(held)
                held = []
            last = key
            held.append(rows.slice(lo, hi - lo))
    if held:
        yield last, pa.concat_tables(held)


def _compare_chunks(threshold: float):
    """Links (u, v) of two chunks of a run (or of one with itself): each row's to the first node it is linked with here."""

    def run(batches: Iterator[pa.RecordBatch]):
        for (*_, i, j), rows in runs(batches, ["pass", "dim", "prefix", "i", "j"]):
            x, side = _matrix(rows.column("vector")), rows.column("chunk").to_numpy()
            first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
            a, b = np.nonzero(x[first] @ x[second].T >= threshold)
            root = roots(len(x), first[a], second[b])
            node, moved = rows.column("node").to_numpy(), np.flatnonzero(root != np.arange(len(x)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])

    return run


def _count(threshold: float):
    """(node, links): weight of the other chunk's members that each member is linked with."""

    def run(batches: Iterator[pa.RecordBatch]):
        for (_, i, j), rows in runs(batches, ["component", "i", "j"]):
            x, copies = _matrix(rows.column("vector")), rows.column("copies").to_numpy()
            side, node = rows.column("chunk").to_numpy(), rows.column("node").to_numpy()
            first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
            near = x[first] @ x[second].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out = [(first, near @ copies[second])]
            else:
                out = [(first, near @ copies[second]), (second, copies[first] @ near)]
            for at, links in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array(links.astype(np.int64))], names=["node", "links"]
                )

    return run


def near_vectors(
    df: DataFrame, key: str, vector: str, threshold: float = 0.9, passes: int | None = None, window: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    * n_links: other rows found linked (cosine >= threshold in double precision); component_id:
      smallest key reachable; kept: the row is that one.
    * Vectors that are null, empty, zero or not finite, and vectors of different lengths, link with
      nothing.  Rows with equal vectors are one class with a weight: copies are never expanded.
    * Each pass sends (pass, hash, vector) through one range shuffle, which keeps a run together.  A run longer than the window
      goes in pairs of chunks of about RUN_CHUNK rows instead.  Without ``passes`` the work counted over all rows decides; given
      ``passes`` fix the bits of a run.  Components are counted in pairs of chunks of about CHUNK members, so no task holds a whole component or run.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    good = rows.filter(usable("vector"))
    classes = good.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    classes = cut(classes.filter("node is not null").withColumn("dim", F.size("vector")))
    kind = classes.schema["vector"].dataType.simpleString()
    if passes is None:
        bits, mean_run = _bits_of_least_work(classes, threshold, seed)
        passes = passes_for(bits, threshold)
    else:
        bits = max((m for m in range(RUN_BITS + 1) if passes_for(m, threshold) <= passes), default=0)
        mean_run = 0.0
    if window is None:
        window = next((w for w in WINDOWS if w >= 2 * mean_run), WINDOWS[-1])
    node = classes.schema["node"].dataType.simpleString()
    keyed = classes.mapInArrow(
        _keys(passes, bits, seed), f"pass int, key binary, prefix int, dim int, node {node}, vector {kind}"
    )
    run = ["pass", "dim", "prefix"]
    long_runs = cut(_run_counts(classes, passes, bits, seed).filter(F.col("n") > window))
    ordered = keyed.join(long_runs, run, "left_anti").select("pass", "key", "prefix", "dim", "node", "vector")
    ordered = ordered.repartitionByRange(*run).sortWithinPartitions("pass", "dim", "key", "node")
    links = ordered.mapInArrow(_compare(window, threshold), f"u {node}, v {node}")
    parts = keyed.join(long_runs, run).withColumn("chunks", F.ceil(F.col("n") / RUN_CHUNK).cast("int"))
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *run, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "vector"
    )
    parts = parts.repartition(*run, "i", "j").sortWithinPartitions(*run, "i", "j")
    links = links.union(parts.mapInArrow(_compare_chunks(threshold), f"u {node}, v {node}"))
    groups = cut(components(links))
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = classes.join(groups.join(sizes, "component"), "node").withColumn("n", F.ceil(F.col("members") / CHUNK).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "copies", "vector"
    )
    pairs = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = pairs.mapInArrow(_count(threshold), f"node {node}, links long").groupBy("node").agg(F.sum("links").alias("links"))
    facts = classes.select("vector", "node", "copies").join(groups, "node", "left").join(links, "node", "left").select(
        "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    found = rows.withColumn("vector", F.when(usable("vector"), F.col("vector"))).join(facts, "vector", "left")
    return found.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
