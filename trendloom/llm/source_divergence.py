"""How far the term shares of the sources of a language lie apart, by three-dimensional cubes.

Every language keeps the terms of at least ``min_docs`` of its documents.  A (language, source)
group, and the language as a whole, gives each kept term the share

    1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept terms))

in whole numbers.  Two groups of a language differ by the sum of the absolute differences of
their shares (part ``pair``); a group's own terms are those above the language's share (part
``term``, the first ``top``).

The comparison is cut along three axes: groups in blocks, groups in blocks again, terms in
blocks.  A task owns one (block, block, term block) cell.  It gets the two slices of counts that
meet there, replicated to every cell they take part in, and sums its part of every pair; cells on
the diagonal also pick each group's candidate terms.  Partial sums are added along the term
axis.  A cell holds about 2 x ``GROUPS`` groups and ``TERMS`` terms whatever the input, so a hot
source or a large vocabulary gives more cells and not larger ones.

Defined results: null language, source and text are read as empty; every row is a document, also
if ids or rows repeat; a group without kept terms takes part with count 0 everywhere; further
columns are ignored; ties go by the item's UTF-8 bytes; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import cut, small, tidy, utf8

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
GROUPS, TERMS = 16, 4096
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
PIECE = 1 << 20  # bytes of a text cut into terms at once
HELD = 200_000  # (group, term) counts held by a task


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        run = TERM.match(text, at + PIECE)
        end = run.end() if run else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def count_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed in the tasks first.

    Every group also has a row with the empty term, so that groups without terms are known.
    """

    @tidy
    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush():
            for (of, by), (n, in_docs) in found.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.repeat(pa.scalar(of, pa.string()), len(terms)), "source": pa.repeat(pa.scalar(by, pa.string()), len(terms)),
                    "term": pa.array(terms, pa.binary()), "n": pa.array([0, *n.values()], pa.int64()),
                    "docs": pa.array([0, *(in_docs[t] for t in n)], pa.int64()),
                })
            found.clear()

        for batch in small(batches):
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, content in zip(names, utf8(batch.column("text"))):
                if group not in found:
                    found[group] = (Counter(), Counter())
                    held += 1
                n, in_docs = found[group]
                held -= len(n)
                own = set()
                for piece in _pieces(content):
                    terms = TERM.findall(piece.lower())
                    n.update(terms)
                    own.update(terms)
                in_docs.update(own)
                held += len(n)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).cast("string").alias("text"),
    )
    parts = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    parts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return parts.withColumn("term", F.col("term").cast("string"))


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / of), exactly; count + PRIOR is at most ``of``."""
    count, of = np.broadcast_arrays(np.asarray(count) + PRIOR, np.asarray(of))
    if of.size and int(of.max()) > (1 << 63) // 1000:
        return np.array([1 + SCALE * int(c) // int(d) for c, d in zip(count.ravel(), of.ravel())], np.int64).reshape(of.shape)
    whole, rest = np.zeros(of.shape, np.int64), count.astype(np.int64)
    for _ in range(3):  # three digits of base 1000
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def _cell(rows: pa.Table, top: int) -> Iterator[tuple[str, str, str, int]]:
    """(part, source, item, value) of one cell: partial sums of its pairs, candidate terms on the diagonal."""
    is_group = pc.is_null(rows["term"])
    groups, counts = rows.filter(is_group), rows.filter(pc.invert(is_group))
    names = groups["source"].combine_chunks()
    block, total, kept = (groups[c].to_numpy() for c in ("block", "total", "kept"))
    of = np.maximum(total + PRIOR * kept, 1)
    coded = counts["term"].combine_chunks().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    who = pc.index_in(counts["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    base = shares(np.zeros(len(of), np.int64), of) * (kept > 0)
    grid = np.repeat(base[:, None], len(terms), axis=1)
    own = shares(counts["n"].to_numpy(), of[who])
    grid[who, at] = own
    names = names.to_pylist()
    same = rows["low"][0].as_py() == rows["high"][0].as_py()
    first = np.arange(len(names)) if same else np.flatnonzero(block == rows["low"][0].as_py())
    second = first if same else np.flatnonzero(block == rows["high"][0].as_py())
    unseen = groups["width"][0].as_py() - len(terms)
    for k, i in enumerate(first):
        others = second[k + 1:] if same else second
        sums = np.abs(grid[others] - grid[i]).sum(axis=1) + unseen * np.abs(base[others] - base[i])
        for j, value in zip(others, sums.tolist()):
            yield "pair", names[i], names[j], value
    if not same:
        return
    above = own - shares(counts["lang_n"].to_numpy(), np.full(len(own), max(groups["lang_total"][0].as_py() + PRIOR * int(kept[0]), 1)))
    place = np.empty(len(terms), np.int64)
    place[sorted(range(len(terms)), key=lambda t: terms[t].encode())] = np.arange(len(terms))
    order = np.lexsort((place[at], -above, who))
    order = order[above[order] > 0]
    rank = np.arange(len(order)) - np.searchsorted(who[order], who[order], side="left")
    for k in order[rank < top]:
        yield "term", names[who[k]], terms[at[k]], int(above[k])


def source_divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP,
    group_block: int = GROUPS, term_block: int = TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group, as the module says."""
    counts = cut(count_terms(docs, lang, source, text))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = cut(kept.filter((F.col("term") != "") & (F.col("docs") >= min_docs)).drop("docs"))
    own = cut(counts.filter("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    )
    known = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(known, "lang", "left").fillna(0, ["kept", "lang_total"])
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    langs = cut(langs.withColumns({"group_blocks": blocks("sources", group_block), "term_blocks": blocks("kept", term_block)}))

    block = F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int").alias("block")
    slab = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("slab")
    per_lang = langs.select("lang", "group_blocks", "term_blocks")
    width = kept.join(per_lang, "lang").groupBy("lang", slab).agg(F.count("*").alias("width"))
    marks = groups.join(langs, "lang").select(
        "lang", block, F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("slab"), "group_blocks", "source",
        "total", "kept", "lang_total",
    ).join(width, ["lang", "slab"], "left").select(
        "lang", "block", "slab", "group_blocks", "source", F.lit(None).cast("string").alias("term"), "total", "kept", "lang_total",
        F.coalesce("width", F.lit(0)).alias("width"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"),
    )
    none = F.lit(0).cast("long")
    slices = own.join(per_lang, "lang").select(
        "lang", block, slab, "group_blocks", "source", "term", none.alias("total"), none.alias("kept"), none.alias("lang_total"),
        none.alias("width"), "n", "lang_n",
    )
    cells = marks.union(slices).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    cells = cells.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "group_blocks")

    def run(key, rows):
        found = list(zip(*_cell(rows, top))) or [[], [], [], []]
        return pa.table({
            "lang": pa.repeat(key[0].cast(pa.string()), len(found[0])), "part": pa.array(found[0], pa.string()),
            "source": pa.array(found[1], pa.string()), "item": pa.array(found[2], pa.string()), "value": pa.array(found[3], pa.int64()),
        })

    parts = cut(cells.groupBy("lang", "low", "high", "slab").applyInArrow(run, "lang string, part string, source string, item string, value long"))
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms)
