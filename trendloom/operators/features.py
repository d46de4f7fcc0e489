"""Term statistics, vocabularies and TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trendloom import fixed_values as fv
from trendloom.functions import text as X
from trendloom.operators.ordering import largest
from trendloom.session import cut_lineage


@dataclass(frozen=True)
class VectorizerConfig:
    """Sizes of n-grams and limits of the vocabularies; a fraction as limit is a share of the rows."""

    word_ngram: tuple[int, int] = fv.WORD_NGRAM
    char_ngram: tuple[int, int] = fv.CHAR_NGRAM
    min_df: int | float = fv.MIN_DF
    max_df: int | float = fv.MAX_DF
    max_features_word: int = fv.WORD_FEATURES
    max_features_char: int = fv.CHAR_FEATURES


COUNTED = "array<struct<term:string,n:int>>"
SLICE_VALUES = 1 << 17  # words or terms that a task works on at once
TERMS_A_BATCH = 1 << 15
CUT_WORDS = 1 << 15  # words that a task cuts into characters at once: each has some twenty n-grams


def _slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` (``SLICE_VALUES``) values in the lists of ``column``; a longer list is alone."""
    most = most or SLICE_VALUES
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(batch):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row and value of every entry of the lists."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values in the order of their rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


# How words become terms: (row, word number), words -> (row, term number, occurrences or None for one each), terms.
Grams = Callable[[np.ndarray, np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | None, pa.Array]]


def _as_they_are(row: np.ndarray, word: np.ndarray, words: pa.Array):
    return row, word, None, words


def _runs(lo: int, hi: int) -> Grams:
    """All runs of ``lo..hi`` neighbouring words; a run is named once for all its places."""

    def grams(row: np.ndarray, word: np.ndarray, words: pa.Array):
        rows, codes, names = [], [], []
        run, known = word, words
        for n in range(1, hi + 1):
            if n > 1:
                here = np.flatnonzero(row[n - 1:] == row[:max(0, len(row) - n + 1)])
                pairs, at = np.unique(run[here] * max(1, len(words)) + word[here + n - 1], return_inverse=True)
                first, last = pairs // max(1, len(words)), pairs % max(1, len(words))
                known = pc.binary_join_element_wise(known.take(pa.array(first)), words.take(pa.array(last)), " ")
                run = np.zeros(len(row), np.int64)
                run[here] = at
            else:
                here = np.arange(len(row))
            if n >= lo:
                rows.append(row[here])
                codes.append(run[here] + sum(len(x) for x in names))
                names.append(known)
        return np.concatenate(rows), np.concatenate(codes), None, pa.concat_arrays(names)

    return grams


def _substrings(words: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, pa.Array]:
    """(word number, n-gram) of all n-grams of space-padded words; a word shorter than ``lo`` is one itself."""
    padded = pc.binary_join_element_wise("", words, "", " ")
    data = np.frombuffer(b"".join(x.as_buffer() for x in pc.cast(padded, pa.binary())), np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of every character
    ends_of = np.append(begins, len(data))
    size = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    owners, starts, stops = [], [], []
    for n in range(lo, hi + 1):
        count = np.maximum(size - (n - 1), 1 if n == lo else 0)
        owner = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        owners.append(owner)
        starts.append(ends_of[at])
        stops.append(ends_of[np.minimum(at + n, (first + size)[owner])])
    owner, start, stop = (np.concatenate(x) for x in (owners, starts, stops))
    offsets = np.concatenate(([0], np.cumsum(stop - start)))
    bytes_at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], stop - start)
    found = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[bytes_at]))
    return owner, found


def _inside_words(lo: int, hi: int) -> Grams:
    """Character n-grams of space-padded words: each word of a slice is cut up once, whatever its occurrences."""

    def grams(row: np.ndarray, word: np.ndarray, words: pa.Array):
        owner, found = _substrings(words, lo, hi)
        coded = found.dictionary_encode()
        by_word = np.argsort(owner, kind="stable")
        code = coded.indices.to_numpy(zero_copy_only=False)[by_word].astype(np.int64)
        count = np.bincount(owner, minlength=len(words))
        first = np.cumsum(count) - count
        size = max(1, len(words))
        pairs, n = np.unique(row * size + word, return_counts=True)
        mine = pairs % size
        each = count[mine]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[mine], each)
        return np.repeat(pairs // size, each), code[at], np.repeat(n, each), coded.dictionary.cast(pa.string())

    return grams


def _cut_up(lists: pa.ListArray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term number and occurrences of the distinct terms of every row, by row, and the terms."""
    row, flat = _flat(lists)
    known = flat.is_valid()
    coded = flat.filter(known).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, code, n, terms = grams(row[known.to_numpy(zero_copy_only=False)], words, coded.dictionary)
    size = max(1, len(terms))
    if n is None:
        pairs, n = np.unique(row * size + code, return_counts=True)
    else:
        key = row * size + code
        order = np.argsort(key)
        key = key[order]
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        pairs, n = key[edges], np.add.reduceat(n[order], edges) if len(edges) else n
    return pairs // size, pairs % size, n, terms


def _counts(df: DataFrame, column: str, grams: Grams, most: int | None = None) -> DataFrame:
    """``df`` with the lists of strings in ``column`` replaced by their distinct terms and counts."""
    names = df.columns
    schema = df.withColumn(column, F.lit(None).cast(COUNTED)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column, most):
                row, code, n, terms = _cut_up(part.column(column), grams)
                counted = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(n.astype(np.int32))], ["term", "n"])
                found = _lists(row, len(part), counted)
                yield pa.RecordBatch.from_arrays([found if c == column else part.column(c) for c in names], names)

    return df.mapInArrow(run, schema)


def _statistics(df: DataFrame, column: str, grams: Grams, most: int | None = None) -> DataFrame:
    """``term_statistics`` of the lists of strings in ``column``, summed slice by slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column, most):
                _, code, n, terms = _cut_up(part.column(column), grams)
                total = np.bincount(code, n, len(terms)).astype(np.int64)  # exact: a slice has fewer than 2**53 occurrences
                docs = np.bincount(code, minlength=len(terms))
                for at in range(0, len(terms), TERMS_A_BATCH):
                    own = slice(at, at + TERMS_A_BATCH)
                    yield pa.RecordBatch.from_arrays([terms[own], pa.array(total[own]), pa.array(docs[own])], ["term", "n", "docs"])

    found = df.select(column).mapInArrow(run, "term string, n bigint, docs bigint").filter("docs > 0")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_terms(df: DataFrame, terms: str) -> DataFrame:
    """``df`` with the array of strings ``terms`` replaced by its distinct terms and their counts.

    Written once, this serves the fit and every transform: texts are cut into terms a single time, and a
    term goes through a shuffle once per row and not once per occurrence.
    """
    return _counts(df, terms, _as_they_are)


def count_word_ngrams(df: DataFrame, words: str, lo: int, hi: int) -> DataFrame:
    """``df`` with the words of a text, in order, replaced by the counts of their runs of ``lo..hi``."""
    return _counts(df, words, _runs(lo, hi))


def count_char_ngrams(df: DataFrame, words: str, lo: int, hi: int) -> DataFrame:
    """``df`` with the words of a text replaced by the counts of the character n-grams inside them."""
    return _counts(df, words, _inside_words(lo, hi), CUT_WORDS)


def word_ngram_statistics(df: DataFrame, words: str, lo: int, hi: int) -> DataFrame:
    """``term_statistics`` of the runs of ``lo..hi`` words, without a list of terms per row."""
    return _statistics(df, words, _runs(lo, hi))


def char_ngram_statistics(df: DataFrame, words: str, lo: int, hi: int) -> DataFrame:
    """``term_statistics`` of the character n-grams inside words, without a list of terms per row."""
    return _statistics(df, words, _inside_words(lo, hi), CUT_WORDS)


def _counted(df: DataFrame, terms: str) -> DataFrame:
    return df if df.schema[terms].dataType.simpleString() == COUNTED else count_terms(df, terms)


def term_statistics(df: DataFrame, terms: str) -> DataFrame:
    """Corpus frequency ``n`` and document frequency ``docs`` of every term, of counted or plain terms.

    A single shuffle on the term, pre-summed on the map side, gives both.
    """
    pairs = _counted(df.select(terms), terms).select(F.explode(terms).alias("p"))
    return pairs.groupBy(F.col("p.term").alias("term")).agg(
        F.sum("p.n").cast("bigint").alias("n"), F.count("*").alias("docs")
    )


def vocabulary(
    df: DataFrame, terms: str, min_df: int | float, max_df: int | float, max_features: int, rows: int
) -> DataFrame:
    """Terms within the document-frequency limits, the most frequent first on overflow.

    An integer limit counts documents, a fraction is a share of ``rows``.  The
    filtered counts are written once; what remains is bounded by ``max_features``.
    """
    return _limited(term_statistics(df, terms), min_df, max_df, max_features, rows)


def _limited(statistics: DataFrame, min_df: int | float, max_df: int | float, max_features: int, rows: int) -> DataFrame:
    """``vocabulary`` of ``term_statistics`` over ``rows`` documents."""

    def documents(limit: int | float) -> float:
        return limit * rows if isinstance(limit, float) else limit

    inside = F.col("docs").between(documents(min_df), documents(max_df))
    kept = cut_lineage(statistics.filter(inside))
    return largest(kept, [F.col("term")], max_features, "n")


@dataclass(frozen=True)
class TermBlock:
    """A frozen vocabulary: terms in alphabetical order and their inverse document frequency."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def fit(cls, df: DataFrame, terms: str, min_df, max_df, max_features: int) -> TermBlock:
        rows = df.count()
        return cls._of(vocabulary(df, terms, min_df, max_df, max_features, rows), rows)

    @classmethod
    def _of(cls, table: DataFrame, rows: int) -> TermBlock:
        idf = F.log((1 + F.lit(rows)) / (1 + F.col("docs"))) + 1
        found = table.select("term", idf.alias("idf")).toArrow().sort_by("term")
        return cls(found["term"].to_pylist(), found["idf"].to_pylist())

    def table(self, spark: SparkSession) -> DataFrame:
        """The vocabulary as (term, idx, idf)."""
        columns = pa.array(self.terms, pa.string()), pa.array(range(len(self.terms)), pa.int32()), pa.array(self.idf, pa.float64())
        return spark.createDataFrame(pa.table(columns, ["term", "idx", "idf"]), "term string, idx int, idf double")

    @classmethod
    def from_table(cls, table: DataFrame) -> TermBlock:
        rows = sorted((r["idx"], r["term"], r["idf"]) for r in table.collect())
        return cls([t for _, t, _ in rows], [w for _, _, w in rows])

    def weighted(self, df: DataFrame, terms: str) -> DataFrame:
        """Counted or plain terms replaced by ``_at`` and ``_w``: numbers of the known terms, ascending, and their TF-IDF weights."""
        counted = _counted(df, terms)
        others = [c for c in df.columns if c != terms]
        shared = df.sparkSession.sparkContext.broadcast(_looked_up(self))
        schema = counted.select(*others, F.lit(None).cast("array<int>").alias("_at"), F.lit(None).cast("array<double>").alias("_w")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, idf = shared.value
            for batch in batches:
                for part in _slices(batch, terms):
                    row, at, w = _unit_weights(part.column(terms), known, idf)
                    found = [_lists(row, len(part), pa.array(v)) for v in (at, w)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *found], [*others, "_at", "_w"])

        return counted.mapInArrow(run, schema)

    def transform(self, df: DataFrame, terms: str, output: str) -> DataFrame:
        """Replace counted or plain terms by the TF-IDF vector; unknown terms are ignored.

        A row is weighted where it lies, so nothing is shuffled.  The vocabulary, bounded by its feature
        limit, is shared with the tasks.
        """
        return _vectors(_counted(df, terms), [(self, terms)], output)


def _looked_up(block: TermBlock) -> tuple[pa.Array, np.ndarray]:
    """Terms and inverse frequencies as the tasks get them: two arrays, no object a term."""
    return pa.array(block.terms, pa.string()), np.array(block.idf if block.idf else [0.0])


def _unit_weights(lists: pa.ListArray, known: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, (1 + ln tf) * idf with unit length per row) of the known terms, by row and number."""
    row, pairs = _flat(lists)
    at = pc.index_in(pairs.field("term"), value_set=known)
    inside = at.is_valid().to_numpy(zero_copy_only=False)
    n = pairs.field("n").to_numpy(zero_copy_only=False)[inside]
    return _weights(row[inside], at.drop_null().to_numpy(zero_copy_only=False), n, len(lists), idf, len(known))


def _unit_weights_of_words(lists: pa.ListArray, grams: Grams, known: pa.Array, idf: np.ndarray):
    """``_unit_weights`` of lists of words, each distinct term of which is looked up once."""
    row, code, n, terms = _cut_up(lists, grams)
    at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)[code]
    inside = at >= 0
    return _weights(row[inside], at[inside], n[inside], len(lists), idf, len(known))


def _weights(row: np.ndarray, at: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray, size: int):
    n = n.astype(float)
    order = np.argsort(row * max(1, size) + at)
    row, at, n = row[order], at[order], n[order]
    w = (1.0 + np.log(n)) * idf[at]
    return row, at, w / np.sqrt(np.bincount(row, w * w, rows))[row]


def _vectors(df: DataFrame, blocks: list[tuple[TermBlock, str]], output: str, grams: Sequence[Grams] | None = None) -> DataFrame:
    """The columns of counted terms of ``blocks`` replaced by one sparse vector, block behind block.

    With ``grams`` the columns hold words: they are cut into terms and weighted in one step, so no list of terms is moved.
    """
    used = [c for _, c in blocks]
    others = [c for c in df.columns if c not in used]
    shared = df.sparkSession.sparkContext.broadcast([_looked_up(b) for b, _ in blocks])
    widths = [max(1, len(b.terms)) for b, _ in blocks]
    schema = StructType([*(df.schema[c] for c in others), StructField(output, VectorUDT())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for part in _slices(batch, used[-1], CUT_WORDS if grams else None):
                if grams:
                    found = [_unit_weights_of_words(part.column(c), g, *t) for c, g, t in zip(used, grams, tables)]
                else:
                    found = [_unit_weights(part.column(c), *t) for c, t in zip(used, tables)]
                row = np.concatenate([r for r, _, _ in found])
                at = np.concatenate([a + sum(widths[:i]) for i, (_, a, _) in enumerate(found)])
                w = np.concatenate([x for _, _, x in found])
                order = np.argsort(row, kind="stable")
                row, n = row[order], len(part)
                vector = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, sum(widths), np.int32)),
                        _lists(row, n, pa.array(at[order].astype(np.int32))), _lists(row, n, pa.array(w[order])),
                    ],
                    ["type", "size", "indices", "values"],
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), vector], [*others, output])

    return df.mapInArrow(run, schema)


def exploded_weights(df: DataFrame, terms: str, block: TermBlock, *keys: str) -> DataFrame:
    """Long form (keys, term, weight) of the TF-IDF weights of counted or plain terms."""
    pairs = F.explode(F.arrays_zip("_at", "_w"))
    long = block.weighted(df.select(*keys, terms), terms).select(*keys, pairs.alias("p")).select(
        *keys, F.col("p._at").alias("idx"), F.col("p._w").alias("weight")
    )
    # The vocabulary is bounded by its feature limit.
    names = F.broadcast(block.table(df.sparkSession).select("idx", "term"))
    return long.join(names, "idx").select(*keys, "term", "weight")


@dataclass(frozen=True)
class Vectorizer:
    """Word and character TF-IDF blocks, set side by side without a common norm."""

    cfg: VectorizerConfig
    word: TermBlock
    char: TermBlock

    @staticmethod
    def with_words(df: DataFrame, text: str, output: str, cfg: VectorizerConfig = VectorizerConfig()) -> DataFrame:
        """``df`` with the counted word n-grams of ``text``."""
        return count_word_ngrams(df.withColumn(output, X.feature_words(F.col(text))), output, *cfg.word_ngram)

    @staticmethod
    def with_chars(df: DataFrame, text: str, output: str, cfg: VectorizerConfig = VectorizerConfig()) -> DataFrame:
        """``df`` with the counted character n-grams of ``text``."""
        return count_char_ngrams(df.withColumn(output, X.spaced_words(F.col(text))), output, *cfg.char_ngram)

    @classmethod
    def counted(cls, df: DataFrame, text: str, cfg: VectorizerConfig = VectorizerConfig()) -> DataFrame:
        """``df`` with the counted terms of ``text`` as ``_words`` and ``_chars``, written once."""
        return cut_lineage(cls.with_chars(cls.with_words(df, text, "_words", cfg), text, "_chars", cfg))

    @classmethod
    def fit(cls, df: DataFrame, text: str, cfg: VectorizerConfig = VectorizerConfig()) -> Vectorizer:
        """Fit on the texts, which are read for each block, or on what ``counted`` made of them; of texts no list of terms is written."""
        limits = (cfg.min_df, cfg.max_df, cfg.max_features_word), (cfg.min_df, cfg.max_df, cfg.max_features_char)
        if "_words" in df.columns:
            return cls(cfg, TermBlock.fit(df, "_words", *limits[0]), TermBlock.fit(df, "_chars", *limits[1]))
        rows = df.count()
        words = df.select(X.feature_words(F.col(text)).alias("_words"))
        chars = df.select(X.spaced_words(F.col(text)).alias("_chars"))
        found = word_ngram_statistics(words, "_words", *cfg.word_ngram), char_ngram_statistics(chars, "_chars", *cfg.char_ngram)
        return cls(cfg, *(TermBlock._of(_limited(x, *limit, rows), rows) for x, limit in zip(found, limits)))

    def transform(self, df: DataFrame, text: str, output: str = "features") -> DataFrame:
        """Add the vector of both blocks; ``df`` may hold what ``counted`` made of the texts."""
        blocks = [(self.word, "_words"), (self.char, "_chars")]
        if "_words" in df.columns:
            return _vectors(df, blocks, output)
        words = df.withColumns({"_words": X.feature_words(F.col(text)), "_chars": X.spaced_words(F.col(text))})
        return _vectors(words, blocks, output, [_runs(*self.cfg.word_ngram), _inside_words(*self.cfg.char_ngram)])
