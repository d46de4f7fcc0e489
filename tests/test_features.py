from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import features

TEXTS = ["", None, "a", "ab cde fghijk ab cde", "да нет  да", "one two one two one", "é" * 9 + " x😀y zz", "abc " * 50]


def counted(df, name):
    return {r["i"]: {t["term"]: t["n"] for t in r[name]} for r in df.select("i", name).collect()}


def test_counts_equal_the_terms_cut_one_by_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(2)
    for lo, hi in ((1, 1), (1, 3), (2, 3)):
        plain = df.select("i", X.word_ngrams(X.feature_words(F.col("t")), lo, hi).alias("x"))
        got = features.count_word_ngrams(df.select("i", X.feature_words(F.col("t")).alias("x")), "x", lo, hi)
        assert counted(got, "x") == {r["i"]: dict(Counter(r["x"])) for r in plain.collect()}
    for lo, hi in ((3, 5), (1, 2), (4, 4)):
        plain = df.select("i", X.char_ngrams(F.col("t"), lo, hi).alias("x"))
        got = features.count_char_ngrams(df.select("i", X.spaced_words(F.col("t")).alias("x")), "x", lo, hi)
        assert counted(got, "x") == {r["i"]: dict(Counter(r["x"])) for r in plain.collect()}


def test_statistics_are_summed_per_slice(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "i int, t string").repartition(2)
    monkeypatch.setattr(features, "CUT_WORDS", 7)
    monkeypatch.setattr(features, "TERMS_A_BATCH", 5)
    words = df.select(X.feature_words(F.col("t")).alias("x"))
    pieces = df.select(X.spaced_words(F.col("t")).alias("x"))
    for got, lists in (
        (features.word_ngram_statistics(words, "x", 1, 2), features.count_word_ngrams(words, "x", 1, 2)),
        (features.char_ngram_statistics(pieces, "x", 3, 5), features.count_char_ngrams(pieces, "x", 3, 5)),
    ):
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in features.term_statistics(lists, "x").collect()}
        assert got.schema.simpleString() == features.term_statistics(lists, "x").schema.simpleString()


def test_a_large_table_is_spread_over_more_tasks_than_cores(spark):
    from trendloom.catalog.bindings import spread

    rows = spark.range(100)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert spread(rows, "id").rdd.getNumPartitions() == 40
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_task_works_on_a_bounded_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(features, "SLICE_VALUES", 10)
    lists = pa.array([["w"] * n for n in (3, 3, 3, 3, 0, 40, 1)] + [None])
    parts = list(features._slices(pa.RecordBatch.from_arrays([lists], ["x"]), "x"))
    assert pa.concat_arrays([p.column("x") for p in parts]).equals(lists)
    assert [[len(x or ()) for x in p.column("x").to_pylist()] for p in parts] == [[3, 3, 3], [3, 0], [40], [1, 0]]


def test_an_assembled_vector_is_sparse_word_part_first(spark):
    df = spark.createDataFrame([(0, "ab ab cd"), (1, "")], "i int, t string")
    v = features.Vectorizer.fit(df, "t", features.VectorizerConfig(word_ngram=(1, 1), char_ngram=(4, 4), min_df=1, max_df=1.0))
    rows = v.transform(df, "t").orderBy("i").collect()
    assert v.word.terms == ["ab", "cd"] and v.char.terms == [" ab ", " cd "]
    assert rows[0]["features"].size == 4 and list(rows[0]["features"].indices) == [0, 1, 2, 3] and rows[1]["features"].numNonzeros() == 0
    assert rows[0]["t"] == "ab ab cd" and abs(sum(x * x for x in rows[0]["features"].values) - 2) < 1e-12


def test_texts_are_fitted_and_weighted_without_written_terms(spark, monkeypatch):
    cfg = features.VectorizerConfig(min_df=1, max_df=1.0)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(2)
    counted_terms = features.Vectorizer.counted(df, "t", cfg)
    want = features.Vectorizer.fit(counted_terms, "t", cfg)
    written, cut = [], features.cut_lineage
    monkeypatch.setattr(features, "cut_lineage", lambda x: written.append(x.schema.simpleString()) or cut(x))
    monkeypatch.setattr(features, "CUT_WORDS", 7)
    got = features.Vectorizer.fit(df, "t", cfg)
    assert written and not any("array" in x for x in written)
    assert (got.word, got.char) == (want.word, want.char)
    vectors = [{r["i"]: r["features"] for r in x.collect()} for x in (got.transform(df, "t"), want.transform(counted_terms, "t"))]
    assert vectors[0] == vectors[1] and len(vectors[0]) == len(TEXTS)
