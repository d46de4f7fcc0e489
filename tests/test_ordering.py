import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators.splits import SplitConfig
from trendloom.operators import ordering, splits


@pytest.mark.parametrize("n", [0, 13, 100, 199, 500])
def test_first_rows_equals_a_sort(spark, n):
    rng = random.Random(n)
    # Half of all rows share one key, some keys are missing.
    rows = [(rng.choice([7, 7, 7, -(1 << 63), (1 << 63) - 1, None]), rng.randint(0, 3), f"{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c string").repartition(5)
    keep = ordering.first_rows(df, [F.col("a"), F.col("b"), F.col("c")], n)
    got = sorted(r["c"] for r in df.filter(keep).collect())
    want = sorted(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))[:n], key=lambda r: r[2])
    assert got == [r[2] for r in want]


@pytest.mark.parametrize("values", ["uniform", "hot", "wide", "few", "signs"])
def test_percentiles_are_exact(spark, values):
    rng = np.random.default_rng(1)
    data = {
        "uniform": rng.random(5000), "hot": np.where(rng.random(5000) < 0.6, 3.0, rng.random(5000)),
        "wide": np.exp(rng.normal(0, 40, 5000)), "few": np.array([2.0]),
        "signs": np.concatenate((rng.normal(size=300), [0.0, -0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308])),
    }[values]
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,)], "x double").repartition(3)
    pcts = [0, 37.5, 98, 100]
    assert ordering.percentiles(df, "x", pcts) == pytest.approx([np.percentile(data, p) for p in pcts], rel=1e-12)


def test_percentiles_of_special_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),), (float("nan"),)], "x double")
    assert ordering.percentiles(df, "x", [0, 100 / 3, 200 / 3])[:2] == [float("-inf"), 1.0]
    assert ordering.percentiles(df.filter("x IS NULL"), "x", [50]) == [None]
    assert ordering.percentile(df.filter("x IS NULL"), "x", 50).first()[0] is None


def test_ranks_of_repeated_values_take_few_passes(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"))
    jobs = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: jobs.append(1) or collect(self))
    assert ordering.values_at(df, "k", [0, 6666, 6667, 19_999]) == {0: (0, 0), 6666: (0, 0), 6667: (1, 6667), 19_999: (2, 13_334)}
    assert len(jobs) <= 3


def test_largest_ties_by_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "t string, n long")
    assert [r["t"] for r in ordering.largest(df, [F.col("t")], 2, "n").collect()] == ["c", "a"]


def test_splits_have_exact_size_and_do_not_depend_on_partitioning(spark):
    rows = [(f"r{i}", f"2025-01-{1 + i % 3:02d} 00:00:00") for i in range(57)]
    df = spark.createDataFrame(rows, "row_id string, at string").withColumn("event_time", F.col("at").cast("timestamp_ntz"))
    for cfg, size in ((SplitConfig(), 57 - int(57 * 0.8)), (SplitConfig(mode="random"), 12)):
        sides = [
            {r["row_id"] for r in splits.validation_rows(splits.with_split(df.repartition(p), cfg)).collect()} for p in (1, 6)
        ]
        assert sides[0] == sides[1] and len(sides[0]) == size
    windowed = splits.with_split(df, SplitConfig(val_from="2025-01-02", val_to="2025-01-02"))
    assert splits.validation_rows(windowed).count() == 19
    # A window that leaves one side empty falls back to the latest fifth.
    empty = splits.with_split(df, SplitConfig(val_from="2030-01-01"))
    assert splits.validation_rows(empty).count() == 57 - int(57 * 0.8)
