import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trendloom.operators.novelty import NoveltyConfig
from trendloom.operators import knn, novelty, projection


def frame(spark, points, offset=0):
    return spark.createDataFrame([(offset + i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")


def brute(queries, base, k, exclude):
    out = {}
    for i, q in enumerate(queries):
        d = np.sqrt(((base - q) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(base)), d)) if not (exclude and j == i)][:k]
        out[i] = [(j, round(float(d[j]), 9)) for j in order]
    return out


def hot_points(n=300):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(n, 3)) + rng.integers(0, 4, size=(n, 1)) * 10
    points[::3] = points[0]  # a third of the rows are copies of one vector
    return points


@pytest.mark.parametrize("exclude", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, exclude):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(knn, "CELL_ROWS", 10)
    points = hot_points()
    df = frame(spark, points)
    got = {}
    for r in knn.nearest(df, df, 5, exclude_self=exclude).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["distance"], 9)))
    assert got == brute(points, points, 5, exclude)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_neighbours_of_other_rows(spark, monkeypatch, k):
    """More neighbours than rows in a cell or in all, text ids, rows without a vector."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    rng = np.random.default_rng(4)
    base, asked = rng.normal(size=(150, 20)), np.vstack((rng.normal(size=(30, 20)), np.full((1, 20), 50.0)))
    name = lambda df, p: df.select(F.format_string(p + "%04d", "id").alias("id"), "vec")
    empty = spark.createDataFrame([("none", None)], "id string, vec array<double>")
    left, right = name(frame(spark, asked), "q").union(empty), name(frame(spark, base), "b").union(empty)
    got = {}
    for r in knn.nearest(left, right, k).orderBy("query", "rank").collect():
        got.setdefault(int(r["query"][1:]), []).append((int(r["id"][1:]), round(r["distance"], 9)))
    assert got == brute(asked, base, k, False)
    assert knn.nearest(left, right.filter("vec IS NULL"), k).collect() == [] == knn.nearest(left.filter("vec IS NULL"), right, k).collect()


def test_bounds_hold_and_prune_where_the_data_allows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64)) * 4
    rows = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 64)) * 0.3
    mean, turn = rows.mean(0), np.linalg.eigh(np.cov(rows.T))[1][:, ::-1]
    axes = knn.Axes(mean, turn, centres)
    cell = knn._squares(rows, centres).argmin(axis=1)
    short = axes.coarse(rows)
    assert (knn._squares(short, short) <= knn._squares(rows, rows) + 1e-6).all()
    group = [np.flatnonzero(cell == c) for c in range(40)]
    cells = knn.Cells(
        np.array([len(g) for g in group]), np.array([np.linalg.norm(rows[g] - centres[c], axis=1).max() for c, g in enumerate(group)]),
        np.array([short[g].min(0) for g in group]), np.array([short[g].max(0) for g in group]),
    )
    visited = 0
    for home in range(40):
        mine = group[home]
        least, most = knn.least_distances(axes, cells, home, rows[mine], short[mine])
        d = np.sqrt(knn._squares(rows[mine], rows))
        for c in range(40):
            assert (least[:, c] <= d[:, group[c]].min(axis=1) + 1e-6).all() and (most[:, c] >= d[:, group[c]].max(axis=1) - 1e-6).all()
        tenth = np.partition(d, 9, axis=1)[:, 9]
        assert (knn._bounds(most, cells.size, 10) >= tenth - 1e-6).all()
        visited += (least <= tenth[:, None]).sum()
    assert visited < 1.5 * len(rows)  # of 40 cells, nearly always the own one only


def test_outlier_scores_equal_plain_statement(spark):
    points, new, k = hot_points(120), np.array([[0.0, 0, 0], [55.0, 5, 5]]), 7
    fit = brute(points, points, k, True)
    kd = np.array([fit[i][-1][1] for i in range(len(points))])
    lrd = np.array([1 / (np.mean([max(d, kd[j]) for j, d in fit[i]]) + 1e-10) for i in range(len(points))])
    want = {}
    for name, rows in (("b", points), ("n", new)):
        for i, near in brute(rows, points, k, False).items():
            own = 1 / (np.mean([max(d, kd[j]) for j, d in near]) + 1e-10)
            want[name, i] = np.mean([lrd[j] for j, _ in near]) / own - 1.5
    rows = knn.local_outlier_scores(frame(spark, points), frame(spark, new), k).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r["score"] == pytest.approx(want["b" if r["is_base"] else "n", r["id"]], rel=1e-6)


def test_projection_keeps_base_geometry_and_flags(spark):
    rng = np.random.default_rng(0)
    base, new = rng.random((20, 30)), rng.random((5, 30))
    b, n = (frame(spark, x).select(F.col("id").alias("row_id"), array_to_vector("vec").alias("features")) for x in (base, new))
    basis = projection.principal_directions(b, "features", 10)
    s = np.linalg.svd(base, compute_uv=False)[:10]
    assert (basis.features, basis.width) == (30, 10) and np.allclose(basis.values, s, rtol=1e-9)
    zb, zn = (projection.projected(x, "features", basis) for x in (b, n))
    assert np.allclose(np.linalg.norm([r["z"] for r in zb.collect()], axis=0), s, rtol=1e-9)
    scores = novelty.novelty_scores(zb, zn, NoveltyConfig(kmeans_k=3, threshold_percentile=90)).persist()
    assert scores.count() == 25 and scores.agg(F.min("novelty_score")).first()[0] >= 0
    flagged = novelty.novel_rows(scores, NoveltyConfig(threshold_percentile=90))
    assert flagged.count() == 5


def test_directions_of_sparse_rows_over_many_blocks(spark, monkeypatch):
    """Blocks of five columns and seven rows; a zero column block, empty rows, a rank below the one asked for."""
    monkeypatch.setattr(projection, "COLUMNS", 5)
    monkeypatch.setattr(projection, "ROWS", 7)
    cloudpickle.register_pickle_by_value(projection)
    try:
        rng = np.random.default_rng(9)
        x = rng.random((40, 6)) @ rng.normal(size=(6, 33)) * (rng.random((1, 33)) < 0.8)
        x[:, 10:15], x[4] = 0, 0
        rows = [(i, Vectors.sparse(33, {j: float(v) for j, v in enumerate(r) if v})) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, ["row_id", "features"]).repartition(3)
        basis = projection.principal_directions(df, "features", 9)
        want = np.linalg.svd(x, compute_uv=False)[:6]
        assert basis.width == 6 and np.allclose(basis.values, want, rtol=1e-8)
        z = np.array([r["z"] for r in projection.projected(df, "features", basis).orderBy("row_id").collect()])
        assert np.allclose(z @ z.T, x @ x.T, atol=1e-8)
        zero = df.withColumn("features", F.lit(None).cast("array<double>")).limit(0)
        assert projection.projected(df.limit(0), "features", basis).columns == ["row_id", "z"] and zero.isEmpty()
        nothing = spark.createDataFrame([(0, Vectors.sparse(33, {}))], ["row_id", "features"])
        none = projection.principal_directions(nothing, "features", 3)
        assert none.width == 0 and list(projection.projected(nothing, "features", none).first()["z"]) == []
    finally:
        cloudpickle.unregister_pickle_by_value(projection)


def test_scores_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return float(x)

    rows = spark.range(50).select(F.col("id").alias("row_id"), score("id").alias("novelty_score"), (F.col("id") < 40).alias("is_base"))
    assert novelty.novel_rows(rows, NoveltyConfig(threshold_percentile=90)).filter("is_novel").count() == 10
    assert seen.value == 50


def test_clusters(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.random((40, 4))).select(F.col("id").alias("row_id"), F.col("vec").alias("z"), (F.col("id") < 30).alias("is_novel"))
    out = novelty.with_clusters(df, "z", 42).collect()
    assert {r["cluster_id"] for r in out if not r["is_novel"]} == {-1}
    assert {r["cluster_id"] for r in out if r["is_novel"]} <= {0, 1, 2} and len(out) == 40
    lone = novelty.with_clusters(df.withColumn("is_novel", F.col("row_id") == 1), "z", 42)
    assert {r["cluster_id"] for r in lone.collect()} == {-1}


def test_a_query_is_sent_to_a_bounded_number_of_places():
    size = np.random.default_rng(8).integers(0, 900, 700)
    regions = knn._regions(knn.Cells(size, *[np.zeros(700)] * 3))
    assert regions.min() == 0 and regions.max() == knn.REGIONS - 1 and (np.diff(regions) >= 0).all()
    assert np.bincount(regions, size).max() < 1.1 * size.sum() / knn.REGIONS
    order, full, limit = knn._kept(np.array([1, 0, 1, 1, 0]), np.array([3.0, 5.0, 1.0, 1.0, 4.0]), 2)
    assert sorted(order.tolist()) == [1, 2, 3, 4] and dict(zip(full.tolist(), limit.tolist())) == {0: 5.0, 1: 1.0}


def test_every_vector_asks(spark):
    from trendloom.catalog.novelty_queries import nearest_neighbours

    sf = "/root/testdata/sf0.001"
    found = nearest_neighbours(spark, sf).groupBy("query").count().collect()
    asked = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(found) == asked and all(r["count"] == 10 for r in found)
