"""Novelty of new complaints: projection, distance or outlier scores, topic clusters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.operators.knn import local_outlier_scores
from trendloom.operators.ordering import percentile
from trendloom.session import cut_lineage


@dataclass(frozen=True)
class NoveltyConfig:
    """Size of the projection, kind of score (``kmeans_distance`` or ``lof``), threshold and topics."""

    svd_components: int = fv.COMPONENTS
    method: str = "kmeans_distance"
    kmeans_k: int = fv.CENTROIDS
    neighbors: int = fv.NEIGHBOURS
    threshold_percentile: float = fv.THRESHOLD_PERCENTILE
    min_cluster_size: int = fv.MIN_TOPIC_ROWS
    seed: int = fv.SEED

MAX_CENTROID_CELLS = 10_000_000


# --- distances -----------------------------------------------------------------------------

def centroid_matrix(df: DataFrame, label: str, vector: str) -> list[tuple[object, list[float]]]:
    """Mean vector per label, summed per dimension so that a large label spreads over tasks."""
    cells = df.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg("x").alias("m"))
    if cells.limit(MAX_CENTROID_CELLS + 1).count() > MAX_CENTROID_CELLS:
        raise ValueError("too many centroids for the driver")
    means: dict = {}
    for r in cells.orderBy(label, "at").collect():
        means.setdefault(r[label], []).append(r["m"])
    return sorted(means.items())


def nearest_centroid(df: DataFrame, vector: str, centroids: list[list[float]], output: str = "distance") -> DataFrame:
    """Distance of every row to the nearest of a few centroids."""
    points = np.asarray(centroids, dtype=float)

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=float)
        rows = np.stack([np.asarray(v, dtype=float) for v in vectors])
        near = points[(np.einsum("ij,ij->i", points, points) - 2 * rows @ points.T).argmin(axis=1)]
        return pd.Series(np.linalg.norm(rows - near, axis=1))

    return df.withColumn(output, distance(vector))


def kmeans_centroids(base: DataFrame, vector: str, k: int, seed: int) -> list[list[float]]:
    """Centres of at most ``k`` clusters of the base rows."""
    rows = base.select(array_to_vector(F.col(vector)).alias("features")).persist()
    try:
        k = min(k, rows.count())
        if k < 2:
            return [list(map(float, r["features"])) for r in rows.limit(1).collect()]
        model = KMeans(k=k, seed=seed).fit(rows)
    finally:
        rows.unpersist()
    return [list(map(float, c)) for c in model.clusterCenters()]


# --- scores, threshold, clusters --------------------------------------------------------------

def novelty_scores(base: DataFrame, new: DataFrame, cfg: NoveltyConfig, row_id: str = "row_id", vector: str = "z") -> DataFrame:
    """(row_id, novelty_score, is_base) of base and new rows."""
    if cfg.method == "lof":
        scores = local_outlier_scores(base, new, cfg.neighbors, row_id, vector)
        return scores.select(F.col("id").alias(row_id), F.col("score").alias("novelty_score"), "is_base")
    centroids = kmeans_centroids(base, vector, cfg.kmeans_k, cfg.seed)
    rows = base.select(row_id, vector, F.lit(True).alias("is_base")).unionByName(
        new.select(row_id, vector, F.lit(False).alias("is_base"))
    )
    return nearest_centroid(rows, vector, centroids, "novelty_score").select(row_id, "novelty_score", "is_base")


def novel_rows(scores: DataFrame, cfg: NoveltyConfig) -> DataFrame:
    """New rows with ``is_novel``: score strictly above the percentile of the base scores."""
    scores = cut_lineage(scores)  # read for the threshold and for the flags, computed once
    threshold = percentile(scores.filter("is_base"), "novelty_score", cfg.threshold_percentile)
    return scores.filter(~F.col("is_base")).drop("is_base").withColumn(
        "is_novel", F.col("novelty_score") > threshold.scalar()
    )


def with_clusters(df: DataFrame, vector: str, seed: int, row_id: str = "row_id") -> DataFrame:
    """Add ``cluster_id`` to rows with ``is_novel``; the others, and a lone novel row, get -1.

    A divisive hierarchy with one cluster per ten novel rows, between two and ten.
    """
    novel = df.filter("is_novel").withColumn("features", array_to_vector(F.col(vector)))
    n = novel.count()
    rest = df.filter(~F.col("is_novel")).withColumn("cluster_id", F.lit(-1))
    if n < 2:
        return df.withColumn("cluster_id", F.lit(-1))
    model = BisectingKMeans(k=min(max(2, n // 10), 10), seed=seed, predictionCol="cluster_id").fit(novel)
    return model.transform(novel).drop("features").unionByName(rest)
