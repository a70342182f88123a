"""Cluster centroids from JSON lines ``{"cluster_id": n, "centroid": [...]}``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 65_536  # centroids that are held in memory


@dataclass(frozen=True)
class Clusters:
    """Ids and a contiguous matrix of centroids, in order of id."""

    ids: np.ndarray
    matrix: np.ndarray

    @property
    def dimension(self) -> int:
        return self.matrix.shape[1]

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        """Rows of the n nearest centroids of each query row by squared distance, ties by smaller id."""
        d = ((np.asarray(q, np.float64)[:, None, :] - self.matrix[None]) ** 2).sum(2) if len(self.ids) * len(q) <= 4096 else _distances(q, self.matrix)
        return np.argsort(d, axis=1, kind="stable")[:, : max(0, n)]


def _distances(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    q = np.asarray(q, np.float64)
    return (q * q).sum(1)[:, None] - 2 * q @ m.T + (m * m).sum(1)[None, :]


def clusters(df: DataFrame, dimension: int | None = None) -> Clusters:
    """Checked centroids of a table (cluster_id, centroid); at most MOST.

    Errors: none at all, null or repeated ids, empty centroids, mixed lengths,
    a length other than ``dimension``.
    """
    rows = df.select("cluster_id", "centroid").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} centroids")
    if not rows:
        raise ValueError("no centroids")
    ids = [r[0] for r in rows]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError("cluster ids must be given and unique")
    sizes = {len(r[1] or []) for r in rows}
    if 0 in sizes or len(sizes) > 1:
        raise ValueError("centroids must have one length, not 0")
    if dimension is not None and sizes != {dimension}:
        raise ValueError(f"centroids have {sizes.pop()} dimensions, not {dimension}")
    rows.sort()
    return Clusters(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32).astype(np.float64))


def read_centroids(spark: SparkSession, path: str, dimension: int | None = None) -> Clusters:
    return clusters(spark.read.schema("cluster_id int, centroid array<float>").json(path), dimension)


def by_label(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(cluster_id, centroid): the mean vector of each label, summed by position on the map side."""
    at = df.where(F.col(label).isNotNull()).select(F.col(label).alias("cluster_id"), F.posexplode(vector).alias("i", "x"))
    mean = at.groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))
