"""Exact vector operators: nearest centroids, dot-product ranking, late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors as fv
from marlstone.operators.blocks import best_each, matrix
from marlstone.sources.centroids import Clusters


def _array(q: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def nearest_centroids(df: DataFrame, row_id: str, vector: str, clusters: Clusters, n: int = 1) -> DataFrame:
    """(<row_id>, rank, cluster_id, d2): the n nearest centroids by squared distance, ties by smaller id.

    The centroids are a checked, bounded matrix in every task, so there is no
    join. Null vectors and those of another dimension give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == clusters.dimension for v in pdf["v"]]]
            x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), clusters.dimension)
            near = clusters.probe(x, n)
            k = near.shape[1]
            d2 = ((x[:, None, :] - clusters.matrix[near]) ** 2).sum(2) if len(x) else np.zeros((0, k))
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), k), "rank": np.tile(np.arange(1, k + 1), len(pdf)), "cluster_id": clusters.ids[near].ravel(), "d2": d2.ravel()})

    got = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(run, "id bigint, rank int, cluster_id int, d2 double")
    return got.withColumnRenamed("id", row_id)


def with_centroid(df: DataFrame, vector: str, assigned: DataFrame, clusters: Clusters, row_id: str) -> DataFrame:
    """``df`` with its rank-1 centroid as an array column."""
    table = F.broadcast(df.sparkSession.createDataFrame([(int(i), [float(x) for x in c]) for i, c in zip(clusters.ids, clusters.matrix)], "cluster_id int, centroid array<double>"))
    return df.join(assigned.where("rank = 1").select(row_id, "cluster_id"), row_id).join(table, "cluster_id")


def top_k(df: DataFrame, row_id: str, vector: str, q: np.ndarray, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(<row_id>, score): the k largest dot products with ``q``, ties by smaller id; ``allowed`` is a semi-join before scoring."""
    rows = df if allowed is None else df.join(allowed.select(row_id), row_id, "left_semi")
    rows = rows.where(F.size(vector) == len(q))
    return rows.select(row_id, fv.dot(F.col(vector), _array(q)).alias("score")).orderBy(F.desc("score"), row_id).limit(k)


def max_sim_each(df: DataFrame, doc_id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, <doc_id>, score): the k best documents of every query of ``queries`` (query_id, chunk, vector), in blocks.

    The score of a document is the sum over the query's vectors of the best
    dot product with any of its vectors. Null vectors and those of another
    dimension than the first query's are left out, and so are null ids.
    """
    one = queries.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
    d = one[0] if one else 0
    rows = df.select(F.col(doc_id).alias("doc"), F.col(vector).alias("v")).where((F.size("v") == d) & F.col("doc").isNotNull())
    asked = queries.select("query_id", "chunk", "vector").where(F.size("vector") == d)
    got = best_each(rows, asked, lambda x, q: matrix(x["v"]) @ matrix(q["vector"]).T, k)
    return got.withColumnRenamed("doc", doc_id)


def top_k_each(df: DataFrame, row_id: str, vector: str, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, <row_id>, score): the k largest dot products with each of ``queries`` (query_id, vector); ``allowed`` is a semi-join before scoring."""
    rows = df if allowed is None else df.join(allowed.select(row_id), row_id, "left_semi")
    return max_sim_each(rows, row_id, vector, queries.select("query_id", F.lit(0).alias("chunk"), "vector"), k)


def max_sim(df: DataFrame, doc_id: str, vector: str, queries: list[np.ndarray]) -> DataFrame:
    """(<doc_id>, score): sum over query vectors of the best dot product with any vector of the document."""
    per = df.where(F.size(vector) == len(queries[0])).groupBy(doc_id).agg(*[F.max(fv.dot(F.col(vector), _array(q))).alias(f"m{i}") for i, q in enumerate(queries)])
    return per.select(doc_id, sum((F.col(f"m{i}") for i in range(len(queries))), F.lit(0.0)).alias("score"))
