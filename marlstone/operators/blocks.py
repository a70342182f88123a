"""A stated set of queries scored against all rows, block by block.

Rows are dealt to blocks by document, queries to blocks by query, and every
block of rows meets every block of queries in one task as two matrices. Only the
best documents of each query leave a task. A document with more rows than a block
holds is dealt out by row, and its chunk maxima are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024

#: (rows, query vectors) to a matrix of scores; -inf where a row isn't to count.
Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def best_each(rows: DataFrame, queries: DataFrame, score: Score, k: int) -> DataFrame:
    """(query_id, doc, score): the k documents of each query with the largest sums over its chunks of the best row; ties by smaller doc.

    ``rows`` has doc and whatever ``score`` reads, ``queries`` (query_id bigint,
    chunk int, vector). A document that no chunk scores is no hit; without rows
    or queries there are no hits.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    per = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    n, most = per.agg(F.sum("n"), F.max("n")).first()
    asked = queries.select("query_id").distinct().count()
    r, c = max(1, -(-(n or 0) // BLOCK_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    if (most or 0) > BLOCK_ROWS:  # at most n / BLOCK_ROWS such documents
        rows = rows.join(F.broadcast(per.where(F.col("n") > BLOCK_ROWS).select("doc", F.lit(True).alias("cut"))), "doc", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    else:
        rows = rows.withColumn("cut", F.lit(False))
    block = F.pmod(F.when(F.col("cut"), F.floor(F.rand(5) * r)).otherwise(F.xxhash64("doc")), F.lit(r)).cast("int")
    left = rows.withColumn("rb", block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(c)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk": pd.Series(dtype="Int32"), "doc": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if not len(x) or not len(q):
            return none
        q = q.sort_values(["query_id", "chunk"], kind="stable").reset_index(drop=True)
        x = x.sort_values(["cut", "doc"], kind="stable").reset_index(drop=True)
        s = score(x, q)
        docs = x["doc"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        best = np.maximum.reduceat(s, first, axis=0)
        docs, cut = docs[first], x["cut"].to_numpy()[first]
        ids = q["query_id"].to_numpy()
        out = []
        if cut.any():
            i, j = np.nonzero(np.isfinite(best) & cut[:, None])
            out.append(pd.DataFrame({"query_id": ids[j], "chunk": q["chunk"].to_numpy()[j], "doc": docs[i], "score": best[i, j]}))
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        hit = np.isfinite(best[~cut])
        total = np.add.reduceat(np.where(hit, best[~cut], 0.0), start, axis=1)
        total = np.where(np.add.reduceat(hit, start, axis=1, dtype=np.int64) > 0, total, -np.inf)
        docs, ids = docs[~cut], ids[start]
        if len(docs):
            least = np.partition(total, len(docs) - k, axis=0)[len(docs) - k] if len(docs) > k else np.full(len(ids), -np.inf)
            i, j = np.nonzero((total >= least) & np.isfinite(total))
            out.append(pd.DataFrame({"query_id": ids[j], "chunk": None, "doc": docs[i], "score": total[i, j]}).astype({"chunk": "Int32"}))
        return pd.concat(out) if out else none

    got = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(run, f"query_id bigint, chunk int, doc {kind}, score double")
    whole = got.where("chunk is null").select("query_id", "doc", "score")
    if (most or 0) > BLOCK_ROWS:
        parts = got.where("chunk is not null").groupBy("query_id", "doc", "chunk").agg(F.max("score").alias("score"))
        whole = whole.unionByName(parts.groupBy("query_id", "doc").agg(F.sum("score").alias("score")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)
