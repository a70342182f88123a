"""Two-pass approximate text search over quantised chunks.

Pass 1: the nearest clusters of every query chunk are probed, one-bit codes of
all chunks in them are scored, and a document's score is the sum over query
chunks of its best chunk. Pass 2: the best documents are ranked again by the
multi-bit code of the whole document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.functions.vectors import pack_bits
from marlstone.operators import rabitq
from marlstone.operators.blocks import best_each, matrix
from marlstone.sources.centroids import Clusters
from marlstone.sources.embedder import Embedder, checked

ENTRY = "doc_id bigint, part int, cluster_id int, style string, bits int, add double, scale double, err double, code binary"


def typed(schema: str, df: DataFrame) -> str:
    """A schema with the type that ``doc_id`` has in ``df``; documents may have ids of any type."""
    return schema.replace("doc_id bigint", f"doc_id {df.schema['doc_id'].dataType.simpleString()}")


#: (codes, bits, add, scale, query, dot products of the query with each row's centroid) to estimated dot products.
Estimator = Callable[[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Config:
    dimension: int = 768
    top_k: int = 100
    dense_bits: int = 8
    n_probes: int = 32
    window: int = text.WINDOW
    step: int = text.STEP
    first_pass: int = 1000
    cache_ttl_s: int = 86_400

    def __post_init__(self) -> None:
        if not 2 <= self.dense_bits <= 8:
            raise ValueError("dense codes have 2 to 8 bits")
        if self.dimension < 1 or self.n_probes < 1 or self.first_pass < 1:
            raise ValueError("dimension, probes and first pass must be positive")


def assign_cluster(x: np.ndarray, clusters: Clusters) -> np.ndarray:
    """Rows of the nearest centroids."""
    return clusters.probe(x, 1)[:, 0]


def quantise(vectors: DataFrame, clusters: Clusters, config: Config) -> DataFrame:
    """Entries of (doc_id, part, embedding): part 0 is the whole document with a multi-bit code, the others are chunks with one bit.

    Null vectors and those of another dimension give no entry.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == clusters.dimension for v in pdf["embedding"]]]
            out = []
            if len(pdf):
                x = np.array(pdf["embedding"].tolist(), np.float32)
                near = assign_cluster(x, clusters)
                for d, p, v, c in zip(pdf["doc_id"], pdf["part"], x, near):
                    e = rabitq.one_bit(v, clusters.matrix[c]) if p else rabitq.multi_bit(v, clusters.matrix[c], config.dense_bits)
                    raw = pack_bits(e.codes) if p else e.codes.tobytes()
                    out.append((d, p, int(clusters.ids[c]), "SingleBit" if p else "MultiBit", e.bits, e.add, e.scale, e.error, raw))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return vectors.select("doc_id", "part", "embedding").mapInPandas(run, typed(ENTRY, vectors))


def document_parts(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, part, payload): the whole text and its sentence windows; documents without text give none."""
    some = docs.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    parts = F.concat(F.array("text"), text.chunk_document(F.col("text"), config.window, config.step))
    return some.select("doc_id", F.posexplode(parts).alias("part", "payload"))


def query_parts(query: str, config: Config) -> list[str]:
    """The whole query and its word windows."""
    w = query.split()
    n, size, step = len(w), max(1, config.window), max(1, config.step)
    count = 0 if not n else min(1 + -(-max(n - size, 0) // step), -(-n // step))
    return [query, *[" ".join(w[i * step : i * step + size]) for i in range(count)]]


def embed_query(query: str, embed: Embedder, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(chunk vectors, whole vector); no vectors for a blank query."""
    if not query.strip():
        return np.zeros((0, config.dimension), np.float32), np.zeros(0, np.float32)
    v = checked(embed, query_parts(query, config), config.dimension)
    return v[1:], v[0]


def sound(entries: DataFrame, clusters: Clusters, style: str, bits: int, code_bytes: int) -> DataFrame:
    """Entries that can be scored: the style, width and code length expected, a known cluster, all factors given."""
    known = F.col("cluster_id").isin([int(i) for i in clusters.ids])
    whole = F.octet_length("code") == code_bytes
    return entries.where((F.col("style") == style) & (F.col("bits") == bits) & known & whole & F.col("add").isNotNull() & F.col("scale").isNotNull() & F.col("err").isNotNull())


def corrupt(entries: DataFrame, clusters: Clusters, config: Config) -> DataFrame:
    """(style, n_entries, n_corrupt)."""
    dense = sound(entries, clusters, "MultiBit", config.dense_bits, config.dimension)
    sparse = sound(entries, clusters, "SingleBit", 1, -(-config.dimension // 64) * 8)
    good = dense.unionByName(sparse).groupBy("style").agg(F.count(F.lit(1)).alias("good"))
    every = entries.groupBy("style").agg(F.count(F.lit(1)).alias("n_entries"))
    return every.join(good, "style", "left").select("style", "n_entries", (F.col("n_entries") - F.coalesce("good", F.lit(0))).alias("n_corrupt"))


def first_pass(entries: DataFrame, clusters: Clusters, q: np.ndarray, config: Config, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): sum over query chunks of the best chunk of the document in any probed cluster.

    The probe is a filter on ``cluster_id`` that prunes files of a table
    partitioned by it; ``allowed`` (doc_id) is a semi-join before any scoring.
    Each task folds its rows to one row per document and query chunk.
    """
    q = np.asarray(q, np.float64)
    rows = np.unique(clusters.probe(q, config.n_probes))
    ids = clusters.ids[rows]
    near = {int(i): clusters.matrix[r] @ q.T for i, r in zip(ids, rows)}
    d = clusters.dimension
    hit = sound(entries, clusters, "SingleBit", 1, -(-d // 64) * 8).where(F.col("cluster_id").isin([int(i) for i in ids]))
    if allowed is not None:
        hit = hit.join(allowed.select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1), axis=1, bitorder="little")[:, :d]
            base = np.stack([near[c] for c in pdf["cluster_id"]])
            s = base + pdf["scale"].to_numpy()[:, None] * (2 * (bits.astype(np.float64) @ q.T) - q.sum(1)[None, :])
            docs, at = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
            best = np.full((len(docs), len(q)), -np.inf)
            np.maximum.at(best, at, s)
            yield pd.DataFrame({"doc_id": np.repeat(docs, len(q)), "chunk": np.tile(np.arange(len(q)), len(docs)), "s": best.ravel()})

    scored = hit.select("doc_id", "cluster_id", "scale", "code").mapInPandas(run, typed("doc_id bigint, chunk int, s double", entries))
    return scored.groupBy("doc_id", "chunk").agg(F.max("s").alias("s")).groupBy("doc_id").agg(F.sum("s").alias("score"))


def second_pass(entries: DataFrame, clusters: Clusters, q: np.ndarray, candidates: DataFrame, config: Config, estimator: Estimator = rabitq.estimate) -> DataFrame:
    """(doc_id, dot_product, error_bound) of candidates whose document has exactly one dense entry, and that a sound one; ``estimator`` may take the place of the usual estimate."""
    q = np.asarray(q, np.float64)
    dense = entries.where("part = 0").join(candidates.select("doc_id"), "doc_id", "left_semi")
    single = dense.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    good = sound(dense, clusters, "MultiBit", config.dense_bits, clusters.dimension).join(single.select("doc_id"), "doc_id", "left_semi")
    near = dict(zip(clusters.ids.tolist(), clusters.matrix @ q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1).astype(np.float64)
            base = np.array([near[c] for c in pdf["cluster_id"]])
            dot = estimator(codes, config.dense_bits, pdf["add"].to_numpy(), pdf["scale"].to_numpy(), q, base) if len(pdf) else []
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "dot_product": dot, "error_bound": pdf["err"]})

    return good.select("doc_id", "cluster_id", "add", "scale", "err", "code").mapInPandas(run, typed("doc_id bigint, dot_product double, error_bound double", entries))


def search(entries: DataFrame, clusters: Clusters, sparse: np.ndarray, dense: np.ndarray, config: Config, allowed: DataFrame | None = None, top_k: int | None = None) -> DataFrame:
    """(doc_id, dot_product, error_bound), best first, ties by smaller doc_id.

    No query vectors, vectors of another dimension or ``top_k`` 0 give no rows.
    """
    k = config.top_k if top_k is None else top_k
    none = entries.sparkSession.createDataFrame([], typed("doc_id bigint, dot_product double, error_bound double", entries))
    sparse, dense = np.asarray(sparse), np.asarray(dense)
    if not len(sparse) or not len(dense) or sparse.shape[1:] != (clusters.dimension,) or dense.shape != (clusters.dimension,) or k <= 0:
        return none
    cut = first_pass(entries, clusters, sparse, config, allowed).orderBy(F.desc("score"), "doc_id").limit(config.first_pass)
    return second_pass(entries, clusters, dense, cut, config).orderBy(F.desc("dot_product"), "doc_id").limit(k)


def first_pass_each(entries: DataFrame, clusters: Clusters, sparse: DataFrame, config: Config, allowed: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, rank, doc, score): ``first_pass`` for every query of ``sparse`` (query_id, chunk, vector), in blocks; the best ``k`` (default: the first-pass cut) of each."""
    d = clusters.dimension
    hit = sound(entries, clusters, "SingleBit", 1, -(-d // 64) * 8)
    if allowed is not None:
        hit = hit.join(allowed.select("doc_id"), "doc_id", "left_semi")
    rows = hit.select(F.col("doc_id").alias("doc"), "cluster_id", "scale", "code")
    where = {int(c): i for i, c in enumerate(clusters.ids)}

    def score(x: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        v = matrix(q["vector"])
        bits = np.unpackbits(np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1), axis=1, bitorder="little")[:, :d]
        at = np.array([where[c] for c in x["cluster_id"]])
        s = (clusters.matrix @ v.T)[at] + x["scale"].to_numpy()[:, None] * (2 * (bits.astype(np.float64) @ v.T) - v.sum(1)[None, :])
        ids, of = np.unique(q["query_id"].to_numpy(), return_inverse=True)
        probed = np.zeros((len(clusters.ids), len(ids)), bool)  # clusters that any chunk of a query probes
        near = clusters.probe(v, config.n_probes)
        probed[near.ravel(), np.repeat(of, near.shape[1])] = True
        return np.where(probed[at][:, of], s, -np.inf)

    asked = sparse.select("query_id", "chunk", "vector").where(F.size("vector") == d)
    return best_each(rows, asked, score, config.first_pass if k is None else k)


def second_pass_each(entries: DataFrame, clusters: Clusters, candidates: DataFrame, dense: DataFrame, config: Config) -> DataFrame:
    """(query_id, doc_id, dot_product, error_bound) of candidates (query_id, doc_id) whose document has exactly one dense entry, and that a sound one; ``dense`` has (query_id, vector)."""
    whole = entries.where("part = 0")
    single = whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    good = sound(whole, clusters, "MultiBit", config.dense_bits, clusters.dimension).join(single.select("doc_id"), "doc_id", "left_semi")
    pairs = candidates.select("query_id", "doc_id").join(good.select("doc_id", "cluster_id", "add", "scale", "err", "code"), "doc_id")
    pairs = pairs.join(dense.select("query_id", "vector").where(F.size("vector") == clusters.dimension), "query_id")
    where = {int(c): i for i, c in enumerate(clusters.ids)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q = matrix(pdf["vector"])
            codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1).astype(np.float64)
            base = np.einsum("ij,ij->i", clusters.matrix[[where[c] for c in pdf["cluster_id"]]], q)
            dot = rabitq.estimate_rows(codes, config.dense_bits, pdf["add"].to_numpy(), pdf["scale"].to_numpy(), q, base)
            yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "dot_product": dot, "error_bound": pdf["err"]})

    return pairs.mapInPandas(run, typed("query_id bigint, doc_id bigint, dot_product double, error_bound double", entries))


def search_each(entries: DataFrame, clusters: Clusters, sparse: DataFrame, dense: DataFrame, config: Config, allowed: DataFrame | None = None, top_k: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, dot_product, error_bound): ``search`` for a whole set of queries; one without vectors has no rows."""
    cut = first_pass_each(entries, clusters, sparse, config, allowed).select("query_id", F.col("doc").alias("doc_id"))
    got = second_pass_each(entries, clusters, cut, dense, config)
    w = W.partitionBy("query_id").orderBy(F.desc("dot_product"), "doc_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (config.top_k if top_k is None else top_k)).select("query_id", "rank", "doc_id", "dot_product", "error_bound")


def hydrated(hits: DataFrame, docs: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    """Documents of a page of ranked hits, best first; the page is cut first, so missing documents shorten it."""
    skip = (max(1, page_no) - 1) * max(1, page_size)
    page = hits.orderBy(F.desc("dot_product"), "doc_id").offset(skip).limit(max(1, page_size))
    return page.join(docs, "doc_id").orderBy(F.desc("dot_product"), "doc_id")


def replace_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after an upsert: all entries of a re-embedded document give way, sparse and dense each by itself."""
    again = new.select("doc_id", "style").distinct()
    return old.join(again, ["doc_id", "style"], "left_anti").unionByName(new)


def missing(docs: DataFrame, entries: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents with text that are neither embedded nor queued."""
    some = docs.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    return some.join(entries.select("doc_id").distinct(), "doc_id", "left_anti").join(queue.select("doc_id").distinct(), "doc_id", "left_anti")


def invalid(entries: DataFrame, clusters: Clusters, config: Config) -> DataFrame:
    """(doc_id) of documents whose entries aren't one sound dense entry and sound chunks only; for a validating reconcile."""
    good = sound(entries, clusters, "MultiBit", config.dense_bits, config.dimension).unionByName(sound(entries, clusters, "SingleBit", 1, -(-config.dimension // 64) * 8))
    n = lambda c: F.count_if(c)
    have = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("all"), n(F.col("style") == "MultiBit").alias("dense"))
    fine = good.groupBy("doc_id").agg(F.count(F.lit(1)).alias("good"))
    both = have.join(fine, "doc_id", "left")
    return both.where((F.coalesce("good", F.lit(0)) < F.col("all")) | (F.col("dense") != 1)).select("doc_id")
