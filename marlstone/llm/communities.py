"""Problem 1: clusters of mutually similar vectors.

Method: an approximate nearest-neighbour graph by neighbour descent (every
vertex introduces its neighbours to each other) from several independent
partitions, until hardly an edge changes, then modularity-based community
detection on the graph (local moves, contraction, moves again, until nothing
moves; communities without cohesion join others), each community described by
the members of highest internal weighted degree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import vectors as V
from marlstone.llm.nearest import top_of
from marlstone.runtime import Table, hot_rows, join_hot, scratch

NEIGHBOURS = 8  # kept for each vertex during the descent
REVERSE = 8  # best incoming edges that take part in a local join; more are left to the other end
MEETINGS = 2048  # vertices around which neighbours meet at once
GRAPH = 6  # best neighbours that become edges
SEEDS = 3  # independent partitions the descent begins from; they link each other's blocks
CHANGED = 0.005  # the descent ends with a round in which a smaller share of the edges is new
LOCAL, LOCAL_EDGES = 100_000, 2_000_000  # vertices and edges of a graph that one task settles; larger ones move in rounds over all tasks
SETTLED, STALLED = 0.01, 3  # such a level ends when a smaller share of its vertices moves, or no fewer than before for so many rounds
INSIDE = 0.7  # part of its weight that a community keeps inside
TYPICAL = 3
LEAF_ROWS, BLOCK_ROWS, LEAVES = 512, 1024, 4096
FIT_ROWS = 64  # sampled rows for each leaf, at most V.SAMPLE in all
CENTROIDS = 65_536  # most centroids that are held by each task


def seed_graph(reps: DataFrame, n: int, k: int = NEIGHBOURS, seed: int = 0) -> DataFrame:
    """(a, b, s): k neighbours of each vertex inside its own small block of one partition, where the descent begins."""
    leaves = max(1, min(LEAVES, n // LEAF_ROWS))
    x = V.sample_units(reps, n, "rep", min(V.SAMPLE, FIT_ROWS * leaves))
    centres = V.spherical_means(x, min(leaves, max(1, len(x) // 8)), rounds=4, seed=5 + seed) if n else np.zeros((1, V.DIM), np.float32)
    del x

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lab = V.nearest_centre(V.unit(V.codes_of(b.column("code").to_pylist())), centres)[0]
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("code"), pa.array(lab.astype(np.int32))], names=["rep", "code", "leaf"])

    placed = Table(reps.mapInArrow(assign, "rep bigint, code binary, leaf int"), "leaves").df
    size = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    placed = placed.join(F.broadcast(size), "leaf")  # at most LEAVES rows

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, u = pdf["rep"].to_numpy(np.int64), V.unit(V.codes_of(pdf["code"].tolist()))
        s = u @ u.T
        np.fill_diagonal(s, -2)
        j = top_of(s, k)
        i = np.repeat(np.arange(len(ids)), j.shape[1])
        j = j.ravel()
        keep = i != j
        return pd.DataFrame({"a": ids[i[keep]], "b": ids[j[keep]], "s": s[i[keep], j[keep]]})

    return placed.groupBy("leaf", F.pmod(F.xxhash64("rep", F.lit(seed)), "blocks").alias("block")).applyInPandas(block, "a bigint, b bigint, s float")


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, s, new): the k best of each vertex; what several tasks found counts once, and is new if all found it so."""
    one = edges.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    per = one.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), "b", "new"))), 1, k).alias("t"))
    return per.select("a", F.explode("t").alias("e")).select("a", F.col("e.b").alias("b"), (-F.col("e.m")).alias("s"), F.col("e.new").alias("new"))


def descend(graph: DataFrame, reps: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """One round of neighbour descent on edges (a, b, s, new).

    Around each vertex meet its k neighbours and its REVERSE best incoming
    ones, so a hub's join is as small as any other's; the limit on incoming
    edges acts before the shuffle. Two that are both old there have met before.
    """
    w = W.partitionBy("b").orderBy(F.desc("s"), "a")
    back = graph.withColumn("r", F.row_number().over(w)).where(F.col("r") <= REVERSE).select(F.col("b").alias("v"), F.col("a").alias("u"), "new")
    meet = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "new").unionByName(back).groupBy("v", "u").agg(F.max("new").alias("new"))
    floor = graph.groupBy("a").agg(F.min("s").alias("floor"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.when(F.col("n") < k, F.lit(-2.0)).otherwise(F.col("floor")).cast("float").alias("floor"))
    who = reps.select(F.col("rep").alias("u"), "code").join(floor, "u", "left")
    around = meet.join(who, "u").groupBy("v").agg(F.collect_list(F.struct("u", "floor", "new", "code")).alias("m")).where(F.exists("m", lambda e: e["new"]))

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in (b.column("m").slice(at, MEETINGS) for b in batches for at in range(0, b.num_rows, MEETINGS)):
            flat, sizes = m.flatten(), np.diff(m.offsets.to_numpy())
            if not len(flat):
                continue
            ids = flat.field("u").to_numpy(zero_copy_only=False)
            low = np.nan_to_num(flat.field("floor").to_numpy(zero_copy_only=False).astype(np.float32), nan=-2.0)
            fresh = flat.field("new").to_numpy(zero_copy_only=False).astype(bool)
            x = V.unit(V.codes_of(flat.field("code").to_pylist()))
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out = []
            for width in np.unique(sizes):
                if width < 2:
                    continue
                at = start[sizes == width][:, None] + np.arange(width)[None, :]
                i, j = np.triu_indices(width, 1)
                for c in range(0, len(at), 2048):
                    g = at[c : c + 2048]
                    y = x[g]
                    s = np.matmul(y, y.transpose(0, 2, 1))[:, i, j]
                    p, q = g[:, i], g[:, j]
                    unmet = fresh[p] | fresh[q]
                    for p, q in ((p, q), (q, p)):
                        new = unmet & (s > low[p])
                        out.append((ids[p[new]], ids[q[new]], s[new]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["a", "b", "s"])

    found = around.select("m").mapInArrow(introduce, "a bigint, b bigint, s float").where("a <> b")
    return best_edges(graph.withColumn("new", F.lit(False)).select("a", "b", "s", "new").unionByName(found.withColumn("new", F.lit(True))), k)


def neighbour_graph(reps: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, s): about the k most similar vertices of every vertex, by cosine.

    Every round only replaces edges by better ones, so the descent comes to an end.
    """
    n = reps.count()
    seeds = [Table(seed_graph(reps, n, k, i), "seed") for i in range(SEEDS if n > LEAF_ROWS else 1)]
    edges = seeds[0].df
    for t in seeds[1:]:
        edges = edges.unionByName(t.df)
    got = Table(best_edges(edges.withColumn("new", F.lit(True)), k), "graph")
    for t in seeds:
        t.drop()
    while True:
        nxt = Table(descend(got.df, reps, k), "graph")
        got.drop()
        got = nxt
        new, edges = got.df.agg(F.count_if("new"), F.count(F.lit(1))).first()
        if new <= CHANGED * edges:
            return got.df.drop("new")


def _moves(edges: DataFrame, vertices: DataFrame, total: float, salt: int) -> tuple[DataFrame, bool]:
    """(v, c) and whether any vertex moved: communities of a large graph by local moves in rounds.

    ``edges`` (a, b, w) holds both directions without loops, ``vertices``
    (v, k) the weighted degrees, ``total`` their sum. In a round one random half
    of the vertices moves at once, then the other; a tie goes to the smaller
    community. The level ends once fewer than SETTLED of the vertices move, or
    their number has not fallen for STALLED rounds.
    """
    lab = Table(vertices.select("v", F.col("v").alias("c"), "k", F.lit(False).alias("moved")), "labels")
    n, least, stalled, r, any_ = vertices.count(), None, 0, 0, False
    while True:
        for half in (0, 1):
            now = lab.df
            size = now.groupBy("c").agg(F.sum("k").alias("t"))
            into = edges.join(now.select(F.col("v").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            moving = now.where(F.pmod(F.xxhash64("v", F.lit(salt), F.lit(r)), F.lit(2)) == half)
            stay = moving.select(F.col("v").alias("a"), "c", F.lit(0.0).alias("w"))
            option = into.unionByName(stay).groupBy("a", "c").agg(F.sum("w").alias("w")).join(size, "c")
            own = moving.select(F.col("v").alias("a"), F.col("c").alias("c0"), "k")
            gain = F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0.0)) / F.lit(total)
            to = option.join(own, "a").groupBy("a").agg(F.max(F.struct(gain.alias("g"), (F.col("c") == F.col("c0")).alias("own"), (-F.col("c")).alias("m"))).alias("x"))
            to = to.where("not x.own").select(F.col("a").alias("v"), (-F.col("x.m")).alias("to"))
            before = F.col("moved") if half else F.lit(False)
            nxt = Table(now.join(to, "v", "left").select("v", F.coalesce("to", "c").alias("c"), "k", (before | F.col("to").isNotNull()).alias("moved")), "labels")
            lab.drop()
            lab = nxt
        moved = lab.df.where("moved").count()
        r, any_ = r + 1, any_ or moved > 0
        stalled = 0 if least is None or moved < least else stalled + 1
        least = moved if least is None else min(least, moved)
        if moved <= SETTLED * n or stalled >= STALLED:
            return lab.df.select("v", "c"), any_


def _joined(edges: DataFrame, vertices: DataFrame, r: int) -> tuple[DataFrame, bool]:
    """(v, c) and whether a loose community is left: one round in which half of them join the one they share most weight with."""
    out = edges.groupBy("a").agg(F.sum("w").alias("cut"), F.max(F.struct("w", (-F.col("b")).alias("m"))).alias("x"))
    loose = vertices.join(out, F.col("v") == F.col("a")).where(F.col("cut") > (1 - INSIDE) * F.col("k"))
    loose = Table(loose.select("v", (-F.col("x.m")).alias("to"), (F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0).alias("goes")), "loose").df
    going = loose.where("goes")
    to = going.join(going.select(F.col("v").alias("to")), "to", "left_anti").select("v", "to")  # no chains
    return vertices.select("v").join(to, "v", "left").select("v", F.coalesce("to", "v").alias("c")), loose.limit(1).count() > 0


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges without loops, sorted by (a, b), parallel ones added up."""
    keep = a != b
    key, at = np.unique(a[keep] * n + b[keep], return_inverse=True)
    return key // n, key % n, np.bincount(at, w[keep], minlength=len(key))


def _best_moves(k: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float) -> np.ndarray:
    """Communities after local moves, one vertex at a time, until no move adds to the modularity."""
    n = len(k)
    start = np.searchsorted(a, np.arange(n + 1)).tolist()
    nb, wt, kk = b.tolist(), w.tolist(), k.tolist()
    comm, tot = list(range(n)), k.tolist()
    todo = deque(np.random.default_rng(17).permutation(n).tolist())
    waits = [True] * n
    while todo:
        v = todo.popleft()
        waits[v] = False
        near: dict[int, float] = {}
        for i in range(start[v], start[v + 1]):
            c = comm[nb[i]]
            near[c] = near.get(c, 0.0) + wt[i]
        own = best = comm[v]
        tot[own] -= kk[v]
        share = kk[v] / total
        most = near.get(own, 0.0) - share * tot[own] + 1e-9
        for c, x in near.items():
            g = x - share * tot[c]
            if g > most:
                best, most = c, g
        tot[best] += kk[v]
        if best != own:
            comm[v] = best
            for i in range(start[v], start[v + 1]):
                u = nb[i]
                if comm[u] != best and not waits[u]:
                    waits[u] = True
                    todo.append(u)
    return np.unique(comm, return_inverse=True)[1]


def settle(k: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float) -> np.ndarray:
    """Community of every vertex of a graph that fits in one task.

    Moves and contractions until a level moves nothing; then a community that
    keeps less than INSIDE of its weight inside joins the one it shares most
    weight with, the loosest first, until all keep as much.
    """
    lab = np.arange(len(k))
    a, b, w = _summed(a, b, w, len(k))
    joining = False
    while True:
        n = len(k)
        if not joining:
            c = _best_moves(k, a, b, w, total)
            joining = c.max(initial=-1) + 1 == n
        if joining:
            cut = np.bincount(a, w, minlength=n)
            loose = np.flatnonzero(cut > (1 - INSIDE) * k + 1e-9)
            c, touched = np.arange(n), np.zeros(n, bool)
            first = np.searchsorted(a, np.arange(n + 1))
            for v in loose[np.argsort((1 - cut / np.maximum(k, 1e-12))[loose], kind="stable")]:
                near = slice(first[v], first[v + 1])
                to = b[near][w[near].argmax()]
                if not touched[v] and not touched[to]:
                    c[v], touched[v], touched[to] = to, True, True
            if not len(loose):
                return lab
            c = np.unique(c, return_inverse=True)[1]
        lab = c[lab]
        m = c.max() + 1
        k = np.bincount(c, k, minlength=m)
        a, b, w = _summed(c[a], c[b], w, m)


def _settled(edges: DataFrame, vertices: DataFrame, total: float) -> DataFrame:
    """(v, c): ``settle`` for a graph of at most LOCAL vertices and LOCAL_EDGES edges, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vs = pdf[pdf["b"].isna()].sort_values("a")
        es = pdf[pdf["b"].notna()]
        ids = vs["a"].to_numpy(np.int64)
        a, b = (np.searchsorted(ids, es[x].to_numpy(np.int64)) for x in ("a", "b"))
        lab = settle(vs["w"].to_numpy(np.float64), a, b, es["w"].to_numpy(np.float64), total)
        first = np.full(lab.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, lab, ids)
        return pd.DataFrame({"v": ids, "c": first[lab]})

    rows = edges.select("a", "b", "w").unionByName(vertices.select(F.col("v").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("k").alias("w")))
    return rows.groupBy(F.lit("all").alias("one")).applyInPandas(run, "v bigint, c bigint")


def communities(graph: DataFrame, reps: DataFrame) -> DataFrame:
    """(v, c, inner): community and internal weighted degree of every vertex.

    Weights are cosines, negative ones left out; a vertex without edges is its
    own community. ``c`` is the smallest vertex of the community. A large graph
    is moved and contracted over all tasks until it fits in one (LOCAL) or
    nothing moves; communities that keep less than INSIDE of their weight
    inside are joined to others, so a loose cloud isn't left in pieces.
    """
    w = W.partitionBy("a").orderBy(F.desc("s"), "b")
    few = graph.where("s > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= GRAPH).select("a", "b", "s")
    both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    edges = whole = Table(both.groupBy("a", "b").agg(F.max("s").cast("double").alias("w")), "edges").df
    degree = edges.groupBy("a").agg(F.sum("w").alias("k"))
    vs = Table(reps.select(F.col("rep").alias("v")).join(degree.withColumnRenamed("a", "v"), "v", "left").select("v", F.coalesce("k", F.lit(0.0)).alias("k")), "vertices").df
    total = vs.agg(F.sum("k")).first()[0] or 1.0
    got, level, joining = None, 0, False

    def over(got: DataFrame | None, up: DataFrame) -> DataFrame:
        if got is None:
            return Table(up, "level").df
        return Table(got.join(up.select(F.col("v").alias("c"), F.col("c").alias("up")), "c").select("v", F.col("up").alias("c")), "level").df

    while vs.count() > LOCAL or edges.count() > LOCAL_EDGES:
        if not joining:
            up, moved = _moves(edges, vs, total, level)
            joining = not moved
        if joining:
            up, loose = _joined(edges, vs, level)
            if not loose:
                break
        up = Table(up, "up").df
        got = over(got, up)
        a, b = up.select(F.col("v").alias("a"), F.col("c").alias("ca")), up.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        edges = Table(edges.join(a, "a").join(b, "b").where("ca <> cb").groupBy("ca", "cb").agg(F.sum("w").alias("w")).toDF("a", "b", "w"), "contracted").df
        vs = Table(vs.join(up, "v").groupBy("c").agg(F.sum("k").alias("k")).withColumnRenamed("c", "v"), "contracted").df
        level += 1
    else:
        got = over(got, _settled(edges, vs, total))
    a, b = got.select(F.col("v").alias("a"), F.col("c").alias("ca")), got.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    inner = whole.join(a, "a").join(b, "b").where("ca = cb").groupBy("a").agg(F.sum("w").alias("inner")).withColumnRenamed("a", "v")
    name = got.groupBy("c").agg(F.min("v").alias("name"))
    return got.join(name, "c").join(inner, "v", "left").select("v", F.col("name").alias("c"), F.coalesce("inner", F.lit(0.0)).alias("inner"))


def members(entries: DataFrame) -> DataFrame:
    """(vec_id, scale, code, cluster_id, community, inner): every sound entry with its community.

    Equal vectors are one vertex of the graph and share its community, so a
    vector that many entries hold is compared once. Null or missing columns of
    an entry other than the packed vector don't matter; an empty table gives
    no rows.
    """
    with scratch():
        rows = Table(V.sound(entries, ("cluster_id",)), "sound").df
        key = Table(rows.groupBy("code").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps").df
        reps = key.select("rep", "code")
        got = Table(communities(neighbour_graph(reps), reps), "communities").df
        whose = reps.join(got, F.col("rep") == F.col("v")).select("code", F.col("c").alias("community"), "inner")
        mine = join_hot(rows, whose, ["code"], hot_rows(key, ["code"], "n"))
        return Table(mine.select("vec_id", "scale", "code", "cluster_id", "community", "inner"), "members", keep=True).df


def described(mine: DataFrame, k: int = TYPICAL) -> DataFrame:
    """(community, size, typical): size in entries and the k entries of highest internal weighted degree (ties: smaller vec_id)."""
    w = W.partitionBy("community").orderBy(F.desc("inner"), "vec_id")
    few = mine.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    typical = few.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vec_id"))), lambda e: e["vec_id"]).alias("typical"))
    return mine.groupBy("community").agg(F.count(F.lit(1)).cast("bigint").alias("size")).join(typical, "community")


def nearest_of(x: np.ndarray, head: np.ndarray, centres: np.ndarray, step: int = 16) -> np.ndarray:
    """Row of ``centres`` nearest to each row of ``x`` (ties: the first), all in double precision.

    ``head`` is a member of the rows' community. Centres are taken in order of
    their distance from it; a row is settled once the triangle inequality rules
    out all that follow, so the result is exact.
    """
    far = np.sqrt(((centres - head) ** 2).sum(1))
    order = np.argsort(far, kind="stable")
    mine = np.sqrt(((x - head) ** 2).sum(1))
    best, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    for at in range(0, len(order), step):
        open_ = open_[far[order[at]] - mine[open_] <= np.sqrt(best[open_]) + 1e-9]
        if not len(open_):
            break
        c = np.sort(order[at : at + step])
        y = x[open_]
        d = ((y[:, None, :] - centres[c][None]) ** 2).sum(2) if len(open_) * len(c) < 20_000 else np.stack([((y - z) ** 2).sum(1) for z in centres[c]], 1)
        j = d.argmin(1)
        v = d[np.arange(len(y)), j]
        better = (v < best[open_]) | ((v == best[open_]) & (c[j] < which[open_]))
        best[open_[better]], which[open_[better]] = v[better], c[j[better]]
    return which


def mended(mine: DataFrame, clusters: DataFrame) -> DataFrame:
    """(vec_id, stored, cluster_id): the nearest centroid of every sound entry, searched from its community's most typical entry.

    Centroids that are null, of another length or without id don't count, of a
    repeated id the smallest row does. Without any centroid there are no rows.
    """
    good = clusters.where(F.col("cluster_id").isNotNull() & (F.size("centroid") == V.DIM) & ~F.exists("centroid", lambda v: v.isNull()))
    got = good.groupBy("cluster_id").agg(F.min("centroid").alias("centroid")).orderBy("cluster_id").limit(CENTROIDS + 1).toPandas()
    if len(got) > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} centroids; mend against them in parts")
    ids = got["cluster_id"].to_numpy()
    centres = np.array(got["centroid"].tolist(), np.float64).reshape(len(got), V.DIM)
    heads = mine.groupBy("community").agg(F.max(F.struct("inner", (-F.col("vec_id")).alias("m"), "scale", "code")).alias("h"))
    heads = heads.select("community", F.col("h.scale").alias("hs"), F.col("h.code").alias("hc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(ids) or not len(pdf):
                continue
            x = V.codes_of(pdf["code"].tolist()) * pdf["scale"].to_numpy(np.float64)[:, None]
            h = V.codes_of(pdf["hc"].tolist()) * pdf["hs"].to_numpy(np.float64)[:, None]
            out = np.zeros(len(pdf), np.int64)
            c = pdf["community"].to_numpy()
            order = np.argsort(c, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
                out[rows] = nearest_of(x[rows], h[rows[0]], centres)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "stored": pdf["cluster_id"].astype("Int32"), "cluster_id": ids[out]})

    return mine.join(heads, "community").mapInPandas(run, "vec_id bigint, stored int, cluster_id int")


def wrong(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(vec_id, cluster_id) of sound entries whose stored cluster is null or not the nearest one."""
    got = mended(members(entries), clusters)
    return got.where(~F.col("stored").eqNullSafe(F.col("cluster_id"))).select("vec_id", "cluster_id")


def checked(mine: DataFrame, clusters: DataFrame, least: float = 0.9) -> DataFrame:
    """(entries, communities_each, together, apart): entries, communities per entry, and whether at least ``least`` of the entries are with the larger part of their nearest centroid's entries, and in a community most of which is nearest to their centroid."""
    at = mended(mine, clusters).select("vec_id", "cluster_id").join(mine.select("vec_id", "community"), "vec_id")
    per = Table(at.groupBy("community", "cluster_id").agg(F.count(F.lit(1)).alias("n")), "overlap").df
    whole, pure = (per.groupBy(c).agg(F.max("n").alias("m")).agg(F.sum("m").alias(n)) for c, n in (("cluster_id", "whole"), ("community", "pure")))
    n = mine.agg(F.countDistinct("vec_id").alias("entries"), F.count(F.lit(1)).alias("rows"))
    one = n.crossJoin(whole).crossJoin(pure)  # one row each
    return one.select("entries", F.ceil(F.col("rows") / F.col("entries")).cast("int").alias("communities_each"), (F.col("whole") >= least * F.col("rows")).alias("together"), (F.col("pure") >= least * F.col("rows")).alias("apart"))
