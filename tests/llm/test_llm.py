"""Every operator of the subpackage: brute force on small tables, nulls, ties, repeats, empty tables, clashing columns."""

import itertools
import json
import os
import random
import re
import threading
import time
from datetime import datetime as D
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import communities, copies, languages, leaks, nearest, packing, pieces, spellings
from marlstone.llm import vectors as V
from marlstone.runtime import shared_dir


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 and 5: vectors

ENTRY = "vec_id bigint, doc_id bigint, cluster_id int, scaling_factor float, packed_vector array<bigint>, rep string, code string, n int"


def entry(i, codes, scale=-0.01, cluster=None):
    words = np.asarray(codes, np.uint8).view("<i8").tolist()
    return (i, None, cluster, scale, words, "clash", "clash", 1)


@pytest.fixture(scope="module")
def cloud(spark):
    """Three groups of vectors, some copies, repeated rows and corrupt entries."""
    rng = np.random.default_rng(3)
    heads = rng.integers(40, 216, (3, 128))
    codes = {i: np.clip(heads[i % 3] + rng.integers(-30, 31, 128), 0, 255) for i in range(1, 301)}
    for i in (31, 61, 91, 121, 151, 181, 211):  # eight equal vectors
        codes[i] = codes[1]
    table = [entry(i, c, -0.01 - i * 1e-5, i % 5 or None) for i, c in codes.items()]
    table += [table[4], table[4], (900, None, 1, -0.01, None, "", "", 1), (901, None, 1, -0.01, [1] * 15, "", "", 1), (902, None, 1, -0.01, [None] * 16, "", "", 1), (903, None, 1, None, [5] * 16, "", "", 1), (None, None, 1, -0.01, [5] * 16, "", "", 1)]
    x = {i: (np.asarray(c, float) - 127.5) * float(np.float32(0.01 + i * 1e-5)) for i, c in codes.items()}
    return spark.createDataFrame(table, ENTRY).cache(), x


def brute_neighbours(x, k=5):
    out = {}
    for i, v in x.items():
        cos = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in x.items() if j != i)
        out[i] = [(j, -c) for c, j in cos[:k]]
    return out


def test_neighbours_against_brute_force(cloud):
    df, x = cloud
    want = brute_neighbours(x)
    got = {}
    for r in nearest.neighbours(df).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["other"], r["cosine"], r["dot_product"]))
    assert set(got) == set(want)
    for i, found in got.items():
        assert [o for _, o, _, _ in sorted(found)] == [j for j, _ in want[i]]
        for _, o, c, dp in found:
            assert c == pytest.approx(x[i] @ x[o] / np.linalg.norm(x[i]) / np.linalg.norm(x[o])) and dp == pytest.approx(x[i] @ x[o], rel=1e-6)
    pairs = {tuple(sorted((i, j))) for i, near in want.items() for j, c in near if c >= 0.8}
    assert set(map(tuple, nearest.close_pairs(df).collect())) == pairs


def test_neighbours_over_many_lists(cloud, monkeypatch):
    df, x = cloud
    monkeypatch.setattr(nearest, "LIST_ROWS", 20)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 30)
    want = {(i, j) for i, near in brute_neighbours(x).items() for j, _ in near}
    got = {(r["vec_id"], r["other"]) for r in nearest.neighbours(df).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_neighbours_keep_the_disk_small(spark, tmp_path, monkeypatch):
    """A round cloud, in which every vector probes every list: tables, shuffles and what is sent stay under four times the input."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((6000, 128))
    codes = np.clip(np.round(127.5 + 40 * v), 0, 255)
    spark.createDataFrame([entry(i, c)[:5] for i, c in enumerate(codes)], ENTRY.split(", rep")[0]).coalesce(1).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    places = [*spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.sparkContext._temp_dir, shared_dir(spark).removeprefix("file://")]

    def used(folders):
        total = 0
        for top in folders:
            for folder, _, files in os.walk(top):
                for f in files:
                    try:
                        total += os.path.getsize(f"{folder}/{f}")
                    except OSError:  # deleted meanwhile
                        pass
        return total

    monkeypatch.setattr(nearest, "ROUND_ROWS", 1000, raising=False)
    monkeypatch.setattr(nearest, "TURNS", 4, raising=False)  # six rounds share four bits
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before, seen, over = used(places), [], threading.Event()

    def watch():
        while not over.wait(0.02):
            seen.append(used(places))

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    nearest.neighbours(df).write.parquet(f"{tmp_path}/out")
    over.set()
    watcher.join()
    assert max(seen) - before <= 4 * used([f"{tmp_path}/in"])
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    monkeypatch.undo()
    assert got == rows(nearest.neighbours(df))
    x = codes - 127.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i, near in enumerate(np.argsort(-cos, axis=1)[:, :5]) for j in near}
    assert len(want & {(r[0], r[2]) for r in got}) >= 0.95 * len(want)


def test_rounds_cover_every_block_once():
    size, blocks = np.array([10, 0, 30, 5, 0]), np.array([1, 1, 3, 1, 1])
    assert nearest.rounds_of(size, blocks, 20) == [(0, 3, 0, 2), (3, 5, 2, 2), (5, 7, 3, 4)]
    assert nearest.rounds_of(size, blocks, 1000) == [(0, 7, 0, 4)] and nearest.rounds_of(np.zeros(1, int), np.ones(1, int), 20) == [(0, 1, 0, 0)]


def test_a_probe_keeps_the_best_of_many(monkeypatch):
    rng = np.random.default_rng(4)
    raw, mine = rng.integers(0, 256, (300, 128)).astype(np.uint8), rng.integers(0, 256, (50, 128)).astype(np.uint8)
    none = [[] for _ in mine]
    kinds = {"rep": pa.int64(), "code": pa.binary(), "block": pa.int32(), "floor": pa.float32(), "near": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "dots": pa.list_(pa.int32()), "coss": pa.list_(pa.float64())}
    values = [range(1000, 1050), [c.tobytes() for c in mine], [9] * 50, [-1.0] * 50, [[4, 5]] * 50, none, none, none]
    t = pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds.values())], names=list(kinds))
    block = np.repeat([7, 8, 10], 100)  # block 9 is their own
    got = []
    for most in (10, 10**6):
        monkeypatch.setattr(nearest, "FOLD_ROWS", most)
        out = nearest._probe(t, block, np.arange(300), raw, V.unit(V.codes_of([c.tobytes() for c in raw[:2]])), np.array([200, 100]), np.ones(2, np.float32), np.ones(2, np.float32), np.array([0, 0, 1, 1]), 4, V.rotation(), 5)
        got.append(out.to_pydict())
    assert got[0] == got[1]
    cos = V.unit(mine.astype(np.int16) * 2 - 255) @ V.unit(raw.astype(np.int16) * 2 - 255).T
    assert sum(len(set(a) & set(b)) for a, b in zip(got[0]["ids"], np.argsort(-cos, axis=1)[:, :5].tolist())) == 250


def test_adaptive_scan_loses_little():
    rng = np.random.default_rng(0)
    q, x = rng.standard_normal((200, 128)), rng.standard_normal((3000, 128))
    x[:200] += 2 * q
    unit = lambda m: (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    q, x = unit(q) @ V.rotation(), unit(x) @ V.rotation()
    floor = np.full(200, 0.25, np.float32)
    s = q @ x.T
    true = {(i, j) for i, j in zip(*np.nonzero(s > 0.25))}
    i, j, c = nearest.adaptive_scan(q, x, floor)
    assert set(zip(i, j)) <= true and len(set(zip(i, j))) >= 0.97 * len(true) and np.allclose(c, s[i, j], atol=1e-5)


def test_few_and_no_vectors(spark, cloud):
    df, _ = cloud
    assert nearest.neighbours(df.limit(0)).count() == 0 and communities.members(df.limit(0)).count() == 0
    two = df.where("vec_id in (2, 3, 900)")
    assert rows(nearest.neighbours(two).select("vec_id", "other")) == [(2, 3), (3, 2)]
    same = spark.createDataFrame([entry(i, [7] * 128) for i in range(10)], ENTRY)
    got = {}
    for r in nearest.neighbours(same).collect():
        got.setdefault(r["vec_id"], []).append(r["other"])
    assert all(sorted(v) == [j for j in range(10) if j != i][:5] for i, v in got.items())
    assert communities.members(same).select("community").distinct().count() == 1


def test_communities_find_the_groups(cloud):
    df, x = cloud
    mine = communities.members(df).cache()
    m = mine.toPandas()
    assert len(m) == 300
    assert all(g["vec_id"].mod(3).nunique() == 1 for _, g in m[~m["vec_id"].isin([31, 61, 91, 121, 151, 181, 211])].groupby("community"))
    d = {r["community"]: r for r in communities.described(mine).collect()}
    assert sum(r["size"] for r in d.values()) == 300 and all(len(r["typical"]) == min(3, r["size"]) for r in d.values())
    for c, r in d.items():
        g = m[m["community"] == c].sort_values(["inner", "vec_id"], ascending=[False, True])
        assert r["typical"] == g["vec_id"].tolist()[:3] and c <= g["vec_id"].min()


def test_neighbour_graph_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(communities, "LEAF_ROWS", 64)
    monkeypatch.setattr(communities, "BLOCK_ROWS", 128)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8)) @ rng.standard_normal((8, 128))
    codes = V.packed(np.clip(np.round(x * 20), -127, 127).astype(np.int16) * 2 - 1)
    reps = spark.createDataFrame([(i, c.as_py()) for i, c in enumerate(codes)], "rep bigint, code binary").cache()
    u = V.unit(V.codes_of([c.as_py() for c in codes]))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, : communities.NEIGHBOURS]
    got = {(r["a"], r["b"]) for r in communities.neighbour_graph(reps).collect()}
    assert sum((i, int(j)) in got for i in range(3000) for j in near[i]) >= 0.9 * near.size


def modularity(lab, edges):
    total, size, cut = sum(edges.values()), {}, 0.0
    for (a, b), w in edges.items():
        size[lab[a]] = size.get(lab[a], 0) + w
        cut += w if lab[a] != lab[b] else 0
    return 1 - cut / total - sum(x * x for x in size.values()) / total**2


def test_no_two_communities_should_be_one(spark):
    n = 512
    ring = spark.createDataFrame([(i, (i + d) % n, 0.9) for i in range(n) for d in (1, n - 1)], "a bigint, b bigint, s float")
    lab = {r["v"]: r["c"] for r in communities.communities(ring, spark.range(n).withColumnRenamed("id", "rep")).collect()}
    size = {c: sum(x == c for x in lab.values()) for c in lab.values()}
    between = {(lab[i], lab[(i + 1) % n]) for i in range(n)}
    assert not [1 for a, b in between if a != b and 1 / n - size[a] * size[b] * 2 / n**2 > 1e-4]  # what a merger adds to the modularity


@pytest.mark.parametrize("local", [100_000, 40])
def test_planted_groups_come_out_whole(spark, monkeypatch, local):
    """In one task and over all tasks: loose clouds are not left in pieces, neighbouring ones stay apart."""
    monkeypatch.setattr(communities, "LOCAL", local)
    r = random.Random(3)
    sizes = [600, 60, 60, 60]
    group = [g for g, k in enumerate(sizes) for _ in range(k)]
    at = {g: [i for i, x in enumerate(group) if x == g] for g in range(4)}
    edges = {}
    for i, g in enumerate(group):
        for j in r.sample(at[g], 6):
            if i != j:
                edges[i, j] = 0.9
        if r.random() < 0.05:
            edges[i, r.randrange(len(group))] = 0.5
    edges = {(a, b): w for (a, b), w in edges.items() if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a bigint, b bigint, s float")
    lab = {x["v"]: x["c"] for x in communities.communities(df, spark.range(len(group)).withColumnRenamed("id", "rep")).collect()}
    for g in range(4):
        mine = [lab[i] for i in at[g]]
        most = max(mine, key=mine.count)
        assert mine.count(most) >= 0.97 * len(mine) and sum(v == most for v in lab.values()) <= 1.05 * len(mine) + 2


def test_settled_labels_have_the_modularity_of_planted_ones():
    r = np.random.default_rng(1)
    group = np.repeat(np.arange(20), 30)
    a = np.repeat(np.arange(600), 5)
    b = np.where(r.random(3000) < 0.9, group[a] * 30 + r.integers(0, 30, 3000), r.integers(0, 600, 3000))
    both = {(int(x), int(y)): 1.0 for x, y in np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]) if x != y}
    e = np.array(sorted(both))
    w = np.ones(len(e))
    lab = communities.settle(np.bincount(e[:, 0], w, 600), e[:, 0], e[:, 1], w, w.sum())
    assert modularity(lab.tolist(), both) >= modularity(group.tolist(), both) - 1e-3
    assert communities.settle(np.zeros(3), *[np.zeros(0, np.int64)] * 2, np.zeros(0), 1.0).tolist() == [0, 1, 2]


def test_mended_clusters(spark, cloud):
    df, x = cloud
    rng = np.random.default_rng(9)
    heads = {3: x[3], 7: x[7] * 0.8, 12: x[8], 20: rng.standard_normal(128)}
    cl = spark.createDataFrame([(k, [float(t) for t in v], 1) for k, v in heads.items()] + [(None, [0.0] * 128, 1), (5, [0.0], 1), (6, None, 1)], "cluster_id int, centroid array<float>, community int")
    c32 = {k: np.float32(v).astype(float) for k, v in heads.items()}
    near = {i: min((((v - c) ** 2).sum(), k) for k, c in c32.items())[1] for i, v in x.items()}
    stored = {i: i % 5 or None for i in x}
    assert set(map(tuple, communities.wrong(df, cl).collect())) == {(i, k) for i, k in near.items() if stored[i] != k}
    assert communities.wrong(df, cl.limit(0)).count() == 0


def test_nearest_of_is_exact():
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((300, 6)), rng.standard_normal((60, 6))
    c[7] = c[30]
    assert (communities.nearest_of(x, x[5], c) == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


# 3: pieces


def pieces_ok(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e in got) == text
    for i, (b, n, e) in enumerate(got):
        assert e - b <= limit and b <= n < e
        assert (b == n == 0) if i == 0 else n - b <= overlap and (overlap == 0 or text[b:n] == text[: got[i - 1][2]][b:])
    return got


def test_random_cuts():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["word ", "a", "Long", ". ", "! ", "\n", "\n\n", "\n \t\n", "。", "# x\n", "  ", "é", " "]) for _ in range(r.randint(0, 200)))
        limit = r.randint(2, 80)
        pieces_ok(text, limit, r.randint(0, limit - 1))


def test_natural_ends():
    a, b = "A first one. " * 5, "Second text! " * 5
    got = pieces_ok(a.strip() + "\n\n" + b.strip(), 80, 10)
    assert [e for _, _, e in got][0] == len(a.strip()) + 2  # at the paragraph
    text = "x" * 30 + " " + "y" * 30
    assert pieces_ok(text, 40, 5)[0][2] == 31 and len(pieces_ok("z" * 100, 30, 5)) == 4
    short = "Ab cd.\n\n" + "One more. " * 20  # a short paragraph doesn't stay alone
    assert pieces_ok(short, 80, 10)[0][2] > 60
    assert pieces.cut("", 10, 2) == [] and pieces.cut("abc", 3, 0) == [(0, 0, 3)]
    with pytest.raises(ValueError):
        pieces.cut("abc", 5, 5)


@pytest.mark.parametrize(
    "text,level",
    [("a" * 9 + "\n \n" + "b" * 9, "paragraph"), ("  " + "a" * 10 + "   ", "paragraph"), ("aaa bbb. ccc ddd! e", "sentence"), ("一二三四五。六七八九十！一二三", "sentence"), ("a.b c d e f g h", "word"), ("ab. abcdefghijklmnop", "none"), ("a" * 11, "none"), ("aaaaa\nbbbbbb", "word"), ("aaaaa\r\n\r\nbbbbbb", "paragraph")],
)
def test_cut_level(text, level):
    assert pieces.cut_level(text, 10) == level


def test_live_pieces(spark):
    long = "word " * 300
    q = [(1, "a", "k", long, D(2024, 1, 1)), (2, "a", "k", "short", D(2024, 1, 2)), (3, "a", "l", long, D(2024, 1, 1)), (4, "a", "l", long + "x", D(2024, 1, 1)), (5, None, None, long, None), (6, "b", "n", None, D(2024, 1, 1)), (7, "b", "o", "", None), (8, "b", "p", "z" * 200_000, None)]
    df = spark.createDataFrame(q, "queue_id bigint, namespace string, doc_key string, text string, enqueued_at timestamp").withColumn("piece", F.lit(0))
    got = pieces.pieces(df).toPandas()
    assert set(got["queue_id"]) == {4, 5, 8} and set(got[got["queue_id"] == 8]["cut_level"]) == {"none"}
    assert got["piece"].str.len().max() <= 1200
    t = got[got["queue_id"] == 4].sort_values("piece_no")
    assert "".join(p[len(p) - n :] for p, n in zip(t["piece"], t["n_new"])) == long + "x"
    assert pieces.pieces(df.limit(0)).count() == 0
    assert tuple(pieces.checked(pieces.pieces(df)).first())[:4] == (3, 1500 + 1501 + 200_000, 0, 0)  # texts of one repeated word hold themselves


# 4: spellings


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_lists_all_words_one_edit_away(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(250)})
    t = spellings.Trie(words)
    for w in words[:60]:
        assert t.near(w) == {x for x in words if osa(w, x) == 1}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, w bigint")
    at = {w: i for i, w in enumerate(words)}
    assert set(map(tuple, spellings.edits(df).collect())) == {(a, b) for a, b in itertools.permutations(words, 2) if osa(a, b) == 1 and at[b] > at[a]}


def test_variants_meet_and_others_do_not(spark):
    groups = [
        ["Ministry of Tidal Works", "ministry  of TIDAL works!", "The Ministry of Tidal Works", "Tidal Works, Ministry of", "Min. of Tidal Works", "Mnstry of Tidal Wroks", "Ministry of Tidal Works HQ", "Ministry of Tidal Woks", "MTW"],
        ["Ministry of Tidal Waters", "Tidal Waters Ministry"],
        ["Ripefap Housing Safety Council", "Ripefap Housing Sfty Cncl", "Council of Housing Safety Ripefap", "Ripefap HSC", "Ripefap Safety Council"],
        ["Ripefap Housing Records Council"],
    ]
    table = [(v, None) for g in groups for k, v in enumerate(g) for _ in range((20 if "Waters" in v else 200) if k == 0 else 2)] + [(None, 1), ("", 1), (" -- ", 1)] * 3
    df = spark.createDataFrame(table, "agency string, name string")
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    want = {(a, b) for g in groups for a, b in itertools.product(set(map(norm, g)), repeat=2) if a < b}
    assert set(map(tuple, spellings.pairs(df, "agency").collect())) == want
    links = {r["name"]: (r["root"], r["n_links"]) for r in spellings.linked(df, "agency").collect()}
    assert len({links[norm(v)] for v in groups[0]}) == 1 and links["ripefap housing records council"][1] == 0
    assert spellings.pairs(df.limit(0), "agency").count() == 0
    assert spellings.pairs(spark.createDataFrame([("of the",), ("the of " + "x" * 50_000,)], "agency string"), "agency").count() == 0


# 6: copies


def test_copies(spark):
    jobs = [(1, "A-Board", "Clerk 1"), (2, "a board", "CLERK (1)"), (2, "a board", "CLERK (1)"), (3, "aboard", "clerk1"), (4, None, "x"), (5, None, "x"), (6, "", "q"), (7, "--", "q"), (8, "abo", "ardclerk1"), (9, "zz" * 30_000, "t")]
    raw = [(1, '{"agency": "X", "jobTitle": "Y", "unit": "Z\\u00a0"}'), (2, "unit=z | AGENCY = x|jobtitle=[y]"), (3, '{"unit":"Z","JOBTITLE":"y","agency":"x"}'), (4, '{"agency": "X", "jobTitle": "Y"}'), (5, "agency=X|jobTitle=Y"), (6, None), (7, ""), (8, "{bad"), (9, '{"agency":null,"jobTitle":"Y"}'), (10, "unit=y|agency=x|jobTitle=z")]
    j = spark.createDataFrame(jobs, "jobId bigint, agency string, jobTitle string").withColumn("key", F.lit("clash")).withColumn("src", F.lit(1))
    r = spark.createDataFrame(raw, "raw_id bigint, payload string").withColumn("fields", F.lit(1))
    rec = copies.job_records(j).unionByName(copies.raw_records(r))
    assert rows(copies.found(rec)) == sorted([("jobs", 1, 2), ("jobs", 1, 3), ("jobs", 6, 7), ("raw_jobs", 1, 2), ("raw_jobs", 1, 3), ("raw_jobs", 4, 5)], key=repr)
    n = {(s, i): c for s, i, c in rows(copies.one_per_group(rec))}
    assert n == {("jobs", 1): 3, ("jobs", 6): 2, ("jobs", 8): 1, ("jobs", 9): 1, ("raw_jobs", 1): 3, ("raw_jobs", 4): 2, ("raw_jobs", 9): 1, ("raw_jobs", 10): 1}
    assert copies.found(rec.limit(0)).count() == 0 and copies.one_per_group(rec.limit(0)).count() == 0


def test_a_third_of_all_records_are_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("jobId"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("a"), "id")).alias("agency"), F.lit("t").alias("jobTitle"))
    assert rows(copies.found(copies.job_records(df))) == sorted([("jobs", 0, i) for i in range(3, 3000, 3)], key=repr)


# 7: packing


def test_plans_keep_capacity():
    r = random.Random(2)
    for capacity in (1, 10, 64, 2048):
        for _ in range(40):
            h = {r.randint(1, capacity): r.randint(1, 60) for _ in range(r.randint(0, 60))}
            runs, made = packing.plan(h, capacity, r.choice((1, 2, 6)))
            load, ranks = {}, {}
            for length, a, b, w, per, wfirst, wper, c in runs:
                for i in range(a, b):
                    k = c + (w + (i - a) // per - wfirst) // wper
                    load[k] = load.get(k, 0) + length
                    ranks.setdefault(length, []).append(i)
            assert all(v <= capacity for v in load.values()) and sorted(load) == list(range(made))
            assert [load[k] for k in range(made)] == sorted(load.values(), reverse=True)
            assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in h.items()}
            total = sum(k * v for k, v in h.items())
            assert made <= max(1, 2 * -(-total // capacity)) or not h


def test_tiers_make_another_plan_as_tight():
    r = random.Random(5)
    h = {}
    for _ in range(5000):
        n = min(2048, 1 + int(r.lognormvariate(5, 1.2)))
        h[n] = h.get(n, 0) + 1
    (one, a), (six, b) = packing.plan(h, 2048, 1), packing.plan(h, 2048, 6)
    assert one != six and max(a, b) * 2048 * 0.99 <= sum(k * v for k, v in h.items()) + 2048
    load = {}
    for length, first, last, w, per, *_ in six:
        for i in range(first, last):
            load.setdefault(w + (i - first) // per, []).append(length)
    # a window holds one document of its own tier or is one of the shortest tier, and what fills its gap is of shorter tiers
    for lengths in load.values():
        tiers = sorted(packing.tier_of(n, 2048) for n in lengths)
        assert sum(lengths) <= 2048 >> tiers[0] and (tiers[0] == 5 or tiers.count(tiers[0]) == 1)


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")
def test_packed_documents(spark):
    texts = [None, "", "one", "two words here", "x " * 100] + [f"text number {i} " * (i % 17) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a")], "doc_id bigint, text string").withColumn("part", F.lit(1)).withColumn("tier", F.lit(1))
    got = packing.packed(df, capacity=64, group=4).toPandas()
    enc = packing.encoder(Path(packing.VOCABULARY).read_bytes())
    n = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == n
    full = got[got["container_id"].notna()]
    assert full.groupby("container_id")["n_tokens"].sum().max() <= 64
    assert all(len(g) == -(-n[i] // 64) for i, g in full.groupby("doc_id"))
    assert set(got[got["container_id"].isna()]["doc_id"]) == {i for i, k in n.items() if k == 0}
    f = packing.fill(packing.packed(df, capacity=64), 64).first()
    assert f["tokens"] == sum(n.values()) and f["unused_share"] < 0.2
    assert packing.packed(df.limit(0)).count() == 0
    ok = packing.checked(packing.packed(df, capacity=64, group=4), 64).first()
    assert (ok["over_capacity"], ok["split_wrongly"], ok["unplaced"], ok["steps_balanced"]) == (0, 0, 0, True)
    assert packing.checked(packing.packed(df.limit(0))).first()["documents"] == 0


# 8: leaks

ITEM = "when the golden bell rang at tifakag the clerk weighed a cedar chest counted 37 coins and left a note about what had been counted twice by the harbour master of the northern district during that winter"


def altered(words, every, offset=3):
    return [("zq%d" % i) if i % every == offset else w for i, w in enumerate(words)]


def test_alignment():
    item = leaks.hashed(ITEM)
    w = ITEM.split()
    n, half = len(w), -(-len(w) // 2)
    it = leaks.Items([5], [item])

    def found(words):
        return it.leaked(leaks.hashed(" ".join(words)), np.ones(1, bool)) == [5]

    pad = ["foo", "bar"] * 10
    assert found(w) and found(pad + w[:half] + pad) and found(pad + w[n - half :] + pad)
    assert not found(pad + w[: half - 3] + pad)  # one or two words less may still be a stretch that ends in a differing word
    assert found(pad + altered(w, 11) + pad) and not found(pad + altered(w, 5) + pad)
    gone = w[:10] + w[11:]
    assert found(gone) and found(w[:10] + ["extra"] + w[10:])
    assert not found(list(reversed(w))) and not found([])


def test_markup_and_case_do_not_matter():
    text = "**When** the <b>golden</b> bell&nbsp;RANG, at _Tifakag_:"
    assert leaks.words(text) == ["when", "the", "golden", "bell", "rang", "at", "tifakag"]
    assert leaks.words("co­op a<b c>d") == ["coop", "a", "d"] or leaks.words("co­op")[0] == "coop"


def test_run_length_is_a_bound():
    for n in (1, 5, 42, 84, 141):
        k = leaks.run_length(n)
        for length in range(max(1, -(-n // 2)), n + 1):
            d = length // 10
            assert -(-(length - d) // (d + 1)) >= k


def dense_passages(texts, step):
    """Term frequencies of all passages by hand."""
    out = []
    for i, t in enumerate(texts):
        blocks = [t[a : a + step] for a in range(0, len(t), step)]
        for j in range(max(1, len(blocks) - 1) if blocks else 0):
            row = np.zeros(leaks.DIMS)
            for w in np.concatenate(blocks[j : j + 2]):
                row[(int(w) * 2654435761 % 2**32) >> 18] += 1
            out.append((i, row))
    return out


def test_passages_against_dense_matrices(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 5, 6, 7, 12, 40, 0, 13)]
    basis = rng.standard_normal((leaks.DIMS, 4)).astype(np.float32)
    want = dense_passages(texts, 6)
    a = np.stack([r for _, r in want])
    p = leaks.Passages(texts, 6)
    assert p.owner.tolist() == [i for i, _ in want] and np.allclose(p.project(basis), a @ basis, atol=1e-4)
    z = rng.standard_normal((len(want), 4)).astype(np.float32)
    assert np.allclose(p.back(z), a.T @ z, atol=1e-4)
    monkeypatch.setattr(leaks, "BATCH_WORDS", 18)  # long texts in parts have the same passages
    parts = list(leaks.batches_of(texts, 6))
    rows = sorted((int(o), tuple(np.round(v, 3))) for q in parts for o, v in zip(q.owner, q.project(basis)))
    assert len(parts) > 3 and rows == sorted((int(o), tuple(np.round(v, 3))) for o, v in zip(p.owner, p.project(basis)))
    assert list(leaks.batches_of([], 6)) == [] and leaks.Passages([texts[0]], 6).project(basis).shape == (0, 4)


def test_decomposition_is_the_singular_one(spark, monkeypatch):
    monkeypatch.setattr(leaks, "RANK", 12)
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 2**32, 12, dtype=np.uint32) for _ in range(4)]
    texts = [rng.choice(topics[i % 4], 24) for i in range(60)]
    hashed = lambda ts: spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(ts)], "doc_id bigint, w binary")
    idf = np.ones(leaks.DIMS)
    basis, sigma = leaks.latent_basis(hashed(texts), hashed(texts[:8]), idf)
    a, b = (np.stack([r for _, r in dense_passages(ts, 12)]) for ts in (texts, texts[:8]))
    start = np.random.default_rng(3).standard_normal((leaks.DIMS, 12))
    m = sum(x.T @ x / np.sqrt(((x.T @ (x @ start)) ** 2).sum()) for x in (a, b))
    true = np.sqrt(np.maximum(np.linalg.eigvalsh(m)[::-1], 0))
    assert np.allclose(sigma[:4], true[:4], rtol=0.02) and (np.diff(sigma) <= 1e-9).all()
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-4)


def test_lists_lose_little():
    rng = np.random.default_rng(1)
    unit = lambda m: (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    heads = unit(rng.standard_normal((30, 32)))
    z, owner = unit(np.repeat(heads, 20, 0) + 0.1 * rng.standard_normal((600, 32))), np.repeat(np.arange(30), 20)
    q = np.concatenate([unit(z[::10] + 0.05 * rng.standard_normal((60, 32))), unit(rng.standard_normal((300, 32)))])
    true = {(int(i), int(owner[j])) for i, j in zip(*np.nonzero(q @ z.T >= 0.55))}
    r, i = leaks.Lists(z, owner).near(q, 0.55)
    got = set(zip(r.tolist(), i.tolist()))
    near = {(int(i), int(owner[j])) for i, j in zip(*np.nonzero(q @ z.T >= 0.7))}
    assert got <= true and len(near) >= 60 and near <= got and len(got) >= 0.9 * len(true)  # what is lost lies at the threshold


def test_long_and_short_items_have_their_own_widths(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    items = [(1, " ".join(r.sample(words, 8))), (2, " ".join(r.sample(words, 30))), (3, " ".join(r.sample(words, 400))), (4, "only")]
    assert [leaks.width_of(n) for n in (1, 8, 16, 30, 72, 400)] == [4, 4, 4, 6, 24, 24] or leaks.width_of(400) == 24
    pad = " ".join(r.sample(words, 60))
    long = items[2][1].split()
    for k in range(20, 400, 45):  # drops words over 200 words: more than the least band allows at once
        long[k] = ""
    docs = [(i, f"{pad} {t} {pad}") for i, t in items[:3]] + [(7, pad), (8, f"{pad} {' '.join(long)}")]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert set(map(tuple, got.collect())) >= {(1, 1), (2, 2), (3, 3), (8, 3)}


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join(f"v{r.randrange(500)}" for _ in range(60))) for i in range(12)]
    docs = [(i, f"{items[i % 12][1]} tail {i}") for i in range(30)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leaks, "ITEMS", 4)
    assert set(map(tuple, leaks.leaks(d, t).collect())) == {(i, i % 12) for i in range(30)}


def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(40, 90)))) for i in range(20)] + [(90, ""), (91, None), (None, "x"), (3, None)]
    docs = []
    for k in range(120):
        body = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if k % 3 == 0:
            w = items[k % 20][1].split()
            m = r.randint(len(w) // 3, len(w))
            a = r.randint(0, len(w) - m)
            body[len(body) // 2 : len(body) // 2] = altered(w[a : a + m], r.choice([1000, 12, 10, 6]))
        docs.append((k, " ".join(body).upper() if k % 2 else ", ".join(body)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(3)).withColumn("w", F.lit(3))
    it = leaks.Items(*zip(*[(i, leaks.hashed(t)) for i, t in items if i is not None and t]))
    want = {(d, i) for d, t in docs if d is not None and t for i in it.leaked(leaks.hashed(t), np.ones(len(it.ids), bool))}
    assert len(want) > 15
    got = [tuple(x) for x in leaks.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.03 * len(want)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(df, none).count() == 0 and leaks.leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


# 9: languages

SENTENCES = {
    "en": ["The office opens at eight every morning of the week.", "Please send your papers to the nearest branch before the end of May.", "Nobody could say who had counted the boxes in the cellar."],
    "de": ["Das Büro öffnet jeden Morgen der Woche um acht Uhr.", "Bitte schicken Sie Ihre Unterlagen bis Ende Mai an die nächste Zweigstelle.", "Niemand wusste zu sagen, wer die Kisten im Keller gezählt hatte."],
    "zh": ["办事处每个星期一到星期五早上八点开门接待市民。", "请在五月底以前把申请材料寄到最近的分局办事处。", "没有人知道是谁把地下室里的箱子重新数了一遍。"],
}


def test_labels(spark):
    given = {"en": "en", "EN": "en", "en-SG": "en", "en_US": "en", "English": "en", " deutsch ": "de", "zho": "zh", "Chinese (Simplified)": "zh", "xx": None, "und": None, "": None, "n/a": None, "unknown": None, None: None, "Bahasa Melayu": "ms", "pt-BR": "pt"}
    df = spark.createDataFrame([(k,) for k in given], "lang string")
    assert [r[0] for r in df.select(languages.label_code(F.col("lang"))).collect()] == list(given.values())


def test_sentences_and_fields():
    t = "Agency: Board of Old Rivers and Tides\nThe office opens at eight.\n\nkey=1; other=2; third=3\nEnd"
    assert [t[a:b] for a, b in languages.sentences(t)] == ["Agency: Board of Old Rivers and Tides", "The office opens at eight.", "key=1; other=2; third=3", "End"]
    assert [languages.is_whole(t[a:b]) for a, b in languages.sentences(t)] == [False] * 4
    assert languages.is_whole("one two three four five six") and not languages.is_whole("one two three four five") and languages.is_whole("一" * 15) and not languages.is_whole("一" * 14)
    assert languages.sentences(" \n ") == []


def test_filter_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    m = (np.uint64(1) << (h % np.uint64(3))).astype(np.uint64)
    f = languages.Filter(["a", "b", "c"], h, m)
    got = np.full(len(h), ~np.uint64(0))
    for p in f._places(h):
        got &= f.bits[p]
    assert ((got & m) == m).all() and ((got != m).mean() < 0.01)


def test_languages(spark):
    r = random.Random(3)
    docs = []
    for i in range(240):
        lang = ["en", "de", "zh"][i % 3]
        docs.append((i, " ".join(r.choice(SENTENCES[lang]) for _ in range(4)), lang if i % 10 else "de"))
    en, de, zh = SENTENCES["en"], SENTENCES["de"], SENTENCES["zh"]
    docs += [(1000, en[0] + " " + de[0], "en"), (1001, de[1], None), (1002, zh[0] + en[1], "zh"), (1003, "", None), (1004, None, "xx"), (1005, "Short one.", None), (1006, en[2], "unknown"), (1007, "   \n", "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("code", F.lit(1)).withColumn("seg_lang", F.lit(1))
    got = rows(languages.mislabelled(df))
    want = {(i, ["en", "de", "zh"][i % 3]) for i in range(0, 240, 10) if i % 3 != 1} | {(1000, "en"), (1000, "de"), (1001, "de"), (1002, "zh"), (1002, "en"), (1006, "en")}
    assert set(got) == want and len(got) == len(want)
    seg = languages.segments(df).where("doc_id = 1000").orderBy("begin").collect()
    assert [s["seg_lang"] for s in seg] == ["en", "de"] and seg[0]["end"] == len(en[0]) and all(0 < s["confidence"] <= 1 for s in seg)
    d = {x["doc_id"]: x for x in languages.documents(df).collect()}
    assert d[0]["lang"] == "en" and d[1000]["n_langs"] == 2 and 1003 not in d
    assert languages.mislabelled(df.limit(0)).count() == 0


def test_a_language_of_wrong_labels_only_is_none(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(SENTENCES["en" if i % 2 else "zh"]) for _ in range(4)), "en" if i % 2 else "zh") for i in range(100)]
    docs += [(200 + i, " ".join(SENTENCES["en"][i % 2 : i % 2 + 2]), "it") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert languages.fit(df).langs == ["en", "zh"]
    assert set(rows(languages.mislabelled(df))) == {(200 + i, "en") for i in range(6)}


def test_hot_vectors_are_split(spark):
    """A third of all entries are one vector, in every join on it."""
    rng = np.random.default_rng(5)
    hot = rng.integers(0, 256, 128)
    df = spark.createDataFrame([entry(i, hot if i % 3 == 0 else rng.integers(0, 256, 128)) for i in range(600)], ENTRY)
    got = {}
    for x in nearest.neighbours(df).collect():
        got.setdefault(x["vec_id"], []).append(x["other"])
    assert len(got) == 600 and all(sorted(got[i]) == [j for j in range(0, 21, 3) if j != i][:5] for i in range(0, 600, 3))
    m = communities.members(df)
    assert m.count() == 600 and m.where("vec_id % 3 = 0").select("community").distinct().count() == 1


def test_queries_have_names_and_columns(spark):
    from marlstone.llm.queries import QUERIES, SQL

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    columns = {"p1_found": ["vec_id", "cluster_id"], "p3_found": ["queue_id", "cut_level"], "p4_found": ["name_a", "name_b"], "p5_found": ["vec_a", "vec_b"], "p6_found": ["src", "first_id", "copy_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "seg_lang"]}
    assert set(SQL) <= set(QUERIES)
    for name, want in columns.items():
        got = QUERIES[name](spark, small)
        assert got.columns == want and got.count() > 0
    assert json.dumps(sorted(QUERIES))
