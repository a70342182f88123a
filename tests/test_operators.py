import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import changelog as cl
from marlstone.operators import blocks, exact, rabitq, rowsets, scans, search, skew
from marlstone.sources import centroids, jsonl
from marlstone.sources.embedder import EmbeddingError, checked, hash_embedder, probe
from marlstone.streaming import queue


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, f"k{i:02d}") for i in range(50)], "id bigint, name string").cache()


def test_cursor_pages_cover_everything_once(table):
    seen, cursor = [], None
    while True:
        page = scans.cursor_page(table, "id", 7, cursor)
        seen += [r["id"] for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == list(range(50))


def test_cursor_rules(table):
    assert scans.cursor_page(table, "id", 0) == scans.CursorPage([], 0)
    p = scans.cursor_page(table, "id", 5, cursor=3, start=40, end=6)  # the cursor replaces start, end still holds
    assert [r["id"] for r in p.rows] == [3, 4, 5] and p.next_cursor is None
    assert scans.cursor_page(table.where("id < 0"), "id", 5) == scans.CursorPage([], None)


def test_other_scans(table, spark):
    assert [r[1] for r in scans.multi_get(table, "id", [9, 77, 9]).collect()] == [9, 77, 9] and [r[2] for r in scans.multi_get(table, "id", [9, 77]).collect()] == ["k09", None]
    assert scans.multi_get(table, "id", []).count() == 0
    assert scans.range_scan(table, "id", 3, 6).count() == 3 and scans.range_scan(table, "id").count() == 50 and scans.prefix_scan(table, "name", "k1").count() == 10
    b = spark.createDataFrame([(bytearray(x),) for x in (b"\xff\xff", b"\xff\x01", b"a", b"ab")], "k binary")
    assert scans.prefix_scan(b, "k", b"\xff").count() == 2 and scans.prefix_scan(b, "k", b"a").count() == 2 and scans.prefix_scan(b, "k", b"").count() == 4
    p = scans.page_with_total(table, "id", 0, 0)
    assert (p.page_no, p.page_size, p.total, [r["id"] for r in p.rows]) == (1, 1, 50, [0])
    assert scans.page_with_total(table, "id", 9, 20).rows == []
    k = spark.createDataFrame([(x,) for x in (-5, 7, 0, -1, 1)], "k bigint")
    assert [r[0] for r in scans.full_scan(k, "k", compat=True).collect()] == [0, 1, 7, -5, -1]


def test_change_log(spark):
    log = spark.createDataFrame([("a", 1, 10, "P", "x"), ("a", 3, 30, "P", "z"), ("a", 2, 20, "D", None), ("b", 5, 50, "D", None), ("b", 4, 40, "P", "y"), ("c", 6, 60, "P", None)], "key string, seq bigint, epoch_ms bigint, op string, v string")
    assert rows(cl.live(log)) == [("a", 3, 30, "z"), ("c", 6, 60, None)]
    assert cl.compacted(log).count() == 2 and rows(cl.live(cl.compacted(log))) == rows(cl.live(log))
    gone = cl.sweep(log, 25, 60, 100)
    assert rows(gone.select("key", "op")) == [("a", "D")]
    assert rows(cl.live(log.unionByName(gone)).select("key")) == [("c",)]
    assert cl.sweep(log, 0, 60, 100, at_most=1).count() == 1
    assert cl.live(log.limit(0)).count() == 0 and cl.counters(log.limit(0)).first()["waste"] == 0.0


def test_row_sets(spark):
    a, b = spark.createDataFrame([(x,) for x in (1, 5, 65_536, 70_000)], "id bigint"), spark.createDataFrame([(5,), (6,)], "id bigint")
    assert rows(rowsets.both(a, b)) == [(5,)] and rowsets.either(a, b).count() == 5 and rowsets.without(a, b).count() == 3
    assert rowsets.rank(a, 65_536) == 3 and rowsets.select(a, 1) == 5 and rowsets.select(a, 9) is None
    assert rows(rowsets.flip(a, 4, 7)) == [(1,), (4,), (6,), (65536,), (70000,)]
    assert rowsets.contains(a, 5) and not rowsets.contains(a, 6)
    with pytest.raises(ValueError):
        rowsets.flip(a, 0, 1 << 40)
    c = rowsets.insert(rowsets.build(spark, [3, 1, 3]), [2, 1])
    assert rows(c) == [(1,), (2,), (3,)] and rows(rowsets.remove(c, [2, 9])) == [(1,), (3,)] and rowsets.clear(c).count() == 0
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 65_537), (None, 2), ("y", None)], "v string, i bigint")
    assert rows(rowsets.listing(df, "v", "i")) == [("x", 0, [1]), ("x", 1, [1])]
    assert rows(rowsets.postings(df, "v", "i")) == [("x", 2, 1, 65537)]
    assert rows(rowsets.distinct_values(df, ["v", "i"])) == [("i", 3), ("v", 2)]


def test_heavy_keys_against_sets(spark):
    rng = np.random.default_rng(2)
    segs, true = [], {}
    for s in range(200):
        key = ("jobs", "agency", None if s % 50 == 0 else "hot" if s % 3 == 0 else f"v{s % 40}")
        c, bits = int(rng.integers(0, 3)), rng.integers(0, 65536, 400 if key[2] == "hot" else 5).tolist()
        bits[0:1] = [None] if s % 7 == 0 else []
        segs += [(*key, c, bits)] * (2 if s % 5 == 0 else 1)
        true.setdefault(key, set()).update(c * 65536 + b for b in bits if b is not None)
    segs += [("jobs", "agency", "none", 1, None), ("jobs", "agency", "nowhere", None, [1])]
    df = spark.createDataFrame(segs, "namespace string, field_name string, field_value string, container bigint, bitmaps array<int>").withColumn("n_ids", F.lit("clash"))
    assert {tuple(r[:3]): r[3] for r in skew.segment_key_counts(df).collect()} == {k: len(v) for k, v in true.items()}
    total = len(set().union(*true.values()))
    assert {tuple(r[:3]) for r in skew.heavy_keys(df).collect()} == {k for k, v in true.items() if len(v) >= 0.03 * total}
    assert skew.heavy_keys(df.limit(0)).count() == 0


def test_rows_and_distinct(spark):
    df = spark.createDataFrame([("a", 1)] * 100 + [("a", 2), ("a", -5), (None, 1), ("b", None)], "k string, i bigint")
    assert rows(skew.rows_and_distinct(df, "k", "i")) == sorted([("a", 102, 3), (None, 1, 1), ("b", 1, 0)], key=repr)


def test_one_bit_code_by_hand():
    e = rabitq.one_bit([1.0, -1.0, 0.0, 2.0], np.zeros(4))
    assert e.codes.tolist() == [1, 0, 1, 1] and e.add == 0.0
    ip = 4 / np.sqrt(6) / 2
    assert e.scale == pytest.approx(np.sqrt(6) / (ip * 2)) and e.error == pytest.approx(np.sqrt(6) * np.sqrt((1 - ip**2) / ip**2) * 1.9 / np.sqrt(3))
    assert rabitq.one_bit(np.zeros(4), np.zeros(4)).scale == 0.0


def test_multi_bit_code():
    rng = np.random.default_rng(4)
    c = rng.standard_normal(64) / 10
    for bits in (2, 4, 8):
        x, q = rng.standard_normal(64), rng.standard_normal(64)
        x, q = x / np.linalg.norm(x), q / np.linalg.norm(q)
        e = rabitq.multi_bit(x, c, bits)
        assert e.codes.max() < 2**bits and ((e.codes >= 2 ** (bits - 1)) == (np.float32(x) - np.float32(c) >= 0)).all()
        got = rabitq.estimate(e.codes[None].astype(float), bits, np.array([e.add]), np.array([e.scale]), q, np.array([c @ q]))[0]
        assert abs(got - x @ q) < 3 * e.error + 1e-4
        if bits < 8:  # with few bits the search looks past the top level, as published, and is no optimum
            continue
        o = np.abs(x - c) / np.linalg.norm(x - c)  # no scale of a fine grid points clearly better
        best = max(((np.minimum(np.floor(t * o), 2 ** (bits - 1) - 1) + 0.5) @ o / np.linalg.norm(np.minimum(np.floor(t * o), 2 ** (bits - 1) - 1) + 0.5)) for t in np.linspace(0.1, 2 ** (bits - 1) / o.max() * 1.2, 3000))
        u = np.where(x - c >= 0, e.codes.astype(int) - 2 ** (bits - 1), 2 ** (bits - 1) - 1 - e.codes.astype(int))
        assert (u + 0.5) @ o / np.linalg.norm(u + 0.5) > best - 2e-3
    z = rabitq.multi_bit(c, c, 8)
    assert (z.codes == 128).all() and (z.add, z.scale, z.error) == (1.0, 0.0, 0.0)
    for bad in (1, 9):
        with pytest.raises(ValueError):
            rabitq.multi_bit(c, c, bad)


def clusters4():
    return centroids.Clusters(np.array([1, 2]), np.eye(4)[:2])


def test_centroids(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text("\n".join(json.dumps({"cluster_id": i, "centroid": v}) for i, v in [(2, [0, 1]), (1, [1, 0])]))
    c = centroids.read_centroids(spark, str(f), 2)
    assert c.ids.tolist() == [1, 2] and c.probe([[0.2, 0.9], [0.5, 0.5]], 1)[:, 0].tolist() == [1, 0]
    for bad in ([(1, [1.0]), (1, [2.0])], [(1, [])], [(1, [1.0]), (2, [1.0, 2.0])], [], [(None, [1.0])]):
        with pytest.raises(ValueError):
            centroids.clusters(spark.createDataFrame(bad, "cluster_id int, centroid array<float>"))
    with pytest.raises(ValueError):
        centroids.read_centroids(spark, str(f), 3)


def test_embedder():
    e = hash_embedder(8)
    assert abs(probe(e, 8) - 1) < 1e-6 and (checked(e, ["a b", "c"], 8) == checked(e, ["a b", "c"], 8)).all()
    with pytest.raises(EmbeddingError):
        checked(e, ["a"], 9)
    with pytest.raises(EmbeddingError):
        checked(lambda t: [], ["a"], 8)


def test_search_sums_the_best_chunks(spark):
    """Scores of sign codes are known: every entry sits on its centroid plus a given residual."""
    config = search.Config(dimension=4, n_probes=2, first_pass=10, top_k=5)
    c = clusters4()
    vec = {(1, 0): [1, 0, 0.1, 0], (1, 1): [1, 0, 0.2, 0.1], (1, 2): [0, 1, 0.1, -0.1], (2, 0): [0, 1, 0, 0], (2, 1): [0, 1, 0.1, 0], (3, 1): [1, 0.1, 0, 0]}
    df = spark.createDataFrame([(d, p, [float(x) for x in v]) for (d, p), v in vec.items()] + [(9, 0, None), (9, 1, [1.0])], "doc_id bigint, part int, embedding array<float>")
    e = search.quantise(df, c, config).cache()
    assert e.count() == 6
    q = np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]])
    want = {}
    for (d, p), v in vec.items():
        if p:
            cl_ = int(c.probe([v], 1)[0, 0])
            code = rabitq.one_bit(v, c.matrix[cl_])
            for i, qq in enumerate(q):
                s = rabitq.estimate(code.codes[None].astype(float), 1, np.zeros(1), np.array([code.scale]), qq, np.array([c.matrix[cl_] @ qq]))[0]
                want.setdefault(d, {}).setdefault(i, []).append(s)
    got = dict(search.first_pass(e, c, q, config).collect())
    assert {d: pytest.approx(sum(max(v) for v in per.values())) for d, per in want.items()} == got
    hits = search.search(e, c, q, q[0], config).collect()
    assert [h["doc_id"] for h in hits] == [1, 2]  # document 3 has no dense entry
    only = spark.createDataFrame([(2,)], "doc_id bigint")
    assert [h["doc_id"] for h in search.search(e, c, q, q[0], config, only).collect()] == [2]
    assert search.search(e, c, q, q[0], config, top_k=0).count() == 0 and search.search(e, c, q[:, :3], q[0], config).count() == 0 and search.search(e, c, np.zeros((0, 4)), q[0], config).count() == 0
    plain = search.second_pass(e, c, q[0], only, config, lambda codes, bits, add, scale, q, base: base).collect()
    assert [(r["doc_id"], r["dot_product"]) for r in plain] == [(2, 0.0)]  # another estimator: the centroid alone
    twice = e.unionByName(e.where("doc_id = 1 and part = 0"))
    assert [h["doc_id"] for h in search.search(twice, c, q, q[0], config).collect()] == [2]
    broken = e.withColumn("code", F.when(F.col("doc_id") == 2, F.lit(None)).otherwise(F.col("code")))
    assert {tuple(r) for r in search.corrupt(broken, c, config).collect()} == {("SingleBit", 4, 1), ("MultiBit", 2, 1)}
    docs = spark.createDataFrame([(1, "one")], "doc_id bigint, text string")
    assert [r["text"] for r in search.hydrated(search.search(e, c, q, q[0], config), docs, 1, 2).collect()] == ["one"]
    assert rows(search.invalid(broken, c, config)) == [(2,), (3,)]


def test_exact_operators(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], "i bigint, v array<double>")
    c = centroids.Clusters(np.array([3, 8]), np.eye(2))
    assert rows(exact.nearest_centroids(df, "i", "v", c).select("i", "cluster_id")) == [(1, 3), (2, 8), (3, 3)]
    assert [r[0] for r in exact.top_k(df, "i", "v", np.array([1.0, 0.0]), 2).collect()] == [1, 3]


def brute_best(x, q, docs, k):
    """{query: [(doc, score)]} of summed chunk maxima."""
    out = {}
    for i in sorted({a for a, _, _ in q}):
        per = {}
        for d in set(docs):
            m = [max(float(np.dot(v, x[r])) for r in range(len(x)) if docs[r] == d) for a, _, v in q if a == i]
            per[d] = sum(m)
        out[i] = sorted(per.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]
    return out


@pytest.mark.parametrize("block", [10_000, 15])
def test_blocks_against_brute_force(spark, monkeypatch, block):
    """Document 3 holds a third of all rows, more than a small block; rows repeat, some have no vector."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(6)
    docs = [3 if i % 3 == 0 else int(i % 11) for i in range(90)]
    x = rng.standard_normal((90, 4))
    x[7] = x[8]
    df = spark.createDataFrame([(d, v.tolist()) for d, v in zip(docs, x)] + [(50, None), (51, [1.0]), (None, [1.0] * 4)], "d bigint, v array<double>").withColumn("rank", F.lit(1))
    q = [(i, c, rng.standard_normal(4)) for i in range(5) for c in range(1 + i % 3)]
    asked = spark.createDataFrame([(i, c, v.tolist()) for i, c, v in q], "query_id bigint, chunk int, vector array<double>")
    want = brute_best(x, q, docs, 4)
    got = {}
    for r in exact.max_sim_each(df, "d", "v", asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["d"], r["score"]))
    assert {i: [(d, pytest.approx(s)) for d, s in v] for i, v in want.items()} == got
    assert exact.max_sim_each(df, "d", "v", asked.limit(0), 4).count() == 0 and exact.max_sim_each(df.limit(0), "d", "v", asked, 4).count() == 0
    names = df.withColumn("d", F.concat(F.lit("k"), "d"))
    assert exact.max_sim_each(names, "d", "v", asked, 1).first()["d"].startswith("k")


def test_many_searches_are_single_ones(spark):
    config = search.Config(dimension=8, n_probes=2, first_pass=6, top_k=4)
    rng = np.random.default_rng(2)
    c = centroids.Clusters(np.arange(1, 6), rng.standard_normal((5, 8)))
    vec = [(d, p, (c.matrix[(d + p) % 5] + 0.3 * rng.standard_normal(8)).tolist()) for d in range(20) for p in range(4)]
    e = search.quantise(spark.createDataFrame(vec, "doc_id bigint, part int, embedding array<double>"), c, config).cache()
    qs = {i: rng.standard_normal((3, 8)) for i in range(3)}
    sparse = spark.createDataFrame([(i, k, v.tolist()) for i, m in qs.items() for k, v in enumerate(m)], "query_id bigint, chunk int, vector array<double>")
    dense = sparse.where("chunk = 0").select("query_id", "vector")
    ok = spark.createDataFrame([(i,) for i in range(0, 20, 2)], "doc_id bigint")
    for allowed in (None, ok):
        got = {}
        for r in search.search_each(e, c, sparse, dense, config, allowed).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], pytest.approx(r["dot_product"])))
        assert got == {i: [(r["doc_id"], r["dot_product"]) for r in search.search(e, c, m, m[0], config, allowed).collect()] for i, m in qs.items()}


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i * 7 % 101 - 50,) for i in range(101)], "k bigint").repartition(5)
    assert [r["pos"] for r in scans.numbered(df, "k").orderBy("k").collect()] == list(range(1, 102)) and scans.numbered(df.limit(0), "k").count() == 0
    assert {r["k"]: r["pos"] for r in scans.numbered(df, "k", compat=True).collect()}[-50] == 52


def test_reconcile(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, " "), (4, None), (5, "e")], "doc_id bigint, text string")
    have, queued = spark.createDataFrame([(1,), (None,)], "doc_id bigint"), spark.createDataFrame([(5,)], "doc_id bigint")
    assert [r[0] for r in search.missing(docs, have, queued).collect()] == [2]


QUEUE = "queue_id bigint, namespace string, doc_key string, text string, retry_count int, last_error string, enqueued_at timestamp"


def entries(spark):
    from datetime import datetime as D

    return spark.createDataFrame([(1, "a", "x", "old", 2, "e", D(2024, 1, 1)), (2, "a", "x", "new", 0, None, D(2024, 1, 2)), (3, "a", "x", "tie", 0, None, D(2024, 1, 2)), (4, "b", None, "t", 5, "e", None), (5, "b", None, "u", None, None, D(2024, 1, 1))], QUEUE)


def test_queue(spark):
    q = entries(spark)
    assert rows(queue.deduplicated(q).select("queue_id")) == [(3,), (5,)]
    assert rows(queue.summary(q)) == [("a", 3, 0), ("b", 1, 1)]
    assert rows(queue.without(q, "a", "x").select("queue_id")) == [(4,), (5,)] and queue.without(q, "b").count() == 3
    assert rows(queue.reset(q, "a").where("namespace = 'a'").select("retry_count", "last_error")) == [(0, None)] * 3
    assert rows(queue.reset(q, "b", only_failed=True).where("namespace = 'b'").select("queue_id", "retry_count")) == [(4, 0), (5, None)]
    assert queue.failed(q, "boom").where("parked").count() == 1
    assert queue.in_turn(q).where("turn = 1 and namespace = 'b'").count() == 1


def test_turns_are_exact_in_a_namespace(spark):
    from datetime import datetime as D

    many = [(i, "a" if i % 4 else None, f"k{i}", "t", 0, None, D(2024, 1, 1 + i * 7 % 28)) for i in range(400)] + [(900, "b", "x", "t", 0, None, None)]
    got = queue.in_turn(spark.createDataFrame(many, QUEUE)).collect()
    for ns in ("a", None, "b"):
        mine = sorted((r["enqueued_at"] or D(1, 1, 1), r["queue_id"], r["turn"]) for r in got if r["namespace"] == ns)
        assert [r[2] for r in mine] == list(range(1, 1 + sum(x[1] == ns for x in many)))


def test_stream_worker_retries(spark, tmp_path):
    entries(spark).write.parquet(str(tmp_path / "in"))

    def handle(batch):
        raise RuntimeError("service is down")

    queue.run_worker(spark, str(tmp_path / "in"), QUEUE, str(tmp_path / "cp"), handle, str(tmp_path / "retry")).awaitTermination()
    assert {(r["queue_id"], r["retry_count"], r["last_error"]) for r in spark.read.parquet(str(tmp_path / "retry")).collect()} == {(3, 1, "service is down"), (5, 1, "service is down")}


def test_jsonl(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('// note\n\n{"id": "7", "a": "x"}\n{"id": 8, "a": 5}\n{"id": -1}\n{"id": 18446744073709551615}\n[1]\n{bad\n{"a": "y"}\n')
    good, bad = jsonl.split_documents(jsonl.lines(spark, str(f)), "id", "u64", {"a": "str"})
    assert rows(good.select(F.hex("key"))) == [("0000000000000007",), ("FFFFFFFFFFFFFFFF",)]
    assert sorted(r[0] for r in bad.select("reason").collect()) == ["field a is no str", "no usable id", "no usable id", "not JSON", "not an object"]
    f.write_text('{"k": "a", "v": [1, 2.5]}\n{"k": "b", "v": [1, null]}\n{"k": 1, "v": []}\n{"k": "c", "v": []}\n')
    good, bad = jsonl.split_values(jsonl.lines(spark, str(f)), "k", "v", "str", "vec_f32")
    assert rows(good) == [("a", [1.0, 2.5]), ("c", [])] and jsonl.summary(good, bad) == {"loaded": 2, "skipped": 2}
