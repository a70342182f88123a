import asyncio
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from marlstone.operators.search import Config
from marlstone.plans.engine import AsyncEngine, ClosedError, Engine, RunningError, Typed
from marlstone.plans.files import Folders
from marlstone.plans.schema import Attribute, DocSchema, Index, KvSchema, RawSchema, SchemaError, from_json, imported
from marlstone.predicate import UnknownField
from marlstone.sources.centroids import Clusters
from marlstone.sources.embedder import EmbeddingError, hash_embedder, http_embedder


@pytest.mark.parametrize(
    "bad",
    [
        {"namespace": "a b"}, {"key_type": "int"}, {"store_type": "kv"}, {"indices": tuple(Index(f"f{i}", "int") for i in range(6))}, {"indices": (Index("", "int"),)},
        {"indices": (Index("a", "int"), Index("a", "str"))}, {"attributes": (Attribute("", "int"),)}, {"attributes": (Attribute("a", "int"),), "indices": (Index("a", "int"),)},
        {"indices": (Index("a", "float"),)}, {"semantic_search_enabled": True}, {"semantic_search_enabled": True, "embedding_fields": ("x",)},
        {"semantic_search_enabled": True, "embedding_fields": ("a",), "attributes": (Attribute("a", "int"),)},
        {"semantic_search_enabled": True, "embedding_fields": ("a", "a"), "attributes": (Attribute("a", "str"),)},
    ],
)
def test_rejected_schemas(bad):
    with pytest.raises(SchemaError):
        DocSchema(**{"namespace": "n", **bad})


def test_amendments():
    s = DocSchema("n", "u64", (Attribute("t", "str"),), (Index("a", "str"),))
    assert s.drop_index("a").declared == s.declared and s.drop_index("zzz") == s
    assert s.drop_index("a").add_index("a", "str").indexed == {"a": "str"}
    v = s.enable_vector_index(["x", "y"])
    assert v.embedding_fields == ("x", "y") and v.disable_vector_index().embedding_fields == ()
    for f in (lambda: v.add_embedding_attribute("z"), lambda: s.enable_vector_index([]), lambda: s.enable_vector_index(["t"]), lambda: s.add_attribute("a", "str"), lambda: s.remove_attribute("q"), lambda: s.add_attribute("t", "str")):
        with pytest.raises(SchemaError):
            f()
    assert from_json(v.to_json()) == v
    d = json.loads(s.to_json())
    d["ns_id"], d["attributes"] = 9, [*d["attributes"], {"name": "a", "attr_type": "str"}]
    assert imported(json.dumps(d)) == s
    with pytest.raises(SchemaError):
        KvSchema("k", value_type="int", semantic_search_enabled=True)


@pytest.fixture
def engine(spark, tmp_path):
    m = np.random.default_rng(1).standard_normal((4, 16))
    c = Clusters(np.arange(1, 5), m / np.linalg.norm(m, axis=1)[:, None])
    return Engine(spark, str(tmp_path / "db"), c, hash_embedder(16), Config(dimension=16, n_probes=4))


def test_documents(engine, tmp_path):
    engine.create_store(DocSchema("jobs", "u64", (Attribute("jobTitle", "str"),), (Index("agency", "str"),), True, ("jobTitle",)))
    f = tmp_path / "jobs.jsonl"
    docs = [(13354909, "National Library Board", "Librarian, Branch"), (13354910, "National Library Board", "Manager, Branch"), (17039645, "Ministry of Transport", "Executive, Shared Mobility")]
    f.write_text("\n".join(json.dumps({"jobId": str(i), "agency": a, "jobTitle": t}) for i, a, t in docs) + "\n{bad\n")
    assert engine.load_documents("jobs", str(f), "jobId") == {"loaded": 3, "skipped": 1}
    got = engine.query("jobs", 'agency = "National Library Board"')
    assert ([r["id"] for r in got["results"]], got["total"], got["page_no"], got["page_size"]) == ([13354909, 13354910], 2, 1, 20)
    with pytest.raises(UnknownField):
        engine.query("jobs", "jobTitle = 'x'")
    page = engine.range("jobs", limit=2)
    assert [r["id"] for r in page["results"]] == [13354909, 13354910] and [r["id"] for r in engine.range("jobs", cursor=page["next_cursor"])["results"]] == [17039645]
    assert len(engine.prefix("jobs", "0000-0000")["results"]) == 3
    engine.work_queue("jobs")
    hits = engine.semantic_search("jobs", "Librarian, Branch")
    assert hits[0]["id"] == 13354909 and engine.semantic_search("jobs", "Librarian, Branch", 'agency = "Ministry of Transport"')[0]["id"] == 17039645
    assert engine.semantic_search("jobs", "  ") == []
    engine.put("jobs", 13354909, {"agency": "Other", "jobTitle": "Librarian, Branch"})
    assert engine.query("jobs", "agency = 'Other'")["total"] == 1 and engine.query("jobs", 'agency = "National Library Board"')["total"] == 1
    with pytest.raises(SchemaError):
        engine.put("jobs", 1, {"agency": 5})
    with pytest.raises(SchemaError):
        engine.put("jobs", 1, "[1]")
    engine.delete("jobs", 17039645)
    engine.delete("jobs", 4)
    assert engine.get("jobs", 17039645) is None and engine.row_count("jobs") == 2 and engine.multi_get("jobs", [13354910, 1, "x"])[1:] == [None, None]
    assert engine.progress()["jobs"]["queued"] == 1 and engine.reconcile("jobs") == 0
    engine.amend("jobs", "drop_index", "agency")
    with pytest.raises(UnknownField):
        engine.query("jobs", "agency = 'Other'")
    engine.amend("jobs", "add_index", "agency", "str")
    engine.compact("jobs")
    assert engine.query("jobs", "NOT agency = 'Other'")["total"] == 1 and engine.clear_query_cache() == 2
    engine.sweep("jobs", 0, 2**50)
    assert engine.row_count("jobs") == 0
    engine.drop_store("jobs")
    with pytest.raises(KeyError):
        engine.schema("jobs")


def test_a_late_index_reads_old_documents(engine):
    engine.create_store(DocSchema("d", "uuid"))
    engine.put("d", "00000000-0000-0000-0000-000000000001", {"n": 3})
    engine.amend("d", "add_index", "n", "int")
    engine.put("d", "00000000-0000-0000-0000-000000000002", {"n": 4})
    assert engine.query("d", "n >= 3")["total"] == 2


def test_failing_service_keeps_the_queue(engine):
    engine.create_store(DocSchema("d", "u128", (Attribute("t", "str"),), (), True, ("t",)))
    engine.put("d", str(2**100), {"t": "hello"})

    def down(texts):
        raise RuntimeError("down")

    good, engine.embed = engine.embed, down
    engine.work_queue("d")
    assert engine.queue("d").first()["retry_count"] == 1
    engine.embed = good
    engine.work_queue("d")
    assert engine.semantic_search("d", "hello")[0]["id"] == str(2**100)


@pytest.mark.parametrize("kind,value", [("str", "x"), ("int", -7), ("f32", 1.5), ("vec_f32", [1.0, 2.0]), ("vec_f32", [])])
def test_key_values(engine, kind, value):
    engine.create_store(KvSchema("kv", "int", kind))
    engine.kv_put("kv", -5, value)
    engine.kv_put("kv", 3, value)
    assert engine.kv_get("kv", -5) == value and [r["key"] for r in engine.kv_range("kv", start=-5, end=3).rows] == [-5] and len(engine.kv_prefix("kv", 3).rows) == 1
    engine.kv_delete("kv", 3)
    assert engine.kv_get("kv", 3) is None
    with pytest.raises(SchemaError):
        engine.kv_put("kv", 1, {"a": 1})
    engine.shutdown()
    with pytest.raises(ClosedError):
        engine.kv_get("kv", 1)


def texts(engine, ns="d", **schema):
    engine.create_store(DocSchema(ns, "u64", (Attribute("t", "str"),), semantic_search_enabled=True, embedding_fields=("t",), **schema))


def down(_):
    raise RuntimeError("down")


def test_parked_and_new_entries_survive_the_worker(engine):
    texts(engine)
    engine.put_many("d", {1: {"t": "one"}, 2: {"t": "two"}, 3: {"t": "three"}})
    engine._change_queue("d", engine.queue("d").where("text like '%one%'"), retry=5, error="old")
    good = engine.embed

    def slow(batch):
        return good(batch)

    engine.embed = slow
    done = Folders.append

    def while_running(self, df, fields=(), by=None):  # a text is queued after the worker took its list
        if by == "cluster_id" and not seen:
            seen.append(1)
            Folders.append = done
            engine.put("d", 2, {"t": "two again"})
        done(self, df, fields, by)

    seen = []
    Folders.append = while_running
    try:
        assert engine.work_queue("d") == 2
    finally:
        Folders.append = done
    left = {r["text"]: r["retry_count"] for r in engine.queue("d").collect()}
    assert len(left) == 2 and left.pop(next(t for t in left if "two again" in t)) == 0 and list(left.values()) == [5]
    assert engine.queue_entry("d", 1)["last_error"] == "old" and engine.queue_entry("d", 3) is None
    assert engine.queue_summary() == {"d": {"actionable": 1, "exhausted": 1}}
    engine.embed = down
    assert engine.work_queue("d") == 0 and engine.queue_entry("d", 1)["retry_count"] == 5 and engine.queue_entry("d", 2)["retry_count"] == 1
    assert len(engine.queue_list("d")) == 2 and len(engine.queue_list("d", 2, 1)) == 1
    engine.queue_retry("d")
    assert engine.queue_entry("d", 1)["retry_count"] == 0 and engine.queue_entry("d", 2)["retry_count"] == 1
    engine.queue_retry("d", 2)
    engine.queue_delete("d", 1)
    assert [r["retry_count"] for r in engine.queue_list("d")] == [0]
    engine.embed = good
    events = []
    engine.observers = (events.append,)
    assert engine.work_all(turn=1, wait_s=0) == 1 and events[-1]["status"] == "done"
    assert engine.vectors("d").where("part = 0").count() == 2
    engine.compact_queue("d")
    engine.compact_vectors("d")
    assert engine.progress("d") == {"d": {"queued": 0, "embedded": 2}}
    engine.delete("d", 2)
    assert engine.vectors("d").where("part = 0").count() == 1
    engine.queue_delete("d")
    assert engine.queue("d").count() == 0


def test_all_stores_have_their_turn(engine):
    for ns in ("a", "b"):
        texts(engine, ns)
        engine.put_many(ns, {i: {"t": f"text {i}"} for i in range(3)})
    order = []
    engine.observers = (lambda e: order.append(e["namespace"]),)
    assert engine.work_all(turn=2, wait_s=0) == 6 and order == ["a", "b", "a", "b"]
    assert engine.probe_embedder() == pytest.approx(1, abs=1e-5)


def test_a_put_during_compaction_and_a_crash_lose_nothing(engine, monkeypatch):
    engine.create_store(DocSchema("d", "u64", (), (Index("n", "int"),)))
    engine.put("d", 1, {"n": 1})
    engine.put("d", 1, {"n": 2})
    commit = Folders.commit

    def late(self, add, gone=()):
        if gone:
            monkeypatch.setattr(Folders, "commit", commit)
            engine.put("d", 2, {"n": 3})
        commit(self, add, gone)

    monkeypatch.setattr(Folders, "commit", late)
    engine.compact("d")
    assert engine.row_count("d") == 2 and engine.query("d", "n >= 2")["total"] == 2
    assert sorted(p["compact"] for p in engine.storage("d")) == [False, True]

    def crash(self, add, gone=()):
        raise OSError("gone")

    monkeypatch.setattr(Folders, "commit", crash)
    with pytest.raises(OSError):
        engine.compact("d")
    monkeypatch.setattr(Folders, "commit", commit)
    assert engine.row_count("d") == 2 and engine.get("d", 1) == {"n": 2}
    before = len(engine.storage("d"))
    assert engine.clean("d", 0) >= 3 and len(engine.storage("d")) == before and engine.row_count("d") == 2
    engine.put("d", 3, {"n": 3})
    assert engine.row_count("d") == 3 and engine.stats()["d"]["rows"] == 3 and engine.stats()["d"]["bytes"] > 0
    assert {r["namespace"]: r["live"] for r in engine.all_metrics().collect()} == {"d": 3, None: 3}


def test_queries_shuffle_keys_not_documents(engine, capsys):
    engine.create_store(DocSchema("d", "u64", (), (Index("n", "int"),)))
    engine.put_many("d", {i: {"n": i, "long": "x" * 100} for i in range(5)})
    engine._matching(engine.doc_schema("d"), "n >= 1").explain("formatted")
    assert "doc" not in capsys.readouterr().out.replace("document", "")


def test_index_build_goes_on_where_it_was(engine):
    engine.create_store(DocSchema("d", "u64"))
    engine.put("d", 1, {"n": 1})
    engine.put("d", 2, {"n": 2})
    engine.amend("d", "add_index", "n", "int")
    engine.put("d", 3, {"n": 3})
    assert engine.index_progress() == {"d": {"done": 1, "total": 3}} and engine.query("d", "n > 0")["total"] == 3
    events = []

    def stop(e):
        events.append(e)
        if len(events) == 1:
            raise RuntimeError("stopped")

    engine.observers = (stop,)
    with pytest.raises(RuntimeError):
        engine.build_index("d")
    assert engine.index_progress("d") == {"d": {"done": 2, "total": 3}}
    engine.observers = (events.append,)
    assert engine.build_index("d") == 1 and events[-1]["status"] == "done" and engine.query("d", "n > 0")["total"] == 3
    assert engine.reindex_document("d", 2) == "indexed" and engine.reindex_document("d", 9) == "missing" and engine.row_count("d") == 3
    assert engine.files.claim(engine._path("running", "index-d"))
    with pytest.raises(RunningError):
        engine.build_index("d")


def test_validating_reconcile(engine, spark):
    texts(engine)
    engine.create_store(KvSchema("k", semantic_search_enabled=True))
    engine.put_many("d", {1: {"t": "one"}, 2: {"t": "two"}})
    engine.kv_put("k", "a", "some text")
    engine.work_all(wait_s=0)
    assert engine.reconcile("d", validate=True) == 0 and engine.reconcile("k", validate=True) == 0
    key = engine.key("d", 1).hex().upper()
    t = engine._table("vectors", "d")
    broken = engine.vectors("d").where(f"doc_id = '{key}' and part = 0").selectExpr("doc_id", "part", "cluster_id", "style", "bits", "add", "scale", "err", "cast('zz' as binary) as code", f"{engine._seq()} as seq")
    t.append(broken, by="cluster_id")
    assert engine.reconcile("d") == 0 and engine.reconcile("d", validate=True) == 1 and engine.queue_entry("d", 1)["text"]
    engine._forget("k", "a")
    assert engine.reconcile("k") == 1 and engine.reindex_vectors("d") == 2 and engine.reindex_vectors("d", 1) == 1
    assert {r["style"]: r["n_corrupt"] for r in engine.corruption("d").collect()}["MultiBit"] == 1


def test_raw_namespaces(engine):
    engine.raw_namespace("cache", ttl_ms=1000, most_deletes=1)
    assert engine.raw_namespace("cache") == RawSchema("cache", 1000, 1)
    engine.raw_put("cache", b"a", b"1", epoch_ms=0)
    engine.raw_put("cache", b"b", b"2", epoch_ms=500)
    assert engine.raw_get("cache", b"a") == b"1" and engine.raw_get("cache", b"z") is None
    engine.sweep_all(5000)
    assert engine.raw_get("cache", b"a") is None and engine.raw_get("cache", b"b") == b"2"
    engine.raw_delete("cache", b"b")
    assert engine.row_count("cache") == 0
    engine.drop_store("cache")
    t = Typed(engine, "typed", "u64")
    for i in (300, 7, 20):
        t.put(i, {"v": i})
    t.delete(20)
    assert list(t.iter()) == [(7, {"v": 7}), (300, {"v": 300})] and t.get(7) == {"v": 7} and t.get(20) is None
    assert [k for k, _ in t.range(8)] == [300] and [k for k, _ in t.prefix("00000000")] == [7, 300] and t.keys().count() == 2


def test_async_and_settings(engine, spark, tmp_path):
    a = AsyncEngine(engine)
    asyncio.run(a.create_store(DocSchema("d", "u64")))
    asyncio.run(a.put("d", 1, {"x": 1}))
    assert asyncio.run(a.get("d", 1)) == {"x": 1} and a.closed is False
    c = tmp_path / "c.jsonl"
    c.write_text('{"cluster_id": 1, "centroid": [1.0, 0.0]}\n')
    toml = f'[storage]\nroot = "{tmp_path}/db2"\n[semantic_search]\nmodel = "Small"\nn_probes = 2\n[[semantic_search.supported_models]]\nname = "small"\ndimension = 2\ncentroids = "{c}"\n'
    (tmp_path / "e.toml").write_text(toml)
    e = Engine.open(spark, str(tmp_path / "e.toml"))
    assert e.config.dimension == 2 and e.config.n_probes == 2 and e.health() == {"open": True, "stores": 0}
    for old, new in (('"Small"', '"other"'), ("dimension = 2", "dimension = 3"), ("n_probes = 2", "dense_bits = 9"), ("dimension = 2", "dimension = 0")):
        (tmp_path / "e.toml").write_text(toml.replace(old, new))
        with pytest.raises(ValueError):
            Engine.open(spark, str(tmp_path / "e.toml"))
    with pytest.raises(ValueError):
        Engine.open(spark, {})


def test_http_embedder():
    calls = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            self.send_response(503 if len(calls) == 1 else 400 if body["payloads"] == ["bad"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"model": "x", "embeddings": [[float(len(t))] * body["dimensions"] for t in body["payloads"]]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = http_embedder(f"http://127.0.0.1:{server.server_port}/", 2)
    assert e(["a", "bcd"]) == [[1.0, 1.0], [3.0, 3.0]] and len(calls) == 2 and e([]) == []
    with pytest.raises(EmbeddingError):
        e(["bad"])
    server.shutdown()
    with pytest.raises(EmbeddingError):
        http_embedder("http://127.0.0.1:1/", 2, tries=1)(["x"])
