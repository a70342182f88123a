"""Queries that go through an engine's stores from end to end, each with its SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import keys
from marlstone.functions import vectors as fv
from marlstone.operators import rabitq, search
from marlstone.plans.engine import Engine
from marlstone.plans.schema import Attribute, DocSchema, Index, KvSchema, SchemaError
from marlstone.predicate import compile_predicate
from marlstone.runtime import read_table, shared_dir
from marlstone.sources import centroids
from marlstone.sources.embedder import hash_embedder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def engine(spark, **named) -> Engine:
    return Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex[:8]}", **named)


_customers: dict[tuple[str, str], Engine] = {}


def customers(spark, d) -> Engine:
    """All customers in a store that no query changes, made once for each application and input."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _customers:
        e = engine(spark)
        e.create_store(DocSchema("customer", "u64", (Attribute("c_name", "str"),), (Index("c_nationkey", "int"), Index("c_mktsegment", "str"))))
        c = read_table(spark, d, "customer")
        doc = F.to_json(F.struct("c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment"))
        e.put_documents("customer", c.select(keys.u64_column(F.col("c_custkey").cast("bigint")).alias("key"), doc.alias("doc")))
        e.compact("customer")
        _customers[at] = e
    return _customers[at]


def _found(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["id"], r["document"]["c_name"]) for r in rows], "c_custkey bigint, c_name string")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer WHERE c_custkey = 77")
def document_get(spark, d):
    got = customers(spark, d).get("customer", 77)
    return _found(spark, [{"id": 77, "document": got}] if got else [])


@query("SELECT w.pos::BIGINT AS pos, c.c_name FROM (VALUES (0, 90), (1, 99999999), (2, 7), (3, 90)) w(pos, k) LEFT JOIN customer c ON c.c_custkey = w.k")
def document_multi_get(spark, d):
    got = customers(spark, d).multi_get("customer", [90, 99_999_999, 7, 90])
    return spark.createDataFrame([(i, r and r["c_name"]) for i, r in enumerate(got)], "pos bigint, c_name string")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer WHERE c_custkey >= 20 AND c_custkey < 55 ORDER BY c_custkey LIMIT 20 OFFSET 20")
def document_range(spark, d):
    e = customers(spark, d)
    return _found(spark, e.range("customer", 20, 55, cursor=e.range("customer", 20, 55)["next_cursor"])["results"])


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer WHERE c_custkey >= 0 AND c_custkey < 256 ORDER BY c_custkey LIMIT 30")
def document_prefix(spark, d):
    return _found(spark, customers(spark, d).prefix("customer", "00000000000000", 30)["results"])


@query("SELECT c_custkey::BIGINT AS c_custkey FROM customer")
def document_keys(spark, d):
    return customers(spark, d).keys("customer").select(keys.u64_number_column(F.col("key")).cast("bigint").alias("c_custkey"))


@query("SELECT c_custkey::BIGINT AS c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND NOT c_mktsegment = 'BUILDING'")
def document_query_keys(spark, d):
    got = customers(spark, d).query_keys("customer", "c_nationkey IN (1, 2, 3) AND NOT c_mktsegment = 'BUILDING'")
    return got.select(keys.u64_number_column(F.col("key")).cast("bigint").alias("c_custkey"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'again' ELSE n_name END AS name FROM nation WHERE n_nationkey % 5 <> 0")
def document_put_delete(spark, d):
    """Put, put again, delete; once with a compaction between."""
    e = engine(spark)
    e.create_store(DocSchema("nation", "u64", (Attribute("name", "str"),)))
    rows = read_table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    e.put_many("nation", {int(r[0]): {"name": r[1]} for r in rows})
    e.put_many("nation", {int(r[0]): {"name": "again"} for r in rows if r[0] % 3 == 0})
    e.compact("nation")
    for r in rows:
        if r[0] % 5 == 0:
            e.delete("nation", int(r[0]))
    got = e.range("nation", limit=100)["results"]
    return spark.createDataFrame([(r["id"], r["document"]["name"]) for r in got], "id bigint, name string")


@query(
    """SELECT 'get' AS what, s_name AS k, s_nationkey::VARCHAR AS v FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT * FROM (SELECT 'range', s_name, s_nationkey::VARCHAR FROM supplier WHERE s_name >= 'Supplier#000000004' AND s_name < 'Supplier#000000009' ORDER BY s_name LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'prefix', s_name, s_nationkey::VARCHAR FROM supplier WHERE s_name LIKE 'Supplier#00000000%' AND s_name <> 'Supplier#000000001' ORDER BY s_name LIMIT 20)"""
)
def kv_reads(spark, d):
    """Point, range and prefix reads of a key-value store with text keys; one key is deleted (no range reaches it)."""
    e = engine(spark)
    e.create_store(KvSchema("supplier"))
    s = read_table(spark, d, "supplier")
    e.put_values("supplier", s.select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("value")))
    key = s.where("s_suppkey = 3").first()["s_name"]
    e.kv_delete("supplier", "Supplier#000000001")
    out = [("get", key, e.kv_get("supplier", key))]
    out += [("range", r["key"], r["value"]) for r in e.kv_range("supplier", "Supplier#000000004", "Supplier#000000009", 3).rows]
    out += [("prefix", r["key"], r["value"]) for r in e.kv_prefix("supplier", "Supplier#00000000").rows]
    return spark.createDataFrame(out, "what string, k string, v string")


@query("SELECT vec_id::BIGINT AS vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def kv_vectors(spark, d):
    """All embeddings as values of a key-value store with integer keys, read back."""
    e = engine(spark)
    e.create_store(KvSchema("vectors", "int", "vec_f32"))
    e.put_values("vectors", read_table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("key"), F.col("embedding").cast("array<float>").alias("value")))
    total = F.aggregate("value", F.lit(0.0), lambda s, x: s + x)
    return e.table("vectors").select(F.col("key").alias("vec_id"), F.size("value").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT count(*) FILTER (raw_id % 7 <> 0) AS loaded, count(*) FILTER (raw_id % 7 = 0) AS skipped, count(*) FILTER (raw_id % 7 = 0) AS rejects, count(*) FILTER (raw_id % 7 <> 0 AND raw_id % 2 = 0) AS even FROM raw_jobs")
def jsonl_documents(spark, d):
    """JSON lines with every seventh one broken: what was loaded, skipped and set aside, and a query on the loaded field."""
    e = engine(spark)
    path = f"{e.root}-in"
    raw = read_table(spark, d, "raw_jobs")
    line = F.to_json(F.struct(F.col("raw_id").cast("string").alias("id"), (F.col("raw_id") % 2).cast("bigint").alias("odd")))
    raw.select(F.when(F.col("raw_id") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line)).write.text(path)
    e.create_store(DocSchema("raw", "u64", (), (Index("odd", "int"),)))
    got = e.load_documents("raw", path, "id", f"{path}.errors")
    rejects = spark.read.json(f"{path}.errors").where("reason = 'not JSON'").count()
    return spark.createDataFrame([(got["loaded"], got["skipped"], rejects, e.query("raw", "odd = 0")["total"])], "loaded bigint, skipped bigint, rejects bigint, even bigint")


@query("SELECT cluster_id, len(centroid) AS dimension, round(list_sum(centroid::DOUBLE[]), 4) AS total FROM clusters")
def centroid_file(spark, d):
    """Centroids written as JSON lines and read back with their checks."""
    path = f"{shared_dir(spark)}/centroids-{uuid.uuid4().hex[:8]}"
    read_table(spark, d, "clusters").select("cluster_id", "centroid").write.json(path)
    c = centroids.read_centroids(spark, path, 128)
    return spark.createDataFrame([(int(i), c.dimension, round(float(v.sum()), 4)) for i, v in zip(c.ids, c.matrix)], "cluster_id int, dimension bigint, total double")


@query("SELECT user_id::BIGINT AS user_id, max(epoch_us(ts) // 1000)::BIGINT AS ms FROM events GROUP BY user_id HAVING max(epoch_us(ts) // 1000) > (SELECT max(epoch_us(ts) // 1000) FROM events) - 86400000")
def raw_ttl(spark, d):
    """A raw namespace with a time to live of a day, swept at the time of the last event."""
    e = engine(spark)
    e.raw_namespace("seen", ttl_ms=86_400_000)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    last = read_table(spark, d, "events").groupBy("user_id").agg(F.max(ms).alias("ms"))
    e.raw_put_rows("seen", last.select(keys.u64_column(F.col("user_id").cast("bigint")).alias("key"), F.encode(F.col("ms").cast("string"), "utf-8").alias("value"), F.col("ms").alias("epoch_ms")))
    e.sweep_all(last.agg(F.max("ms")).first()[0])
    return e.table("seen").select(keys.u64_number_column(F.col("key")).cast("bigint").alias("user_id"), F.decode("value", "utf-8").cast("bigint").alias("ms"))


@query(
    """WITH s AS (SELECT count(*) AS n FROM nation) SELECT 'failed' AS step, s.n AS queued, 0 AS parked, 0 AS embedded FROM s
    UNION ALL SELECT 'parked', s.n, s.n, 0 FROM s UNION ALL SELECT 'retried', s.n, 0, 0 FROM s UNION ALL SELECT 'done', 0, 0, s.n FROM s UNION ALL SELECT 'deleted', 0, 0, s.n - 1 FROM s UNION ALL SELECT 'lost', 1, 0, s.n - 1 FROM s"""
)
def queue_worker(spark, d):
    """Texts through the queue of a key-value store: a service that fails, parking, a retry, the work, a delete, and a reconcile after a lost entry."""
    rng = np.random.default_rng(1).standard_normal((4, 16))
    c = centroids.Clusters(np.arange(1, 5), rng / np.linalg.norm(rng, axis=1)[:, None])
    good = hash_embedder(16)

    def down(_):
        raise RuntimeError("down")

    e = engine(spark, clusters=c, embed=down, config=search.Config(dimension=16, n_probes=4))
    e.create_store(KvSchema("nation", "int", semantic_search_enabled=True))
    e.put_values("nation", read_table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("value")))
    out = []

    def step(name: str) -> None:
        q = e.queue_summary()["nation"]
        out.append((name, q["actionable"] + q["exhausted"], q["exhausted"], e.progress("nation")["nation"]["embedded"]))

    e.work_queue("nation")
    step("failed")
    for _ in range(4):
        e.work_queue("nation")
    step("parked")
    e.queue_retry("nation")
    step("retried")
    e.embed = good
    e.work_all(wait_s=0)
    step("done")
    e.kv_delete("nation", 1)
    step("deleted")
    e.kv_put("nation", 1, "again")
    e.queue_delete("nation", 1)
    e.reconcile("nation")
    step("lost")
    return spark.createDataFrame(out, "step string, queued bigint, parked bigint, embedded bigint")


@query("SELECT 'customer' AS namespace, count(*) AS entries, count(*) AS live FROM customer UNION ALL SELECT NULL, count(*), count(*) FROM customer")
def engine_metrics(spark, d):
    return customers(spark, d).all_metrics().select("namespace", "entries", "live")


@query("SELECT c_custkey::BIGINT AS c_custkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 20")
def late_index(spark, d):
    """A field that becomes an index after the documents were put, before and after its build."""
    e = engine(spark)
    e.create_store(DocSchema("late", "u64"))
    c = read_table(spark, d, "customer").select(keys.u64_column(F.col("c_custkey").cast("bigint")).alias("key"), F.to_json(F.struct((F.col("c_acctbal") > 5000).alias("rich"))).alias("doc"))
    e.put_documents("late", c)
    e.amend("late", "add_index", "rich", "bool")
    before = [r["id"] for r in e.query("late", "rich = true")["results"]]
    e.build_index("late")
    after = [r["id"] for r in e.query("late", "rich = true")["results"]]
    return spark.createDataFrame([(i,) for i in after if before == after], "c_custkey bigint")


_BAD = {
    "color = 'red'": "UnknownField", "age = 'x'": "TypeMismatch", "age = true": "TypeMismatch", "status = 5": "TypeMismatch", "is_active > true": "UnsupportedOperator", "age = 1 AND status = 2": "TypeMismatch",
    "status = 'a' OR nothing > 3": "UnknownField", "NOT (age IN (1, 'b'))": "TypeMismatch", "age = 3.14": "SyntaxProblem", "age IN ()": "SyntaxProblem",
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in _BAD.items()) + ") t(predicate, error)")
def predicate_errors(spark, d):
    out = []
    for p in _BAD:
        try:
            compile_predicate(p, {"status": "str", "age": "int", "is_active": "bool"})
            out.append((p, None))
        except Exception as e:
            out.append((p, type(e).__name__))
    return spark.createDataFrame(out, "predicate string, error string")


@query(
    """SELECT DISTINCT vec_id, len(packed_vector) AS n_words, packed_vector[1] & 255 AS first_code, list_sum(list_transform(packed_vector, lambda w: list_sum(list_transform(range(8), lambda i: (w >> (8 * i)) & 255))))::BIGINT AS total,
    true AS same FROM vector_index WHERE len(packed_vector) = 16 AND len(list_filter(packed_vector, lambda w: w IS NULL)) = 0"""
)
def code_packs(spark, d):
    """Packed codes taken apart and packed again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [fv.unpack_words(w, signed=True) for w in pdf["packed_vector"]]
            same = [fv.pack_words(c, signed=True) == [int(x) for x in w] for c, w in zip(codes, pdf["packed_vector"])]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n_words": [len(c) // 8 for c in codes], "first_code": [int(c[0]) for c in codes], "total": [int(c.sum()) for c in codes], "same": same})

    v = read_table(spark, d, "vector_index").where((F.size("packed_vector") == 16) & ~F.exists("packed_vector", lambda x: x.isNull()))
    return v.select("vec_id", "packed_vector").mapInPandas(run, "vec_id bigint, n_words bigint, first_code bigint, total bigint, same boolean").distinct()


@query(
    """WITH z AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i))
    SELECT vec_id::BIGINT AS vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE - c[i] >= 0)) AS ones FROM embeddings, z"""
)
def one_bit_codes(spark, d):
    """Sign codes of all embeddings against their mean, packed and taken apart."""
    e = read_table(spark, d, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    c = np.array([r["m"] for r in mean])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [rabitq.one_bit(v, c).codes for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "ones": [int(fv.unpack_bits(fv.pack_bits(x), len(x)).sum()) for x in codes]})

    return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInPandas(run, "vec_id bigint, ones bigint")


@query("SELECT * FROM (VALUES ('a', 'doc'), ('b', 'kv'), ('c', 'raw'), ('copy', 'doc')) t(namespace, kind)")
def store_list(spark, d):
    """Stores made, one from an exported schema, one dropped, one refused."""
    e = engine(spark)
    e.create_store(DocSchema("a", "uuid", (Attribute("x", "int"),)))
    e.create_store(KvSchema("b", "int", "f32"))
    e.create_store(KvSchema("gone"))
    e.raw_namespace("c", 1000)
    e.drop_store("gone")
    try:
        e.create_store(KvSchema("a"))
    except SchemaError:
        e.import_schema(json.dumps(json.loads(e.export_schema("a")) | {"namespace": "copy", "ns_id": 3}))
    return spark.createDataFrame([(s.namespace, s.store_type) for s in e.stores()], "namespace string, kind string")
