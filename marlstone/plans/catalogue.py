"""All queries of the core, each with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import fields, keys, text
from marlstone.functions import vectors as fv
from marlstone.operators import changelog as cl
from marlstone.operators import exact, rowsets, scans, search
from marlstone.plans import engine_queries, skew_queries
from marlstone.plans.schema import Attribute, DocSchema, Index, KvSchema
from marlstone.predicate import compile_predicate, match
from marlstone.predicate.syntax import Between
from marlstone.runtime import Table, read_table, shared_dir
from marlstone.sources import centroids, jsonl
from marlstone.sources.embedder import embed_column, hash_embedder
from marlstone.streaming import queue

QUERIES = {**skew_queries.QUERIES, **engine_queries.QUERIES}
SQL = {**skew_queries.SQL, **engine_queries.SQL}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


EVENTS = {"event_type": "str", "user_id": "int", "event_id": "int"}
USERS = {"status": "str", "age": "int", "is_active": "bool"}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return scans.offset_page(match(read_table(spark, d, "events"), "event_type = 'click' AND user_id < 100", EVENTS), "event_id", 1, 20)


# Predicates


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def pred_eq(spark, d):
    return match(read_table(spark, d, "events"), "event_type = 'click'", EVENTS).select("event_id", "user_id")


@query("SELECT user_id, status FROM users WHERE status <> 'active'")
def pred_ne(spark, d):
    return match(read_table(spark, d, "users"), 'status != "active"', USERS).select("user_id", "status")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20")
def pred_range(spark, d):
    return match(read_table(spark, d, "part"), "p_size >= 10 and p_size <= 20", {"p_size": "int"}).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey < 500")
def pred_in(spark, d):
    return match(read_table(spark, d, "orders"), "o_orderstatus IN ('F', 'O', 'F') AND o_custkey < 500", {"o_orderstatus": "str", "o_custkey": "int"}).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type = 'view' OR (event_type = 'click' AND user_id < 50)")
def pred_and_or_precedence(spark, d):
    return match(read_table(spark, d, "events"), "event_type = 'view' OR event_type = 'click' AND user_id < 50", EVENTS).select("event_id")


@query("SELECT user_id, age FROM users WHERE is_active AND age > 30")
def pred_bool(spark, d):
    return match(read_table(spark, d, "users"), "is_active = true AND age > 30", USERS).select("user_id", "age")


@query("SELECT user_id FROM users WHERE is_active IN (true, false) AND status >= 'c' AND status < 'inactivf'")
def pred_str_order(spark, d):
    return match(read_table(spark, d, "users"), "is_active IN (TRUE, false) AND status >= 'c' AND status < 'inactivf'", USERS).select("user_id")


@query("SELECT user_id, status, age FROM users WHERE status IS NOT NULL AND status <> 'active'")
def pred_not_universe(spark, d):
    return match(read_table(spark, d, "users"), "NOT status = 'active'", USERS).select("user_id", "status", "age")


@query("SELECT user_id, status, age FROM users WHERE (status IS NOT NULL OR age IS NOT NULL) AND NOT (coalesce(status = 'active', false) AND coalesce(age > 40, false))")
def pred_not_compound(spark, d):
    return match(read_table(spark, d, "users"), "NOT (status = 'active' AND age > 40)", USERS).select("user_id", "status", "age")


@query(
    """SELECT user_id, age, is_active FROM users WHERE (is_active IS NOT NULL OR age IS NOT NULL)
    AND NOT ((is_active IS NOT NULL AND NOT coalesce(is_active, false)) OR coalesce(age IN (30, 40), false))"""
)
def pred_not_nested(spark, d):
    return match(read_table(spark, d, "users"), "NOT (NOT (is_active = true) OR age IN (30, 40))", USERS).select("user_id", "age", "is_active")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
def pred_between_api(spark, d):
    return match(read_table(spark, d, "part"), Between("p_size", 5, 9), {"p_size": "int"}).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id >= 20 ORDER BY event_id")
def query_keys(spark, d):
    return match(read_table(spark, d, "events"), "event_type != 'click' AND user_id >= 20", EVENTS).select("event_id").orderBy("event_id")


@query("""SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'click' AND user_id < 100) AS total
    FROM events WHERE event_type = 'click' AND user_id < 100 ORDER BY event_id LIMIT 20 OFFSET 20""")
def query_page_total(spark, d):
    hit = match(read_table(spark, d, "events"), "event_type = 'click' AND user_id < 100", EVENTS)
    page = scans.page_with_total(hit.select("event_id", "user_id"), "event_id", 2, 20)
    return spark.createDataFrame([(r["event_id"], r["user_id"], page.total) for r in page.rows], "event_id bigint, user_id bigint, total bigint")


# Scans


@query("SELECT * FROM customer WHERE c_custkey = 77")
def point_get(spark, d):
    return scans.point_get(read_table(spark, d, "customer"), "c_custkey", 77)


@query("SELECT w.pos, c.c_custkey, c.c_name FROM (VALUES (0, 90), (1, -1), (2, 7), (3, 90)) w(pos, k) LEFT JOIN customer c ON c.c_custkey = w.k")
def multi_get(spark, d):
    got = scans.multi_get(read_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", [90, -1, 7, 90])
    return got.select("pos", F.when(F.col("c_name").isNotNull(), F.col("c_custkey")).alias("c_custkey"), "c_name")


@query("SELECT c_custkey, c_name FROM customer")
def full_scan(spark, d):
    return scans.full_scan(read_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT o_orderkey FROM orders")
def keys_only(spark, d):
    return scans.keys_only(read_table(spark, d, "orders"), "o_orderkey")


@query("SELECT c_name, c_acctbal FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000055'")
def range_scan(spark, d):
    return scans.range_scan(read_table(spark, d, "customer").select("c_name", "c_acctbal"), "c_name", "Customer#000000010", "Customer#000000055")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 300")
def range_open(spark, d):
    return scans.range_scan(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 300)


@query("SELECT c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def prefix_scan_str(spark, d):
    return scans.prefix_scan(read_table(spark, d, "customer").select("c_name"), "c_name", "Customer#00000001")


@query("SELECT doc_id FROM documents WHERE doc_id >= 256 AND doc_id < 512")
def prefix_scan_doc_bytes(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", keys.u64_column(F.col("doc_id")).alias("key"))
    return scans.prefix_scan(docs, "key", keys.from_cursor("00000000-0000-01")).select("doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 21")
def cursor_page_first(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source")
    page = scans.cursor_page(docs, "doc_id", 20)
    last = [page.next_cursor] if page.next_cursor is not None else []
    return spark.createDataFrame(page.rows + scans.point_get(docs, "doc_id", last[0]).collect() if last else page.rows, "doc_id bigint, source string")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20) WHERE doc_id < 900000")
def cursor_page_next(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    first = scans.cursor_page(docs, "doc_id", 20)
    page = scans.cursor_page(docs, "doc_id", 20, cursor=first.next_cursor, start=0, end=900_000)
    return spark.createDataFrame(page.rows, "doc_id bigint")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 30")
def offset_page(spark, d):
    return scans.offset_page(read_table(spark, d, "customer"), "c_custkey", 3, 15).select("c_custkey")


@query("SELECT cluster_id, count(*) AS n FROM vector_index WHERE cluster_id IN (4, 6, 11, 13) GROUP BY cluster_id")
def multi_prefix_scan(spark, d):
    return scans.multi_prefix(read_table(spark, d, "vector_index"), "cluster_id", [4, 6, 11, 13]).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, row_number() OVER (ORDER BY k < 0, k) AS pos FROM (SELECT DISTINCT user_id - 75 AS k FROM events)")
def kv_int_order_compat(spark, d):
    return scans.numbered(read_table(spark, d, "events").select((F.col("user_id") - 75).alias("k")).distinct(), "k", compat=True)


@query("SELECT doc_id, printf('%016x', doc_id) AS u64_hex, printf('%032x', doc_id) AS u128_hex, CAST(doc_id AS VARCHAR) AS back FROM documents")
def key_codec(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    k = keys.u64_column(F.col("doc_id"))
    return docs.select("doc_id", F.lower(F.hex(k)).alias("u64_hex"), F.lower(F.hex(keys.u128_column(F.col("doc_id").cast("string")))).alias("u128_hex"), keys.u64_number_column(k).cast("string").alias("back"))


# Change log: events are changes of users, errors delete


def _log(spark, d):
    e = read_table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return cl.changes(e, F.col("user_id"), F.col("event_id"), ms, F.when(F.col("event_type") == "error", cl.DELETE).otherwise(cl.PUT), {"event_type": F.col("event_type"), "value": F.col("value")})


_LATEST = "latest AS (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(epoch_us(ts) // 1000, event_id) AS epoch_ms FROM events GROUP BY user_id)"
NOW, TTL = 1_705_000_000_000, 86_400_000


@query(f"WITH {_LATEST} SELECT user_id AS key, seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, event_type FROM latest")
def latest_wins(spark, d):
    return cl.latest(_log(spark, d)).select("key", "seq", "op", "event_type")


@query(f"WITH {_LATEST} SELECT user_id AS key, seq, event_type FROM latest WHERE event_type <> 'error'")
def latest_after_delete(spark, d):
    return cl.live(_log(spark, d)).select("key", "seq", "event_type")


@query(f"WITH {_LATEST} SELECT user_id AS key, epoch_ms FROM latest WHERE event_type <> 'error' AND {NOW + 20 * TTL} - epoch_ms >= {TTL}")
def ttl_expire(spark, d):
    return cl.expired(cl.live(_log(spark, d)), TTL, NOW + 20 * TTL).select("key", "epoch_ms")


@query(f"WITH {_LATEST}, gone AS (SELECT user_id FROM latest WHERE event_type <> 'error' AND {NOW + 20 * TTL} - epoch_ms >= {TTL}) SELECT user_id AS key FROM latest WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM gone)")
def ttl_sweep(spark, d):
    log = _log(spark, d)
    deletes = cl.sweep(log, TTL, NOW + 20 * TTL, 2**40)
    return cl.live(log.unionByName(deletes)).select("key")


@query(f"WITH {_LATEST} SELECT (SELECT count(*) FROM events) AS entries, count(*) AS kept FROM latest WHERE event_type <> 'error'")
def compact_counts(spark, d):
    log = _log(spark, d)
    return log.agg(F.count(F.lit(1)).alias("entries"), F.lit(1).alias("x")).join(cl.compacted(log).agg(F.count(F.lit(1)).alias("kept"), F.lit(1).alias("x")), "x").drop("x")


@query(f"WITH {_LATEST} SELECT (SELECT count(*) FROM events) AS entries, (SELECT count(*) FROM events WHERE event_type <> 'error') AS puts, (SELECT count(*) FROM events WHERE event_type = 'error') AS deletes, count(*) AS keys, count(*) FILTER (event_type <> 'error') AS live FROM latest")
def log_counters(spark, d):
    return cl.counters(_log(spark, d)).select("entries", "puts", "deletes", "keys", "live")


# Index statistics and row-id sets


@query("SELECT count(DISTINCT o_orderkey) AS n FROM orders")
def row_count(spark, d):
    """All orders put into a key-value store twice, and the rows it counts."""
    e = engine_queries.engine(spark)
    e.create_store(KvSchema("orders", "int", "str"))
    for _ in range(2):
        e.put_values("orders", read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value")))
    return spark.createDataFrame([(e.row_count("orders"),)], "n bigint")


@query("SELECT doc_id, source FROM documents WHERE source = 'notice-board' ORDER BY doc_id LIMIT 20 OFFSET 20")
def document_query(spark, d):
    """Documents put into a store, and the second page of a predicate over them."""
    e = engine_queries.engine(spark)
    e.create_store(DocSchema("docs", "u64", (), (Index("source", "str"),)))
    docs = read_table(spark, d, "documents").where("doc_id is not null")
    e.put_documents("docs", docs.select(keys.u64_column(F.col("doc_id")).alias("key"), F.to_json(F.struct("doc_id", "source")).alias("doc")))
    got = e.query("docs", "source = 'notice-board'", 2, 20)["results"]
    return spark.createDataFrame([(r["id"], r["document"]["source"]) for r in got], "doc_id bigint, source string")


@query("SELECT 'age' AS field, count(DISTINCT age) AS n_values FROM users UNION ALL SELECT 'is_active', count(DISTINCT is_active) FROM users UNION ALL SELECT 'status', count(DISTINCT status) FROM users")
def distinct_values(spark, d):
    return rowsets.distinct_values(read_table(spark, d, "users"), ["status", "age", "is_active"])


@query("SELECT event_type AS value, count(DISTINCT event_id) AS n_ids, min(event_id) AS least, max(event_id) AS most FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def value_postings(spark, d):
    return rowsets.postings(read_table(spark, d, "events"), "event_type", "event_id")


@query("SELECT status AS value, user_id // 65536 AS container, list(DISTINCT CAST(user_id % 65536 AS INTEGER) ORDER BY CAST(user_id % 65536 AS INTEGER)) AS bits FROM users WHERE status IS NOT NULL GROUP BY ALL")
def value_listing(spark, d):
    return rowsets.listing(read_table(spark, d, "users"), "status", "user_id")


def _sets(spark, d):
    e = read_table(spark, d, "events")
    return rowsets.ids(match(e, "event_type = 'click'", EVENTS), "event_id"), rowsets.ids(match(e, "user_id < 60", EVENTS), "event_id")


_A, _B = "(SELECT event_id AS id FROM events WHERE event_type = 'click')", "(SELECT event_id AS id FROM events WHERE user_id < 60)"


@query(f"SELECT 'and' AS op, id FROM (SELECT id FROM {_A} INTERSECT SELECT id FROM {_B}) UNION ALL SELECT 'or', id FROM (SELECT id FROM {_A} UNION SELECT id FROM {_B}) UNION ALL SELECT 'and_not', id FROM (SELECT id FROM {_A} EXCEPT SELECT id FROM {_B})")
def bitmap_and_or_andnot(spark, d):
    a, b = _sets(spark, d)
    named = [("and", rowsets.both(a, b)), ("or", rowsets.either(a, b)), ("and_not", rowsets.without(a, b))]
    frames = [x.select(F.lit(n).alias("op"), "id") for n, x in named]
    return frames[0].union(frames[1]).union(frames[2])


@query(f"SELECT 'and' AS op, id FROM (SELECT id FROM {_A} INTERSECT SELECT id FROM {_B}) WHERE id >= 100 AND id < 700 UNION ALL SELECT 'or', id FROM (SELECT id FROM {_A} UNION SELECT id FROM {_B}) WHERE id >= 100 AND id < 700")
def bitmap_range_ops(spark, d):
    a, b = _sets(spark, d)
    return rowsets.both_within(a, b, 100, 700).select(F.lit("and").alias("op"), "id").union(rowsets.either_within(a, b, 100, 700).select(F.lit("or").alias("op"), "id"))


@query(f"SELECT id FROM {_A} WHERE id < 50 OR id >= 400 UNION ALL SELECT id FROM (SELECT unnest(range(50, 400)) AS id EXCEPT SELECT id FROM {_A})")
def bitmap_flip(spark, d):
    return rowsets.flip(_sets(spark, d)[0], 50, 400)


@query(f"SELECT count(*) FILTER (id <= 500) AS rank_500, (SELECT id FROM {_A} ORDER BY id LIMIT 1 OFFSET 10) AS nth_10, count(*) AS n, min(id) AS least, max(id) AS most FROM {_A}")
def rank_select(spark, d):
    a = _sets(spark, d)[0]
    r, s = rowsets.rank(a, 500), rowsets.select(a, 10)
    return rowsets.extent(a).select(F.lit(r).cast("bigint").alias("rank_500"), F.lit(s).cast("bigint").alias("nth_10"), "n", "least", "most")


# Text

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORDS = f"list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"


def _windowed(units: str, size: int, step: int) -> str:
    n = "len(u)"
    count = f"least(1 + CAST(ceil(greatest({n} - {size}, 0) / {step}.0) AS BIGINT), CAST(ceil({n} / {step}.0) AS BIGINT))"
    return f"SELECT doc_id, i AS pos, array_to_string(u[i * {step} + 1 : i * {step} + {size}], ' ') AS chunk FROM (SELECT doc_id, u, unnest(range(CASE WHEN len(u) = 0 THEN 0 ELSE {count} END)) AS i FROM (SELECT doc_id, {units} AS u FROM documents WHERE text IS NOT NULL))"


def _exploded(spark, d, chunks):
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))


@query(f"SELECT doc_id, len({_WORDS}) AS n_words, {_WORDS}[1] AS first_word FROM documents WHERE text IS NOT NULL")
def chunk_words(spark, d):
    w = text.words(F.col("text"))
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))


@query(f"SELECT doc_id, unnest(u) AS chunk, unnest(range(len(u))) AS pos FROM (SELECT doc_id, {_SENT} AS u FROM documents WHERE text IS NOT NULL)")
def chunk_sentences(spark, d):
    return _exploded(spark, d, text.sentences(F.col("text")))


@query(_windowed(_WORDS, 5, 3))
def sliding_windows(spark, d):
    return _exploded(spark, d, text.windows(text.words(F.col("text")), 5, 3))


@query(_windowed(_SENT, 4, 2))
def chunk_document(spark, d):
    return _exploded(spark, d, text.chunk_document(F.col("text")))


@query("SELECT jobId, concat_ws(chr(10), 'jobTitle: ' || jobTitle, 'agency: ' || agency) AS t FROM jobs")
def embedding_text(spark, d):
    return read_table(spark, d, "jobs").select("jobId", text.embedding_text(["jobTitle", "agency"]).alias("t"))


# JSON documents


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return read_table(spark, d, "events").select("event_id", fields.field(fields.variant(F.col("props")), "k", "int").alias("k"))


@query("""SELECT raw_id, CASE WHEN NOT json_valid(payload) OR left(ltrim(payload), 1) <> '{' THEN 'not an object'
    WHEN json_exists(payload, '$.agency') AND json_type(payload, '$.agency') NOT IN ('VARCHAR', 'NULL') THEN 'field agency is no str' END AS problem FROM raw_jobs""")
def doc_validate(spark, d):
    s = DocSchema("raw", "u64", (Attribute("unit", "str"),), (Index("agency", "str"),))
    return read_table(spark, d, "raw_jobs").select("raw_id", s.problem(F.col("payload")).alias("problem"))


@query("SELECT count(*) FILTER (ok) AS loaded, count(*) FILTER (NOT ok) AS skipped FROM (SELECT CASE WHEN json_valid(payload) THEN json_exists(payload, '$.agency') ELSE false END AS ok FROM raw_jobs)")
def jsonl_load_good_bad(spark, d):
    rows = read_table(spark, d, "raw_jobs").select(F.col("payload").alias("line"))
    good, bad = jsonl.split_values(rows, "agency", "agency", "str", "str")
    a, b = good.agg(F.count(F.lit(1)).alias("loaded"), F.lit(1).alias("x")), bad.agg(F.count(F.lit(1)).alias("skipped"), F.lit(1).alias("x"))
    return a.join(b, "x").drop("x")


# Vectors: centroids are the means of the labels of the embeddings table

_CENT = """cent AS (SELECT label AS cluster_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM
    (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
    near AS (SELECT vec_id, cluster_id, c, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], c), 7), cluster_id) AS rank FROM embeddings, cent)"""
#: Every row whose id is divisible by 50 is a query.
_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, {0})"


def _clusters(spark, d):
    got = centroids.clusters(centroids.by_label(read_table(spark, d, "embeddings"), "label", "embedding"))
    return got


def _asked(spark, d):
    """(query_id, vector)"""
    return read_table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _asked_documents(spark, d):
    """Five embeddings make a document, see _index; every tenth document asks with all its chunks: (query_id, chunk, vector)."""
    e = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc"), (F.col("vec_id") % 5).cast("int").alias("chunk"), F.col("embedding").alias("vector"))
    return e.where("doc % 10 = 0").select((F.col("doc") * 5).alias("query_id"), "chunk", "vector")


@query(f"WITH {_CENT} SELECT vec_id, cluster_id FROM near WHERE rank = 1")
def assign_cluster(spark, d):
    return exact.nearest_centroids(read_table(spark, d, "embeddings"), "vec_id", "embedding", _clusters(spark, d)).select("vec_id", "cluster_id")


@query(f"WITH {_CENT} SELECT vec_id, rank, cluster_id FROM near WHERE rank <= 3")
def probe_topn(spark, d):
    return exact.nearest_centroids(read_table(spark, d, "embeddings"), "vec_id", "embedding", _clusters(spark, d), 3).select("vec_id", F.col("rank").cast("bigint").alias("rank"), "cluster_id")


@query(f"WITH {_Q}, s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings, q) SELECT query_id, rank, vec_id, round(s, 5) AS score FROM (SELECT *, {_RANK.format('vec_id')} AS rank FROM s) WHERE rank <= 10")
def exact_topk(spark, d):
    got = exact.top_k_each(read_table(spark, d, "embeddings"), "vec_id", "embedding", _asked(spark, d), 10)
    return got.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 5).alias("score"))


@query(f"WITH {_Q}, s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE label = 3) SELECT query_id, rank, vec_id FROM (SELECT *, {_RANK.format('vec_id')} AS rank FROM s) WHERE rank <= 10")
def filtered_topk_semi(spark, d):
    e = read_table(spark, d, "embeddings")
    got = exact.top_k_each(e, "vec_id", "embedding", _asked(spark, d), 10, match(e, "label = 3", {"label": "int"}))
    return got.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id")


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 100000) AS BIGINT)) AS u FROM embeddings")
def l2_normalise(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.transform(fv.l2_normalise(F.col("embedding")), lambda x: F.round(x * 100_000).cast("bigint")).alias("u"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE - list_min(embedding)::DOUBLE) / ((list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 15) + 0.5) AS INTEGER)) AS levels FROM embeddings""")
def grid_quantise(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", fv.grid_quantise(F.col("embedding"), 4).alias("levels"))


@query(f"WITH {_CENT} SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] - c[i] >= 0 THEN 1 ELSE 0 END) AS bits FROM near WHERE rank = 1")
def residual_sign_code(spark, d):
    e, c = read_table(spark, d, "embeddings"), _double_clusters(spark, d)
    at = exact.with_centroid(e, "embedding", exact.nearest_centroids(e, "vec_id", "embedding", c), c, "vec_id")
    return at.select("vec_id", fv.sign_code(fv.residual(F.col("embedding"), F.col("centroid"))).alias("bits"))


def _double_clusters(spark, d):
    """Centroids without the rounding to single precision that stored ones have."""
    rows = sorted((r[0], r[1]) for r in centroids.by_label(read_table(spark, d, "embeddings"), "label", "embedding").collect())
    return centroids.Clusters(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64))


@query(
    f"""WITH {_CENT}, {_Q}, r AS (SELECT vec_id, c, list_transform(range(1, len(v) + 1), lambda i: v[i] - c[i]) AS r FROM near WHERE rank = 1),
    n AS (SELECT vec_id, c, r, list_inner_product(r, r) / list_sum(list_transform(r, lambda x: abs(x))) AS f FROM r),
    s AS (SELECT query_id, vec_id, list_inner_product(c, q) + f * list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] >= 0 THEN q[i] ELSE -q[i] END)) AS s FROM n, q)
    SELECT query_id, rank, vec_id, round(s, 3) AS estimate FROM (SELECT *, {_RANK.format('vec_id')} AS rank FROM s) WHERE rank <= 10"""
)
def rabitq1_estimate_topk(spark, d):
    """One-bit entries of all embeddings, each a document of its own, scored for every query with all clusters probed."""
    c = _clusters(spark, d)
    config = search.Config(dimension=c.dimension, n_probes=len(c.ids))
    one = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("part"), "embedding")
    got = search.first_pass_each(search.quantise(one, c, config), c, _asked(spark, d).withColumn("chunk", F.lit(0)), config, k=10)
    return got.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("doc").alias("vec_id"), F.round("score", 3).alias("estimate"))


@query("""WITH q AS (SELECT vec_id // 5 * 5 AS query_id, vec_id % 5 AS chunk, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id // 5 % 10 = 0),
    m AS (SELECT e.vec_id // 5 AS doc_id, query_id, chunk, max(list_inner_product(embedding::DOUBLE[], q)) AS m FROM embeddings e, q GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(m) AS s FROM m GROUP BY ALL)
    SELECT query_id, rank, doc_id, round(s, 4) AS score FROM (SELECT *, """ + _RANK.format("doc_id") + """ AS rank FROM s) WHERE rank <= 15""")
def maxsim_rank(spark, d):
    e = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), "embedding")
    got = exact.max_sim_each(e, "doc_id", "embedding", _asked_documents(spark, d), 15)
    return got.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def _index(spark, d, c, config):
    """Each five embeddings are the chunks of one document, their first one stands for the whole."""
    e = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("p"), "embedding")
    parts = e.select("doc_id", (F.col("p") + 1).alias("part"), "embedding").unionByName(e.where("p = 0").select("doc_id", F.lit(0).alias("part"), "embedding"))
    return Table(search.quantise(parts, c, config), "entries").df


@query("SELECT count(*) AS n_pairs, true AS bound_held, true AS close FROM (SELECT DISTINCT vec_id // 5 AS doc_id FROM embeddings) d, (SELECT DISTINCT vec_id // 5 FROM embeddings WHERE vec_id // 5 % 10 = 0) q")
def rabitq8_bound(spark, d):
    """Multi-bit estimates of every query and document against exact dot products: at least 90 % within the bound for the query's length (it is 1.9 standard deviations, about 94 %), none off by more than 0.02."""
    c = _clusters(spark, d)
    config = search.Config(dimension=c.dimension)
    dense = _asked_documents(spark, d).where("chunk = 0").select("query_id", "vector")
    docs = read_table(spark, d, "embeddings").where("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), "embedding")
    n = docs.count()
    true = exact.top_k_each(docs, "doc_id", "embedding", dense, n)  # a report of all pairs, for the comparison only
    got = search.second_pass_each(_index(spark, d, c, config), c, true, dense, config).join(true, ["query_id", "doc_id"])
    got = got.join(dense.select("query_id", F.sqrt(fv.dot(F.col("vector"), F.col("vector"))).alias("length")), "query_id")
    off = F.abs(F.col("dot_product") - F.col("score"))
    return got.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count_if(off <= F.col("error_bound") * F.col("length")) >= 0.9 * F.count(F.lit(1))).alias("bound_held"), (F.max(off) <= 0.02).alias("close"))


def _searched(spark, d, allowed=None):
    c = _clusters(spark, d)
    config = search.Config(dimension=c.dimension, top_k=10)
    sparse = _asked_documents(spark, d)
    return search.search_each(_index(spark, d, c, config), c, sparse, sparse.where("chunk = 0").select("query_id", "vector"), config, allowed)


def _label_documents(spark, d):
    rows = read_table(spark, d, "embeddings").where(compile_predicate("label IN (1, 3)", {"label": "int"}))
    return rows.select(F.floor(F.col("vec_id") / 5).alias("doc_id")).distinct()


@query()
def two_pass_search(spark, d):
    return _searched(spark, d).select("query_id", "rank", "doc_id", "dot_product", "error_bound")


@query()
def two_pass_search_filtered(spark, d):
    return _searched(spark, d, _label_documents(spark, d)).select("query_id", "rank", "doc_id", "dot_product", "error_bound")


_RECALL = "SELECT count(*) AS n_queries, true AS recall_95 FROM (SELECT DISTINCT vec_id // 5 FROM embeddings WHERE vec_id // 5 % 10 = 0)"


def _recall(spark, d, got, allowed=None):
    """(n_queries, recall_95): whether at least 95 % of the exact ten best documents of all queries were found."""
    docs = read_table(spark, d, "embeddings").where("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), "embedding")
    true = exact.top_k_each(docs, "doc_id", "embedding", _asked_documents(spark, d).where("chunk = 0").select("query_id", "vector"), 10, allowed)
    both = true.select("query_id", "doc_id").join(got.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_95"))


@query(_RECALL)
def two_pass_recall(spark, d):
    return _recall(spark, d, _searched(spark, d))


@query(_RECALL)
def two_pass_recall_filtered(spark, d):
    ok = _label_documents(spark, d)
    return _recall(spark, d, _searched(spark, d, ok), ok)


@query(
    """WITH one AS (SELECT DISTINCT vec_id, quantisation_style, packed_vector, number_of_bits, cluster_id, addition_factor, scaling_factor, error_bound FROM vector_index)
    SELECT quantisation_style AS style, count(*) AS n_entries, count(*) FILTER (NOT coalesce(quantisation_style = 'MultiBit' AND number_of_bits = 8 AND len(list_filter(packed_vector, lambda x: x IS NOT NULL)) = 16
    AND cluster_id IN (SELECT cluster_id FROM clusters) AND addition_factor IS NOT NULL AND scaling_factor IS NOT NULL AND error_bound IS NOT NULL, false)) AS n_corrupt FROM one GROUP BY 1"""
)
def search_corruption(spark, d):
    """Entries of the packed vector table that can't be scored: (style, n_entries, n_corrupt)."""
    c = centroids.clusters(read_table(spark, d, "clusters").select("cluster_id", "centroid"))
    words = F.transform(F.filter("packed_vector", lambda x: x.isNotNull()), lambda x: F.lpad(F.hex(x), 16, "0"))
    e = read_table(spark, d, "vector_index").select(
        F.col("vec_id").alias("doc_id"), F.lit(0).alias("part"), "cluster_id", F.col("quantisation_style").alias("style"), F.col("number_of_bits").alias("bits"), F.col("addition_factor").alias("add"),
        F.col("scaling_factor").alias("scale"), F.col("error_bound").alias("err"), F.unhex(F.array_join(words, "")).alias("code"),
    ).distinct()
    return search.corrupt(e, c, search.Config(dimension=c.dimension, dense_bits=8))


def _texts(spark, d):
    """Live queue entries with text: (doc_id, text)"""
    live = queue.deduplicated(read_table(spark, d, "embed_queue"))
    return live.where("trim(text) <> ''").select(F.col("queue_id").alias("doc_id"), "text")


def _embedded(spark, d):
    """All live queue texts chunked, embedded by the test embedder and quantised against random centroids; every text whose id is divisible by 50 is searched for."""
    config = search.Config(dimension=32, n_probes=4, first_pass=200, top_k=10)
    rng = np.random.default_rng(1).standard_normal((16, 32))
    c = centroids.Clusters(np.arange(1, 17), rng / np.linalg.norm(rng, axis=1)[:, None])
    embed = hash_embedder(32)
    vectors = Table(embed_column(search.document_parts(_texts(spark, d), config), "payload", embed, 32), "vectors").df
    asked = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("part").alias("chunk"), F.col("embedding").alias("vector"))
    entries = Table(search.quantise(vectors, c, config), "entries").df
    return search.search_each(entries, c, asked.where("chunk > 0"), asked.where("chunk = 0").drop("chunk"), config)


@query()
def embed_and_search(spark, d):
    return _embedded(spark, d)


# Embedding queue

_LIVE = "live AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY namespace, doc_key ORDER BY enqueued_at DESC NULLS LAST, queue_id DESC) AS r FROM embed_queue) WHERE r = 1)"


@query(f"WITH {_LIVE} SELECT queue_id, namespace, doc_key, retry_count FROM live")
def queue_dedup(spark, d):
    return queue.deduplicated(read_table(spark, d, "embed_queue")).select("queue_id", "namespace", "doc_key", "retry_count")


@query(f"WITH {_LIVE} SELECT namespace, count(*) FILTER (coalesce(retry_count, 0) < 5) AS actionable, count(*) FILTER (coalesce(retry_count, 0) >= 5) AS exhausted FROM live GROUP BY namespace")
def queue_summary(spark, d):
    return queue.summary(queue.deduplicated(read_table(spark, d, "embed_queue")))


@query("SELECT queue_id, namespace, retry_count FROM embed_queue WHERE retry_count > 0 AND namespace = 'jobs'")
def queue_retried(spark, d):
    return queue.retried(read_table(spark, d, "embed_queue"), "jobs").select("queue_id", "namespace", "retry_count")


@query("SELECT queue_id, CASE WHEN namespace = 'jobs' THEN 0 ELSE retry_count END AS retry_count, CASE WHEN namespace IS DISTINCT FROM 'jobs' THEN last_error END AS last_error FROM embed_queue")
def queue_reset(spark, d):
    return queue.reset(read_table(spark, d, "embed_queue"), "jobs").select("queue_id", "retry_count", "last_error")


@query("SELECT queue_id FROM embed_queue WHERE namespace IS DISTINCT FROM 'documents'")
def queue_delete_all(spark, d):
    return queue.without(read_table(spark, d, "embed_queue"), "documents").select("queue_id")


@query(
    f"""WITH {_LIVE}, asked AS (SELECT queue_id FROM live WHERE trim(text) <> '' AND queue_id % 50 = 0)
    SELECT count(*) AS n_queries, count(*) AS n_first FROM asked"""
)
def embed_finds_itself(spark, d):
    """How many texts asked for come first, or with the score of the first, among all texts."""
    got = _embedded(spark, d)
    texts = _texts(spark, d)
    same = got.join(texts.select(F.col("doc_id").alias("query_id"), F.col("text").alias("asked")), "query_id").join(texts, "doc_id")
    own = same.where("text = asked").groupBy("query_id").agg(F.min("rank").alias("r"))
    n = texts.where("doc_id % 50 = 0").agg(F.count(F.lit(1)).alias("n_queries"))
    return n.crossJoin(own.agg(F.count_if(F.col("r") == 1).alias("n_first")))  # one row each


@query(f"WITH {_LIVE} SELECT queue_id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY enqueued_at NULLS FIRST, queue_id) AS turn FROM live WHERE coalesce(retry_count, 0) < 5")
def queue_turns(spark, d):
    return queue.in_turn(queue.deduplicated(read_table(spark, d, "embed_queue"))).select("queue_id", "namespace", "turn")


@query()
def queue_stream(spark, d):
    """Queued entries worked off by the streaming worker: (queue_id, n_chars) as it wrote them."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    src = read_table(spark, d, "embed_queue")
    src.select("queue_id", "namespace", "doc_key", "text", "retry_count", "last_error", "enqueued_at").write.parquet(f"{root}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{root}/in").schema.fields)

    def handle(batch: DataFrame) -> None:
        batch.select("queue_id", F.length("text").alias("n_chars")).write.mode("append").parquet(f"{root}/out")

    q = queue.run_worker(spark, f"{root}/in", schema, f"{root}/checkpoint", handle, f"{root}/retry")
    q.awaitTermination()
    return spark.read.schema("queue_id bigint, n_chars int").parquet(f"{root}/out")


SQL["queue_stream"] = f"WITH {_LIVE} SELECT queue_id, length(text) AS n_chars FROM live WHERE coalesce(retry_count, 0) < 5"


@query(
    """SELECT d.doc_id FROM documents d WHERE trim(d.text) <> '' AND d.doc_id NOT IN (SELECT doc_id FROM vector_index WHERE doc_id IS NOT NULL)
    AND CAST(d.doc_id AS VARCHAR) NOT IN (SELECT doc_key FROM embed_queue WHERE namespace = 'documents' AND doc_key IS NOT NULL)"""
)
def reconcile_missing(spark, d):
    q = read_table(spark, d, "embed_queue").where("namespace = 'documents'").select(F.col("doc_key").try_cast("bigint").alias("doc_id"))
    return search.missing(read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "vector_index").select("doc_id"), q).select("doc_id")


@query(
    """WITH hits AS (SELECT doc_id, max(dot_product::DOUBLE) AS dot FROM query_result JOIN (SELECT DISTINCT vec_id, doc_id FROM vector_index WHERE doc_id IS NOT NULL) USING (vec_id) WHERE dot_product IS NOT NULL GROUP BY doc_id),
    page AS (SELECT * FROM hits ORDER BY dot DESC, doc_id LIMIT 40 OFFSET 40) SELECT doc_id, source, round(dot, 5) AS dot_product FROM page JOIN documents USING (doc_id)"""
)
def hydrate(spark, d):
    """The best stored answer of each document; documents of the second page of forty."""
    of = read_table(spark, d, "vector_index").where("doc_id is not null").select("vec_id", "doc_id").distinct()
    hits = read_table(spark, d, "query_result").where("dot_product is not null").join(of, "vec_id").groupBy("doc_id").agg(F.max(F.col("dot_product").cast("double")).alias("dot_product"))
    got = search.hydrated(hits, read_table(spark, d, "documents").select("doc_id", "source"), 2, 40)
    return got.select("doc_id", "source", F.round("dot_product", 5).alias("dot_product"))


@query("SELECT vec_id, quantisation_style AS style FROM vector_index WHERE doc_id IS NOT NULL AND doc_id % 7 <> 0 UNION ALL SELECT -vec_id, quantisation_style FROM vector_index WHERE doc_id % 7 = 0")
def upsert_vectors(spark, d):
    v = read_table(spark, d, "vector_index").where("doc_id is not null").select("vec_id", "doc_id", F.col("quantisation_style").alias("style"))
    new = v.where("doc_id % 7 = 0").select((-F.col("vec_id")).alias("vec_id"), "doc_id", "style")
    return search.replace_vectors(v, new).select("vec_id", "style")


#: The steps of schema_round_trip as text.
_STEPS = {
    "start": '[{"attr_type": "str", "description": null, "name": "jobTitle"}], "embedding_fields": [], "indices": [{"field": "agency", "index_type": "str"}]',
    "drop_index": '[{"attr_type": "str", "description": null, "name": "jobTitle"}, {"attr_type": "str", "description": null, "name": "agency"}], "embedding_fields": [], "indices": []',
    "add_index": '[{"attr_type": "str", "description": null, "name": "jobTitle"}], "embedding_fields": [], "indices": [{"field": "agency", "index_type": "str"}]',
    "embed": '[{"attr_type": "str", "description": null, "name": "jobTitle"}, {"attr_type": "str", "description": null, "name": "summary"}], "embedding_fields": ["summary"], "indices": [{"field": "agency", "index_type": "str"}]',
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{k}' AS step, '{{"attributes": {v}, "key_type": "u64", "namespace": "jobs", "semantic_search_enabled": {'true' if k == 'embed' else 'false'}, "store_type": "doc"}}' AS schema""" for k, v in _STEPS.items()
    )
)
def schema_round_trip(spark, d):
    """A store's schema through its amendments, exported after each: (step, schema)."""
    e = engine_queries.engine(spark)
    e.create_store(DocSchema("jobs", "u64", (Attribute("jobTitle", "str"),), (Index("agency", "str"),)))
    out = [("start", e.export_schema("jobs"))]
    for step, change in (("drop_index", ("drop_index", "agency")), ("add_index", ("add_index", "agency", "str")), ("embed", ("add_embedding_attribute", "summary"))):
        e.amend("jobs", *change)
        out.append((step, e.export_schema("jobs")))
    return spark.createDataFrame([(n, json.dumps(json.loads(x), sort_keys=True)) for n, x in out], "step string, schema string")


@query("SELECT CASE WHEN dense THEN 'MultiBit' ELSE 'SingleBit' END AS style, CASE WHEN dense THEN 8 ELSE 1 END AS bits, count(*) AS n, CASE WHEN dense THEN any_value(len(embedding)) ELSE (any_value(len(embedding)) + 63) // 64 * 8 END AS code_bytes FROM (SELECT embedding, false AS dense FROM embeddings UNION ALL SELECT embedding, true FROM embeddings WHERE vec_id % 5 = 0) GROUP BY dense")
def quantise_golden(spark, d):
    """Entries of all documents, made of five embeddings each: (style, bits, n, code_bytes)."""
    c = _clusters(spark, d)
    e = _index(spark, d, c, search.Config(dimension=c.dimension))
    return e.groupBy("style", "bits").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("code")).cast("bigint").alias("code_bytes"))
