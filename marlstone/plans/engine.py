"""Stores on a folder of Parquet change logs, with one method for each thing a user can ask."""

from __future__ import annotations

import asyncio
import json
import time
import tomllib
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import keys
from marlstone.functions.fields import field, variant
from marlstone.functions.text import embedding_text
from marlstone.operators import changelog as cl
from marlstone.operators import scans, search
from marlstone.plans.files import Files, Folders
from marlstone.plans.schema import RESERVED, DocSchema, KvSchema, RawSchema, SchemaError, from_json, imported
from marlstone.predicate import compile_predicate
from marlstone.runtime import Table, scratch, ship
from marlstone.sources import jsonl
from marlstone.sources.centroids import Clusters, read_centroids
from marlstone.sources.embedder import Embedder, embed_column, http_embedder, probe
from marlstone.streaming import queue as q

Schema = DocSchema | KvSchema | RawSchema
QUEUE = "doc_key string, text string, retry_count int, last_error string, seq bigint, step bigint"
VECTORS = search.ENTRY.replace("doc_id bigint", "doc_id string") + ", seq bigint"
STYLES = ("SingleBit", "MultiBit")
MOST_FOLDERS = 256  # appended folders of a log after which it is compacted by the next write
MAX_RETRIES = q.MAX_RETRIES
Observer = Callable[[dict[str, Any]], None]


class ClosedError(RuntimeError):
    pass


class RunningError(RuntimeError):
    """The same job of a store is running already."""


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Engine:
    """All stores below ``root``. Sequence numbers are the nanoseconds of the writing call; of one batch the last row of a key wins.

    ``observers`` are told of the progress of long jobs: {job, namespace,
    done, total, status, error}.
    """

    def __init__(self, spark: SparkSession, root: str, clusters: Clusters | None = None, embed: Embedder | None = None, config: search.Config | None = None, observers: tuple[Observer, ...] = ()) -> None:
        ship(spark)
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        self.clusters, self.embed, self.config, self.observers = clusters, embed, config, observers
        if clusters is not None and config is not None and clusters.dimension != config.dimension:
            raise ValueError("centroids and configuration have different dimensions")
        self.closed = False
        self._cache: dict[str, tuple[float, tuple[np.ndarray, np.ndarray]]] = {}
        self._last = 0

    @classmethod
    def open(cls, spark: SparkSession, config: str | dict[str, Any], observers: tuple[Observer, ...] = ()) -> Engine:
        """An engine from settings or a TOML file of them, checked before anything is opened.

        ``[storage] root``; ``[semantic_search]`` with the fields of Config,
        ``model``, ``embedding_url`` and ``[[semantic_search.supported_models]]``
        of name, dimension and centroids (a JSON-lines file). Every listed
        model needs centroids of its dimension, and the active one must be
        listed unless none is.
        """
        if isinstance(config, str):
            files = Files(spark, config.rsplit("/", 1)[0] or "/")
            config = tomllib.loads(files.read(config))
        root = config.get("storage", {}).get("root")
        if not root:
            raise ValueError("storage.root must name a folder")
        given = dict(config.get("semantic_search", {}))
        model, url, models = given.pop("model", None), given.pop("embedding_url", None), given.pop("supported_models", [])
        known = {}
        for m in models:
            if not m.get("name") or not m.get("dimension"):
                raise ValueError("a model has a name and a dimension above 0")
            known[m["name"].lower()] = read_centroids(spark, m["centroids"], m["dimension"])
        if known and (model or "").lower() not in known:
            raise ValueError(f"model {model!r} isn't among the supported ones: {', '.join(sorted(known))}")
        clusters = known.get((model or "").lower())
        settings = search.Config(**({"dimension": clusters.dimension} if clusters is not None else {}) | given) if given or known else None
        embed = http_embedder(url, settings.dimension) if url and settings else None
        return cls(spark, root, clusters, embed, settings, observers)

    # Files

    def _open(self) -> None:
        if self.closed:
            raise ClosedError("the engine was shut down")

    def shutdown(self) -> None:
        self.closed = True

    def _path(self, *parts: str) -> str:
        return self.files.path(*parts)

    def _table(self, kind: str, ns: str) -> Folders:
        return Folders(self.files, self._path(kind, ns))

    def _seq(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _tell(self, job: str, ns: str, done: int, total: int, status: str = "running", error: str | None = None) -> None:
        for o in self.observers:
            o({"job": job, "namespace": ns, "done": done, "total": total, "status": status, "error": error})

    def _alone(self, job: str, ns: str) -> str:
        """Claim a job of a store; the caller deletes the file in the end."""
        path = self._path("running", f"{job}-{ns}")
        if not self.files.claim(path):
            raise RunningError(f"{job} of {ns} is running")
        return path

    # Stores and schemas; a schema is the newest file of its folder

    def _schema_file(self, ns: str) -> str | None:
        names = [n for n in self.files.names(self._path("schemas", ns)) if n.endswith(".json") and not n.startswith(".")]
        return self._path("schemas", ns, names[-1]) if names else None

    def stores(self) -> list[Schema]:
        self._open()
        found = [self._schema_file(n) for n in self.files.names(self._path("schemas"))]
        return [from_json(self.files.read(p)) for p in found if p]

    def schema(self, ns: str) -> Schema:
        self._open()
        path = self._schema_file(ns)
        if path is None:
            raise KeyError(f"no store {ns}")
        return from_json(self.files.read(path))

    def create_store(self, schema: Schema) -> None:
        self._open()
        if schema.namespace in RESERVED or self._schema_file(schema.namespace):
            raise SchemaError(f"{schema.namespace} is there already")
        self._save(schema)

    def drop_store(self, ns: str) -> None:
        if ns in RESERVED:
            raise SchemaError(f"{ns} can't be removed")
        self.schema(ns)
        for kind in ("schemas", "log", "vectors", "queue"):
            if self.files.exists(self._path(kind, ns)):
                self.files.delete(self._path(kind, ns))

    def _save(self, schema: Schema) -> None:
        self.files.create(self._path("schemas", schema.namespace, f"{self._seq():020d}.json"), schema.to_json())

    def amend(self, ns: str, change: str, *args: Any, **named: Any) -> DocSchema:
        """``change`` is the name of an amendment of DocSchema."""
        allowed = ("add_attribute", "remove_attribute", "update_attribute", "add_embedding_attribute", "enable_vector_index", "disable_vector_index", "add_index", "drop_index")
        if change not in allowed:
            raise SchemaError(f"no amendment {change}")
        new = getattr(self.doc_schema(ns), change)(*args, **named)
        self._save(new)
        if change == "disable_vector_index":
            self._drop_vectors(ns)
        return new

    def indices(self, ns: str) -> list[dict[str, str]]:
        s = self.doc_schema(ns)
        return [{"field": f, "kind": "attribute", "type": t} for f, t in s.indexed.items()] + [{"field": f, "kind": "vector", "type": "str"} for f in s.embedding_fields if s.semantic_search_enabled]

    def drop_all_indices(self, ns: str) -> DocSchema:
        s = self.doc_schema(ns)
        for f in s.indexed:
            s = s.drop_index(f)
        self._save(s)
        return s

    def _drop_vectors(self, ns: str) -> None:
        for kind in ("vectors", "queue"):
            t = self._table(kind, ns)
            t.commit([], [p["path"] for p in t.parts()])

    def drop_vector_index(self, ns: str) -> DocSchema:
        return self.amend(ns, "disable_vector_index")

    def export_schema(self, ns: str) -> str:
        return self.schema(ns).to_json()

    def import_schema(self, text: str) -> Schema:
        s = imported(text)
        self.create_store(s)
        return s

    def doc_schema(self, ns: str) -> DocSchema:
        s = self.schema(ns)
        if not isinstance(s, DocSchema):
            raise SchemaError(f"{ns} is no document store")
        return s

    def kv_schema(self, ns: str) -> KvSchema:
        s = self.schema(ns)
        if not isinstance(s, KvSchema):
            raise SchemaError(f"{ns} is no key-value store")
        return s

    def raw_schema(self, ns: str) -> RawSchema:
        s = self.schema(ns)
        if not isinstance(s, RawSchema):
            raise SchemaError(f"{ns} is no raw namespace")
        return s

    # Change log

    def _log_schema(self, s: Schema) -> str:
        value = "doc string" if isinstance(s, DocSchema) else "value binary" if isinstance(s, RawSchema) else f"value {s.spark_value}"
        key = {"str": "string", "int": "bigint"}[s.key_type] if isinstance(s, KvSchema) else "binary"
        return f"key {key}, seq bigint, epoch_ms bigint, op string, {value}"

    def _stale(self, s: Schema, part: dict[str, Any]) -> list[str]:
        """Declared fields, with their type, that a folder was written without."""
        return [n for n, t in s.declared.items() if f"{n}:{t}" not in part["fields"]] if isinstance(s, DocSchema) else []

    def log(self, ns: str) -> DataFrame:
        """All changes; documents come with typed columns of the declared fields, from the files if they were written with them, else from the document."""
        s = self.schema(ns)
        base = self._log_schema(s)
        declared = s.declared if isinstance(s, DocSchema) else {}
        typed = "".join(f", `{n}` {_SPARK[t]}" for n, t in declared.items())
        by: dict[tuple[str, ...], list[str]] = {}
        for p in self._table("log", ns).parts():
            by.setdefault(tuple(self._stale(s, p)), []).append(p["path"])
        if not by:
            return self.spark.createDataFrame([], base + typed)
        frames = []
        for stale, paths in by.items():
            there = "".join(f", `{n}` {_SPARK[t]}" for n, t in declared.items() if n not in stale)
            df = self.spark.read.schema(base + there).parquet(*paths)
            v = variant(F.col("doc")) if stale else None
            frames.append(df.withColumns({n: field(v, n, declared[n]) for n in stale}).select(*_columns(base), *[f"`{n}`" for n in declared]))
        return reduce(DataFrame.unionByName, frames)

    def _fields(self, s: Schema) -> list[str]:
        return [f"{n}:{t}" for n, t in s.declared.items()] if isinstance(s, DocSchema) else []

    def _append(self, s: Schema, rows: DataFrame) -> None:
        t = self._table("log", s.namespace)
        t.append(s.with_fields(rows) if isinstance(s, DocSchema) else rows, self._fields(s))
        if sum(not p["compact"] for p in t.parts()) > MOST_FOLDERS:
            self.compact(s.namespace)

    def table(self, ns: str) -> DataFrame:
        return cl.live(self.log(ns))

    def compact(self, ns: str) -> None:
        """The log as it is now, rewritten to what counts, with all declared fields as columns, sorted by key for pruning.

        The new folder takes the place of those it was made from in one commit:
        a crash before it changes nothing, and what is put meanwhile stays.
        """
        s = self.schema(ns)
        t = self._table("log", ns)
        old = [p["path"] for p in t.parts()]
        if old:
            new = t.write(cl.compacted(self.log(ns)).repartitionByRange("key").sortWithinPartitions("key"), self._fields(s), compact=True)
            t.commit([new], old)

    def build_index(self, ns: str) -> int:
        """Give folders written before an amendment the declared fields as columns, one folder after another; returns how many were rebuilt.

        New writes have them at once. What was done is committed folder by
        folder, so a build that was cut off goes on where it was.
        """
        s = self.doc_schema(ns)
        claim = self._alone("index", ns)
        try:
            t = self._table("log", ns)
            stale = [p for p in t.parts() if self._stale(s, p)]
            base = self._log_schema(s)
            for i, p in enumerate(stale):
                rows = self.spark.read.schema(base).parquet(p["path"])
                t.commit([t.write(s.with_fields(rows), self._fields(s), compact=p["compact"])], [p["path"]])
                self._tell("index", ns, i + 1, len(stale))
            self._tell("index", ns, len(stale), len(stale), "done")
            return len(stale)
        except Exception as e:
            self._tell("index", ns, 0, 0, "failed", str(e)[:300])
            raise
        finally:
            self.files.delete(claim)

    reindex_attributes = build_index

    def reindex_document(self, ns: str, doc_id: str | int) -> str:
        """Derive the fields of one document anew: ``indexed`` or ``missing``."""
        s = self.doc_schema(ns)
        row = cl.live(scans.point_get(self.log(ns), "key", bytearray(self.key(ns, doc_id)))).select("key", "epoch_ms", "doc").collect()
        if not row:
            return "missing"
        again = self.spark.createDataFrame([(row[0]["key"], self._seq(), row[0]["epoch_ms"], cl.PUT, row[0]["doc"])], self._log_schema(s))
        self._append(s, again)
        return "indexed"

    def index_progress(self, ns: str | None = None) -> dict[str, dict[str, int]]:
        """Folders that have all declared fields as columns, and all folders, of one store or of all."""
        out = {}
        for s in self.stores():
            if isinstance(s, DocSchema) and ns in (None, s.namespace):
                parts = self._table("log", s.namespace).parts()
                out[s.namespace] = {"done": sum(not self._stale(s, p) for p in parts), "total": len(parts)}
        return out

    def sweep(self, ns: str, ttl_ms: int | None = None, now_ms: int | None = None, at_most: int | None = None) -> None:
        """Delete what has reached the time to live, a raw namespace's own by default."""
        s = self.schema(ns)
        if isinstance(s, RawSchema):
            ttl_ms, at_most = s.ttl_ms if ttl_ms is None else ttl_ms, at_most or s.most_deletes
        if ttl_ms is None:
            return
        now = int(time.time() * 1000) if now_ms is None else now_ms
        rows = cl.sweep(self.log(ns), ttl_ms, now, self._seq(), at_most)
        self._table("log", ns).append(rows, self._fields(s))

    def sweep_all(self, now_ms: int | None = None) -> None:
        for s in self.stores():
            if isinstance(s, RawSchema):
                self.sweep(s.namespace, None, now_ms)

    def clean(self, ns: str, older_ms: int = 3_600_000) -> int:
        """Reclaim the disk of replaced folders."""
        self.schema(ns)
        return sum(self._table(kind, ns).clean(older_ms) for kind in ("log", "vectors", "queue") if self.files.exists(self._path(kind, ns)))

    def row_count(self, ns: str) -> int:
        """Live rows; only keys and sequence numbers are read."""
        return cl.live(self.log(ns).select("key", "seq", "op")).count()

    def metrics(self, ns: str) -> DataFrame:
        return cl.counters(self.log(ns).select(*_columns(self._log_schema(self.schema(ns)))[:4])).withColumn("namespace", F.lit(ns))

    def all_metrics(self) -> DataFrame | None:
        """Counters of each store and, under the null namespace, of all together."""
        each = [self.metrics(s.namespace) for s in self.stores()]
        return cl.summed(reduce(DataFrame.unionByName, each)) if each else None

    def storage(self, ns: str) -> list[dict[str, Any]]:
        """Folders of a store: table, folder, files, bytes, whether compact, fields written as columns."""
        self.schema(ns)
        return [{"table": kind, **f} for kind in ("log", "vectors", "queue") for f in self._table(kind, ns).storage()]

    def stats(self) -> dict[str, dict[str, Any]]:
        """Of each store: kind, live rows, files, bytes, share of log entries that no longer count, queued texts."""
        out = {}
        for s in self.stores():
            m, f = self.metrics(s.namespace).first(), self.storage(s.namespace)
            out[s.namespace] = {"kind": s.store_type, "rows": m["live"], "entries": m["entries"], "waste": m["waste"], "files": sum(x["files"] for x in f), "bytes": sum(x["bytes"] for x in f)}
        return out

    def health(self) -> dict[str, Any]:
        return {"open": not self.closed, "stores": len(self.files.names(self._path("schemas")))}

    # Documents

    def put_documents(self, ns: str, docs: DataFrame, wal: bool = True, epoch_ms: int | None = None) -> None:
        """Upsert (key, doc); any bad document fails the batch before anything is written. ``wal`` has no effect here.

        The input is evaluated once; log and queue are made from what was written.
        """
        s = self.doc_schema(ns)
        with scratch():
            given = Table(docs.select("key", "doc", F.monotonically_increasing_id().alias("i")), "put").df
            bad = given.select(s.problem(F.col("doc")).alias("p"), F.col("key").isNull().alias("k")).where("p is not null or k").limit(1).collect()
            if bad:
                raise SchemaError(bad[0][0] or "a key is null")
            last = given.groupBy("key").agg(F.max_by("doc", "i").alias("doc"))
            seq, ms = self._seq(), epoch_ms if epoch_ms is not None else int(time.time() * 1000)
            self._append(s, last.select("key", F.lit(seq).alias("seq"), F.lit(ms).cast("bigint").alias("epoch_ms"), F.lit(cl.PUT).alias("op"), "doc"))
            if s.semantic_search_enabled:
                self._enqueue(ns, s.with_fields(last).select(F.hex("key").alias("doc_key"), embedding_text(list(s.embedding_fields)).alias("text")), seq)

    def put(self, ns: str, doc_id: str | int, doc: dict | str) -> None:
        self.put_many(ns, {doc_id: doc})

    def put_many(self, ns: str, docs: dict[str | int, dict | str]) -> None:
        """Many documents in one job and one folder."""
        rows = [(bytearray(self.key(ns, i)), d if isinstance(d, str) else json.dumps(d)) for i, d in docs.items()]
        self.put_documents(ns, self.spark.createDataFrame(rows, "key binary, doc string"))

    def key(self, ns: str, doc_id: str | int) -> bytes:
        return keys.key_bytes(self.doc_schema(ns).key_type, doc_id)

    def delete(self, ns: str, doc_id: str | int) -> None:
        """Vectors and queue entry go first, as appended marks; a missing document is no error."""
        s, key = self.doc_schema(ns), self.key(ns, doc_id)
        if s.semantic_search_enabled:
            self._forget(ns, key.hex().upper())
        row = self.spark.createDataFrame([(bytearray(key), self._seq(), int(time.time() * 1000), cl.DELETE, None)], self._log_schema(s))
        self._append(s, row)

    def get(self, ns: str, doc_id: str | int) -> dict | None:
        got = cl.live(scans.point_get(self.log(ns), "key", bytearray(self.key(ns, doc_id)))).select("doc").collect()
        return json.loads(got[0][0]) if got else None

    def multi_get(self, ns: str, ids: list[str | int]) -> list[dict | None]:
        """In the order asked; missing documents and ids that can't be read are None."""
        raw = []
        for i in ids:
            try:
                raw.append(self.key(ns, i))
            except ValueError:
                raw.append(None)
        wanted = [bytearray(k) for k in raw if k is not None]
        rows = cl.live(self.log(ns).where(F.col("key").isin(wanted))).select("key", "doc").collect() if wanted else []
        by = {bytes(r[0]): json.loads(r[1]) for r in rows}
        return [by.get(k) if k is not None else None for k in raw]

    def range(self, ns: str, start: str | int | None = None, end: str | int | None = None, limit: int = 20, cursor: str | None = None) -> dict:
        page = scans.cursor_page(self.table(ns), "key", limit, *[bytearray(x) if x is not None else None for x in (keys.from_cursor(cursor) if cursor else None, self.key(ns, start) if start is not None else None, self.key(ns, end) if end is not None else None)])
        return self._doc_page(ns, page)

    def prefix(self, ns: str, hex_prefix: str, limit: int = 20, cursor: str | None = None) -> dict:
        page = scans.prefix_page(self.table(ns), "key", keys.from_cursor(hex_prefix), limit, keys.from_cursor(cursor) if cursor else None)
        return self._doc_page(ns, page)

    def _doc_page(self, ns: str, page: scans.CursorPage) -> dict:
        kind = self.doc_schema(ns).key_type
        return {"results": [{"id": keys.key_json(kind, r["key"]), "document": json.loads(r["doc"])} for r in page.rows], "next_cursor": keys.to_cursor(page.next_cursor) if page.next_cursor is not None else None}

    def keys(self, ns: str) -> DataFrame:
        """(key) of all live rows, in order."""
        return cl.live(self.log(ns).select("key", "seq", "op")).select("key").orderBy("key")

    def query_frame(self, ns: str, predicate: str) -> DataFrame:
        """Matching rows; the predicate is checked before anything is read, and the latest version of a row decides."""
        s = self.doc_schema(ns)
        return self.table(ns).where(compile_predicate(predicate, s.indexed))

    def query_keys(self, ns: str, predicate: str) -> DataFrame:
        return self._matching(self.doc_schema(ns), predicate).orderBy("key")

    def query(self, ns: str, predicate: str, page_no: int = 1, page_size: int = 20) -> dict:
        """A page of matching documents and the exact total.

        Rows are resolved, filtered and ordered on keys and indexed fields
        alone, in one pass that is written; documents are fetched for the
        page's keys.
        """
        s = self.doc_schema(ns)
        skip, size = scans.window_of(page_no, page_size)
        with scratch():
            hits = Table(self._matching(s, predicate), "hits").df
            total = hits.count()
            page = [r[0] for r in hits.orderBy("key").offset(skip).limit(size).collect()] if skip < total else []
        docs = cl.live(self.log(ns).select("key", "seq", "op", "doc").where(F.col("key").isin(page))).orderBy("key").collect() if page else []
        return {"results": [{"id": keys.key_json(s.key_type, r["key"]), "document": json.loads(r["doc"])} for r in docs], "page_no": max(1, page_no), "page_size": size, "total": total}

    def _matching(self, s: DocSchema, predicate: str) -> DataFrame:
        """(key) of matching rows, from narrow columns."""
        match = compile_predicate(predicate, s.indexed)
        return cl.live(self.log(s.namespace).select("key", "seq", "op", *[f"`{n}`" for n in s.indexed])).where(match).select("key")

    def load_documents(self, ns: str, path: str, id_field: str, errors: str | None = None) -> dict[str, int]:
        """JSON lines into a store; rejects go to ``errors`` (default: beside the input)."""
        s = self.doc_schema(ns)
        good, bad = jsonl.split_documents(jsonl.lines(self.spark, path), id_field, s.key_type, s.declared)
        jsonl.write_rejects(bad, errors or f"{path}.errors")
        self.put_documents(ns, good)
        return jsonl.summary(good, bad)

    def load_values(self, ns: str, path: str, key_field: str = "key", value_field: str = "value", errors: str | None = None) -> dict[str, int]:
        s = self.kv_schema(ns)
        good, bad = jsonl.split_values(jsonl.lines(self.spark, path), key_field, value_field, s.key_type, s.value_type)
        jsonl.write_rejects(bad, errors or f"{path}.errors")
        self._put_values(s, good)
        return jsonl.summary(good, bad)

    # Key-value stores

    def _kv_key(self, s: KvSchema, key: Any) -> Any:
        return int(key) if s.key_type == "int" else str(key)

    def _put_values(self, s: KvSchema, rows: DataFrame) -> None:
        with scratch():
            given = Table(rows.select("key", "value", F.monotonically_increasing_id().alias("i")), "put").df
            last = given.groupBy("key").agg(F.max_by("value", "i").alias("value"))
            seq = self._seq()
            self._append(s, last.select("key", F.lit(seq).alias("seq"), F.lit(int(time.time() * 1000)).cast("bigint").alias("epoch_ms"), F.lit(cl.PUT).alias("op"), "value"))
            if s.semantic_search_enabled:
                self._enqueue(s.namespace, last.select(F.col("key").cast("string").alias("doc_key"), F.col("value").alias("text")), seq)

    def put_values(self, ns: str, rows: DataFrame) -> None:
        """Upsert (key, value) rows."""
        s = self.kv_schema(ns)
        if rows.where("key is null or value is null").limit(1).count():
            raise SchemaError("a key or value is null")
        self._put_values(s, rows)

    def kv_put(self, ns: str, key: Any, value: Any) -> None:
        s = self.kv_schema(ns)
        kind = "string" if s.key_type == "str" else "bigint"
        self._put_values(s, self.spark.createDataFrame([(self._kv_key(s, key), s.check_value(value))], f"key {kind}, value {s.spark_value}"))

    def kv_get(self, ns: str, key: Any) -> Any:
        s = self.kv_schema(ns)
        got = cl.live(scans.point_get(self.log(ns), "key", self._kv_key(s, key))).select("value").collect()
        return got[0][0] if got else None

    def kv_delete(self, ns: str, key: Any) -> None:
        s = self.kv_schema(ns)
        if s.semantic_search_enabled:
            self._forget(ns, str(key))
        self._append(s, self.spark.createDataFrame([(self._kv_key(s, key), self._seq(), int(time.time() * 1000), cl.DELETE, None)], self._log_schema(s)))

    def kv_range(self, ns: str, start: Any = None, end: Any = None, limit: int = 20, cursor: Any = None) -> scans.CursorPage:
        s = self.kv_schema(ns)
        return scans.cursor_page(self.table(ns), "key", limit, *[self._kv_key(s, x) if x is not None else None for x in (cursor, start, end)])

    def kv_prefix(self, ns: str, prefix: Any, limit: int = 20, cursor: Any = None) -> scans.CursorPage:
        """Text keys by prefix; of an integer key the prefix is the whole key."""
        s = self.kv_schema(ns)
        p = self._kv_key(s, prefix)
        table = self.table(ns)
        hit = scans.prefix_scan(table, "key", p) if s.key_type == "str" else scans.point_get(table, "key", p)
        return scans.cursor_page(hit, "key", limit, cursor)

    # Raw namespaces: bytes under bytes

    def raw_namespace(self, ns: str, ttl_ms: int | None = None, most_deletes: int | None = None) -> RawSchema:
        """Get or create."""
        if self._schema_file(ns) is None:
            self.create_store(RawSchema(ns, ttl_ms, most_deletes))
        return self.raw_schema(ns)

    def raw_put(self, ns: str, key: bytes, value: bytes, epoch_ms: int | None = None) -> None:
        s = self.raw_schema(ns)
        ms = int(time.time() * 1000) if epoch_ms is None else epoch_ms
        self._append(s, self.spark.createDataFrame([(bytearray(key), self._seq(), ms, cl.PUT, bytearray(value))], self._log_schema(s)))

    def raw_put_rows(self, ns: str, rows: DataFrame) -> None:
        """Upsert (key, value, epoch_ms); keys must be unique."""
        s = self.raw_schema(ns)
        self._append(s, rows.select("key", F.lit(self._seq()).alias("seq"), F.col("epoch_ms").cast("bigint").alias("epoch_ms"), F.lit(cl.PUT).alias("op"), "value"))

    def raw_get(self, ns: str, key: bytes) -> bytes | None:
        self.raw_schema(ns)
        got = cl.live(scans.point_get(self.log(ns), "key", bytearray(key))).select("value").collect()
        return bytes(got[0][0]) if got else None

    def raw_delete(self, ns: str, key: bytes) -> None:
        s = self.raw_schema(ns)
        self._append(s, self.spark.createDataFrame([(bytearray(key), self._seq(), int(time.time() * 1000), cl.DELETE, None)], self._log_schema(s)))

    def raw_range(self, ns: str, start: bytes | None = None, end: bytes | None = None, limit: int = 20, cursor: bytes | None = None) -> scans.CursorPage:
        self.raw_schema(ns)
        return scans.cursor_page(self.table(ns), "key", limit, *[None if x is None else bytearray(x) for x in (cursor, start, end)])

    def raw_prefix(self, ns: str, prefix: bytes, limit: int = 20, cursor: bytes | None = None) -> scans.CursorPage:
        self.raw_schema(ns)
        return scans.prefix_page(self.table(ns), "key", prefix, limit, cursor)

    # Embedding queue: a log in which the latest (seq, step) of a document counts; a null text means that it is done

    def _enqueue(self, ns: str, rows: DataFrame, seq: int) -> None:
        rows = rows.where(F.trim("text") != "").select("doc_key", "text", F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"), F.lit(seq).alias("seq"), F.lit(0).cast("bigint").alias("step"))
        self._table("queue", ns).append(rows)

    def _queue_log(self, ns: str, parts: list[dict[str, Any]] | None = None) -> DataFrame:
        paths = [p["path"] for p in (self._table("queue", ns).parts() if parts is None else parts)]
        return self.spark.read.schema(QUEUE).parquet(*paths) if paths else self.spark.createDataFrame([], QUEUE)

    def queue(self, ns: str, parts: list[dict[str, Any]] | None = None) -> DataFrame:
        """Live queue entries of a store: the latest for each document; texts follow for those alone."""
        log = self._queue_log(ns, parts)
        last = log.groupBy("doc_key").agg(F.max(F.struct("seq", "step")).alias("w")).select("doc_key", "w.seq", "w.step")
        return log.where("text is not null").join(last, ["doc_key", "seq", "step"], "left_semi").select(F.lit(ns).alias("namespace"), *_columns(QUEUE))

    def _change_queue(self, ns: str, hit: DataFrame, done: bool = False, seq: int | None = None, retry: Any = 0, error: Any = None) -> None:
        """Append the next step of live entries; with ``seq`` as entries queued anew."""
        text = F.lit(None).cast("string") if done else F.col("text")
        rows = hit.select("doc_key", text.alias("text"), (retry if not isinstance(retry, int) else F.lit(retry)).cast("int").alias("retry_count"), F.lit(error).cast("string").alias("last_error"), (F.col("seq") if seq is None else F.lit(seq)).alias("seq"), F.lit(time.time_ns()).alias("step"))
        self._table("queue", ns).append(rows)

    def compact_queue(self, ns: str) -> None:
        t, claim = self._table("queue", ns), self._alone("compact-queue", ns)
        try:
            parts = t.parts()
            if parts:
                t.commit([t.write(self.queue(ns, parts).select(*_columns(QUEUE)), compact=True)], [p["path"] for p in parts])
        finally:
            self.files.delete(claim)

    def _queue_key(self, ns: str, doc_id: str | int) -> str:
        return str(doc_id) if isinstance(self.schema(ns), KvSchema) else self.key(ns, doc_id).hex().upper()

    def queue_entry(self, ns: str, doc_id: str | int) -> dict[str, Any] | None:
        got = self.queue(ns).where(F.col("doc_key") == self._queue_key(ns, doc_id)).collect()
        return got[0].asDict() if got else None

    def queue_list(self, ns: str, page_no: int = 1, page_size: int = 20, failed: bool = False) -> list[dict[str, Any]]:
        skip, size = scans.window_of(page_no, page_size)
        rows = q.retried(self.queue(ns)) if failed else self.queue(ns)
        return [r.asDict() for r in rows.orderBy("seq", "doc_key").offset(skip).limit(size).collect()]

    def queue_summary(self) -> dict[str, dict[str, int]]:
        out = {}
        for s in self.stores():
            if getattr(s, "semantic_search_enabled", False):
                got = q.summary(self.queue(s.namespace)).first()
                out[s.namespace] = {"actionable": got["actionable"] if got else 0, "exhausted": got["exhausted"] if got else 0}
        return out

    def queue_delete(self, ns: str, doc_id: str | int | None = None) -> None:
        """One entry, or all of a store."""
        rows = self.queue(ns)
        self._change_queue(ns, rows if doc_id is None else rows.where(F.col("doc_key") == self._queue_key(ns, doc_id)), done=True)

    def queue_retry(self, ns: str, doc_id: str | int | None = None) -> None:
        """Set the retries of one entry back, or of all that have used them up."""
        rows = self.queue(ns)
        hit = rows.where(F.col("retry_count") >= MAX_RETRIES) if doc_id is None else rows.where(F.col("doc_key") == self._queue_key(ns, doc_id))
        self._change_queue(ns, hit)

    # Vectors: a log in which the latest entries of a document and style count; an entry without code means that they are gone

    def vectors(self, ns: str, parts: list[dict[str, Any]] | None = None) -> DataFrame:
        """Live entries. A filter on ``cluster_id`` prunes files: versions are resolved on narrow columns beside it."""
        parts = self._table("vectors", ns).parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], VECTORS).drop("seq")
        frames = [self.spark.read.schema(VECTORS).parquet(p["path"]) for p in parts]  # one base path each, for the partition column
        df = reduce(DataFrame.unionByName, frames)
        if len(parts) > 1 or not parts[0]["compact"]:
            last = df.groupBy("doc_id", "style").agg(F.max("seq").alias("seq"))
            df = df.join(last, ["doc_id", "style", "seq"], "left_semi").where("code is not null")
        return df.select(*_columns(search.ENTRY))

    def compact_vectors(self, ns: str) -> None:
        """One folder without marks; entries keep no version, so any later change wins."""
        t, claim = self._table("vectors", ns), self._alone("compact-vectors", ns)
        try:
            parts = t.parts()
            if parts:
                rows = self.vectors(ns, parts).withColumn("seq", F.lit(0).cast("bigint"))
                t.commit([t.write(rows, compact=True, by="cluster_id")], [p["path"] for p in parts])
        finally:
            self.files.delete(claim)

    def _forget(self, ns: str, doc_key: str) -> None:
        """Marks, not rewrites: a delete costs one row for each style and one in the queue."""
        seq = self._seq()
        gone = [(doc_key, -1, None, s, None, None, None, None, None, seq) for s in STYLES]
        self._table("vectors", ns).append(self.spark.createDataFrame(gone, VECTORS), by="cluster_id")
        self._table("queue", ns).append(self.spark.createDataFrame([(doc_key, None, 0, None, seq, time.time_ns())], QUEUE))

    def _ready(self) -> None:
        if self.clusters is None or self.embed is None or self.config is None:
            raise SchemaError("the engine has no centroids, embedder or search configuration")

    def probe_embedder(self) -> float:
        """Norm of a test vector; an error if the service is down or has another dimension."""
        self._ready()
        return probe(self.embed, self.config.dimension)

    def work_queue(self, ns: str, at_most: int | None = None) -> int:
        """Embed and quantise queued texts, all or the ``at_most`` oldest; returns how many documents are done.

        Entries that have used up their retries stay parked, and what is queued
        while the job runs stays queued. A failing service leaves the texts
        queued with a higher count.
        """
        self._ready()
        with scratch():
            todo = self.queue(ns).where(F.col("retry_count") < MAX_RETRIES)
            todo = Table(todo if at_most is None else todo.orderBy("seq", "doc_key").limit(at_most), "todo").df
            n = todo.count()
            if not n:
                return 0
            try:
                parts = search.document_parts(todo.select(F.col("doc_key").alias("doc_id"), "text"), self.config)
                new = search.quantise(embed_column(parts, "payload", self.embed, self.config.dimension), self.clusters, self.config)
                new = Table(new.join(todo.select(F.col("doc_key").alias("doc_id"), "seq"), "doc_id").select(*_columns(VECTORS)), "entries").df
            except Exception as e:
                self._change_queue(ns, todo, retry=F.col("retry_count") + 1, error=str(e)[:300])
                self._tell("queue", ns, 0, n, "failed", str(e)[:300])
                return 0
            self._table("vectors", ns).append(new, by="cluster_id")
            self._change_queue(ns, todo, done=True)
            self._tell("queue", ns, n, n, "done")
            return n

    def work_all(self, turn: int = 10_000, wait_s: float = 2.0) -> int:
        """Work off the queues of all stores in turns of ``turn`` documents each, so no store delays the others, until nothing but parked entries is left."""
        done = 0
        names = [s.namespace for s in self.stores() if getattr(s, "semantic_search_enabled", False)]
        while names:
            left = []
            for ns in names:
                n = self.work_queue(ns, turn)
                done += n
                if self.queue(ns).where(F.col("retry_count") < MAX_RETRIES).limit(1).count():
                    left.append(ns)
                    if not n:
                        time.sleep(wait_s)
            names = left
        return done

    def _texts(self, ns: str, doc_id: str | int | None = None) -> DataFrame:
        """(doc_key, text) of all documents of a store, or of one."""
        s, t = self.schema(ns), self.table(ns)
        if isinstance(s, DocSchema):
            t = t if doc_id is None else scans.point_get(t, "key", bytearray(self.key(ns, doc_id)))
            return t.select(F.hex("key").alias("doc_key"), embedding_text(list(s.embedding_fields)).alias("text"))
        t = t if doc_id is None else scans.point_get(t, "key", self._kv_key(s, doc_id))
        return t.select(F.col("key").cast("string").alias("doc_key"), F.col("value").alias("text"))

    def reindex_vectors(self, ns: str, doc_id: str | int | None = None) -> int:
        """Queue all documents again, or one; returns how many. A second full run beside a running one is an error."""
        claim = self._alone("vectors", ns) if doc_id is None else None
        try:
            with scratch():
                rows = Table(self._texts(ns, doc_id).where(F.trim("text") != ""), "again").df
                self._enqueue(ns, rows, self._seq())
                return rows.count()
        finally:
            if claim:
                self.files.delete(claim)

    def reconcile(self, ns: str, validate: bool = False) -> int:
        """Queue documents that are neither embedded nor queued; returns how many.

        With ``validate`` also those whose entries can't be scored or aren't
        one dense entry and chunks. For document and key-value stores.
        """
        docs = self._texts(ns).withColumnRenamed("doc_key", "doc_id")
        have = self.vectors(ns)
        if validate:
            self._ready()
            have = have.join(search.invalid(have, self.clusters, self.config), "doc_id", "left_anti")
        with scratch():
            lost = Table(search.missing(docs, have, self.queue(ns).select(F.col("doc_key").alias("doc_id"))), "lost").df
            n = lost.count()
            if n:
                self._enqueue(ns, lost.select(F.col("doc_id").alias("doc_key"), "text"), self._seq())
        return n

    def _query_vectors(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, hit = self._cache.get(text, (0.0, None))
        if hit is None or time.time() - at > self.config.cache_ttl_s or hit[1].shape != (self.config.dimension,):
            hit = search.embed_query(text, self.embed, self.config)
            self._cache[text] = (time.time(), hit)
        return hit

    def clear_query_cache(self) -> int:
        n = len(self._cache)
        self._cache.clear()
        return n

    def hits(self, ns: str, text: str, predicate: str | None = None, top_k: int | None = None) -> DataFrame:
        self._ready()
        allowed = None if predicate is None else self._matching(self.doc_schema(ns), predicate).select(F.hex("key").alias("doc_id"))
        sparse, dense = self._query_vectors(text)
        return search.search(self.vectors(ns), self.clusters, sparse, dense, self.config, allowed, top_k)

    def semantic_search(self, ns: str, text: str, predicate: str | None = None, top_k: int | None = None, page_no: int = 1, page_size: int = 20) -> list[dict]:
        """Ranked documents; a page is cut before documents are fetched, so deleted ones shorten it."""
        s = self.schema(ns)
        t = self.table(ns)
        if isinstance(s, DocSchema):
            docs = t.select(F.hex("key").alias("doc_id"), "doc")
            rows = search.hydrated(self.hits(ns, text, predicate, top_k), docs, page_no, page_size).collect()
            return [{"id": keys.key_json(s.key_type, bytes.fromhex(r["doc_id"])), "document": json.loads(r["doc"]), "dot_product": r["dot_product"], "error_bound": r["error_bound"]} for r in rows]
        if predicate is not None:
            raise SchemaError("key-value stores have no predicates")
        rows = search.hydrated(self.hits(ns, text, None, top_k), t.select(F.col("key").cast("string").alias("doc_id"), "value"), page_no, page_size).collect()
        return [{"key": r["doc_id"], "value": r["value"], "dot_product": r["dot_product"], "error_bound": r["error_bound"]} for r in rows]

    def corruption(self, ns: str) -> DataFrame:
        self._ready()
        return search.corrupt(self.vectors(ns), self.clusters, self.config)

    def progress(self, ns: str | None = None) -> dict[str, dict[str, int]]:
        """Queued and embedded documents of one store or of all."""
        out = {}
        for s in self.stores():
            if getattr(s, "semantic_search_enabled", False) and ns in (None, s.namespace):
                out[s.namespace] = {"queued": self.queue(s.namespace).count(), "embedded": self.vectors(s.namespace).where("part = 0").count()}
        return out


class AsyncEngine:
    """Every method of an engine as a coroutine, run in a thread."""

    def __init__(self, engine: Engine) -> None:
        self._engine = engine

    def __getattr__(self, name: str) -> Any:
        f = getattr(self._engine, name)
        if not callable(f):
            return f

        async def call(*args: Any, **named: Any) -> Any:
            return await asyncio.to_thread(f, *args, **named)

        return call


class Typed:
    """A raw namespace with typed keys (u64, u128, uuid or str) and JSON values, in key order."""

    def __init__(self, engine: Engine, ns: str, key_type: str = "str", ttl_ms: int | None = None) -> None:
        self.engine, self.ns, self.kind = engine, ns, key_type
        engine.raw_namespace(ns, ttl_ms)

    def _raw(self, key: Any) -> bytes:
        return str(key).encode() if self.kind == "str" else keys.key_bytes(self.kind, key)

    def _key(self, raw: bytes) -> Any:
        return bytes(raw).decode() if self.kind == "str" else keys.key_json(self.kind, bytes(raw))

    def put(self, key: Any, value: Any) -> None:
        self.engine.raw_put(self.ns, self._raw(key), json.dumps(value).encode())

    def get(self, key: Any) -> Any:
        got = self.engine.raw_get(self.ns, self._raw(key))
        return None if got is None else json.loads(got)

    def delete(self, key: Any) -> None:
        self.engine.raw_delete(self.ns, self._raw(key))

    def _pages(self, page: Callable[..., scans.CursorPage], *args: Any):
        cursor = None
        while True:
            got = page(self.ns, *args, limit=1000, cursor=cursor)
            yield from ((self._key(r["key"]), json.loads(bytes(r["value"]))) for r in got.rows)
            if got.next_cursor is None:
                return
            cursor = bytes(got.next_cursor)

    def iter(self):
        return self._pages(self.engine.raw_range)

    def keys(self) -> DataFrame:
        return scans.keys_only(self.engine.table(self.ns), "key")

    def range(self, start: Any = None, end: Any = None):
        return self._pages(self.engine.raw_range, *[None if x is None else self._raw(x) for x in (start, end)])

    def prefix(self, prefix: str):
        return self._pages(self.engine.raw_prefix, prefix.encode() if self.kind == "str" else keys.from_cursor(prefix))


_SPARK = {"str": "string", "int": "bigint", "bool": "boolean"}
