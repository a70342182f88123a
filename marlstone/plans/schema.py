"""Declared schemas of document and key-value stores, their checks and amendments."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fields as jf
from marlstone.functions.keys import KEY_TYPES

FIELD_TYPES = ("bool", "int", "str")
VALUE_TYPES = ("int", "str", "f32", "vec_f32")
MOST_INDICES = 5
NAMESPACE = re.compile(r"[A-Za-z0-9_-]+")
RESERVED = ("default", "system")


class SchemaError(ValueError):
    pass


def _need(ok: object, message: str) -> None:
    if not ok:
        raise SchemaError(message)


@dataclass(frozen=True)
class Attribute:
    name: str
    attr_type: str
    description: str | None = None


@dataclass(frozen=True)
class Index:
    field: str
    index_type: str


@dataclass(frozen=True)
class DocSchema:
    namespace: str
    key_type: str = "uuid"
    attributes: tuple[Attribute, ...] = ()
    indices: tuple[Index, ...] = ()
    semantic_search_enabled: bool = False
    embedding_fields: tuple[str, ...] = ()
    store_type: str = field(default="doc")

    def __post_init__(self) -> None:
        _need(self.store_type == "doc", "store_type must be doc")
        _need(NAMESPACE.fullmatch(self.namespace), "a namespace has letters, digits, _ and -")
        _need(self.key_type in KEY_TYPES, f"unknown key type {self.key_type}")
        indexed = [i.field for i in self.indices]
        named = [a.name for a in self.attributes]
        _need(len(indexed) <= MOST_INDICES, f"at most {MOST_INDICES} indices")
        _need(all(indexed), "an index needs a field")
        _need(len(set(indexed)) == len(indexed), "a field is indexed twice")
        _need(all(named), "an attribute needs a name")
        _need(not set(named) & set(indexed), "a field is attribute and index")
        _need(all(i.index_type in FIELD_TYPES for i in self.indices), "unknown index type")
        _need(all(a.attr_type in FIELD_TYPES for a in self.attributes), "unknown attribute type")
        if self.semantic_search_enabled:
            _need(self.embedding_fields, "semantic search needs embedding fields")
        _need(all(self.embedding_fields), "an embedding field needs a name")
        _need(len(set(self.embedding_fields)) == len(self.embedding_fields), "an embedding field is given twice")
        _need(not set(self.embedding_fields) & set(indexed), "an embedding field is indexed")
        text = {a.name for a in self.attributes if a.attr_type == "str"}
        _need(set(self.embedding_fields) <= text, "embedding fields must be declared str attributes")

    @property
    def indexed(self) -> dict[str, str]:
        return {i.field: i.index_type for i in self.indices}

    @property
    def declared(self) -> dict[str, str]:
        return self.indexed | {a.name: a.attr_type for a in self.attributes}

    # Amendments return a new schema; a bad one changes nothing.

    def _free(self, name: str) -> None:
        _need(name, "a name is needed")
        _need(name not in self.indexed, f"{name} is indexed")

    def add_attribute(self, name: str, attr_type: str, description: str | None = None) -> DocSchema:
        self._free(name)
        _need(name not in self.declared, f"{name} is there already")
        return replace(self, attributes=(*self.attributes, Attribute(name, attr_type, description)))

    def remove_attribute(self, name: str) -> DocSchema:
        self._free(name)
        _need(name in self.declared, f"no attribute {name}")
        left = tuple(e for e in self.embedding_fields if e != name)
        return replace(self, attributes=tuple(a for a in self.attributes if a.name != name), embedding_fields=left, semantic_search_enabled=self.semantic_search_enabled and bool(left))

    def update_attribute(self, name: str, attr_type: str, description: str | None = None) -> DocSchema:
        self._free(name)
        _need(name in self.declared, f"no attribute {name}")
        return replace(self, attributes=tuple(Attribute(name, attr_type, description) if a.name == name else a for a in self.attributes))

    def enable_vector_index(self, names: list[str], description: str | None = None) -> DocSchema:
        """One vector index for a store; its fields must be new."""
        _need(not self.semantic_search_enabled, "there is a vector index already")
        _need(names and all(names), "a vector index needs fields")
        _need(len(set(names)) == len(names), "a field is given twice")
        _need(not set(names) & set(self.declared), "a field of the vector index is declared already")
        more = tuple(Attribute(n, "str", description) for n in names)
        return replace(self, attributes=(*self.attributes, *more), embedding_fields=tuple(names), semantic_search_enabled=True)

    def add_embedding_attribute(self, name: str, description: str | None = None) -> DocSchema:
        return self.enable_vector_index([name], description)

    def disable_vector_index(self) -> DocSchema:
        return replace(self, semantic_search_enabled=False, embedding_fields=())

    def add_index(self, name: str, index_type: str) -> DocSchema:
        """An attribute of that name is promoted."""
        return replace(self, attributes=tuple(a for a in self.attributes if a.name != name), indices=(*self.indices, Index(name, index_type)))

    def drop_index(self, name: str) -> DocSchema:
        """The field stays as an attribute; an unknown one changes nothing."""
        kind = self.indexed.get(name)
        if kind is None:
            return self
        return replace(self, indices=tuple(i for i in self.indices if i.field != name), attributes=(*self.attributes, Attribute(name, kind)))

    def problem(self, doc: Column) -> Column:
        """What is wrong with a document, null if nothing: it must be an object, and declared fields that are present must have their type.

        JSON null counts as absent; fields that aren't declared pass.
        """
        v = jf.variant(doc)
        wrong = [F.when(jf.misfit(v, n, t), F.lit(f"field {n} is no {t}")) for n, t in self.declared.items()]
        return F.when(~jf.is_object(doc), "not an object").otherwise(F.coalesce(*wrong, F.lit(None).cast("string")))

    def with_fields(self, docs: DataFrame, doc: str = "doc") -> DataFrame:
        """Typed columns of all declared fields; a dotted name reads the top level and so finds nothing."""
        v = jf.variant(F.col(doc))
        return docs.withColumns({n: jf.field(v, n, t) for n, t in self.declared.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


@dataclass(frozen=True)
class KvSchema:
    namespace: str
    key_type: str = "str"
    value_type: str = "str"
    semantic_search_enabled: bool = False
    store_type: str = field(default="kv")

    def __post_init__(self) -> None:
        _need(self.store_type == "kv", "store_type must be kv")
        _need(NAMESPACE.fullmatch(self.namespace), "a namespace has letters, digits, _ and -")
        _need(self.key_type in ("str", "int"), f"unknown key type {self.key_type}")
        _need(self.value_type in VALUE_TYPES, f"unknown value type {self.value_type}")
        _need(not self.semantic_search_enabled or self.value_type == "str", "semantic search is for str values")

    @property
    def spark_value(self) -> str:
        return {"int": "bigint", "str": "string", "f32": "float", "vec_f32": "array<float>"}[self.value_type]

    def check_value(self, v: object) -> object:
        number = isinstance(v, int | float) and not isinstance(v, bool)
        ok = {
            "int": isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63,
            "str": isinstance(v, str),
            "f32": number,
            "vec_f32": isinstance(v, list) and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v),
        }[self.value_type]
        _need(ok, f"the value is no {self.value_type}")
        return [float(x) for x in v] if self.value_type == "vec_f32" else float(v) if self.value_type == "f32" else v

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


@dataclass(frozen=True)
class RawSchema:
    """A namespace of bytes under bytes, with a time to live or none."""

    namespace: str
    ttl_ms: int | None = None
    most_deletes: int | None = None
    store_type: str = field(default="raw")

    def __post_init__(self) -> None:
        _need(self.store_type == "raw", "store_type must be raw")
        _need(NAMESPACE.fullmatch(self.namespace), "a namespace has letters, digits, _ and -")
        _need(self.ttl_ms is None or self.ttl_ms >= 0, "a time to live isn't negative")
        _need(self.most_deletes is None or self.most_deletes > 0, "a sweep deletes at least one row")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


def from_json(text: str) -> DocSchema | KvSchema | RawSchema:
    """A schema from JSON; ``store_type`` decides which kind."""
    try:
        d = json.loads(text)
    except ValueError as e:
        raise SchemaError(f"not JSON: {e}") from None
    _need(isinstance(d, dict) and d.get("store_type") in ("doc", "kv", "raw"), "store_type must be doc, kv or raw")
    d.pop("ns_id", None)
    try:
        if d["store_type"] == "kv":
            return KvSchema(**d)
        if d["store_type"] == "raw":
            return RawSchema(**d)
        d["attributes"] = tuple(Attribute(**a) for a in d.get("attributes") or ())
        d["indices"] = tuple(Index(**i) for i in d.get("indices") or ())
        d["embedding_fields"] = tuple(d.get("embedding_fields") or ())
        return DocSchema(**d)
    except TypeError as e:
        raise SchemaError(str(e)) from None


def imported(text: str) -> DocSchema | KvSchema | RawSchema:
    """A schema exported elsewhere: its namespace number is dropped, and attributes that are also indexed."""
    d = json.loads(text)
    if isinstance(d, dict) and d.get("store_type") == "doc":
        indexed = {i.get("field") for i in d.get("indices") or ()}
        d["attributes"] = [a for a in d.get("attributes") or () if a.get("name") not in indexed]
    return from_json(json.dumps(d))
