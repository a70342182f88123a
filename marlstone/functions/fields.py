"""Strictly typed top-level fields of JSON documents: no value is ever converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of JSON values as the variant type names them.
KINDS = {"str": r"^STRING$", "bool": r"^BOOLEAN$", "int": r"^(BIGINT|INT|SMALLINT|TINYINT)$"}


def variant(doc: Column) -> Column:
    """Parsed document, null if it isn't JSON."""
    return F.try_parse_json(doc)


def is_object(doc: Column) -> Column:
    v = variant(doc)
    return v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def _path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def kind(v: Column, name: str) -> Column:
    """Variant type of a top-level field; null if it is missing, VOID if it is JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, _path(name), "variant"))


def field(v: Column, name: str, want: str) -> Column:
    """Value of a top-level field if it has just the wanted kind (bool, int or str), else null.

    ``1.0`` and integers beyond 64 bits are no ints, ``"1"`` is none either.
    """
    got = F.try_variant_get(v, _path(name), {"str": "string", "bool": "boolean", "int": "bigint"}[want])
    return F.when(kind(v, name).rlike(KINDS[want]), got)


def misfit(v: Column, name: str, want: str) -> Column:
    """True if the field is present, not null, and of another kind."""
    k = kind(v, name)
    return F.coalesce(k.isNotNull() & (k != "VOID") & ~k.rlike(KINDS[want]), F.lit(False))
