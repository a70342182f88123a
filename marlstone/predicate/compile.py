"""From a syntax tree to one Spark column, after the whole tree has been checked.

A row without a value in a field is in no comparison of that field, ``!=``
included. ``NOT x`` holds for rows that have a value in any field named in ``x``
and are not in ``x``; unlike SQL's NOT it is never unknown.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.predicate.errors import EmptyInList, InactiveField, TypeMismatch, UnknownField, UnsupportedOperator
from marlstone.predicate.syntax import Between, Both, Compare, Either, Literal, Node, OneOf, Without, parse

TYPES = ("bool", "int", "str")


def kind_of(value: Literal) -> str:
    return "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "str"


def check(node: Node, fields: Mapping[str, str], inactive: frozenset[str] = frozenset()) -> None:
    """Raise for the first problem of the tree, left to right; no literal is ever converted."""
    if isinstance(node, Both | Either):
        check(node.left, fields, inactive)
        check(node.right, fields, inactive)
    elif isinstance(node, Without):
        check(node.inner, fields, inactive)
    else:
        if node.field in inactive:
            raise InactiveField(f"field {node.field!r} has no active index")
        if node.field not in fields:
            raise UnknownField(f"unknown field {node.field!r}")
        want = fields[node.field]
        values = node.values if isinstance(node, OneOf) else (node.low, node.high) if isinstance(node, Between) else (node.value,)
        if not values:
            raise EmptyInList("IN needs at least one value")
        for v in values:
            if kind_of(v) != want:
                raise TypeMismatch(f"field {node.field!r} holds {want}, not {kind_of(v)}")
        op = "BETWEEN" if isinstance(node, Between) else getattr(node, "op", "IN")
        if want == "bool" and op not in ("=", "!=", "IN"):
            raise UnsupportedOperator(f"{op} is not for bool fields")


def named(node: Node) -> set[str]:
    if isinstance(node, Both | Either):
        return named(node.left) | named(node.right)
    return named(node.inner) if isinstance(node, Without) else {node.field}


def _literal(v: Literal) -> Column:
    return F.lit(v).cast("bigint") if kind_of(v) == "int" else F.lit(v)


def column(node: Node, at: Mapping[str, Column]) -> Column:
    """A column that is true for matching rows, else false or null (comparisons keep their pushable form)."""
    if isinstance(node, Both):
        return column(node.left, at) & column(node.right, at)
    if isinstance(node, Either):
        return column(node.left, at) | column(node.right, at)
    if isinstance(node, Without):
        there = reduce(lambda a, b: a | b, [at[f].isNotNull() for f in sorted(named(node.inner))])
        return there & ~F.coalesce(column(node.inner, at), F.lit(False))
    c = at[node.field]
    if isinstance(node, OneOf):
        return c.isin(*[_literal(v) for v in dict.fromkeys(node.values)])
    if isinstance(node, Between):
        return c.between(_literal(node.low), _literal(node.high))
    v = _literal(node.value)
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[node.op]


def compile_predicate(query: str | Node, fields: Mapping[str, str], inactive: frozenset[str] = frozenset(), columns: Mapping[str, Column] | None = None) -> Column:
    """Filter column of a predicate. ``fields`` maps the indexed fields to bool, int or str."""
    node = parse(query) if isinstance(query, str) else query
    check(node, fields, inactive)
    return column(node, columns or {f: F.col(f"`{f}`") for f in fields})


def match(df: DataFrame, query: str | Node, fields: Mapping[str, str], inactive: frozenset[str] = frozenset()) -> DataFrame:
    return df.where(compile_predicate(query, fields, inactive))
