"""The boolean predicate language: text to syntax tree to Spark column."""

from marlstone.predicate.compile import compile_predicate, match
from marlstone.predicate.errors import EmptyInList, InactiveField, PredicateError, SyntaxProblem, TypeMismatch, UnknownField, UnsupportedOperator
from marlstone.predicate.syntax import parse

__all__ = ["EmptyInList", "InactiveField", "PredicateError", "SyntaxProblem", "TypeMismatch", "UnknownField", "UnsupportedOperator", "compile_predicate", "match", "parse"]
