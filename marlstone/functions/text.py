"""Words, sentences, sliding windows and embedding text, as column expressions.

White space is Unicode white space (``(?U)\\s``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, STEP = 4, 2


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs without white space; punctuation stays. Null gives null, blank text none."""
    return _kept(F.split(text, r"(?U)\s+"))


def sentences(text: Column) -> Column:
    """Pieces that end after ``.``, ``!`` or ``?`` before white space, trimmed, empty ones dropped."""
    return _kept(F.split(text, r"(?U)(?<=[.!?])\s+"))


def windows(units: Column, size: int = WINDOW, step: int = STEP) -> Column:
    """Units joined by one space in windows of ``size`` at every ``step``; the first that reaches the end is the last."""
    w, s = max(1, size), max(1, step)

    def cut(u: Column) -> Column:
        n = F.size(u)
        full = F.least(F.ceil(F.greatest(n - w, F.lit(0)) / s) + 1, F.ceil(n / s)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(u, i * s + 1, w), " "))

    # The one-element array binds the units to a variable, so they are split once and not for each window.
    return F.when(units.isNotNull(), F.transform(F.array(units), cut)[0])


def chunk_document(text: Column, size: int = WINDOW, step: int = STEP) -> Column:
    return windows(sentences(text), size, step)


def chunk_query(text: Column, size: int = WINDOW, step: int = STEP) -> Column:
    return windows(words(text), size, step)


def embedding_text(fields: list[str]) -> Column:
    """``name: value`` lines of the fields that have a value, in the given order; '' if none has."""
    return F.concat_ws("\n", *[F.when(F.col(f"`{f}`").isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f"`{f}`"))) for f in fields])
