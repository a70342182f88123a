"""Point, range and prefix reads with cursor and offset pages.

Every read is a filter on the key column, so Parquet statistics prune files and
row groups; ``values`` names what is read beside the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marlstone.functions.keys import prefix_end
from marlstone.runtime import Table

PAGE_SIZE = 20


@dataclass(frozen=True)
class CursorPage:
    rows: list[Row]
    next_cursor: Any | None


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    page_no: int
    page_size: int
    total: int


def _order(key: str, compat: bool) -> list[Column]:
    return [F.col(key) < 0, F.col(key)] if compat else [F.col(key)]


def point_get(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def multi_get(df: DataFrame, key: str, wanted: list[Any]) -> DataFrame:
    """Rows of ``df`` for each wanted key in the given order, nulls where a key is missing.

    Columns: pos, the key, and the others. A repeated wanted key gives repeated
    rows, a null one a row of nulls.
    """
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"pos int, `{key}` {df.schema[key].dataType.simpleString()}")
    few = len(wanted) <= 10_000
    found = df.where(F.col(key).isin([v for v in wanted if v is not None])) if few else df
    # A short list is sought in the scan; what is left of the table is then no larger than the list (times repeats of a key).
    return asked.join(found, key, "left").select("pos", *df.columns).orderBy("pos")


def full_scan(df: DataFrame, key: str, ordered: bool = True, compat: bool = False) -> DataFrame:
    return df.orderBy(*_order(key, compat)) if ordered else df


def numbered(df: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """``df`` with ``pos``, the place of each row in key order from 1.

    Rows are sorted by ranges and counted range by range, so none is ranked by
    one task; the sorted rows are written once.
    """
    part, at = F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("_at")
    placed = Table(full_scan(df, key, compat=compat).select("*", part, at), "numbered").df
    per = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())  # one row for each range
    before, total = [], 0
    for p, n in per:
        before.append((p, total))
        total += n
    offset = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before bigint"))
    return placed.join(offset, "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias("pos"))


def keys_only(df: DataFrame, key: str, ordered: bool = True, compat: bool = False) -> DataFrame:
    return full_scan(df.select(key), key, ordered, compat)


def range_scan(df: DataFrame, key: str, start: Any = None, end: Any = None) -> DataFrame:
    """Keys in ``[start, end)``, either end open if None; not sorted, see ``full_scan``."""
    out = df.where(F.col(key).isNotNull())
    if start is not None:
        out = out.where(F.col(key) >= F.lit(start))
    return out if end is None else out.where(F.col(key) < F.lit(end))


def prefix_scan(df: DataFrame, key: str, prefix: str | bytes) -> DataFrame:
    """Keys that begin with ``prefix``: as a range for bytes (statistics prune), as a prefix for text."""
    if isinstance(prefix, str):
        return df.where(F.col(key).startswith(F.lit(prefix)))
    return range_scan(df, key, bytearray(prefix), None if prefix_end(prefix) is None else bytearray(prefix_end(prefix)))


def multi_prefix(df: DataFrame, column: str, values: list[int]) -> DataFrame:
    """Rows of many partitions at once, such as the chunks of probed clusters."""
    return df.where(F.col(column).isin([int(v) for v in values]))


def cursor_page(df: DataFrame, key: str, limit: int = PAGE_SIZE, cursor: Any = None, start: Any = None, end: Any = None) -> CursorPage:
    """``limit`` rows in key order and the key after them.

    A cursor takes the place of ``start`` and isn't checked against it; ``end``
    still holds. With limit 0 the page is empty and the cursor is the first key.
    The top ``limit + 1`` keys are found first; only the page's rows are read whole.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    keys = range_scan(df.select(key), key, start if cursor is None else cursor, end).orderBy(key).limit(limit + 1)
    got = [r[0] for r in keys.collect()]
    after = got[limit] if len(got) > limit else None
    page = got[:limit]
    rows = range_scan(df, key, page[0], end if after is None else after).orderBy(key).limit(limit).collect() if page else []
    return CursorPage(rows, after)


def prefix_page(df: DataFrame, key: str, prefix: bytes, limit: int = PAGE_SIZE, cursor: bytes | None = None) -> CursorPage:
    """Cursor page of a byte prefix; the cursor replaces the prefix's start only."""
    stop = prefix_end(prefix)
    return cursor_page(df, key, limit, None if cursor is None else bytearray(cursor), bytearray(prefix), None if stop is None else bytearray(stop))


def window_of(page_no: int = 1, page_size: int = PAGE_SIZE) -> tuple[int, int]:
    """(offset, limit) of a page; both numbers count as at least 1."""
    n, size = max(1, page_no), max(1, page_size)
    return (n - 1) * size, size


def offset_page(df: DataFrame, key: str, page_no: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows of a page in key order; keys are sought first, so wide columns are read for the page only."""
    skip, size = window_of(page_no, page_size)
    keys = df.select(key).orderBy(key).offset(skip).limit(size)
    return df.join(keys, key, "left_semi").orderBy(key)


def page_with_total(df: DataFrame, key: str, page_no: int = 1, page_size: int = PAGE_SIZE) -> Page:
    """Exact total first; the page is read only if it can have rows. ``key`` must be unique."""
    skip, size = window_of(page_no, page_size)
    total = df.count()
    rows = offset_page(df, key, page_no, page_size).collect() if skip < total else []
    return Page(rows, max(1, page_no), size, total)
