"""Per-key results over skewed keys.

Rows are first folded into compact states that merge by an algebraic
function (bit-or, sum, min, max), so that Spark's partial aggregation keeps a
bounded hash table per task, spills it if needed, and only the states shuffle.
The first grouping key always carries a spread part (a 64-bit word of the row
id), so a key that holds a third of all rows is dealt over all tasks. The
second aggregation sees at most one state per key, word and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINER = 65536  # row ids in a container of a segment


def _bits(word_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One 64-bit mask for each key and word; partial aggregation merges masks on the map side."""
    return word_rows.groupBy(*keys, "__word").agg(F.expr("bit_or(__mask)").alias("__mask"))


def id_words(df: DataFrame, row_id: Column, keys: dict[str, Column]) -> DataFrame:
    """Rows as (keys, word, mask): the row id's upper part and one bit for its lower six."""
    return df.where(row_id.isNotNull()).select(
        *(c.alias(k) for k, c in keys.items()),
        F.shiftright(row_id, 6).alias("__word"),
        F.expr("1L").alias("__one"),
        row_id.bitwiseAND(63).cast("int").alias("__low"),
    ).select(*keys, "__word", F.expr("shiftleft(__one, __low)").alias("__mask"))


def segment_words(segments: DataFrame) -> DataFrame:
    """Row-id words of field-index segments.

    A segment lists ``container * 65536 + b`` for each ``b`` of ``bitmaps``.
    Null or empty bitmaps, null containers and null members hold no ids. Each
    segment is folded to one mask per word before any row leaves its task.
    """
    keys = ["namespace", "field_name", "field_value"]
    low = segments.where(F.col("container").isNotNull()).select(*keys, "container", F.explode("bitmaps").alias("__b"))
    low = low.where(F.col("__b").isNotNull())
    return id_words(low, F.col("container") * CONTAINER + F.col("__b").cast("long"), {k: F.col(k) for k in keys})


def segment_key_counts(segments: DataFrame) -> DataFrame:
    """(namespace, field_name, field_value, n_ids): exact distinct row ids per key.

    Repeated or overlapping segments count once. A null namespace, field or
    value is a key of its own. Keys without any id don't appear; an empty
    table gives no rows.
    """
    keys = ["namespace", "field_name", "field_value"]
    words = _bits(segment_words(segments), keys)
    return words.groupBy(*keys).agg(F.sum(F.bit_count("__mask")).cast("bigint").alias("n_ids"))


def heavy_keys(segments: DataFrame, share: float = 0.03) -> DataFrame:
    """Keys that hold at least ``share`` of the distinct row ids of their namespace and field.

    Columns: namespace, field_name, field_value, n_ids, n_total. The comparison
    is exact in integers (``share`` is taken in parts of a million).
    """
    keys = ["namespace", "field_name", "field_value"]
    words = _bits(segment_words(segments), keys)
    counts = words.groupBy(*keys).agg(F.sum(F.bit_count("__mask")).cast("bigint").alias("n_ids"))
    over = _bits(words.select("namespace", "field_name", "__word", "__mask"), ["namespace", "field_name"])
    totals = over.groupBy("namespace", "field_name").agg(F.sum(F.bit_count("__mask")).cast("bigint").alias("n_total"))
    t = totals.select(F.col("namespace").alias("__ns"), F.col("field_name").alias("__fn"), "n_total")
    met = counts.join(t, F.col("namespace").eqNullSafe(F.col("__ns")) & F.col("field_name").eqNullSafe(F.col("__fn")))
    return met.where(F.col("n_ids") * 1_000_000 >= F.col("n_total") * round(share * 1_000_000)).select(*keys, "n_ids", "n_total")


def rows_and_distinct(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """(<key>, n_rows, n_ids): rows and distinct ids for each key, null being a key.

    The first aggregation groups by key and id word, so a hot key spreads over
    all tasks and repeats of an id collapse on the map side. Rows with a null
    id count as rows only; a key with null ids alone has ``n_ids`` 0.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(row_id).cast("long").alias("__id"))
    words = rows.select(
        "__key",
        F.shiftright("__id", 6).alias("__word"),
        F.when(F.col("__id").isNotNull(), F.expr("shiftleft(1L, cast(__id & 63 as int))")).alias("__mask"),
    )
    part = words.groupBy("__key", "__word").agg(F.count(F.lit(1)).alias("__rows"), F.expr("bit_or(__mask)").alias("__mask"))
    return part.groupBy("__key").agg(
        F.sum("__rows").cast("bigint").alias("n_rows"), F.coalesce(F.sum(F.bit_count("__mask")), F.lit(0)).cast("bigint").alias("n_ids")
    ).withColumnRenamed("__key", key)
