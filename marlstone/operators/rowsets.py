"""Field-index statistics and algebra of row-id sets; a set is a DataFrame with one column ``id``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CONTAINERS = 1 << 20


def ids(df: DataFrame, row_id: str) -> DataFrame:
    return df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id")).distinct()


def build(spark: SparkSession, values: Iterable[int]) -> DataFrame:
    """A set of numbers in any order, with repeats."""
    return spark.createDataFrame([(int(v),) for v in sorted(set(values))], "id bigint")


def insert(a: DataFrame, values: Iterable[int]) -> DataFrame:
    return either(a, build(a.sparkSession, values))


def remove(a: DataFrame, values: Iterable[int]) -> DataFrame:
    return without(a, build(a.sparkSession, values))


def clear(a: DataFrame) -> DataFrame:
    return a.limit(0)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def within(a: DataFrame, low: int, high: int) -> DataFrame:
    return a.where((F.col("id") >= low) & (F.col("id") < high))


def both_within(a: DataFrame, b: DataFrame, low: int, high: int) -> DataFrame:
    return both(within(a, low, high), within(b, low, high))


def either_within(a: DataFrame, b: DataFrame, low: int, high: int) -> DataFrame:
    return either(within(a, low, high), within(b, low, high))


def flip(a: DataFrame, low: int, high: int) -> DataFrame:
    """Members of ``[low, high)`` change places with non-members; the rest stays."""
    if high > low and ((high - 1) >> 16) - (low >> 16) + 1 > MOST_CONTAINERS:
        raise ValueError("the range covers too many containers")
    rest = a.where(~((F.col("id") >= low) & (F.col("id") < high)))
    return rest.union(a.sparkSession.range(low, max(low, high)).subtract(within(a, low, high)))


def contains(a: DataFrame, value: int) -> bool:
    return bool(a.where(F.col("id") == value).limit(1).count())


def rank(a: DataFrame, value: int) -> int:
    """Members that are at most ``value``."""
    return a.where(F.col("id") <= value).count()


def select(a: DataFrame, n: int) -> int | None:
    """The n-th smallest member, from 0."""
    got = a.orderBy("id").offset(n).limit(1).collect() if n >= 0 else []
    return got[0][0] if got else None


def extent(a: DataFrame) -> DataFrame:
    """(n, least, most)."""
    return a.agg(F.count("id").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_values): exact numbers of distinct values, nulls left out.

    One pass: rows are unpivoted and de-duplicated on the map side, no value is
    expanded per field in the final stage.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    return long.where("value is not null").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n_values"))


def postings(df: DataFrame, field: str, row_id: str) -> DataFrame:
    """(value, n_ids, least, most) of each value; the ids themselves stay rows, see ``listing``."""
    pairs = df.where(F.col(field).isNotNull() & F.col(row_id).isNotNull()).select(F.col(field).alias("value"), F.col(row_id).alias("id")).distinct()
    return pairs.groupBy("value").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("least"), F.max("id").alias("most"))


def listing(df: DataFrame, field: str, row_id: str) -> DataFrame:
    """(value, container, bits): the inverted index as segments.

    One row per value and container of 65,536 ids, so no value's ids are ever
    gathered into one row; ``bits`` are sorted offsets in the container.
    """
    rows = df.where(F.col(field).isNotNull() & F.col(row_id).isNotNull()).select(F.col(field).alias("value"), F.col(row_id).cast("bigint").alias("id"))
    return rows.groupBy("value", F.shiftright("id", 16).alias("container")).agg(F.sort_array(F.collect_set(F.col("id").bitwiseAND(65535).cast("int"))).alias("bits"))
