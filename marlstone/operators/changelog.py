"""An append-only change log and the live table it stands for.

A change has a key, a sequence number that grows, the time it was made in
milliseconds, an operation ('P' put, 'D' delete) and the values. Whatever the
order of arrival, the largest sequence number of a key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = "P", "D"


def changes(df: DataFrame, key: Column, seq: Column, epoch_ms: Column, op: Column | str = PUT, values: dict[str, Column] | None = None) -> DataFrame:
    return df.select(key.alias("key"), seq.cast("bigint").alias("seq"), epoch_ms.cast("bigint").alias("epoch_ms"), (F.lit(op) if isinstance(op, str) else op).alias("op"), *[c.alias(n) for n, c in (values or {}).items()])


def latest(log: DataFrame) -> DataFrame:
    """The winning change of each key, deletes included.

    Partial aggregation keeps one state per key and task, so a key that was
    written a billion times moves no more than one row per task.
    """
    rest = [c for c in log.columns if c not in ("key", "seq")]
    won = log.groupBy("key").agg(F.max_by(F.struct("seq", *rest), F.col("seq")).alias("w"))
    return won.select("key", *[F.col(f"w.{c}").alias(c) for c in ["seq", *rest]])


def live(log: DataFrame) -> DataFrame:
    """Current rows: the winning puts."""
    return latest(log).where(F.col("op") == PUT).drop("op")


def expired(table: DataFrame, ttl_ms: int, now_ms: int) -> DataFrame:
    """Rows whose age has reached the time to live; reads don't look at it, only sweeps do."""
    return table.where(F.lit(now_ms) - F.col("epoch_ms") >= ttl_ms)


def sweep(log: DataFrame, ttl_ms: int, now_ms: int, first_seq: int, at_most: int | None = None) -> DataFrame:
    """Deletes for expired keys, oldest first if ``at_most`` bounds the pass; their numbers start at ``first_seq``."""
    old = expired(live(log), ttl_ms, now_ms)
    if at_most is not None:
        old = old.orderBy("epoch_ms", "key").limit(at_most)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields if f.name not in ("key", "seq", "epoch_ms", "op")]
    # One number serves the whole pass: sequence numbers only have to order changes of the same key.
    return old.select("key", F.lit(first_seq).cast("bigint").alias("seq"), F.lit(now_ms).cast("bigint").alias("epoch_ms"), F.lit(DELETE).alias("op"), *empty)


def compacted(log: DataFrame) -> DataFrame:
    """The log without overwritten and deleted entries."""
    return latest(log).where(F.col("op") == PUT).select(*log.columns)


def conform(log: DataFrame, sizes: int | None = None) -> Column:
    """True if key and value fit the size limit of a record (2**32 - 1 less 64 KiB)."""
    limit = (sizes or 2**32 - 1) - 64 * 1024
    wide = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in log.dtypes if t in ("string", "binary")]
    return sum(wide, F.lit(0)) <= limit


def counters(log: DataFrame) -> DataFrame:
    """Per-operation counts and bytes, and the share of entries that no longer count."""
    won = latest(log).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("op") == PUT).alias("live"))
    all_ = log.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("op") == PUT).alias("puts"), F.count_if(F.col("op") == DELETE).alias("deletes"))
    a, b = all_.withColumn("one", F.lit(1)), won.withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one").withColumn("waste", F.when(F.col("entries") > 0, 1 - F.col("live") / F.col("entries")).otherwise(0.0))


def summed(counts: DataFrame) -> DataFrame:
    """Counters of several logs, and those of all together under the null namespace."""
    names = ("entries", "puts", "deletes", "keys", "live")
    total = counts.agg(*[F.sum(n).alias(n) for n in names]).withColumn("waste", F.when(F.col("entries") > 0, 1 - F.col("live") / F.col("entries")).otherwise(0.0))
    return counts.unionByName(total.withColumn("namespace", F.lit(None).cast("string")))
