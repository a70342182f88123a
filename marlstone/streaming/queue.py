"""The embedding queue: de-duplication, retries, administration, and a streaming worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.runtime import Table

MAX_RETRIES = 5
KEY = ["namespace", "doc_key"]


def deduplicated(queue: DataFrame) -> DataFrame:
    """The live entry of each (namespace, doc_key): the latest ``enqueued_at``, then the largest ``queue_id``.

    Only narrow columns are aggregated; the texts of the winners follow by id.
    """
    last = queue.groupBy(*KEY).agg(F.max(F.struct("enqueued_at", "queue_id")).alias("m")).select(F.col("m.queue_id").alias("queue_id"))
    return queue.join(last, "queue_id", "left_semi")


def summary(queue: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(namespace, actionable, exhausted)."""
    spent = F.coalesce("retry_count", F.lit(0)) >= max_retries
    return queue.groupBy("namespace").agg(F.count_if(~spent).alias("actionable"), F.count_if(spent).alias("exhausted"))


def retried(queue: DataFrame, namespace: str | None = None) -> DataFrame:
    out = queue.where(F.col("retry_count") > 0)
    return out if namespace is None else out.where(F.col("namespace") == namespace)


def entry(queue: DataFrame, namespace: str, key: str) -> DataFrame:
    return queue.where((F.col("namespace") == namespace) & (F.col("doc_key") == key))


def without(queue: DataFrame, namespace: str, key: str | None = None) -> DataFrame:
    """The queue less one entry, or less all of a namespace."""
    hit = F.col("namespace").eqNullSafe(namespace)
    return queue.where(~(hit if key is None else hit & F.col("doc_key").eqNullSafe(key)))


def reset(queue: DataFrame, namespace: str, key: str | None = None, only_failed: bool = False) -> DataFrame:
    """Retry counts and errors of one entry or of a namespace set back."""
    hit = F.col("namespace") == namespace
    if key is not None:
        hit = hit & (F.col("doc_key") == key)
    if only_failed:
        hit = hit & (F.coalesce("retry_count", F.lit(0)) >= MAX_RETRIES)
    hit = F.coalesce(hit, F.lit(False))
    return queue.withColumn("retry_count", F.when(hit, F.lit(0)).otherwise(F.col("retry_count")).cast("int")).withColumn("last_error", F.when(~hit, F.col("last_error")))


def in_turn(queue: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Actionable entries with ``turn``: the n-th of each namespace comes before any n+1-th; order is by time, then id, nulls first.

    Entries lie in parts in order, so no namespace is ranked by one task: the
    rank is the entries of the namespace in earlier parts and the place in the own one.
    """
    from pyspark.sql import Window as W

    spark = queue.sparkSession
    todo = queue.where(F.coalesce("retry_count", F.lit(0)) < max_retries)
    ranged = todo.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "namespace", "enqueued_at", "queue_id")
    placed = Table(ranged.withColumn("_part", F.spark_partition_id()), "turns").df  # parts must not move between the two readings
    per = placed.groupBy("namespace", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("namespace").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offset = per.select(F.col("namespace").alias("_ns"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("namespace", "_part").orderBy("enqueued_at", "queue_id"))
    ranked = placed.withColumn("_rank", rank).join(offset, F.col("namespace").eqNullSafe(F.col("_ns")) & (F.col("_part") == F.col("_p")))
    return ranked.withColumn("turn", F.col("_before") + F.col("_rank")).select(*queue.columns, "turn")


def failed(batch: DataFrame, error: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Entries after a failed attempt, parked once ``max_retries`` is reached."""
    n = F.coalesce("retry_count", F.lit(0)) + 1
    return batch.withColumn("retry_count", n.cast("int")).withColumn("last_error", F.lit(error)).withColumn("parked", n >= max_retries)


def run_worker(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame], None], retry_path: str, max_retries: int = MAX_RETRIES) -> StreamingQuery:
    """Work off all queued files and stop.

    Each micro-batch is de-duplicated and handed over; a batch that fails is
    appended to the retry table with a higher count. ``handle`` may see a batch
    again after a crash, so it must write by key.
    """

    def one(batch: DataFrame, number: int) -> None:
        todo = deduplicated(batch).where(F.coalesce("retry_count", F.lit(0)) < max_retries)
        try:
            handle(todo)
        except Exception as e:  # the service's failure is the entries', not the stream's
            failed(todo, str(e)[:500], max_retries).withColumn("batch", F.lit(number)).write.mode("append").parquet(retry_path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
