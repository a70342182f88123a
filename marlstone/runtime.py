"""Session-wide helpers: the shared folder, cut lineage, and hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside ``spark.checkpoint.dir``.

    The cluster names the folder all executors share. Only where it is unset
    (local tests) a temporary folder of this machine is used.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="marlstone-")
        _roots[app] = f"{base.rstrip('/')}/marlstone-{app}"
        atexit.register(lambda: _remove_quietly(spark, _roots[app]))
    return _roots[app]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # already inside a shipped archive
        return
    out = os.path.join(tempfile.mkdtemp(prefix="marlstone-code-"), "marlstone.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(out)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_scopes: list[list[Table]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are dropped at the end, but for those made with ``keep``."""
    made: list[Table] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for t in made:
            t.drop()


class Table:
    """A written table in the shared folder: lineage is cut, loss of an executor costs nothing."""

    def __init__(self, df: DataFrame, name: str = "t", keep: bool = False) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        self.schema = df.schema
        if _scopes and not keep:
            _scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside delete their shuffle files when they end, not whenever the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    return Table(df, name).df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition for each core, for operators that spend far more on a row than moving it costs.

    Large inputs have more partitions than that and stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def hot_keys(counts: DataFrame, key: str, count: str, shares: int = 256) -> DataFrame:
    """Keys that hold more than one part in ``shares`` of all rows; at most ``shares`` rows by counting."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) * shares > F.lit(total)).select(key)


def hot_rows(counts: DataFrame, key: list[str], count: str, shares: int = 256) -> DataFrame | None:
    """The keys that hold more than one part in ``shares`` of all rows as a local table of at most ``shares`` rows; None if there are none."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    few = counts.where(F.col(count) * shares > F.lit(total)).select(*key)
    got = few.collect() if total else []
    return counts.sparkSession.createDataFrame(got, few.schema) if got else None


def join_hot(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key; hot keys (see ``hot_rows``) by broadcast, all others by shuffle."""
    if hot is None:
        return left.join(right, key, how)
    h = F.broadcast(hot)
    few = F.broadcast(right.join(h, key, "left_semi"))  # no more rows than ``hot``
    rest = left.join(h, key, "left_anti").join(right.join(h, key, "left_anti"), key, how)
    return left.join(h, key, "left_semi").join(few, key, how).unionByName(rest)
