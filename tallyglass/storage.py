"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one is set where it is missing in local mode alone, elsewhere that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyglass-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallyglass/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, held: list[str] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """The same rows from a table in the shared folder, computed once; its path is added to ``held``, for :func:`remove`."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers get batches of ``size`` bytes in what is run inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is planned and run inside go as soon as it is done, not when the driver collects its garbage; the session's setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove stored tables (missing ones are ignored)."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def expected_bytes(df: DataFrame) -> int | None:
    """What the optimiser expects ``df`` to fill, none where it has no statistics: a tuning figure, on which no result depends."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else None
