"""Session-level helpers: the shared work folder, lineage cuts, and row keys."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode is a local one set where the session does not name one; on a cluster that is an error,
    as executors would write where nobody reads.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local" and spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyglass-"))
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


class _Scopes(threading.local):
    """Paths given out inside :func:`temporary` in this thread, innermost last."""

    def __init__(self):
        self.held: list[list[str]] = []


_SCOPES = _Scopes()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{work_dir(spark).rstrip('/')}/tallyglass/{name}-{uuid.uuid4().hex}"
    if _SCOPES.held:
        _SCOPES.held[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; what must last is stored after it, or under a path made before."""
    _SCOPES.held.append([])
    try:
        yield
    finally:
        for path in _SCOPES.held.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table (missing ones are ignored)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of 4 MB, where the session doesn't set a size.

    Spark's own limits are 10,000 rows and 64 MB, which long texts fill, on both sides and for every task.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))


def doc_columns(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that other columns cannot clash."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in more])


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct, to carry rows past an operator's own columns whatever they are called."""
    lean(docs.sparkSession)
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def id_crc(id_col: Column | str = "doc_id") -> Column:
    """crc32 of the id written in decimal (null ids: of the empty string)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows of ``left`` with the other columns of ``right``, by equal keys, where nulls are equal too."""
    right = right.withColumnsRenamed({c: f"__right_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in keys]
    return left.join(right, same, how).drop(*[f"__right_{c}" for c in keys])


def partitions_for(df: DataFrame, bytes_each: int, least: int = 1, most: int = 100_000) -> int:
    """How many partitions of about ``bytes_each`` bytes the optimiser expects ``df`` to fill.

    A tuning figure only: no result depends on it.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 56:  # no statistics
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(min(most, max(least, -(-size // bytes_each))))


#: Removes the shuffle files of a finished SQL execution at once instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Like :func:`stored`, and the shuffles that made the table are removed as soon as it is written.

    For large intermediate shuffles that nothing else reads. The session's setting is put back.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        path = path or scratch(spark, name)
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BITS = 26


def key_filter(keys: DataFrame, column: str = "key") -> Callable[[Column], Column]:
    """A Bloom filter of the 64-bit hashes in ``column``: from a column of such hashes to whether they may be among them.

    2**26 bits, 8 MB whatever the input. The set bits are gathered as 64-bit words, so the driver gets 2**20 rows
    at most. With more keys than it can tell apart the filter lets more rows through; no result depends on it.
    """
    spots = lambda c: [F.shiftrightunsigned(F.xxhash64(c, F.lit(k)), 64 - FILTER_BITS) for k in (1, 2)]
    marked = keys.select(F.explode(F.array(*spots(F.col(column)))).alias("p"))
    words = marked.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    bits_b = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(T.BooleanType())
    def maybe(first: pa.Array, second: pa.Array) -> pa.Array:
        out = True
        for p in (first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)):
            out = out & (bits_b.value[p >> 6] >> (p & 63) & 1).astype(bool)
        return pa.array(out, pa.bool_())

    return lambda hashed: maybe(*spots(hashed))
