"""Notifications to many subscribers, each batch exactly once for each.

A micro-batch is written once, under its number; then every subscriber takes it. Who has
taken which batch is a ledger of one empty file each, written after the subscriber is done
and looked up before, so a batch that is played again goes only to those who don't have it.
A subscriber that fails doesn't keep the others from theirs; the batch then fails as a
whole, and its replay serves the one that missed it. Subscribers make their effects
idempotent by the batch number, as a failure may come between effect and ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyglass.storage import exists

Subscriber = Callable[[DataFrame, int], None]


class FanOut:
    def __init__(self, spark: SparkSession, path: str, subscribers: dict[str, Subscriber]):
        """``subscribers`` by name; the names are the ledger's, so they stay the same over restarts."""
        self.spark, self.path, self.subscribers = spark, path.rstrip("/"), subscribers

    def _mark(self, name: str, batch: int) -> str:
        return f"{self.path}/ledger/{name}/{batch}"

    def taken(self, name: str, batch: int) -> bool:
        return exists(self.spark, self._mark(name, batch))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """For ``writeStream.foreachBatch``."""
        waiting = [name for name in self.subscribers if not self.taken(name, batch)]
        if not waiting:
            return
        body = f"{self.path}/batches/{batch}"
        rows.write.mode("overwrite").parquet(body)  # all subscribers see the same rows, computed once
        failed = {}
        for name in waiting:
            try:
                self.subscribers[name](self.spark.read.schema(rows.schema).parquet(body), batch)
            except Exception as e:  # noqa: BLE001  the others get theirs first
                failed[name] = e
                continue
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._mark(name, batch))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()
        if failed:
            raise RuntimeError(f"batch {batch} failed for {sorted(failed)}") from next(iter(failed.values()))
