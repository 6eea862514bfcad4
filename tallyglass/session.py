"""Session builder with the settings the operators assume (all of them defaults a cluster may override)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tallyglass", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and a shuffle width that suits the given master.

    On a cluster leave ``master`` unset (spark-submit provides it) and size
    ``shuffle_partitions`` to about 100-200 MB of shuffled bytes a partition.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", os.environ.get("TALLYGLASS_UI", "false"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
