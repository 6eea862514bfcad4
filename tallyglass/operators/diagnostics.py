"""Diagnostics: latest per file, filtered, distinct, reported."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import one_line

SEVERITIES = (0, 1)


def latest(events: DataFrame, key: str = "uri", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest notification of each key; one with equal times falls to the higher id."""
    return events.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def report_lines(diagnostics: DataFrame) -> DataFrame:
    """Errors only (or of no severity), as path, line, col (from 1), message on one line, each once per target."""
    rows = diagnostics.where(F.col("severity").isin(*SEVERITIES))
    out = rows.select("target_id", "path", (F.col("line") + 1).alias("line"), (F.col("character") + 1).alias("col"), one_line(F.col("message")).alias("message"))
    return out.dropDuplicates(["target_id", "path", "line", "col", "message"])


def _bursts(quiet_us: int, total_us: int):
    """Rows come sorted by uri, time and id; of the open burst only its totals are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["uri", "first_ts", "last_ts", "n_events", "event_id"], None
        open_: list | None = None
        for batch in batches:
            kinds = kinds or [batch.column(c).type for c in ("uri", "ts", "ts")] + [pa.int64(), batch.column("event_id").type]
            done = []
            for uri, t, event_id in zip(batch.column("uri").to_pylist(), batch.column("ts").cast(pa.int64()).to_pylist(), batch.column("event_id").to_pylist(), strict=True):
                if open_ is not None and (open_[0] != uri or t - open_[2] > quiet_us or t - open_[1] >= total_us):
                    done.append(open_)
                    open_ = None
                open_ = [uri, t, t, 1, event_id] if open_ is None else [uri, open_[1], t, open_[3] + 1, event_id]
            if done:
                yield _burst_batch(done, names, kinds)
        if open_ is not None:
            yield _burst_batch([open_], names, kinds)

    return run


def _burst_batch(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64() if k in (1, 2) else t).cast(t) for k, (c, t) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names)


def settle(events: DataFrame, quiet: float, total: float) -> DataFrame:
    """Bursts of notifications (uri, ts, event_id): one ends after more than ``quiet`` seconds of silence, or ``total`` seconds after its
    first event; the first event after that begins the next one, and its ``total``.

    Returns uri, first and last time, number of events, and the id of the last notification. Where a burst ends depends on
    where it began, so the events of a uri are gone through in order, in constant memory.
    """
    rows = events.select("uri", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"uri {kind['uri']}, first_ts timestamp, last_ts timestamp, n_events long, event_id {kind['event_id']}"
    return rows.repartition("uri").sortWithinPartitions("uri", "ts", "event_id").mapInArrow(_bursts(round(quiet * 1e6), round(total * 1e6)), schema)


def idle_sessions(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Sessions of a key that end after ``minutes`` without activity."""
    return events.groupBy("uri", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_events")).select("uri", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
