"""Streaming forms: settled diagnostics, idle sessions, correlated requests, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def idle_sessions(events: DataFrame, key: str = "uri", minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``minutes`` of silence; a session is emitted when the watermark passes its end."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def settled(events: DataFrame, quiet_ms: int = 40, late: str = "1 second") -> DataFrame:
    """The latest notification of each uri once ``quiet_ms`` of event time have passed without another.

    Columns uri long, ts timestamp, event_id long; state is one row for each open uri.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, event_id, n = state.get
            state.remove()
            yield pd.DataFrame({"uri": [key[0]], "ts": [pd.Timestamp(ts, unit="us")], "event_id": [event_id], "n_events": [n]})
            return
        ts, event_id, n = state.get if state.exists else (-1, -1, 0)
        for pdf in batches:
            for t, e in zip(pdf["ts"].astype("datetime64[us]").astype("int64"), pdf["event_id"], strict=True):
                ts, event_id = max((ts, event_id), (int(t), int(e)))
                n += 1
        state.update((ts, event_id, n))
        state.setTimeoutTimestamp(max(ts // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))

    grouped = events.select("uri", "ts", "event_id").withWatermark("ts", late).groupBy("uri")
    return grouped.applyInPandasWithState(step, "uri long, ts timestamp, event_id long, n_events long", "ts long, event_id long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def correlated(requests: DataFrame, responses: DataFrame, within: str = "1 minute") -> DataFrame:
    """Requests (request_id, ts) with their responses (response_id, ts, answer_to); both sides' state ends with the watermark."""
    q = requests.withWatermark("ts", within).alias("q")
    r = responses.withColumnRenamed("ts", "response_ts").withWatermark("response_ts", within).alias("r")
    on = F.expr(f"answer_to = request_id AND response_ts >= ts AND response_ts <= ts + INTERVAL {within}")
    return q.join(r, on).select("request_id", "ts", "response_id", "response_ts")


def index_files(files: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Incremental indexing: each micro-batch of files goes to ``upsert``; returns the running query."""
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
