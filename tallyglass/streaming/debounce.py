"""Debounced notifications in a stream, with a limit of silence and one of total time, as :func:`tallyglass.operators.diagnostics.settle` has them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """For each uri the open burst, and the events that the watermark hasn't passed, as these may still get earlier neighbours.

    One timer is set: for the first moment at which something can be emitted.
    """

    def __init__(self, quiet_us: int, total_us: int):
        self.quiet, self.total = quiet_us, total_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, event_id long")
        self.waiting = handle.getListState("waiting", "us long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r["us"], r["event_id"]) for r in rows]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, fresh: list[tuple], known_to: int) -> Iterator[Row]:
        """Goes through the events up to ``known_to``, the time before which none can come any more."""
        held = list(self.waiting.get()) if self.waiting.exists() else []
        events = sorted((int(t), int(e)) for t, e in [*held, *fresh])
        burst = tuple(self.open.get()) if self.open.exists() else None
        passed = 0
        for t, event_id in events:
            if t > known_to:
                break
            passed += 1
            if burst is not None and (t - burst[1] > self.quiet or t - burst[0] >= self.total):
                yield self._row(key, burst)
                burst = None
            burst = (t, t, 1, event_id) if burst is None else (burst[0], t, burst[2] + 1, event_id)
        rest = events[passed:]
        if burst is not None and (known_to - burst[1] >= self.quiet or known_to - burst[0] >= self.total):
            # the next event is later than known_to, so it begins a burst of its own
            yield self._row(key, burst)
            burst = None
        if burst is None:
            self.open.clear()
        else:
            self.open.update(burst)
        if passed or fresh:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if burst is not None or rest:
            first, last = (burst[0], burst[1]) if burst is not None else (rest[0][0], rest[0][0])
            self.handle.registerTimer(min(last + self.quiet, first + self.total) // 1000 + 1)

    @staticmethod
    def _row(key: tuple, burst: tuple) -> Row:
        return Row(uri=key[0], first_us=burst[0], last_us=burst[1], n_events=burst[2], event_id=burst[3])


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while queries are started; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def debounced(events: DataFrame, quiet: float, total: float, late: str = "10 seconds") -> DataFrame:
    """Bursts of a stream of notifications (uri, ts, event_id): one ends after more than ``quiet`` seconds of silence, or ``total``
    seconds after its first event. Start queries over it inside :func:`state_store`.

    Events may come in any order within ``late``; later ones are dropped, as of any watermark. A burst is emitted when the watermark
    shows that no event can join it. State of a uri is its open burst and its events of the last ``late`` of time.
    """
    kind = events.schema["uri"].dataType.simpleString()
    rows = events.select("uri", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    processor = Debounce(round(quiet * 1e6), round(total * 1e6))
    out = rows.groupBy("uri").transformWithState(processor, f"uri {kind}, first_us long, last_us long, n_events long, event_id long", "Append", "EventTime")
    return out.select("uri", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n_events", "event_id")


def replay(events: DataFrame, path: str, quiet: float, total: float, late: str = "10 seconds") -> None:
    """What a stream has now, through :func:`debounced` to Parquet in ``path``/bursts; called again it goes on from its checkpoint."""
    with state_store(events.sparkSession):
        out = debounced(events, quiet, total, late).writeStream.format("parquet").option("path", f"{path}/bursts").option("checkpointLocation", f"{path}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
