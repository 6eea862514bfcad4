import datetime as dt
import random

from tallyglass.operators import diagnostics
from tallyglass.streaming import debounce

SCHEMA = "uri long, ts timestamp, event_id long"
BASE = dt.datetime(2024, 1, 1)


def _rows(seed):
    """Bursts with gaps around both limits, ties, and a hot uri that never pauses."""
    rnd, out, t = random.Random(seed), [], 0.0
    for i in range(400):
        t += rnd.choice([0, 0.5, 1, 2, 2.001, 3, 9])
        out.append((rnd.choice([1, 1, 1, 2, 3]), BASE + dt.timedelta(seconds=t), i))
    return [*out, *((7, BASE + dt.timedelta(seconds=k), 1000 + k) for k in range(60))]


def _write(spark, rows, path, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{n}")


def _replay(spark, source, path):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    debounce.replay(stream, path, quiet=2, total=10, late="300 seconds")


def test_stream_equals_batch_over_restarts_and_disorder(spark, tmp_path):
    rows = sorted(_rows(5), key=lambda r: r[1])
    late = [rows[i] for i in range(0, len(rows), 9)]  # these come a batch later
    on_time = [r for r in rows if r not in late]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    size = len(on_time) // 10  # a batch spans less time than may be late
    pending = []
    for n in range(0, len(on_time), size):
        now = on_time[n : n + size]
        _write(spark, [*now, *pending], source, f"{n:05d}")
        pending = [r for r in late if (on_time[n - 1][1] if n else BASE - dt.timedelta(1)) < r[1] <= now[-1][1]]
        if n == size * 4:
            _replay(spark, source, out)  # stops here, and goes on from the checkpoint
    _write(spark, [*pending, *(r for r in late if r[1] > on_time[-1][1])], source, "99998")
    _replay(spark, source, out)
    _write(spark, [(-1, dt.datetime(2100, 1, 1), -1)], source, "99999")
    _replay(spark, source, out)
    columns = ["uri", "first_ts", "last_ts", "n_events", "event_id"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/bursts").select(*columns).collect())
    want = sorted(tuple(r) for r in diagnostics.settle(spark.createDataFrame(rows, SCHEMA), 2, 10).select(*columns).collect())
    assert got == want and len(want) > 50
    assert max(r[3] for r in got if r[0] == 7) == 10  # the limit of time cuts what never pauses


def test_the_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with debounce.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
