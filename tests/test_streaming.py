import datetime as dt

import pytest

from tallyglass.operators import diagnostics
from tallyglass.streaming import events as st

SCHEMA = "uri long, ts timestamp, event_id long"
BASE = dt.datetime(2024, 1, 1)


def _source(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, BASE + dt.timedelta(seconds=s), e) for u, s, e in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_idle_sessions_match_batch(spark, tmp_path):
    rows = [[(1, 0, 1), (1, 60, 2), (2, 30, 3)], [(1, 4000, 4)], [(9, 90_000, 5)]]
    out = _run(st.idle_sessions(_source(spark, str(tmp_path), rows)), "sessions")
    flat = spark.createDataFrame([(u, BASE + dt.timedelta(seconds=s), e) for b in rows for u, s, e in b], SCHEMA)
    want = {tuple(r) for r in diagnostics.idle_sessions(flat).where("uri < 9").collect()}
    assert {tuple(r) for r in out} == want and len(want) == 3


def test_settled_emits_latest(spark, tmp_path):
    rows = [[(1, 0, 1), (1, 0, 2), (2, 1, 3)], [(3, 100, 4)], [(3, 200, 5)], [(3, 300, 6)]]
    out = _run(st.settled(_source(spark, str(tmp_path), rows)), "settled")
    got = {(r.uri, r.event_id, r.n_events) for r in out}
    assert {(1, 2, 2), (2, 3, 1)} <= got


def test_incremental_index(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"f{i}.go", "package x")], "path string, content string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("path string, content string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = st.index_files(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_every_subscriber_takes_every_batch_once(spark, tmp_path):
    from tallyglass.streaming.fanout import FanOut

    source, got, trouble = tmp_path / "in", {"a": [], "b": [], "late": []}, [True]
    schema = "event_id long, kind string"
    for i in range(3):
        spark.createDataFrame([(i * 10 + k, "x") for k in range(4)], schema).coalesce(1).write.mode("append").parquet(str(source))

    def take(name):
        def run(rows, batch):
            got[name].append((batch, sorted(r["event_id"] for r in rows.collect())))

        return run

    def sometimes(rows, batch):
        if batch == 1 and trouble:
            trouble.clear()
            raise OSError("away")
        take("late")(rows, batch)

    def play():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = FanOut(spark, str(tmp_path / "fan"), {"a": take("a"), "late": sometimes, "b": take("b")})
        stream.writeStream.foreachBatch(out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="late"):
        play()
    play()
    assert got["a"] == got["b"] == sorted(got["late"]) and [b for b, _ in got["a"]] == [0, 1, 2]
    assert sorted(e for _, rows in got["a"] for e in rows) == [i * 10 + k for i in range(3) for k in range(4)]
