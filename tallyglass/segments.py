"""A log of immutable segments: which of them make up an index, by numbered versions.

A version is one small file that lists segments and the batches that are in them. It is
written beside its place and renamed, so it is there whole or not at all; a second writer
of the same number fails. Readers take the highest version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from tallyglass.storage import remove


class Conflict(RuntimeError):
    """Somebody else committed first; read the state again and retry."""


@dataclass
class State:
    version: int = 0
    segments: list[str] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)


class SegmentLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> State:
        versions = self._versions()
        if not versions:
            return State()
        fs, p = self._fs(f"{self.path}/log/{versions[-1]:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def commit(self, state: State) -> State:
        """``state`` becomes the next version after its own number, or :class:`Conflict` if that exists."""
        after = State(state.version + 1, state.segments, state.batches)
        target = f"{self.path}/log/{after.version:010d}.json"
        fs, p = self._fs(target)
        beside = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")[1]
        out = fs.create(beside, False)
        try:
            out.write(json.dumps(asdict(after)).encode())
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, False)
            raise Conflict(target)
        return after

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the last ``keep`` versions, and the segments that no kept version names; their paths."""
        versions = self._versions()
        kept = set()
        for v in versions[-keep:]:
            fs, p = self._fs(f"{self.path}/log/{v:010d}.json")
            stream = fs.open(p)
            kept |= set(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"])
            stream.close()
        fs, p = self._fs(f"{self.path}/segments")
        there = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        gone = [f"{self.path}/segments/{s}" for s in there if s not in kept]
        remove(self.spark, gone + [f"{self.path}/log/{v:010d}.json" for v in versions[:-keep]])
        return gone
