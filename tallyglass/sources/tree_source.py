"""Trees as a Spark data source: subtrees are read in parallel, ignored directories are never listed, filters reach the walk.

``spark.read.format("tree").option("path", root).load()`` after :func:`register`. Options: ``patterns`` (lines of an ignore file),
``extensions`` (comma list), ``max_kb``, ``content`` (false: places and sizes only), ``split`` (directories the driver lists at least,
if there are as many, before the rest is left to tasks). The root is a path that all executors see.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from tallyglass.functions import ignore
from tallyglass.functions.languages import DEFAULT_EXTENSIONS

BATCH_BYTES = 4 << 20
#: Directories that the driver lists before it leaves subtrees to tasks.
SPLIT = 64
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Subtree(ds.InputPartition):
    """A directory below the root ('' is the root); ``deep``: with all that is below, else its own files."""

    directory: str
    deep: bool

    def __post_init__(self):
        super().__init__((self.directory, self.deep))


class TreeReader(ds.DataSourceReader):
    def __init__(self, root: str, patterns: Sequence[str], extensions: Iterable[str], max_bytes: int, content: bool, split: int):
        self.root, self.max_bytes, self.content, self.split = root, max_bytes, content, split
        self.extensions = frozenset(x.lower() for x in extensions)
        self.ignored = ignore.regex(patterns, walk=True)
        self.prefixes: list[str] = []
        self.paths: frozenset[str] | None = None
        self.suffixes: list[str] = []
        self.least = 0

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes equality, membership, prefixes and suffixes of the path, and bounds of the size; gives the others back."""
        for f in filters:
            match f:
                case ds.EqualTo(("path",), str() as value):
                    self._only([value])
                case ds.In(("path",), values) if all(isinstance(v, str) for v in values):
                    self._only(values)
                case ds.StringStartsWith(("path",), value):
                    self.prefixes.append(value)
                case ds.StringEndsWith(("path",), value):
                    self.suffixes.append(value)
                case ds.LessThanOrEqual(("bytes",), int() as value):
                    self.max_bytes = min(self.max_bytes, value)
                case ds.LessThan(("bytes",), int() as value):
                    self.max_bytes = min(self.max_bytes, value - 1)
                case ds.GreaterThanOrEqual(("bytes",), int() as value):
                    self.least = max(self.least, value)
                case ds.GreaterThan(("bytes",), int() as value):
                    self.least = max(self.least, value + 1)
                case ds.IsNotNull(("path" | "bytes",)):
                    pass
                case _:
                    yield f

    def _only(self, values: Iterable[str]) -> None:
        self.paths = frozenset(values) if self.paths is None else self.paths & frozenset(values)

    def _enters(self, directory: str) -> bool:
        """Whether a wanted file can be below a directory; an ignored one has none, whatever is in it."""
        if self.ignored and re.search(self.ignored, directory):
            return False
        below = f"{directory}/"
        if any(not (below.startswith(p) or p.startswith(below)) for p in self.prefixes):
            return False
        return self.paths is None or any(p.startswith(below) for p in self.paths)

    def _takes(self, path: str, size: int) -> bool:
        name = path.rsplit("/", 1)[-1]
        if (f".{name.rsplit('.', 1)[1]}" if "." in name else "").lower() not in self.extensions or not self.least <= size <= self.max_bytes:
            return False
        if not all(map(path.startswith, self.prefixes)) or not all(map(path.endswith, self.suffixes)):
            return False
        return (self.paths is None or path in self.paths) and not (self.ignored and re.search(self.ignored, path))

    def _list(self, directory: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Directories to enter and files to take in one directory; what can't be read isn't there, links aren't followed."""
        inner, files = [], []
        try:
            with os.scandir(os.path.join(self.root, directory)) as entries:
                for e in entries:
                    path = f"{directory}/{e.name}" if directory else e.name
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if self._enters(path):
                                inner.append(path)
                        elif e.is_file(follow_symlinks=False) and self._takes(path, size := e.stat(follow_symlinks=False).st_size):
                            files.append((path, size))
                    except OSError:
                        continue
        except OSError:
            pass
        return sorted(inner), sorted(files)

    def partitions(self) -> Sequence[ds.InputPartition]:
        """Level by level, until enough directories are known: the files of each listed one, and the subtrees that remain."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        listed, level = [], [""]
        while level and len(listed) + len(level) < self.split:
            listed += level
            level = [inner for d in level for inner in self._list(d)[0]]
        return [*(Subtree(d, False) for d in listed), *(Subtree(d, True) for d in level)] or [Subtree("", False)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        todo = [partition.directory]
        while todo:
            inner, files = self._list(todo.pop())
            if partition.deep:
                todo += reversed(inner)
            for path, n in files:
                text = None
                if self.content:
                    try:
                        with open(os.path.join(self.root, path), "rb") as f:
                            raw = f.read()
                    except OSError:
                        continue
                    text, n = raw.decode("utf-8", "replace"), len(raw)
                if held and size + n > BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
                held.append((path, text, n))
                size += (n if self.content else 0) + len(path)
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        paths, texts, sizes = zip(*rows, strict=True)
        columns = {"path": pa.array(paths, pa.string()), "bytes": pa.array(sizes, pa.int64())}
        if self.content:
            columns = {"path": columns["path"], "content": pa.array(texts, pa.string()), "bytes": columns["bytes"]}
        return pa.RecordBatch.from_pydict(columns)


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() != "false"

    def schema(self) -> str:
        return "path string, content string, bytes bigint" if self._content() else "path string, bytes bigint"

    def reader(self, schema) -> TreeReader:
        o = self.options
        if "path" not in o:
            raise ValueError("a tree needs a path")
        extensions = [x.strip() for x in o["extensions"].split(",")] if "extensions" in o else DEFAULT_EXTENSIONS
        max_kb = int(o.get("max_kb", "0"))
        patterns = [p for p in map(ignore.normalise, o.get("patterns", "").split("\n")) if p]
        return TreeReader(o["path"], patterns, extensions, max_kb * 1024 if max_kb > 0 else (1 << 63) - 1, self._content(), int(o.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it (Spark's own default keeps them from Python sources)."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, root: str, patterns: Sequence[str] = (), extensions: Iterable[str] = DEFAULT_EXTENSIONS, max_kb: int = 0, content: bool = True) -> DataFrame:
    """The files that :func:`tallyglass.sources.files.walk` takes, in no order; hidden and empty ones too, links not followed."""
    register(spark)
    options = {"patterns": "\n".join(patterns), "extensions": ",".join(extensions), "max_kb": str(max_kb), "content": str(content).lower()}
    return spark.read.format("tree").options(**options).option("path", root).load()
