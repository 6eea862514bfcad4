"""Life of an index: build, freshness, search, status, removal.

An index is a log that names one segment: ``chunks`` (Parquet, partitioned by language),
``meta`` (one JSON row) and, if asked for, ``ivf`` (an inverted-file index of the vectors).
A build writes a new segment and commits its name when all of it is there, so whatever
fails, and whenever, the index before it stays.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import ids, ignore, paths
from tallyglass.functions.index_state import describe, is_stale
from tallyglass.functions.languages import CHUNK_LANGUAGES, lookup
from tallyglass.functions.text import describe as describe_chunk
from tallyglass.operators.embed import Provider, embed, keyword_vector
from tallyglass.operators.extract import syntax_chunks
from tallyglass.operators.ivf import IvfIndex
from tallyglass.operators.vector_search import DEFAULT_K, top_k
from tallyglass.segments import SegmentLog, State
from tallyglass.sources.files import walk
from tallyglass.storage import exists

META = "branch string, commit_sha string, ignore_fingerprint string, indexed_at timestamp, file_count long, chunk_count long"


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = SegmentLog(spark, self.path)

    def _root(self) -> str | None:
        """The folder of the segment that counts, or none where nothing is indexed."""
        segments = self.log.state().segments
        return f"{self.path}/segments/{segments[-1]}" if segments else None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        return self._root() is not None

    def meta(self) -> DataFrame:
        """One row, or none where nothing is indexed."""
        root = self._root()
        return self.spark.createDataFrame([], META) if root is None else self.spark.read.schema(META).json(f"{root}/meta")

    def chunks(self) -> DataFrame:
        root = self._root()
        if root is None:
            raise FileNotFoundError(f"no index at {self.path}; build it first")
        return self.spark.read.parquet(f"{root}/chunks")

    def stale(self, commit: str, fingerprint: str) -> bool:
        row = self.meta().select(is_stale(F.lit(True), F.col("commit_sha"), F.col("ignore_fingerprint"), F.lit(commit), F.lit(fingerprint))).first()
        return True if row is None else bool(row[0])

    def build(
        self, files: DataFrame, commit: str = "", branch: str = "", patterns: Sequence[str] = (), provider: Callable[[], Provider] | None = None, force: bool = False, now: dt.datetime | None = None, ivf: bool = False
    ) -> bool:
        """Chunk, embed and store ``files``; False if the index is up to date and ``force`` isn't set. ``ivf`` adds inverted lists of the vectors."""
        fingerprint = ignore.fingerprint(patterns)
        if not force and not self.stale(commit, fingerprint):
            return False
        state, name = self.log.state(), uuid.uuid4().hex
        target = f"{self.path}/segments/{name}"
        chunks = syntax_chunks(walk(files, patterns))
        chunks = chunks.withColumn("id", ids.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"))).withColumn("content", ids.content_cut(F.col("content")))
        language = lookup(CHUNK_LANGUAGES, paths.extension(F.col("path")), "other")
        chunks = chunks.withColumn("language", language)
        vectors = chunks.withColumn("vector", keyword_vector(F.col("content")).cast("array<float>")) if provider is None else embed(chunks, provider)
        vectors.write.partitionBy("language").parquet(f"{target}/chunks")
        done = self.spark.read.parquet(f"{target}/chunks").agg(F.countDistinct("path").alias("file_count"), F.count("*").alias("chunk_count"))
        at = now or dt.datetime.now(dt.timezone.utc)
        meta = done.select(F.lit(branch).alias("branch"), F.lit(commit).alias("commit_sha"), F.lit(fingerprint).alias("ignore_fingerprint"), F.lit(at).alias("indexed_at"), "file_count", "chunk_count")
        meta.coalesce(1).write.json(f"{target}/meta")
        if ivf:
            IvfIndex(self.spark, f"{target}/ivf").build(self.spark.read.parquet(f"{target}/chunks").select("id", "vector"))
        self.log.commit(State(state.version, [name], []))
        self.log.vacuum()
        return True

    def append(self, chunks: DataFrame) -> None:
        """More chunks (of the stored columns), as they are: an insert, not an upsert."""
        missing = set(self.chunks().columns) - set(chunks.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        root = self._root()
        chunks.write.mode("append").partitionBy("language").parquet(f"{root}/chunks")
        if exists(self.spark, f"{root}/ivf"):
            IvfIndex(self.spark, f"{root}/ivf").append(chunks.select("id", "vector"))

    def clear(self) -> bool:
        fs, p = self._fs(self.path)
        return bool(fs.exists(p) and fs.delete(p, True))

    def search(self, query: Sequence[float], k: int = 10, languages: Sequence[str] = (), patterns: Sequence[str] = (), n_probes: int = 0) -> DataFrame:
        """Ranked hits: top k by cosine, then without ignored paths, so that fewer than k can come back.

        With ``n_probes``, and without ``languages``, only so many inverted lists are read (the index was built with ``ivf``).
        """
        rows = self.chunks()
        if languages:
            rows = rows.where(F.col("language").isin(*languages))  # prunes partitions
        if n_probes and not languages:
            asked = self.spark.createDataFrame([("", [float(x) for x in query])], "id string, vector array<double>")
            near = IvfIndex(self.spark, f"{self._root()}/ivf").search(asked, k if k > 0 else DEFAULT_K, n_probes).select("id", "score")
            hits = rows.join(F.broadcast(near), "id")  # k rows at most
        else:
            hits = top_k(rows, query, k)
        if patterns:
            hits = hits.where(~ignore.ignored(F.col("path"), patterns))
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))  # k rows at most
        return hits.select(rank.alias("rank"), "path", "start_line", "end_line", "score", describe_chunk(F.col("content"), F.col("node_type")).alias("description"), "content", "language")

    def status(self, commit: str = "", fingerprint: str = "", now: dt.datetime | None = None) -> DataFrame:
        """The stored metadata and a sentence on its state; one row in any case."""
        at = F.lit(now or dt.datetime.now(dt.timezone.utc))
        one = self.spark.range(1).join(self.meta().withColumn("__has", F.lit(True)), F.lit(True), "left")
        seconds = F.unix_timestamp(at) - F.unix_timestamp("indexed_at")
        text = describe(F.col("__has").isNotNull(), seconds, F.col("file_count"), F.col("chunk_count"), F.col("commit_sha"), F.col("ignore_fingerprint"), F.lit(commit), F.lit(fingerprint))
        return one.select("branch", "commit_sha", "indexed_at", "file_count", "chunk_count", text.alias("state"))
