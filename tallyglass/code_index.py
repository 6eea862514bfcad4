"""A stored, incremental code index: identifiers, symbols, calls, types and chunks of a tree.

Files are told apart by path and digest of their content. An update reads only what changed,
writes it as one immutable segment (tombstones for what is gone) and commits; of each path
the rows of its newest segment count. Compaction rewrites the live rows as one segment.
Every file is parsed once, when it is indexed; questions are answered from the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.ids import chunk_id
from tallyglass.operators import chunk, extract, postings
from tallyglass.operators.edges import go_embeds, implemented, related
from tallyglass.operators.enclosing import enclosing
from tallyglass.segments import SegmentLog, State
from tallyglass.storage import expected_bytes, remove, stored

postings_columns = [c.strip().split(" ")[0] for c in postings.SCHEMA.split(",")]
CALLABLE = ("function", "method", "constructor")
_SYMBOLS = "path string, language string, name string, type string, start_line long, end_line long, start long, end long, container string, signature string"
TABLES = {
    "files": "path string, digest string, deleted boolean", "postings": postings.SCHEMA, "symbols": _SYMBOLS,
    "calls": "path string, language string, caller string, callee string, line long, declared long", "supers": "path string, language string, name string, parent string, line long",
    "members": "path string, language string, owner string, name string, line long, required boolean", "embeds": "path string, owner string, kind string, part string",
    "chunks": "id string, path string, start_line long, end_line long, node_type string, content string",
}


class CodeIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = postings.BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = SegmentLog(spark, path)

    # -- writing

    def update(self, files: DataFrame, batch: str | None = None, whole: bool = True, deleted: DataFrame | None = None) -> dict[str, int]:
        """Index what is new or changed in ``files`` (path, content); numbers of added or changed, and of deleted files.

        With ``whole`` the table is all there is, so that other paths are gone; without it only the paths of ``deleted`` are.
        A ``batch`` that was committed before does nothing, so a batch that is played again after a failure is in once.
        Null contents are empty texts; of rows with one path that of the greatest digest counts.
        """
        state = self.log.state()
        if batch is not None and batch in state.batches:
            return {"changed": 0, "deleted": 0}
        held: list[str] = []
        now = files.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("digest", F.sha2("content", 256))
        digests = now.groupBy("path").agg(F.max("digest").alias("digest"))
        live = self._live_files(state)
        changed = digests.join(live, ["path", "digest"], "left_anti").select("path", "digest", F.lit(False).alias("deleted"))
        gone = live.join(digests, "path", "left_anti") if whole else live.join(deleted.select("path").distinct(), "path", "left_semi") if deleted is not None else live.limit(0)
        if not whole and deleted is not None:
            gone = gone.join(digests, "path", "left_anti")
        changes = stored(changed.unionByName(gone.select("path", "digest", F.lit(True).alias("deleted"))), "index-changes", held)
        n = {r["deleted"]: r["n"] for r in changes.groupBy("deleted").agg(F.count("*").alias("n")).collect()}
        done = {"changed": n.get(False, 0), "deleted": n.get(True, 0)}
        segments = state.segments
        if n:
            fresh = now.join(changes.where("NOT deleted").select("path", "digest"), ["path", "digest"], "left_semi").dropDuplicates(["path"])
            segments = [*segments, self._segment(stored(fresh.select("path", "content"), "index-fresh", held), changes)]
        if n or batch is not None:
            self.log.commit(State(state.version, segments, [*state.batches, batch] if batch is not None else state.batches))
        remove(self.spark, held)
        return done

    def _segment(self, fresh: DataFrame, changes: DataFrame) -> str:
        name = uuid.uuid4().hex
        held: list[str] = []
        symbols = self._write(name, "symbols", extract.exploded(fresh).dropDuplicates(["path", "start", "end", "name"]))
        found = stored(related(fresh), "index-related", held)  # one parse for calls, supertypes and members
        for kind in ("calls", "supers", "members"):
            self._write(name, kind, found.select("path", "language", F.explode(kind).alias("r")).select("path", "language", "r.*"))
        self._write(name, "embeds", go_embeds(fresh, symbols))
        windows = chunk.windows(fresh)
        self._write(name, "chunks", windows.withColumn("id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"))))
        postings.write(postings.postings(fresh, self.buckets), f"{self.path}/segments/{name}/postings", expected_bytes(fresh), self.buckets)
        self._write(name, "files", changes)
        remove(self.spark, held)
        return name

    def _write(self, segment: str, table: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/segments/{segment}/{table}"
        columns = [c.strip().split(" ") for c in TABLES[table].split(",")]
        rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def compact(self, vacuum: bool = True) -> None:
        """All live rows as one segment; the old ones go, unless ``vacuum`` is false."""
        state = self.log.state()
        if not state.segments:
            return
        name = uuid.uuid4().hex
        for table in TABLES:
            rows = self._postings(state) if table == "postings" else self.rows(table, state)
            if table == "postings":  # blocks stay as they are as long as they have a live file; dead files lose their paths
                rows = rows.join(postings.paths_of(rows).select("block").distinct(), "block", "left_semi").select(*postings_columns)
                postings.write(rows, f"{self.path}/segments/{name}/postings", expected_bytes(rows), self.buckets)
            else:
                self._write(name, table, rows)
        self.log.commit(State(state.version, [name], state.batches))
        if vacuum:
            self.log.vacuum()

    # -- reading

    def _all(self, table: str, state: State) -> DataFrame:
        out = None
        for k, name in enumerate(state.segments):
            one = self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/segments/{name}/{table}").withColumn("segment", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], TABLES[table] + ", segment int") if out is None else out

    def _live_files(self, state: State) -> DataFrame:
        newest = self._all("files", state).groupBy("path").agg(F.max(F.struct("segment", "digest", "deleted")).alias("f"))
        return newest.where("NOT f.deleted").select("path", "f.digest")

    def rows(self, table: str, state: State | None = None) -> DataFrame:
        """The live rows of a table (but ``postings``): of each path those of its newest segment."""
        state = state or self.log.state()
        if table == "files":
            return self._live_files(state).withColumn("deleted", F.lit(False))
        rows = self._all(table, state)
        columns = [c.strip().split(" ")[0] for c in TABLES[table].split(",")]
        if len(state.segments) < 2:
            return rows.select(*columns)
        return rows.join(self._later(state), "path", "left").where("newest IS NULL OR segment = newest").select(*columns)

    def _postings(self, state: State | None = None) -> DataFrame:
        """All posting rows, and of the path rows those of live files."""
        state = state or self.log.state()
        rows = self._all("postings", state)
        if len(state.segments) < 2:
            return rows.select(*postings_columns)
        paths = rows.where(F.col("bucket") == postings.PATHS).join(self._later(state), F.col("token") == F.col("path"), "left").where("newest IS NULL OR segment = newest")
        return rows.where(F.col("bucket") != postings.PATHS).select(*postings_columns).unionByName(paths.select(*postings_columns))

    def _later(self, state: State) -> DataFrame:
        """What later segments changed or deleted hides earlier rows; after a compaction that is nothing."""
        return self._all("files", state).where("segment > 0").groupBy("path").agg(F.max("segment").alias("newest"))

    def occurrences(self, names: Sequence[str]) -> DataFrame:
        """token, path, line, col of every place of these identifiers; reads their buckets."""
        rows = self._postings()
        return postings.named(postings.decoded(postings.lookup(rows, names, self.buckets)), postings.paths_of(rows))

    def references(self, names: Sequence[str], scope: str = "") -> DataFrame:
        """Occurrences but the lines that declare the name; ``scope`` is a folder or file to stay in."""
        declared = self.rows("symbols").where(F.col("name").isin(list(names))).select(F.col("name").alias("token"), "path", F.col("start_line").alias("line"))
        found = self.occurrences(names).join(declared, ["token", "path", "line"], "left_anti")
        return found.where((F.col("path") == scope) | F.col("path").startswith(scope.rstrip("/") + "/")) if scope else found

    def referrers(self, names: Sequence[str], scope: str = "") -> DataFrame:
        """token, path, line, col of references, with the innermost function around each (name, start_line, end_line; null outside)."""
        found = self.references(names, scope)
        spans = self.rows("symbols").where(F.col("type").isin(*CALLABLE))
        around = enclosing(found, spans, carry=["name"])
        return found.join(around, ["path", "line"], "left").select("token", "path", "line", "col", "name", "start_line", "end_line")

    def definitions(self, name: str, files: DataFrame) -> DataFrame:
        """All declarations of a name, the first in each file, with code; only files that declare it are read."""
        own = extract.first_matches(self.rows("symbols").where(F.col("name") == name))
        code = F.expr("substring(content, CAST(start AS INT) + 1, CAST(end - start AS INT))")
        return own.join(files.select("path", "content"), "path").withColumn("code", code).drop("content").orderBy("path")

    def call_edges(self) -> DataFrame:
        """caller, callee, path, line: calls of declared names, with the place that declares the caller."""
        known = self.rows("symbols").where(F.col("type").isin(*CALLABLE, "class", "struct")).select(F.col("name").alias("callee")).distinct()
        return self.rows("calls").join(known, "callee", "left_semi").select("caller", "callee", "path", F.col("declared").alias("line")).distinct()

    def type_edges(self) -> DataFrame:
        """super, sub, path, line: named supertypes, and Go interfaces whose methods a type has, itself or by embedding."""
        return implemented(self.rows("supers"), self.rows("members"), self.rows("embeds"))

