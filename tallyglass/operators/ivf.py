"""Inverted-file index of vectors: a coarse quantiser, inverted lists, probes.

The quantiser is spherical k-means on a bounded sample; its centres (``MAX_LISTS`` at most)
are broadcast, every vector goes to the lists of its nearest centres, and a search joins
(query, probed list) with the lists, block by block. With as many probes as lists the
result is the exact one; with fewer, some neighbours in unprobed lists are missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyglass.operators.vector_blocks import SPLIT_ROWS, best_pairs, directions, matrix, packed
from tallyglass.storage import fresh_path, remove

#: The quantiser is fitted on so many vectors at most (those of least id hash), in so many rounds.
TRAIN_ROWS, TRAIN_VALUES, ROUNDS = 1 << 16, 1 << 23, 10
#: Bound of the number of lists, and so of what is broadcast.
MAX_LISTS = 4096
#: Lists that hold each vector, and the share of all lists that a query probes. For vectors without any clusters, the worst
#: case, these give a recall of 0.9 or more; clustered ones need far fewer probes.
COPIES, PROBED = 2, 0.4


def fit(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means; begins with evenly spaced rows, and a centre without rows keeps its place."""
    rows = directions(sample)
    n_lists = max(1, min(n_lists, len(rows)))
    centres = rows[np.linspace(0, len(rows) - 1, n_lists).astype(int)] if len(rows) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        nearest = np.concatenate([(rows[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres = np.where((sums * sums).sum(axis=1, keepdims=True) > 0, directions(sums), centres)
    return centres


def near_lists(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` (id, vector) with ``list``: one row for each of the ``n`` nearest centres."""
    centres_b = rows.sparkSession.sparkContext.broadcast(centres)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())])
    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                vectors = matrix(batch.column("vector"))
                order = np.argsort(-(directions(vectors) @ centres_b.value.T), axis=1, kind="stable")[:, :n]
                which = np.repeat(np.arange(len(vectors)), order.shape[1])
                repeated = vectors[which]
                offsets = pa.array(np.arange(0, repeated.size + 1, vectors.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(repeated.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_arrow).take(pa.array(which)), lists, pa.array(order.ravel(), pa.int32())], ["id", "vector", "list"])

    return rows.select("id", "vector").where("vector IS NOT NULL").mapInArrow(run, schema)


class IvfIndex:
    """A folder with ``centres`` and segments of inverted lists, each partitioned by list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, n_lists: int | None = None, copies: int = COPIES) -> IvfIndex:
        """Index all rows of ``vectors`` (id, vector); vectors are of one length, null ones are left out."""
        rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        wanted = n_lists or max(1, round(n**0.5))
        least = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(max(1, min(TRAIN_ROWS, TRAIN_VALUES // (width or 1))))
        sample = np.array([r[0] for r in least.select("vector").collect()], np.float64).reshape(-1, width or 1)
        centres = fit(sample, min(wanted, MAX_LISTS)) if n else np.zeros((0, 1))
        rows_c = [(i, c.tolist()) for i, c in enumerate(centres)]
        remove(self.spark, [self.path])
        self.spark.createDataFrame(rows_c, "list int, vector array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        self.spark.createDataFrame([(copies, rows.schema["id"].dataType.simpleString())], "copies int, id_type string").coalesce(1).write.parquet(f"{self.path}/meta")
        return self.append(rows)

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # MAX_LISTS rows at most
        return np.array([r["vector"] for r in found])

    def append(self, vectors: DataFrame) -> IvfIndex:
        """One more segment, in the lists of the centres that are there."""
        centres = self.centres()
        if not len(centres):  # nothing was indexed so far, so the first vectors make the centres
            return self if vectors.isEmpty() else self.build(vectors, copies=self._meta()["copies"])
        listed = near_lists(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")), centres, self._meta()["copies"])
        path = fresh_path(self.spark, "ivf-listed")
        listed.write.parquet(path)
        listed = self.spark.read.schema(listed.schema).parquet(path)
        # a list of many vectors is dealt over several splits; the table of sizes has a row for each list
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("splits"))
        split = F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")
        rows = listed.join(F.broadcast(sizes), "list").select("list", split.alias("split"), "id", "vector")
        packed(rows, ["list", "split"]).write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        remove(self.spark, [path])
        return self

    def _meta(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/meta").first()

    def lists(self) -> DataFrame:
        """list, split, ids, data: the blocks of all segments."""
        return self.spark.read.schema(f"list int, split int, ids array<{self._meta()['id_type']}>, data binary").parquet(f"{self.path}/lists")

    def drop(self) -> None:
        remove(self.spark, [self.path])

    def search(self, queries: DataFrame, k: int = 10, n_probes: int | None = None) -> DataFrame:
        """query_id, id, score: about the k best for each of ``queries`` (id, vector), exactly those if all lists are probed.

        ``n_probes`` defaults to ``PROBED`` of the lists; ties fall by id; an empty index or no queries give no rows.
        """
        centres = self.centres()
        n_probes = min(len(centres), n_probes or max(1, round(len(centres) * PROBED)))
        if not len(centres):
            id_type = self._meta()["id_type"]
            return self.spark.createDataFrame([], f"query_id {id_type}, id {id_type}, score double")
        lists = self.lists()
        asked = near_lists(queries.select("id", F.col("vector").cast("array<double>").alias("vector")), centres, n_probes)
        # all queries may probe one list, so they are dealt over sixteen keys before they become blocks
        blocks = packed(asked.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")), ["list", "deal"])
        splits = lists.select("list", "split").distinct()
        return best_pairs(blocks.join(F.broadcast(splits), "list"), lists, k)  # a row for each 65,536 vectors or list
