"""Vectors in blocks: matrices of one group that are multiplied block by block.

A vector table becomes rows of (group, split, ids, matrix). Groups of more than
``SPLIT_ROWS`` vectors are dealt over several splits, so a large group is many join
keys; the other side's blocks go to every split of their group. A pair of blocks is one
row for one matrix product, which gives k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a block, and about how many vectors of a group share a join key.
BLOCK, SPLIT_ROWS = 1024, 1 << 16


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def directions(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay zero."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.where(norm == 0, 0.0, rows / np.where(norm == 0, 1.0, norm))


def packed(rows: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``keys``, ids, data: the vectors (id, vector) of each key in blocks of at most ``size`` rows of doubles."""
    id_type = rows.schema["id"].dataType
    arrow = [pa.field(k, to_arrow_type(rows.schema[k].dataType)) for k in keys] + [pa.field("ids", pa.list_(to_arrow_type(id_type))), pa.field("data", pa.binary())]
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, ids, np.concatenate(parts).tobytes()), arrow, strict=True)], schema=pa.schema(arrow))

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            own, values, i = batch.column("id").to_pylist(), matrix(batch.column("vector")), 0
            while i < len(marks):
                if key is not None and (marks[i] != key or len(ids) >= size):
                    yield block()
                    key, ids, parts = None, [], []
                j, key = i, marks[i]
                while j < len(marks) and marks[j] == key and len(ids) + j - i < size:
                    j += 1
                ids += own[i:j]
                parts.append(values[i:j])
                i = j
        if ids:
            yield block()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "id", "vector").mapInArrow(run, schema)


def best_pairs(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best vectors by cosine, ties by id, for each query, over pairs of blocks of equal (list, split).

    Both sides are :func:`packed` by list and split. A vector may be in several lists and counts once.
    """
    id_type = vectors.schema["ids"].dataType.elementType
    query_type = queries.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([pa.field("query_id", to_arrow_type(query_type)), pa.field("id", to_arrow_type(id_type)), pa.field("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, ids = (np.array(batch.column(c)[i].as_py()) for c in ("query_ids", "ids"))
                left, right = (directions(np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(len(n), -1)) for c, n in (("query_data", query_ids), ("data", ids)))
                scores = np.round(left @ right.T, 6)
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                n = order.shape[1]
                columns = np.repeat(query_ids, n), ids[order].ravel(), np.take_along_axis(scores, order, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype.kind in "UO" else c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    pairs = queries.select("list", "split", F.col("ids").alias("query_ids"), F.col("data").alias("query_data")).join(vectors, ["list", "split"])
    # each pair is some megabytes in a row, so few go to Python at once
    found = pairs.drop("list", "split").mapInArrow(run, schema)
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
