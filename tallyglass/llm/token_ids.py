"""Operator 5: token ids as Huffman-coded files.

Documents are dealt into ranges of ascending ids and tokenized there; a task gathers
its ids into *blocks* and counts them. The counts of all tasks are added up (a row
for each id of the vocabulary), one canonical length-limited code is made of them,
and every block is coded on its own, with a bit offset for every 256th id.

A dataset is a folder with ``blocks`` (Parquet: part, block, start_in_part, doc_ids,
n_tokens, payload; the payload is a block of :mod:`tallyglass.llm.huffman`) and
``code`` (a row for each id with a code: id, bits). Blocks in order of part and block
hold the documents in ascending order of id; any of them can be decoded alone, and
any stretch of one from its nearest checkpoint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import huffman, tokens
from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, partitions_for, released, scratch

TOKENIZER, END_ID = "word_bpe_49k.json", 1
BLOCK_IDS = 1 << 18
PART_BYTES = 8 << 20


def _block_schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start_in_part", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
        ]
    )


def _id_blocks(docs: DataFrame, tokenizer: str | None, end_id: int, block_ids: int, dtype: str) -> DataFrame:
    """Blocks of plain ids (``dtype``) of sorted documents; block -1 of a part: its counts by id (64-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = tokens.encoder(tokenizer or tokens.public_path(TOKENIZER), dtype)
        end = np.array([end_id], dtype).tobytes()
        counts = np.zeros(0, np.int64)
        block = start = held = 0
        owners, sizes, texts = [], [], []

        def row(number, docs, n, payload):
            values = pa.concat_arrays(docs) if docs else pa.array([], id_type)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (values, pa.array(n, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), *lists, pa.array([payload], pa.binary())], names)

        names, id_type = ["part", "block", "start_in_part", "doc_ids", "n_tokens", "payload"], None
        for batch in tc.slices(tc.trimmed(batches)):
            column = batch.column("doc_id")
            id_type = column.type
            encoded, counts_of = encoder.encode_all(tc.as_bytes(batch.column("text")))
            data, at = encoded.tobytes(), 0
            for d, n_ids in enumerate(counts_of.tolist()):
                ids = data[at : at + n_ids * len(end)] + end
                at += n_ids * len(end)
                owners.append(column.slice(d, 1))
                sizes.append(len(ids) // len(end))
                texts.append(ids)
                held += sizes[-1]
                if held >= block_ids:
                    payload = b"".join(texts)
                    more = np.bincount(np.frombuffer(payload, dtype), minlength=len(counts))
                    more[: len(counts)] += counts
                    counts = more
                    yield row(block, owners, sizes, payload)
                    block, start, held = block + 1, start + held, 0
                    owners, sizes, texts = [], [], []
        if texts:
            payload = b"".join(texts)
            more = np.bincount(np.frombuffer(payload, dtype), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
            yield row(block, owners, sizes, payload)
        if id_type is not None:
            yield row(-1, [], [], counts.astype("<i8").tobytes())

    return docs.mapInArrow(run, _block_schema(docs.schema["doc_id"].dataType))


def _counts(rows: DataFrame) -> np.ndarray:
    """Global counts by id: partial sums in each task, then one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                own = np.frombuffer(payload, "<i8").copy()
                short, long = sorted((total, own), key=len)
                long[: len(short)] += short
                total = long
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = rows.where("block = -1").select("payload").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, max_bits: int = huffman.MAX_BITS) -> None:
    """Tokenize ``docs`` and write a dataset at ``path``.

    Null texts are empty, null ids come first, documents of equal id follow in order of their text's hash.
    A document is never cut; one longer than a block makes a longer block. An empty table makes an empty dataset.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs)
    tie = F.xxhash64("text")
    parts = partitions_for(docs, PART_BYTES, least=2)
    ranged = docs.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    dtype = tokens.id_type(tokenizer or tokens.public_path(TOKENIZER))
    plain = released(_id_blocks(ranged, tokenizer, end_id, block_ids, dtype), "plain-ids", compression="zstd")
    codec = huffman.limited(_counts(plain), max_bits)
    lengths = [(i, int(n)) for i, n in enumerate(codec.lengths) if n]
    spark.createDataFrame(lengths, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    lengths_b = spark.sparkContext.broadcast(codec.lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        coder = huffman.Codec(lengths_b.value)
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                coded = coder.encode(np.frombuffer(own.column("payload")[0].as_py(), dtype))
                yield pa.RecordBatch.from_arrays([*own.columns[:5], pa.array([coded], pa.binary())], own.schema.names)

    plain.where("block >= 0").mapInArrow(run, plain.schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_codec(spark: SparkSession, path: str) -> huffman.Codec:
    """The code of a dataset (a row for each id of the vocabulary at most)."""
    code = spark.read.schema("id int, bits int").parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 0, np.uint8)
    lengths[code["id"].to_numpy(np.int64)] = code["bits"].to_numpy(np.uint8)
    return huffman.Codec(lengths)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``, array of int) of every document, decoded from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType
    lengths_b = spark.sparkContext.broadcast(read_codec(spark, path).lengths)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32")]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        coder = huffman.Codec(lengths_b.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = coder.decode(batch.column("payload")[i].as_py())
                n = batch.column("n_tokens")[i].values.to_numpy()
                owners = batch.column("doc_ids")[i].values
                end = np.cumsum(n)
                if int(end[-1]) != len(ids):
                    raise ValueError("a block's ids don't match its documents")
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                out = [owners, pa.array(np.full(len(n), batch.column("part")[i].as_py(), np.int32)), pa.array(end - n + batch.column("start_in_part")[i].as_py()), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, schema.fieldNames())

    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    found = blocks.mapInArrow(run, schema).join(before, "part")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op5(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_ids(spark.read.parquet(f"{d}/documents.parquet"), path)
    return read_ids(spark, path)


QUERIES = {"op5_token_ids": op5}
