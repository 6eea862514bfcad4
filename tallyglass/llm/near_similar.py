"""Near duplicates by similarity of word shingles, found by SimHash.

The general form of operator 7 for stages that go by similarity: two texts are linked
if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

1. Each row gets the keys of ``BANDS`` bands of four minimum hashes each (a pair of
   similarity 0.8 misses all bands once in 30,000); equal sets are one node. Texts stay where they are.
2. Nodes that share a key get a SimHash of ``BITS`` bits and their shingle set; only their
   texts are shuffled. In each key the SimHashes are compared bit-sliced; the spanning
   stars of those within ``RADIUS`` bits make groups.
3. The sets of a group meet in one task, each set once, and links are verified on them.
   A group of more than ``CELL_BYTES`` of sets is cut into chunks that are verified on
   their own first; what then is not in the group's largest component is compared
   with every chunk, so no link is left out and copies don't cost their square.

A pair of similarity 0.8 has SimHashes that differ in 78 of 512 bits, with a deviation of
8 (96 and 9 where a set has few shingles), so that it passes ``RADIUS`` but once in 10**8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, key_filter, released, scratch, stored, temporary
from tallyglass.llm.graph import components
from tallyglass.llm.simhash import _LOWER, bucket_links, majority, whole_keys

U = np.uint64
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
BITS, RADIUS = 512, 150
#: Nodes of a key that are compared in one task; bytes of sets that are verified in one task.
HOT_KEY, CELL_BYTES = 2048, 8 << 20
#: Entries (node, 64 others) that are compared at once.
AT_ONCE = 1 << 17
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_C = _rng.integers(1, 2**63, BITS // 64, dtype=np.uint64)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; fewer words than a shingle are one shingle."""
    parts = text.translate(_LOWER).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    hashes = tc.word_hashes(joined, *tc.bounds(joined))
    return np.unique(tc.window_hashes(hashes, min(words, len(parts))))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, ~U(0))
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048]
        np.minimum(low, (part[:, None] * _A + _B).min(axis=0), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = tc.mix(key * U(0x9E3779B97F4A7C15) + low[r::ROWS])
    return key


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set: ``BITS`` bits as 64-bit words, a word for each of some hash functions."""
    out = np.zeros((BITS // 64, 1), np.uint64)
    for i in range(len(out)):
        out[i] = majority(tc.mix(hashes ^ _C[i]), np.array([len(hashes)]))
    return out.ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


_KEYS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_SETS = T.StructType([T.StructField("sketch", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def _keys(words: int):
    @F.arrow_udf(_KEYS)
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tc.trimmed(batches):
            node, n, found = [], [], []
            for text in tc.each_text(column):
                s = shingle_set(text, words)
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                n.append(len(s))
                found.append(band_keys(s).view(np.int64).tolist() if len(s) else [])
            columns = [pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, names=_KEYS.fieldNames())

    return keys


def _sets(words: int):
    @F.arrow_udf(_SETS)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tc.trimmed(batches):
            found = [shingle_set(text, words) for text in tc.each_text(column)]
            columns = [pa.array([sketch(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=_SETS.fieldNames())

    return sets


def _sorted_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """The rows of each run of equal first column, as lists by column."""
    held: list[list] | None = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held is not None and held[0][0] != row[0]:
                yield held
                held = None
            if held is None:
                held = [[] for _ in columns]
            for c, v in zip(held, row, strict=True):
                c.append(v)
    if held is not None:
        yield held


def _edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    u, v = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


_EDGES = "u binary, v binary"


def _near_in_keys(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            prints = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            edges = list(bucket_links(batch.column("key").to_numpy(), prints, radius, AT_ONCE))
            if edges:
                u, v = (batch.column("node").take(pa.array(c)) for c in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return run


def near_edges(nodes: DataFrame, sketches: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges u, v between nodes (node, key; one row for each key that they share) that connect those within ``radius`` bits.

    ``sketches`` has node and sketch. A key of more than ``hot_key`` nodes is cut into chunks; pairs of chunks are compared in tasks of their own.
    """
    sizes = nodes.groupBy("key").agg(F.ceil(F.count("*") / hot_key).cast("int").alias("chunks"))
    chunked = nodes.join(sizes, "key").join(sketches, "node").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunked = chunked.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")))
    dealt = chunked.select(pair.alias("key"), "node", "sketch").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_near_in_keys(radius), _EDGES).distinct()


class _Cell:
    """The sets of one task."""

    def __init__(self, sketches: list[bytes], sets: list[bytes], least: float, radius: int):
        self.least, self.radius = least, radius
        self.sketches = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sets), -1)
        self.sizes = np.array([len(s) // 8 for s in sets])
        ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1].astype(np.int32)
        self.ends = np.cumsum(self.sizes)
        self.ids, self.marked = ids, np.zeros(len(ids) + 1, np.uint8)

    def own(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are linked to ``i``: by size and SimHash first, then on the sets."""
        n = self.sizes[others]
        others = others[np.minimum(n, self.sizes[i]) >= self.least * np.maximum(n, self.sizes[i])]  # no similarity is above this
        others = others[np.bitwise_count(self.sketches[others] ^ self.sketches[i]).sum(axis=1) <= self.radius]
        if not len(others):
            return others
        self.marked[self.own(i)] = 1
        n = self.sizes[others]
        common = np.add.reduceat(self.marked[np.concatenate([self.own(j) for j in others.tolist()])], np.cumsum(n) - n, dtype=np.int64)
        self.marked[self.own(i)] = 0
        return others[common / (n + self.sizes[i] - common) >= self.least]

    def hub(self) -> int:
        """The node nearest to the bitwise majority."""
        bits = np.unpackbits(self.sketches.view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits), bitorder="little").view(np.uint64)
        return int(np.bitwise_count(self.sketches ^ middle).sum(axis=1).argmin())


def cell_links(cell: _Cell) -> Iterator[tuple[int, int]]:
    """Links that join the components of a cell. The hub's links come first; pairs of nodes that it links need no check."""
    m = len(cell.sizes)
    label = np.arange(m)
    hub = cell.hub()
    star = cell.linked(hub, np.flatnonzero(label != hub))
    yield from ((hub, j) for j in star.tolist())
    label[star] = hub
    joined = label == hub
    before = joined.copy()
    for i in np.flatnonzero(~joined).tolist():
        for j in cell.linked(i, np.flatnonzero(before & (label != label[i]))).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, j
        before[i] = True


def _cells(least: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, sketches, sets in _sorted_groups(batches, ["cell", "node", "sketch", "shingles"]):
            place = list({n: i for i, n in enumerate(node)}.values())  # equal rows of a table are one node
            if len(place) > 1:
                cell = _Cell([sketches[i] for i in place], [sets[i] for i in place], least, radius)
                edges = [(node[place[a]], node[place[b]]) for a, b in cell_links(cell)]
                if edges:
                    yield _edge_batch(edges)

    return run


def _grid(least: float, radius: int):
    """Rows with ``turn`` are compared with the others of the cell that have another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, sketches, sets, label, turn in _sorted_groups(batches, ["cell", "node", "sketch", "shingles", "label", "turn"]):
            if all(turn) or not any(turn):
                continue
            cell = _Cell(sketches, sets, least, radius)
            _, labels = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
            other = ~np.array(turn)
            edges = []
            for i in np.flatnonzero(~other).tolist():
                for j in cell.linked(i, np.flatnonzero(other & (labels != labels[i]))).tolist():
                    if labels[j] != labels[i]:
                        labels[labels == labels[j]] = labels[i]
                        edges.append((node[i], node[j]))
            if edges:
                yield _edge_batch(edges)

    return run


def _by_cell(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("cell", "node", "sketch", "shingles", *columns).repartition("cell").sortWithinPartitions("cell", "node")


def verified_components(sets: DataFrame, groups: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """node, root of the nodes that are linked to others of their group, by the sets.

    ``sets`` has node, sketch and shingles, ``groups`` node and root.
    """
    chunks = lambda size: F.greatest(F.ceil(size / cell_bytes), F.lit(1)).cast("int")
    rows = sets.join(groups, "node")
    sizes = stored(rows.groupBy("root").agg(chunks(F.sum(F.octet_length("shingles"))).alias("chunks")), "group-sizes")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("own")
    rows = rows.join(sizes, "root").select("root", "chunks", own, "node", "sketch", "shingles")
    edges = released(_by_cell(rows.withColumn("cell", F.xxhash64("root", "own"))).mapInArrow(_cells(least, radius), _EDGES), "verified")
    labels = components(edges)
    if sizes.where("chunks > 1").isEmpty():
        return labels
    # large groups: one node of the largest component of each chunk is compared with those of other chunks
    large = rows.where("chunks > 1").join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = released(large, "large-groups")
    counts = large.groupBy("root", "own", "label").agg(F.count("*").alias("n"), F.min("node").alias("one"))
    first = counts.groupBy("root", "own").agg(F.max_by("one", F.struct("n", "label")).alias("node")).select("node")
    middles = large.join(first, "node", "left_semi").withColumn("cell", F.xxhash64("root"))
    edges = edges.unionByName(released(_by_cell(middles).mapInArrow(_cells(least, radius), _EDGES), "verified-middles"))
    labels = components(edges)
    # what is outside a group's largest component is compared with all that have another label
    large = large.drop("label").join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = stored(large.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("size")), "group-labels")
    main = counts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = counts.join(main, "root").where("label != main")
    if rest.isEmpty():
        return labels
    columns = rest.groupBy("root").agg(chunks(F.sum("size")).alias("columns"))
    open_ = large.join(columns, "root").join(main, "root")
    cell = F.xxhash64("root", "row", "column")
    all_ = open_.withColumn("row", F.col("own")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("turn", F.lit(False))
    turns = open_.where("label != main").withColumn("column", F.pmod(F.xxhash64("node"), F.col("columns")).cast("int"))
    turns = turns.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("turn", F.lit(True))
    both = all_.unionByName(turns.select(all_.columns)).withColumn("cell", cell)
    more = released(_by_cell(both, "label", "turn").mapInArrow(_grid(least, radius), _EDGES), "verified-rest")
    return components(edges.unionByName(more))


def near_groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, root for each row of ``docs``; linked rows share a root.

    Letters A-Z are lower-cased. Texts without words are alike; repeated rows are alike; an empty table gives no rows.
    """
    docs = doc_columns(docs).withColumn("text_hash", F.xxhash64("text"))
    spark = docs.sparkSession
    path = scratch(spark, "similar-groups")
    with temporary(spark):
        rows = stored(docs.select("doc_id", "text_hash", _keys(words)("text").alias("f")).select("doc_id", "text_hash", "f.*"), "similar-rows")
        nodes = rows.groupBy("node").agg(F.min_by(F.struct("doc_id", "text_hash", "keys"), F.xxhash64("doc_id", "text_hash")).alias("f"))
        nodes = stored(nodes.select("node", "f.*"), "similar-nodes")
        keyed = nodes.select("node", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        shared = stored(shared, "similar-shared")
        keyed = released(keyed.where(key_filter(shared)(F.col("key"))).join(shared, "key"), "similar-keys")
        wanted = stored(nodes.select("node", "doc_id", "text_hash").join(keyed.select("node").distinct(), "node", "left_semi"), "similar-wanted")
        place = F.xxhash64("doc_id", "text_hash")
        texts = docs.where(key_filter(wanted.select(place.alias("key")))(place))
        same = (texts.text_hash == wanted.text_hash) & texts.doc_id.eqNullSafe(wanted.doc_id)
        sets = texts.join(wanted, same).select(wanted.node, _sets(words)(texts.text).alias("f")).select("node", "f.*")
        sets = released(sets, "similar-sets")
        groups = components(released(near_edges(keyed, sets.select("node", "sketch")), "near-edges"))
        found = verified_components(sets, groups, least)
        rows.join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")).write.parquet(path)
    return spark.read.parquet(path)
