"""Operator 7: SimHash near-dedup by bit-sliced comparison.

Fingerprints: 64 bits over the XXH64 hashes of word shingles. Candidates: two
fingerprints that differ in at most r bits agree on ``parts - r`` of ``parts`` bit
groups at least, so every choice of that many groups is a table, and the bits in
them its key. Within a key the fingerprints are stored as vertical bit planes; 64
distances are updated at once with carry-save counters, plane by plane, and words
in which every lane is beyond the radius are abandoned.

Equal fingerprints are one node. Of a key only the edges of a spanning star for each
linked set leave the task, never all pairs. In a key with more than ``HOT_KEY``
fingerprints the bits outside the key are grouped in the same way, so each gets six
narrower keys; only what is hot even then is cut into chunks, and pairs of chunks are
compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, key_filter, scratch, stored, temporary, whole_rows
from tallyglass.llm.graph import components
from tallyglass.llm.xx64 import xxh64

U = np.uint64
SHINGLE, RADIUS, SEED, PARTS = 3, 2, 42, 4
HOT_KEY = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = U(0x0101010101010101)


def shingle_hashes(texts: list[bytes | None], shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of some texts, one text after another, and how many each has."""
    joined = [b" ".join(t.translate(_LOWER).split()) if t else b"" for t in texts]
    starts, ends, counts, base = [], [], np.zeros(len(texts), np.int64), 0
    for i, j in enumerate(joined):
        if j:
            s, e = tc.bounds(j)
            k = min(shingle, len(s))
            counts[i] = len(s) - k + 1
            starts.append(s[: counts[i]] + base)
            ends.append(e[k - 1 :] + base)
        base += len(j) + 1
    if not starts:
        return np.zeros(0, np.uint64), counts
    return xxh64(b"\n".join(joined), np.concatenate(starts), np.concatenate(ends), seed), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that are set in more than half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    pieces = -(-n // 255)  # byte lanes hold sums of 255 bits
    owner_start = np.cumsum(pieces) - pieces
    cuts = np.repeat(first - 255 * owner_start, pieces) + 255 * np.arange(int(pieces.sum()))
    votes = np.empty((len(cuts), 8, 8), np.int64)
    for b in range(8):
        votes[:, :, b] = np.add.reduceat((hashes >> U(b)) & _LANES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.add.reduceat(votes.reshape(-1, 64), owner_start, axis=0)
    out[full] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    return majority(*shingle_hashes(texts, shingle, seed))


def _fingerprint_column(shingle: int, seed: int):
    @F.arrow_udf(T.LongType())
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tc.trimmed(batches):
            texts, out, i = tc.as_bytes(column), [], 0
            while i < len(texts):  # a megabyte or one text at a time
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or b"") < 1 << 20):
                    size += len(texts[j] or b"")
                    j += 1
                out.append(simhash(texts[i:j], shingle, seed))
                i = j
            yield pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), pa.int64())

    return fingerprint


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """``planes[j, w]``: bit j of the 64 prints of word w. ``prints`` has a row of 64-bit words each, 64 rows to a word."""
    bits = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: sum and carry of three bits in each lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_masks(query: np.ndarray, word: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, word of 64 lanes): the lanes within ``radius`` bits. ``query`` has a row of 64-bit words each.

    Distances are counted by carry-save adders, eight planes at a time: ones, twos and fours are kept as planes, and
    the eights are added to a counter that begins so far below its end that it overflows in lanes beyond the radius.
    Entries in which all lanes are beyond it are abandoned after each eight planes.
    """
    out = np.zeros(len(query), np.uint64)
    live, full = np.arange(len(query)), ~U(0)
    digits = (radius // 8 + 1).bit_length()
    start = (1 << digits) - (radius // 8 + 1)
    low = [np.zeros(len(query), np.uint64) for _ in range(3)]
    high = [np.full(len(query), full if start >> k & 1 else U(0)) for k in range(digits)]
    over = ~valid[word]
    for j in range(0, len(planes), 8):
        own = query[:, j // 64]
        x = [planes[j + k][word] ^ (U(0) - ((own >> U(j % 64 + k)) & U(1))) for k in range(8)]
        low[0], two = _add(low[0], x[0], x[1])
        low[0], more = _add(low[0], x[2], x[3])
        low[1], four = _add(low[1], two, more)
        low[0], two = _add(low[0], x[4], x[5])
        low[0], more = _add(low[0], x[6], x[7])
        low[1], more = _add(low[1], two, more)
        low[2], carry = _add(low[2], four, more)
        for k in range(digits):
            high[k], carry = high[k] ^ carry, high[k] & carry
        over |= carry
        keep = over != full
        if not keep.all():
            live, query, word, over = live[keep], query[keep], word[keep], over[keep]
            low, high = [c[keep] for c in low], [c[keep] for c in high]
            if not len(live):
                return out
    out[live] = ~(over | _above(low + high, 8 * start + radius))
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is more than ``radius``."""
    more, equal = np.zeros(len(counters[0]), np.uint64), np.full(len(counters[0]), ~U(0))
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more


def _stars(members: np.ndarray, masks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning stars of the linked sets among ``members`` (masks: rows of words of lanes)."""
    m = len(members)
    todo = np.ones(m, bool)
    for s in range(m):
        if not todo[s]:
            continue
        todo[s] = False
        frontier = np.array([s])
        while len(frontier):
            reach = np.bitwise_or.reduce(masks[frontier], axis=0)
            near = np.flatnonzero(np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little")[:m].astype(bool) & todo)
            todo[near] = False
            for x in near.tolist():
                yield int(members[x]), int(members[s])
            frontier = near


def bucket_links(key: np.ndarray, prints: np.ndarray, radius: int, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Star edges (as places) within each run of equal ``key`` (sorted); ``most`` bounds the words compared at once.

    ``prints`` has a row of 64-bit words for each key.
    """
    cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(key)))
    wanted = [(int(a), int(m)) for a, m in zip(cuts, sizes, strict=True) if m > 1]
    i = 0
    while i < len(wanted):
        j, total = i, 0
        while j < len(wanted) and (j == i or total + wanted[j][1] * -(-wanted[j][1] // 64) <= most):
            total += wanted[j][1] * -(-wanted[j][1] // 64)
            j += 1
        yield from _compare(wanted[i:j], prints, radius, most)
        i = j


def _compare(buckets: list[tuple[int, int]], prints: np.ndarray, radius: int, most: int) -> Iterator[tuple[int, int]]:
    lanes = np.concatenate([np.arange(a, a + -(-m // 64) * 64) for a, m in buckets])
    real = np.concatenate([np.arange(-(-m // 64) * 64) < m for _, m in buckets])
    planes = bit_planes(prints[np.minimum(lanes, len(prints) - 1)])
    valid = np.packbits(real, bitorder="little").view("<u8")
    word, queries, words = 0, [], []
    for a, m in buckets:
        w = -(-m // 64)
        queries.append(np.repeat(np.arange(a, a + m), w))
        words.append(np.tile(np.arange(word, word + w), m))
        word += w
    query, words = np.concatenate(queries), np.concatenate(words)
    masks = np.concatenate([near_masks(prints[query[i : i + most]], words[i : i + most], planes, valid, radius) for i in range(0, len(query), most)])
    at = 0
    for a, m in buckets:
        w = -(-m // 64)
        own = masks[at : at + m * w].reshape(m, w)
        at += m * w
        if int(np.bitwise_count(own).sum()) > m:  # more than each with itself
            yield from _stars(np.arange(a, a + m), own)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by ``key``, in batches that don't cut a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[0].column("key")[0].as_py() != key[0]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            fp = batch.column("fp").to_numpy()
            edges = list(bucket_links(batch.column("key").to_numpy(), fp.view(np.uint64)[:, None], radius))
            if edges:
                u, v = (pa.array(fp[list(c)]) for c in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return link


def fingerprint_edges(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges u, v that connect exactly the fingerprints (distinct longs ``fp``) within ``radius`` bits of each other."""
    width = 64 // parts
    tables = list(combinations(range(parts), parts - radius))
    part = lambda p: F.shiftrightunsigned("fp", p * width).bitwiseAND((1 << width) - 1)

    def table_key(t: int, chosen: tuple[int, ...]):
        key = F.lit(t).cast("long")
        for p in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part(p))
        return key

    if width * (parts - radius) > 56 or 64 % parts or width * radius % parts:
        raise ValueError("a table's key must fit 56 bits; parts must divide 64 and the bits outside a key")
    keyed = fps.select("fp", F.explode(F.array(*[table_key(t, c) for t, c in enumerate(tables)])).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key", F.lit(True).alias("hot"))
    marked = keyed.join(hot, "key", "left")
    # of a hot key, the bits outside it are cut into parts again: those within the radius agree on all but ``radius`` of them
    rest = [[q for q in range(parts) if q not in c] for c in tables]
    narrow = width * radius // parts
    fine = F.lit(0).cast("long")
    for t, free in enumerate(rest):
        bits = F.lit(0).cast("long")
        for q in free:
            bits = F.shiftleft(bits, width).bitwiseOR(part(q))
        fine = F.when(F.shiftrightunsigned("key", width * (parts - radius)) == t, bits).otherwise(fine)
    piece = lambda p: F.shiftrightunsigned("rest", p * narrow).bitwiseAND((1 << narrow) - 1)
    subs = F.array(*[F.xxhash64("key", F.lit(t), *[piece(p) for p in c]) for t, c in enumerate(tables)])
    cool = marked.where("hot IS NULL").select("key", "fp")
    split = marked.where("hot").withColumn("rest", fine).select(F.explode(subs).alias("key"), "fp")
    # sub-keys that are hot still are cut into chunks; a pair of chunks is a key of its own
    sizes = split.groupBy("key").agg(F.ceil(F.count("*") / hot_key).cast("int").alias("chunks"))
    chunked = split.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")))
    dealt = cool.unionByName(chunked.select(pair.alias("key"), "fp")).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links(radius), "u long, v long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """doc_id, text_hash, fp (long), root (long; the same for linked rows) and component_id for each row of ``docs``.

    * Letters A-Z are lower-cased; words are runs of anything but ASCII white space; fewer words than a
      shingle are one shingle; a text without words (null, empty, white space) has fingerprint 0, which links like any other.
    * component_id is the least doc_id of the component (null if all its ids are null).
    * Repeated rows have equal fingerprints and so one component; an empty table gives no rows; other columns are ignored.
    """
    docs = doc_columns(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _fingerprint_column(shingle, seed)("text").alias("fp"))
    rows = stored(rows, "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "fingerprint-nodes")
    found = components(fingerprint_edges(nodes.select("fp"), radius, parts))
    labelled = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labelled.select("fp", "root").join(roots, "root")
    return rows.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` (all columns) with one row of each group: the one of least doc_id (then text hash).

    ``grouped`` gives doc_id, text_hash and root of the rows; :func:`near_groups` unless named. What it stores on the
    way is removed once it is known which rows stay. Only rows that may go are shuffled; the others pass by.
    Rows that are equal in id and text are one. Null ids come last, null texts are a text of their own.
    """
    spark = docs.sparkSession
    path = scratch(spark, "near-dedup-open")
    with temporary(spark):
        groups = (grouped or near_groups)(docs)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k")
        sizes = stored(groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "near-groups")
        best = sizes.groupBy("root").agg(first, F.sum("n").alias("m")).where("m > 1").select(F.col("root").alias("r"), "k")
        stays = (F.col("text_hash") == F.col("k.text_hash")) & F.col("doc_id").eqNullSafe(F.col("k.doc_id"))
        sizes.join(best, F.col("root") == F.col("r")).select("doc_id", "text_hash", "n", stays.alias("stays")).where("NOT stays OR n > 1").write.parquet(path)
    open_ = spark.read.parquet(path)
    place = lambda i, h: F.xxhash64(i, h)
    rows = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("maybe", key_filter(open_.select(place("doc_id", "text_hash").alias("key")))(place("i", "h")))
    judged = rows.where("maybe").join(open_, (F.col("h") == open_.text_hash) & F.col("i").eqNullSafe(open_.doc_id), "left").where("coalesce(stays, true)")
    if not open_.where("stays AND n > 1").isEmpty():  # rows that are equal in id and text: one stays
        judged = judged.where("n IS NULL").select("row").unionByName(judged.where("n > 1").dropDuplicates(["i", "h"]).select("row"))
    return rows.where("NOT maybe").select("row").unionByName(judged.select("row")).select("row.*")


def op7(spark: SparkSession, d: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{d}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7}
