"""Operator 10: quality classifier, a factorisation machine.

Inputs of a score, all from the text: hashed words, structure statistics and
metadata (size of the text). The machine adds to the linear terms the interactions
of all pairs of inputs through low-rank factors,

    sum over i < j of <v_i, v_j> x_i x_j  =  1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so a score takes time linear in the number of inputs of a document.

It is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``); scoring covers
every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, id_crc, lean, stored

WORD_BUCKETS = 1 << 12
RANK, BATCH = 6, 128
#: Passes over the sample: about so many rows in all, from 12 to 60 passes.
FIT_ROWS = 75_000
#: About so many labelled rows are used to fit the machine (a fraction by hash of the id; all where there are fewer).
TRAIN_ROWS = 8_000
THRESHOLD = 0.3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SYMBOLS = b"#$%&*|<>!?@^~=+_{}[]\\/"
N_STRUCTURE = 15 + len(_SYMBOLS)


def structure(text: bytes, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Statistics of a text's form; ratios are from 0 to 1, sizes logarithms."""
    n, size = max(1, len(words)), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    order = np.sort(hashes)
    distinct = 1 + int((order[1:] != order[:-1]).sum()) if len(order) else 0
    runs = int((hashes[1:] == hashes[:-1]).sum())
    pairs = len(set(zip(hashes[:-1].tolist(), hashes[1:].tolist(), strict=True))) if len(hashes) > 1 else 0
    top = int(np.unique(order, return_counts=True)[1].max()) if len(order) else 0
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    form = [
        np.log1p(len(words)) / 10, np.log1p(len(text)) / 15, size / n / 20, np.log1p(n / max(1, len(lines))) / 10,
        (len(lines) - len(set(lines))) / max(1, len(lines)), distinct / n, runs / n, (len(hashes) - 1 - pairs) / n if len(hashes) > 1 else 0.0, top / n,
        upper / max(1, upper + lower), int(counts[48:58].sum()) / size, int(counts[128:].sum()) / size, int(counts[32]) / size,
        int(counts[[44, 46, 59, 58]].sum()) / n, max(map(len, words), default=0) / size,
    ]
    return np.array(form + [min(1.0, 4 * int(counts[b]) / n) for b in _SYMBOLS], np.float32)


def inputs(text: bytes | None, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics, and buckets and values (of norm 1) of the hashed words, for a whole text."""
    text = text or b""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    hashes = tc.word_hashes(joined, *tc.bounds(joined))
    form = structure(text, words, hashes)
    if not words:
        return form, np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = np.bincount((hashes & tc.U64(buckets - 1)).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at])
    return form, at.astype(np.int32), (value / np.linalg.norm(value)).astype(np.float32)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def rows(self, form: np.ndarray, at: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of some documents as one list: index, value, and the first entry of each document."""
        k = form.shape[1]
        scaled = np.clip((form - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        index = [np.concatenate((np.arange(k), a + k)) for a in at]
        x = [np.concatenate((s, v)) for s, v in zip(scaled, value, strict=True)]
        first = np.cumsum([0] + [len(i) for i in index[:-1]])
        return np.concatenate(index), np.concatenate(x), first

    def margin(self, index: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value for each document, and its factor sums."""
        vx = self.factor[index] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(vx * vx, first, axis=0)
        return self.bias + np.add.reduceat(self.weight[index] * x, first) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        forms, at, value = zip(*(inputs(t) for t in texts), strict=True)
        margin, _ = self.margin(*self.rows(np.array(forms), list(at), list(value)))
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))


Inputs = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(rows: list[Inputs], labels: np.ndarray, rank: int = RANK, epochs: int | None = None, seed: int = 10, buckets: int = WORD_BUCKETS) -> Machine:
    """A machine from the :func:`inputs` of some texts: logistic loss, AdaGrad in small batches, a fixed seed.

    One class alone, or no rows, gives a constant score.
    """
    n = N_STRUCTURE + buckets
    rng = np.random.default_rng(seed)
    machine = Machine(np.zeros(N_STRUCTURE, np.float32), np.ones(N_STRUCTURE, np.float32), 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, rank)).astype(np.float32))
    labels = np.asarray(labels, np.float32)
    epochs = epochs or max(12, min(60, FIT_ROWS // max(1, len(labels))))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine.bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        machine.factor[:] = 0
        return machine
    forms, at, value = zip(*rows, strict=True)
    forms = np.array(forms)
    machine.mean = forms.mean(axis=0)
    machine.scale = forms.std(axis=0) + 1e-3
    g_bias, g_weight, g_factor = 1e-6, np.full(n, 1e-6, np.float32), np.full((n, rank), 1e-6, np.float32)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(labels)), 0.1 * (1 - epoch / epochs) + 0.005
        for s in range(0, len(order), BATCH):
            own = order[s : s + BATCH]
            index, x, first = machine.rows(forms[own], [at[i] for i in own], [value[i] for i in own])
            margin, sums = machine.margin(index, x, first)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
            lengths = np.diff(np.append(first, len(index)))
            e = np.repeat(error, lengths)
            used, place = np.unique(index, return_inverse=True)
            grad_w = np.bincount(place, e * x, len(used)).astype(np.float32) + 1e-4 * machine.weight[used]
            inner = x[:, None] * np.repeat(sums, lengths, axis=0) - machine.factor[index] * (x * x)[:, None]
            grad_v = np.stack([np.bincount(place, e * inner[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + 1e-4 * machine.factor[used]
            g_bias += float(error.sum()) ** 2
            machine.bias -= rate * float(error.sum()) / g_bias**0.5
            g_weight[used] += grad_w**2
            machine.weight[used] -= rate * grad_w / np.sqrt(g_weight[used])
            g_factor[used] += grad_v**2
            machine.factor[used] -= 0.5 * rate * grad_v / np.sqrt(g_factor[used])
    return machine


@F.arrow_udf(T.StructType([T.StructField("form", T.ArrayType(T.FloatType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]))
def _inputs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in tc.trimmed(batches):
        rows = [inputs(t) for t in tc.each_text(column)]
        columns = [pa.array([r[k].tolist() for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.float32(), pa.int32(), pa.float32()))]
        yield pa.StructArray.from_arrays(columns, names=["form", "at", "value"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 10) -> Machine:
    """A machine from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0/1).

    The inputs of about ``rows`` labelled rows, chosen by a hash of the id, come to the driver: 32 kB each at most, however
    long the texts. The documents themselves aren't shuffled, since the chosen ids are few and go to them.
    A document labelled twice takes the lower label.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    chosen = stored(chosen.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), "quality-labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("x", _inputs("text")).select("doc_id", F.octet_length("text").alias("n"), "quality", "x.*").toPandas()
    sample = sample.sort_values(["doc_id", "n"], kind="stable")
    found = [tuple(np.asarray(v, kind) for v, kind in zip(r, (np.float32, np.int32, np.float32), strict=True)) for r in zip(sample["form"], sample["at"], sample["value"], strict=True)]
    return fit(found, sample["quality"].to_numpy(np.float32))


def scorer(spark: SparkSession, machine: Machine):
    """A UDF from text to score."""
    machine_b = spark.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tc.trimmed(batches):
            texts = tc.as_bytes(column)
            out = [machine_b.value.score(texts[i : i + 64]) for i in range(0, len(texts), 64)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted (1 if the score is ``THRESHOLD`` or more) for each row of ``docs``.

    A null text is an empty one; both have a score. Only the text is read for it, so repeated rows score alike.
    """
    out = doc_columns(docs).withColumn("score", scorer(docs.sparkSession, machine)("text"))
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (all columns) without the rows that the machine rejects."""
    lean(docs.sparkSession)
    return docs.where(scorer(docs.sparkSession, machine)("text") >= THRESHOLD)


def learned(spark: SparkSession, docs: DataFrame, d: str) -> Machine:
    """The machine of the labelled rows that aren't held out (crc32 of the id, modulo 5, is not 0)."""
    labels = spark.read.parquet(f"{d}/labels.parquet").where(F.pmod(id_crc(), F.lit(5)) != 0)
    return train(docs, labels)


def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = scored(docs, learned(spark, docs, d))
    return out.select("doc_id", (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10}
