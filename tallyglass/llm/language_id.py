"""Operator 6: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds the
permuted letter vectors (rotated by two places, by one, by none) by multiplication;
a document bundles, that is adds up, the vectors of its trigrams; a language's
prototype bundles the directions of its training documents. A document is given the
language whose prototype, less the mean of all prototypes, has the greatest cosine.

Vectors of letters come from a generator seeded by the code point, so workers agree
without sharing a table. Bundling is a matrix product of trigram counts and trigram
vectors, taken for some megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, id_crc

DIMENSIONS = 1024
SEED = 6
#: About so many labelled rows are used to fit the prototypes (a fraction by hash of the id; all where there are fewer).
TRAIN_ROWS = 30_000
UNKNOWN = "und"
_TRIGRAMS_AT_ONCE = 8192
#: Prototypes are rounded to whole numbers of this fraction.
MODEL_SCALE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        """The vector of a code point; 0 stands for what is between words."""
        if code not in self._letters:
            if len(self._letters) > 50_000:
                self._letters.clear()
            self._letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self._letters[code]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of its trigram vectors; a zero row where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        parts, owners = [], []
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(_is_letter()[codes], codes, 0)
            if not codes.any():
                continue
            codes = np.concatenate(([0], codes, [0]))
            codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]  # one mark between words
            parts.append(codes)
            owners.append(np.full(len(codes), i))
        if not parts:
            return out
        codes, owner = np.concatenate(parts), np.concatenate(owners)
        alphabet, symbol = self._dense(codes)
        k = len(alphabet)
        tri = (symbol[:-2] * k + symbol[1:-1]) * k + symbol[2:]
        inside = owner[:-2] == owner[2:]
        tri, owner = tri[inside], owner[:-2][inside]
        if k**3 <= 1 << 22:
            known = np.flatnonzero(np.bincount(tri, minlength=k**3))
            place = np.zeros(k**3, np.int64)
            place[known] = np.arange(len(known))
            tri = place[tri]
        else:
            known, tri = np.unique(tri, return_inverse=True)
        vectors = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
        order = None
        if len(known) > _TRIGRAMS_AT_ONCE:
            order = np.argsort(tri, kind="stable")
            tri, owner = tri[order], owner[order]
        for a in range(0, len(known), _TRIGRAMS_AT_ONCE):
            ids = known[a : a + _TRIGRAMS_AT_ONCE]
            own, who = tri, owner
            if order is not None:
                i, j = np.searchsorted(tri, (a, a + len(ids)))
                own, who = tri[i:j] - a, owner[i:j]
            counts = np.bincount(who * len(ids) + own, minlength=len(texts) * len(ids)).reshape(len(texts), -1).astype(np.float32)
            bound = first[ids // (k * k)] * second[ids // k % k] * vectors[ids % k]
            out += counts @ bound.astype(np.float32)
        return out

    @staticmethod
    def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, place[codes]


def _text_slices(texts: list[bytes | None], size: int = 1 << 20, most: int = 256) -> Iterator[list[str]]:
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and j - i < most and (j == i or total + len(texts[j] or b"") < size):
            total += len(texts[j] or b"")
            j += 1
        yield [t.decode() if t else "" for t in texts[i:j]]
        i = j


def directions(bundled: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(bundled, axis=1, keepdims=True)
    return bundled / np.where(norm == 0, 1, norm)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes, from doc_id, text and non-null lang of ``docs``.

    About ``rows`` rows, chosen by a hash of the id, are used. The driver gets a vector for each language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    share = min(1.0, rows / max(1, total))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    parts = max(1, min(32, -(-min(total, rows) // 500)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in _text_slices(tc.as_bytes(batch.column("text"))):
                for lang, v in zip(langs[at : at + len(texts)], directions(encoder.bundle(texts)), strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
                at += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    found = chosen.select("lang", "text").repartition(parts).mapInArrow(run, "lang string, v array<double>").toPandas()
    sums: dict[str, np.ndarray] = {}
    for lang, v in sorted(zip(found["lang"], found["v"], strict=True), key=lambda x: x[0]):
        sums[lang] = sums.get(lang, 0) + np.asarray(v)
    langs = [k for k, v in sorted(sums.items()) if np.any(v)]
    return langs, directions(np.array([sums[k] for k in langs])) if langs else np.zeros((0, dimensions))


def predictor(spark: SparkSession, langs: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED):
    """A UDF from text to lang_pred and score ((1 + cosine) / 2)."""
    centred = prototypes - prototypes.mean(axis=0) if len(langs) > 1 else prototypes
    # whole numbers, so that sums are exact and a score doesn't depend on the texts it is computed with
    model_b = spark.sparkContext.broadcast((langs, np.rint(directions(centred) * MODEL_SCALE)))

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, model = model_b.value
        encoder = Encoder(dimensions, seed)
        for column in tc.trimmed(batches):
            pred, score = [], []
            for texts in _text_slices(tc.as_bytes(column)):
                if not names:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                vectors = encoder.bundle(texts).astype(np.float64)
                norm = np.sqrt(np.array([np.dot(v, v) for v in vectors]))
                known = norm > 0
                cosines = vectors @ model.T / (MODEL_SCALE * np.where(known, norm, 1))[:, None]
                best = cosines.argmax(axis=1)
                pred += [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                top = np.clip((1 + cosines[np.arange(len(texts)), best]) / 2, 0, 1)
                score += np.where(known, top, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, training: DataFrame, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``, learned from ``training`` (doc_id, text, lang).

    * ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    * lang, source and doc_id of ``docs`` aren't read for a prediction; repeated rows get equal results; ties fall to the first language by name.
    """
    langs, prototypes = train(training.select("doc_id", "text", "lang"), rows, dimensions, seed)
    predict = predictor(docs.sparkSession, langs, prototypes, dimensions, seed)
    return doc_columns(docs).withColumn("__p", predict("text")).select("doc_id", "__p.*")


def op6(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held_out = F.pmod(id_crc(), F.lit(3)) == 1
    out = identify(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6}
