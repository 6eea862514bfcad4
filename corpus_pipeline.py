"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import decontamination, near_similar, packing, quality_classifier, simhash, substring_dedup
from tallyglass.llm.common import scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones; repeated rows score alike; an empty table, or one without labels, is
    judged by a constant score; other columns pass whole, whatever they are called.
    """
    return quality_classifier.keep_good(docs, quality_classifier.learned(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least id; five-word shingles, similarity 0.8 or more, found by SimHash.

    Null, empty and blank texts are one group; a null id comes after all others; of documents with one id the text with
    the least hash stays, and of rows equal in id and text any; an empty table stays empty.
    """
    return simhash.near_dedup(docs, near_similar.near_groups)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that occur more than once are cut; ``n_chars`` follows the text.

    Null texts stay null, texts that lose nothing stay as they are; rows that repeat one another lose all passages of
    35 words; an empty table stays empty.
    """
    return substring_dedup.dedup(docs, size_col="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go.

    Null and empty texts stay; each row is judged on its own; an empty benchmark or table changes nothing.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset.

    Null texts are empty ones, of one end token; repeated rows are packed one by one; an empty table gives no pieces.
    Half the table of pieces, as workers of earlier stages hold memory too.
    """
    return packing.pack_documents(docs, memo=0.5)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: The first stages learn a model and compare texts by meaning of their hashes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
