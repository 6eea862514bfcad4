"""Operator 3: quality rules with adaptive thresholds.

Text statistics are measured once for each document. Thresholds aren't fixed: for
each language and source, a quantile sketch of each statistic over the documents that
pass the base rules gives quantiles, and a document fails if a statistic lies far
beyond its group's. The sketches are histograms over buckets of equal ratio (2 % wide,
so quantiles are within 1 % of their value and ranks are exact): they are merged by
adding counts, and don't depend on the order or the layout of the rows.

A pair of language and source is judged by its own counts, to which its language's
sketch is added with the weight of ``PRIOR`` documents; to a language's, likewise, that
of all documents. So each document moves its group's limits, at every size, and a group
of few documents is mostly judged by the level above.

Only bucket counts are shuffled for the thresholds, at most some 1,500 a group and
statistic; a group that holds most rows is counted partition by partition.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, stored

REPEAT_WIDTH = 8
_SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Statistic -> (expression, factor of the tail, whether there is a lower limit).
#: The upper limit is the median, four times the distance from there to the third quartile, and ``factor`` times that to the
#: tail, the 99th percentile. With a lower limit, the rule lies ``factor`` times the distance of the quartiles beyond both of them. Either distance is at least ``LEAST_SHARE`` of that
#: among all documents, so that groups that hardly know a statistic don't fail at its first occurrence; what fewer than 1 % of all documents
#: have is no tail to judge by, and fails nowhere. Junk lies beyond a
#: small share of its own tail in symbols; repeated lines are common in good texts, so that only what is far beyond the tail
#: fails. Repeated passages have no adaptive rule: the base rule cuts them far below any tail of theirs.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.2, False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 3.0, False),
    "word_length": ("word_chars / greatest(n_words, 1)", 4.0, True),
}
QUANTILES = (0.25, 0.5, 0.75, 0.99)
#: Weights are sums of fractions: ranks that differ by less are equal.
SAME = 1e-6
LEAST_SHARE = 0.5
#: Buckets of the sketches: bucket b holds the values from RATIO**(b - 1) to RATIO**b; those below LEAST are zero.
RATIO, LEAST, ZERO = 1.02, 1e-9, -100_000
#: The sketch of the level above counts as so many documents.
PRIOR = 100


def measure(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a text."""
    if not text:
        return (0,) * 6
    words = text.split()
    joined = b" ".join(words)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    if joined.isascii():
        chars = len(joined) - max(0, len(words) - 1)
    else:
        buf = np.frombuffer(joined, np.uint8)
        chars = len(joined) - int(np.count_nonzero((buf & 0xC0) == 0x80)) - max(0, len(words) - 1)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > REPEAT_WIDTH:
        starts, ends = tc.bounds(joined)
        hashes = tc.window_hashes(tc.word_hashes(joined, starts, ends), REPEAT_WIDTH)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        if same.any():
            maybe = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
            passages = [joined[a:b] for a, b in zip(starts[maybe].tolist(), ends[maybe + REPEAT_WIDTH - 1].tolist(), strict=True)]
            count = Counter(passages)  # equal hashes only propose; the words decide
            twice = maybe[[count[x] > 1 for x in passages]]
            repeated = int(tc.covered(len(words), twice, REPEAT_WIDTH).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in tc.trimmed(batches):
        rows = [measure(t) for t in tc.each_text(column)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures and base_failed of each row."""
    rows = doc_columns(docs, "lang", "source").withColumn("__m", _measures("text")).select("doc_id", "lang", "source", "__m.*")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """The sketches: lang, source, rule, bucket and n, over the rows that pass the base rules."""
    bucket = lambda x: F.when(x < LEAST, F.lit(ZERO)).otherwise(F.ceil(F.log(x) / F.lit(math.log(RATIO)))).cast("int")
    values = F.array(*[F.struct(F.lit(name).alias("rule"), bucket(F.expr(rule[0]).cast("double")).alias("bucket")) for name, rule in RULES.items()])
    rated = rows.where(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("v"))
    return rated.groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count("*").alias("n"))


def blended(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """lang, source, rule, bucket, weight: the sketch of each pair, with that of its language as so many documents, and in that all's.

    The rows of null language and source with ``overall`` true are those of all documents. A group's sketch has every bucket
    of the level above, so its size is bounded by that of all, whatever the number of documents.
    """
    share = lambda rows, by: rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "rule"))).drop("n")
    whole = counts.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))  # some thousands of rows at most
    of_all = share(whole, [])

    def above(groups: DataFrame, own: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
        """The parent's shares for each group, as ``prior`` documents, and the group's own counts."""
        given = groups.join(parent, [F.col(f"g_{c}").eqNullSafe(F.col(c)) for c in by] or F.lit(True)).drop(*by)
        names = [c for c in groups.columns]
        mine = own.select(*[F.col(c[2:]).alias(c) for c in names], "rule", "bucket", F.col("n").cast("double").alias("n"), F.lit(0.0).alias("p"))
        both = mine.unionByName(given.select(*names, "rule", "bucket", F.lit(0.0).alias("n"), (F.col("share") * prior).alias("p")))
        # one of each kind a bucket, so the sums are the same in any order
        return both.groupBy(*names, "rule", "bucket").agg((F.sum("n") + F.sum("p")).alias("n")).withColumnsRenamed({c: c[2:] for c in names})

    by_lang = counts.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    langs = above(counts.select(F.col("lang").alias("g_lang")).distinct(), by_lang, F.broadcast(of_all), [])
    pairs = above(counts.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).distinct(), counts, share(langs, ["lang"]), ["lang"])
    out = pairs.select("lang", "source", F.lit(False).alias("overall"), "rule", "bucket", F.col("n").alias("weight"))
    none = F.lit(None).cast("string")
    return out.unionByName(whole.select(none.alias("lang"), none.alias("source"), F.lit(True).alias("overall"), "rule", "bucket", F.col("n").cast("double").alias("weight")))


def _quantiles(sketches: DataFrame) -> DataFrame:
    """lang, source, overall, and the quantiles of each rule."""
    group = ["lang", "source", "overall"]
    of = Window.partitionBy(*group, "rule")  # a few hundred buckets each
    below = sketches.withColumn("up_to", F.sum("weight").over(of.orderBy("bucket"))).withColumn("total", F.max("up_to").over(of))
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(RATIO), F.col("bucket")) * (2 / (1 + RATIO)))
    reached = lambda rule, q: F.min(F.when((F.col("rule") == rule) & (F.col("up_to") >= F.col("total") * q - SAME), value))
    return below.groupBy(*group).agg(*[reached(rule, q).alias(f"{rule}_{k}") for rule in RULES for k, q in enumerate(QUANTILES)])


def _reach(name: str) -> Column:
    """How far beyond its median, or its quartiles, a group lets a statistic go."""
    _, factor, both = RULES[name]
    q1, q2, q3, tail = (F.col(f"{name}_{k}") for k in range(4))
    if both:
        return factor * (q3 - q1)
    return F.when(F.col("overall") & (tail <= 0), F.lit(float("inf"))).otherwise(4 * (q3 - q2) + factor * (tail - q2))


def thresholds(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """lang, source and the limits of each pair that occurs among rows that pass the base rules."""
    counts = stored(bucket_counts(rows), "sketches")
    known = stored(_quantiles(blended(counts, prior)).withColumns({f"reach_{n}": _reach(n) for n in RULES}), "quantiles")
    least = known.where("overall").select(*[(F.col(f"reach_{n}") * LEAST_SHARE).alias(f"least_{n}") for n in RULES])
    own = known.where("NOT overall").join(F.broadcast(least), F.lit(True))  # one row
    limits = []
    for name, (*_, both) in RULES.items():
        reach = F.greatest(f"reach_{name}", f"least_{name}")
        low = F.col(f"{name}_0") - reach if both else F.lit(float("-inf"))
        limits += [low.alias(f"low_{name}"), (F.col(f"{name}_{2 if both else 1}") + reach).alias(f"high_{name}")]
    return own.select("lang", "source", *limits)


def verdicts(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, the measures, base_failed, kept and ``failed`` (names of the adaptive rules that failed) for each row.

    ``prior`` is the weight of a group's level above, in documents.

    * A null or empty text has no words and fails the base rules.
    * Null languages and sources are groups of their own; repeated rows count as often as they occur.
    * A row that fails the base rules isn't judged by the adaptive ones and isn't kept.
    * An empty table gives no rows; other columns are ignored; equal tables give equal verdicts, however they are laid out.
    """
    rows = stored(measured(docs), "measures")
    limits = thresholds(rows, prior).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failing = []
    for n, (expr, *_) in RULES.items():
        x = F.expr(expr)
        failing.append(F.when((x > F.col(f"high_{n}")) | (x < F.col(f"low_{n}")), F.lit(n)))
    out = joined.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*failing))))
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def op3(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{d}/documents.parquet")).drop("n_lines", "failed")


def brute(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base statistics from their definitions."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen: dict[tuple, int] = {}
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])] = seen.get(tuple(words[i : i + 8]), 0) + 1
    repeated = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in earlier
            earlier.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


QUERIES = {"op3_quality_rules": op3}
