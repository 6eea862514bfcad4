"""Operator 12: fill-in-the-middle transformation over run-length encoded character classes.

A text is cut at unit borders, where a unit is a run of ASCII letters or any other single
code point. The text is stored as maximal runs of one character class with the number of
units before each: letters are one class, all other code points are classed by their width
in UTF-8. A cut after ``c`` units is found by a binary search for the run that holds unit
``c``; its byte and code point offsets follow by multiplication, as all code points of a
run have one width. Long texts are encoded a stretch at a time: the first pass keeps each
stretch's totals, the second encodes only the stretches that hold a cut again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import lean
from tallyglass.llm.textcore import each_text

#: Bytes that are encoded at once.
STRETCH = 1 << 20
#: Marks of prefix, suffix and middle in the output (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many stay plain, and of a hundred others so many give the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_LETTER = 0
_CLASS = np.ones(256, np.uint8)  # the width in bytes of the code point that a byte begins
_CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 2, 3, 4
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER


class Runs:
    """The maximal class runs of one stretch of a text; ``joined`` says that its first letters go on with the run before it."""

    def __init__(self, raw: np.ndarray, joined: bool = False):
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        classes = _CLASS[raw[heads]]
        first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))) if len(heads) else heads
        self.classes, self.chars, self.bytes = classes[first], first, heads[first]
        lengths = np.diff(np.append(first, len(heads)))
        units = np.where(self.classes == _LETTER, 1, lengths)
        if joined and len(units) and self.classes[0] == _LETTER:
            units[0] = 0
        ends = np.cumsum(units)
        self.units = ends - units  # units before each run
        self.n_units, self.n_chars = int(ends[-1]) if len(ends) else 0, len(heads)

    def at(self, unit: int) -> tuple[int, int]:
        """Offsets in bytes and code points at which a unit of this stretch begins."""
        run = int(np.searchsorted(self.units, unit, "right")) - 1
        more = unit - int(self.units[run])
        return int(self.bytes[run]) + more * int(self.classes[run]), int(self.chars[run]) + more


class EncodedText:
    """A text's stretches with their totals; run tables are built when asked for, and the last one is kept."""

    def __init__(self, raw: bytes, stretch: int = STRETCH):
        self.raw = np.frombuffer(raw, np.uint8)
        self.starts, self.units, self.chars = [], [], []
        self.n_units = self.n_chars = i = 0
        self._kept: tuple[int, Runs] | None = None
        while i < len(raw):
            j = min(len(raw), i + stretch)
            while j < len(raw) and raw[j] & 0xC0 == 0x80:
                j += 1
            self.starts.append((i, j))
            self.units.append(self.n_units)
            self.chars.append(self.n_chars)
            runs = self._runs(len(self.starts) - 1)
            self.n_units += runs.n_units
            self.n_chars += runs.n_chars
            i = j

    def _runs(self, k: int) -> Runs:
        if self._kept is None or self._kept[0] != k:
            i, j = self.starts[k]
            self._kept = (k, Runs(self.raw[i:j], i > 0 and _CLASS[self.raw[i - 1]] == _LETTER))
        return self._kept[1]

    def cut(self, unit: int) -> int:
        """The number of code points in the first ``unit`` units."""
        if unit >= self.n_units:
            return self.n_chars
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        return self.chars[k] + self._runs(k).at(unit - self.units[k])[1]


_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS)
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units of each text, and code points of its prefix and middle."""
    out = []
    for raw, *draws in zip(each_text(text), h1.to_pylist(), h2.to_pylist(), strict=True):
        t = EncodedText(raw or b"")
        a, b = sorted(h % (t.n_units + 1) for h in draws)
        a, b = t.cut(a), t.cut(b)
        out.append((t.n_units, a, b - a))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], _CUTS.names)


def draws(ids: Column, seed: int | str = 1) -> list[Column]:
    """Four unsigned 32-bit numbers for each id: the first groups of the sha256 of ``seed:id``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int | str = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each row.

    * A null text is an empty one; an empty text, and one that contains a mark, is plain: the output is the text itself
      and the numbers of code points are null, but ``n`` counts its units.
    * Rows are judged one by one, so repeated rows come out alike; rows with one id are cut by the same draws.
    * Very long texts are encoded a stretch at a time; an empty table gives no rows; other columns are not read.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select("*", form.alias("form"), _cuts("text", h1, h2).alias("c"))
    cut = cut.select("doc_id", "text", "form", "c.*").select("*", F.expr("substring(text, 1, CAST(prefix_chars AS INT))").alias("prefix"),
        F.expr("substring(text, CAST(prefix_chars AS INT) + 1, CAST(middle_chars AS INT))").alias("middle"), F.expr("substring(text, CAST(prefix_chars + middle_chars AS INT) + 1)").alias("suffix"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    shown = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return cut.select("doc_id", "n", "form", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transform` was made from, by the output and its form alone.

    No text that is cut contains a mark, and none arises where pieces meet, so the marks divide the output.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op12(spark: SparkSession, d: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{d}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


_H = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, {_H} FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n,
  least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""

QUERIES = {"op12_fill_in_middle": op12}
ORACLES = {"op12_fill_in_middle": ORACLE}
