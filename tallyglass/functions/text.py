"""Text columns: lines, snippets, descriptions. Lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def total_lines(content: Column) -> Column:
    """Line ends plus one."""
    return F.size(lines(content))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    """Trimmed, with runs of white space as single spaces."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def line_range(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive), clamped to the text."""
    all_lines = lines(content)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(all_lines))
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def describe(content: Column, label: Column, most: int = 120) -> Column:
    """``label — first line``, cut at ``most`` characters; a blank label is ``block``."""
    name = F.when(strip(label) == "", F.lit("block")).otherwise(label)
    first = strip(F.substring_index(content, "\n", 1))
    cut = F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)
    return F.concat_ws(" — ", name, cut)


def display(content: Column, most: int = 3) -> Column:
    """The first lines, then an ellipsis line if there are more."""
    all_lines = lines(content)
    return F.when(F.size(all_lines) <= most, content).otherwise(F.concat(F.array_join(F.slice(all_lines, 1, most), "\n"), F.lit("\n...")))


def signature(code: Column) -> Column:
    """The first line without carriage returns or line feeds at its end."""
    return F.regexp_replace(F.substring_index(code, "\n", 1), r"[\r\n]+$", "")


def outline_signature(code: Column) -> Column:
    """The first line that is neither blank nor an annotation, trimmed."""
    kept = F.filter(lines(code), lambda x: (strip(x) != "") & ~strip(x).startswith("@") & ~strip(x).startswith("#["))
    return F.coalesce(strip(F.get(kept, F.lit(0))), F.lit(""))


def loc(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0))


def is_import(snippet: Column) -> Column:
    return strip(snippet).startswith("import ")


def split_at_lines(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters, cut after the last line end that fits, else anywhere; they join to the text."""
    if most <= 0 or len(text) <= most:
        return [text]
    parts = []
    while len(text) > most:
        cut = text.rfind("\n", 0, most) + 1 or most
        parts.append(text[:cut])
        text = text[cut:]
    return parts + ([text] if text else [])


def duration(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours and minutes."""
    whole = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, whole(seconds, "s")).when(seconds < 3600, whole(seconds / 60, "m")).otherwise(F.concat(whole(seconds / 3600, "h "), whole(seconds % 3600 / 60, "m")))


def least_cap(a: Column, b: Column) -> Column:
    """The lesser of two limits, of which one that isn't positive doesn't count."""
    return F.when(a <= 0, b).when(b <= 0, a).otherwise(F.least(a, b))


def split_sizes(text: Column, most: int) -> Column:
    """Parts of at most ``most`` characters as (start, length), cut behind the last line break that fits, else at the limit; an empty text has none.

    Folded over the lengths of the lines: a part takes whole lines while they fit, and a longer line is cut by itself.
    """
    lines_ = F.split(text, "\n", -1)
    lengths = F.transform(lines_, lambda line, i: F.length(line) + (i < F.size(lines_) - 1).cast("int"))
    part = "array<struct<start:int,length:int>>"
    empty = F.struct(F.array().cast(part).alias("parts"), F.lit(0).alias("start"), F.lit(0).alias("held"))

    def closed(s, upto):
        return F.when(upto > 0, F.concat(s["parts"], F.array(F.struct(s["start"].alias("start"), upto.alias("length"))))).otherwise(s["parts"])

    def step(s, n):
        fits = s["held"] + n <= most
        whole = F.floor((n - 1) / most).cast("int")  # full parts that a long line gives by itself
        begin = s["start"] + s["held"]
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda k: F.struct((begin + (k - 1) * most).cast("int").alias("start"), F.lit(most).alias("length")))
        parts = F.when(fits, s["parts"]).when(whole > 0, F.concat(closed(s, s["held"]), cuts)).otherwise(closed(s, s["held"]))
        return F.struct(parts.alias("parts"), F.when(fits, s["start"]).otherwise(begin + whole * most).cast("int").alias("start"), F.when(fits, s["held"] + n).otherwise(n - whole * most).cast("int").alias("held"))

    return F.aggregate(lengths, empty, step, lambda s: closed(s, s["held"]))
