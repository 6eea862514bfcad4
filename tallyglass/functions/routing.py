"""Classifying a request and budgeting its answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import strip

# fixed values: extensions that make a request a path
PATH_EXTENSIONS = (
    ".go .ts .tsx .js .jsx .py .java .rs .c .h .cpp .cc .hpp .rb .php .cs .swift .kt .scala .sh .sql .yaml .yml .json .toml .xml .html .css .md"
).split()
MODES = ("symbol", "path", "text", "ast")

# fixed values: words that make a request one about a failure
FAILURE_CUES = ("error", "err ", "exception", "failed", "failure", "bug", "fix", "panic", "stack", "trace", "crash", "fault", "debug", "broken")
CLASS_LIKE = ("class", "struct", "interface", "module", "trait", "enum")

# fixed values: lines of the budgets, and percentages for definition, references and callers (the rest is for notes)
BUDGETS = {"small": 80, "medium": 120, "large": 160}
BUDGET_CAP, DEPTH_BONUS, SHARES = 240, 20, (50, 25, 15)

QUALIFIED = r"^[\p{L}\p{N}_]+( *\. *[\p{L}\p{N}_]+)+$"


def classify(request: Column, mode: Column | None = None) -> Column:
    """symbol, path, text or ast; a valid override wins, and a blank request is text."""
    q = strip(F.coalesce(request, F.lit("")))
    ext = F.lower(F.regexp_extract(q, r"(\.[^./]*)$", 1))
    out = (
        F.when(q == "", F.lit("text"))
        .when(q.contains("/") | ext.isin(PATH_EXTENSIONS), F.lit("path"))
        .when(q.startswith('"') | q.startswith("'"), F.lit("text"))
        .when(q.contains("{") | q.contains("}"), F.lit("ast"))
        .when(q.contains(" ") & ~q.rlike(QUALIFIED), F.lit("text"))
        .otherwise(F.lit("symbol"))
    )
    return out if mode is None else F.when(mode.isin(*MODES), mode).otherwise(out)


def budget(flag: Column, depth: Column) -> dict[str, Column]:
    """Lines in all and by section."""
    base = F.when(depth > 1, F.lit(BUDGETS["medium"])).otherwise(F.lit(BUDGETS["small"]))
    for name, n in BUDGETS.items():
        base = F.when(flag == name, F.lit(n)).otherwise(base)
    total = F.least(base + DEPTH_BONUS * F.greatest(depth - 1, F.lit(0)), F.lit(BUDGET_CAP)).cast("int")
    d, r, c = (F.floor(total * s / 100).cast("int") for s in SHARES)
    return {"total_lines": total, "definition_lines": d, "reference_lines": r, "caller_lines": c, "meta_lines": (total - d - r - c).cast("int")}


def most_items(lines: Column) -> Column:
    """How many references or callers fit: two lines each, one at least."""
    return F.greatest(F.floor(lines / 2).cast("int"), F.lit(1))


def has_failure_cue(request: Column) -> Column:
    low = F.lower(request)
    out = F.lit(False)
    for cue in FAILURE_CUES:
        out = out | low.contains(cue)
    return out


def is_class_like(kind: Column) -> Column:
    return F.lower(kind).isin(*CLASS_LIKE)
