"""Symbol kinds, names and visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import strip

# fixed values: numbers of symbol kinds in the language server protocol
KINDS = {"class": 5, "method": 6, "constructor": 9, "enum": 10, "interface": 11, "function": 12, "constant": 14, "struct": 23, "type_parameter": 26}
REF_KINDS = {
    "function": ("function",), "method": ("method",), "class": ("class",), "interface": ("interface",),
    "type": ("class", "interface", "enum", "struct", "type_parameter"), "constant": ("constant",),
}
CALLABLE = ("function", "method", "constructor")
_LABELS = ("function", "method", "class", "interface", "constant")


def normalise_kind(kind: str) -> str:
    k = kind.strip().lower()
    if k and k not in REF_KINDS:
        raise ValueError(f"kind {kind!r} is none of {', '.join(sorted(REF_KINDS))}")
    return k


def kind_matches(kind: Column, wanted: str) -> Column:
    return kind.isin(*[KINDS[k] for k in REF_KINDS[wanted]])


def is_callable(kind: Column) -> Column:
    return kind.isin(*[KINDS[k] for k in CALLABLE])


def kind_label(kind: Column) -> Column:
    out = F.lit("type")
    for name in _LABELS:
        out = F.when(kind == KINDS[name], F.lit(name)).otherwise(out)
    return out


def name_matches(name: Column, wanted: Column) -> Column:
    """Equal, or with a signature after it."""
    return (name == wanted) | name.startswith(F.concat(wanted, F.lit("(")))


def name_keys(name: Column) -> Column:
    """Every wanted name that ``name`` matches, for joins on equality: itself, and what stands before each bracket."""
    parts = F.split(name, r"\(")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "("))


def trimmed_name(name: Column) -> Column:
    """Without the signature."""
    return strip(F.regexp_replace(name, r"(?<=.)\((?!\*?\w+\)\.).*$", ""))


def base_part(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(trimmed_name(name), ".", -1)


def container_part(name: Column) -> Column:
    """What precedes the last dot, without parentheses and asterisks; '' if there is no dot."""
    return F.regexp_replace(F.regexp_extract(trimmed_name(name), r"^(.*)\.[^.]*$", 1), r"[()*]", "")


def caller_matches(name: Column, container: Column, wanted: Column) -> Column:
    """A bare request matches by base name; a qualified one needs the same container, in the name or beside it."""
    same = base_part(name) == base_part(wanted)
    asked = container_part(wanted)
    own = F.regexp_replace(F.coalesce(container, F.lit("")), r"[()*]", "")
    return same & ((asked == "") | (container_part(name) == asked) | (own == asked))


def identity(path: Column, line: Column, char: Column, name: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), char.cast("string"), name)


def is_constructor(name: Column) -> Column:
    return F.lower(name).isin("__init__", "constructor", "new", "init") | name.startswith("New")


def visibility(language: Column, name: Column, signature: Column) -> Column:
    """public, private or protected, by each language's own convention."""
    sig = strip(signature)
    word = lambda w: sig.rlike(rf"\b{w}\b")
    modifiers = F.when(word("private"), F.lit("private")).when(word("protected"), F.lit("protected"))
    return (
        F.when(language == "go", F.when(name.rlike(r"^\p{Lu}"), F.lit("public")).otherwise(F.lit("private")))
        .when(language == "python", F.when(name.startswith("_"), F.lit("private")).otherwise(F.lit("public")))
        .when(language == "java", modifiers.when(word("public"), F.lit("public")).otherwise(F.lit("package")))
        .when(language.isin("javascript", "typescript"), modifiers.when(name.startswith("#"), F.lit("private")).otherwise(F.lit("public")))
        .when(language == "rust", F.when(sig.startswith("pub"), F.lit("public")).otherwise(F.lit("private")))
        .otherwise(F.lit(""))
    )
