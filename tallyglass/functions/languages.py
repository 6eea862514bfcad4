"""Extension and language tables, and their Column forms.

The two extension maps differ on purpose: one serves chunking, the other symbol extraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions of code that a walk takes by default
DEFAULT_EXTENSIONS = (
    ".go .ts .tsx .js .jsx .py .java .rs .c .h .cpp .cc .cxx .hpp .hxx .rb .php .cs .swift .kt .scala .sh .bash .sql"
).split()

# fixed values: extension -> language for chunking
CHUNK_LANGUAGES = {
    ".go": "go", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".java": "java", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".yaml": "yaml", ".yml": "yaml",
    ".json": "json", ".md": "markdown", ".sql": "sql",
}

# fixed values: extension -> language for symbol extraction
EXTRACT_LANGUAGES = {
    ".go": "go", ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".xml": "xml", ".html": "html", ".htm": "html",
}

# fixed values: names accepted by the language and symbol type filters of a listing
LANGUAGE_ALIASES = {
    "go": "go", "golang": "go", "python": "python", "py": "python", "java": "java", "javascript": "javascript", "js": "javascript", "typescript": "typescript",
    "ts": "typescript", "rust": "rust", "rs": "rust", "cpp": "cpp", "c++": "cpp", "xml": "xml", "svg": "xml", "html": "html", "htm": "html",
}
SYMBOL_TYPES = "function method class interface struct type enum trait impl element script style".split()
SYMBOL_TYPE_ALIASES = {"": "", "func": "function"} | {t: t for t in SYMBOL_TYPES}

# fixed values: languages that have a language server
SERVED_LANGUAGES = "go python java javascript typescript rust cpp".split()


def lookup(table: dict[str, str], key: Column, default: str = "") -> Column:
    """``table[key]``, or ``default``; a literal map stays in codegen and never raises on a missing key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def normalise_language(name: str) -> str:
    key = name.strip().lower()
    if key and key not in LANGUAGE_ALIASES:
        raise ValueError(f"unsupported language filter {name!r}")
    return LANGUAGE_ALIASES.get(key, "")


def normalise_symbol_type(name: str) -> str:
    key = name.strip().lower()
    if key not in SYMBOL_TYPE_ALIASES:
        raise ValueError(f"unsupported symbol type {name!r}")
    return SYMBOL_TYPE_ALIASES[key]


def symbol_type_matches(column: Column, wanted: str) -> Column:
    """'' admits all; ``function`` admits methods too."""
    if not wanted:
        return F.lit(True)
    return column.isin("function", "method") if wanted == "function" else column == wanted


def sql_case(column: str, table: dict[str, str], default: str = "") -> str:
    """The same look-up as an SQL CASE (for the DuckDB forms)."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"
