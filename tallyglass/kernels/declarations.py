"""Symbols of source files: Python by its own parser, markup by tags, brace languages by a scanner.

The scanner blanks comments and literals first, so that what is left has only
structural braces; declarations are then found by one pattern for each kind, and a
body ends at the brace that closes it. Offsets are of characters, lines start at 1.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple


class Symbol(NamedTuple):
    name: str
    type: str
    start_line: int
    end_line: int
    start: int
    end: int
    container: str


_STRING = {'"': r'"(?:\\.|[^"\\\n])*"?', "'": r"'(?:\\.|[^'\\\n])*'?"}
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_JS_LITERALS = r"`(?:\\.|[^`\\])*`?|(?:(?<=[=(,:!&|?])|(?<=[=(,:!&|?] ))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
#: What a language's comments and literals look like; directives of the preprocessor count as comments.
_OPAQUE = {
    "go": rf"{_COMMENT}|{_STRING['"']}|{_STRING["'"]}|`[^`]*`?",
    "java": rf"{_COMMENT}|\"\"\".*?\"\"\"|{_STRING['"']}|{_STRING["'"]}",
    "javascript": rf"{_COMMENT}|{_JS_LITERALS}|{_STRING['"']}|{_STRING["'"]}",
    "rust": rf"{_COMMENT}|\br(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\"?|'(?:\\(?:x..|u\{{[^}}]*\}}|.)|[^'\\\n])'",
    "cpp": rf"{_COMMENT}|^[ \t]*\#(?:\\\n|[^\n])*|{_STRING['"']}|(?<!\d){_STRING["'"]}",
}
_OPAQUE["typescript"] = _OPAQUE["javascript"]
_OPAQUE_RE = {lang: re.compile(p, re.M | re.S) for lang, p in _OPAQUE.items()}


def blank(text: str, language: str) -> str:
    """The text with comments and the insides of literals as spaces; line ends and quotes stay."""

    def wipe(m: re.Match) -> str:
        hidden = re.sub(r"[^\n]", " ", m[0])
        return hidden if m[0].lstrip()[0] in "/#" or len(m[0]) < 2 else m[0][0] + hidden[1:-1] + (m[0][-1] if m[0][-1] != "\n" else "\n")

    return _OPAQUE_RE[language].sub(wipe, text)


class _Source:
    """Blanked text with its brackets matched, in one pass over them; a bracket that nothing closes reaches the end."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.code = text, language, blank(text, language)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self._at: list[int] = []
        self._inner: list[int] = []
        stack: list[int] = []
        braces: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            c, i = m[0], m.start()
            if c in "([{":
                stack.append(i)
                if c == "{":
                    braces.append(i)
            elif c == "}":
                if braces:
                    while stack[-1] != braces[-1]:
                        stack.pop()
                    braces.pop()
                    self._match(stack.pop(), i)
            elif stack and self.code[stack[-1]] == ("(" if c == ")" else "["):
                self._match(stack.pop(), i)
            if c in "{}":
                self._at.append(i)
                self._inner.append(braces[-1] if braces else -1)
        self._lines = [m.end() for m in re.finditer("\n", text)]

    def _match(self, first: int, last: int) -> None:
        self.close[first] = last
        self.open[last] = first

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at) + 1

    def around(self, at: int) -> int:
        """The innermost brace that is open before ``at``; -1 outside all."""
        k = bisect.bisect_left(self._at, at) - 1
        return self._inner[k] if k >= 0 else -1

    def past(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``."""
        return min(self.close.get(at, len(self.code)) + 1, len(self.code))

    def body(self, at: int) -> tuple[int, int]:
        """Opening brace (-1: none) and end of the declaration whose head goes on at ``at``."""
        m = _STOP.search(self.code, at)
        while m:
            i, c = m.start(), m[0]
            if c == "{" and not (self.language == "go" and _GO_EMPTY.search(self.code, max(0, i - 12), i)):
                return i, self.past(i)
            if c in "([{":
                m = _STOP.search(self.code, self.past(i))
            elif c == ";":
                return -1, i + 1
            elif c in ")]}" or (self.language == "go" and c == "\n"):
                return -1, i
            else:
                m = _STOP.search(self.code, i + 1)
        return -1, len(self.code)

    def statement(self, at: int, declarator: bool = False) -> int:
        """The end of the statement (or of the declarator in a list of them) that goes on at ``at``, without its semicolon."""
        i = at
        while m := _STOP_OR_COMMA.search(self.code, i):
            i, c = m.start(), m[0]
            if c in "([{":
                i = self.past(i)
                continue
            if c in ")]};" or (c == "," and declarator and _NEXT_DECLARATOR.match(self.code, i)):
                return i
            if c == "\n":
                before, after = self.code[at:i].rstrip()[-1:], _AFTER.match(self.code, i)[1]
                if not ((before and before in "=+-*/%&|^<>!,.?:") or (self.language in ("javascript", "typescript") and after and after in ".?:+-*/&|,=<>")):
                    return i
            i += 1
        return len(self.code)


_STOP, _STOP_OR_COMMA = re.compile(r"[(){}\[\];\n]"), re.compile(r"[(){}\[\];\n,]")
_GO_EMPTY = re.compile(r"\b(?:interface|struct)[ \t]*$")
_NEXT_DECLARATOR = re.compile(r",\s*[A-Za-z_$][\w$]*\s*(?:=(?!=)|:|,|;|$)", re.M)
_AFTER = re.compile(r"\s*(.?)")

_ID = r"[A-Za-z_$][\w$]*"
_GEN = r"<(?:[^<>;{}()]|<(?:[^<>;{}()]|<[^<>;{}()]*>)*>)*>"
_AT = r"(?:^|(?<=[{};]))[ \t]*"
_ANNOTATION = r"@(?!interface\b)[\w.]+(?:\([^()]*\))?"
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw", "synchronized", "function", "sizeof", "await", "with", "super", "this", "try", "enum"}
_JAVA_MODS = rf"(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp|synchronized|native|default|{_ANNOTATION})\s+)*"
_JS_OUT = r"(?:(?:export|default|declare)\s+)*"
_RUST_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_CPP_TEMPLATE = rf"(?P<template>template\s*{_GEN}\s*)?"

#: language -> (kind, pattern with groups "at", where the symbol begins, and "name"); patterns see blanked text.
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "go": [("function", rf"^(?P<at>func\s*(?:\((?P<recv>[^()]*)\)\s*)?(?P<name>{_ID}))")],
    "java": [
        ("class", rf"{_AT}(?P<at>{_JAVA_MODS}(?:class|record)\s+(?P<name>{_ID}))"),
        ("interface", rf"{_AT}(?P<at>{_JAVA_MODS}@?interface\s+(?P<name>{_ID}))"),
        ("enum", rf"{_AT}(?P<at>{_JAVA_MODS}enum\s+(?P<name>{_ID}))"),
        ("constructor", rf"{_AT}(?P<at>{_JAVA_MODS}(?:{_GEN}\s*)?(?P<name>{_ID}))\s*(?=\()"),
        ("method", rf"{_AT}(?P<at>{_JAVA_MODS}(?:{_GEN}\s*)?(?:{_ANNOTATION}\s+)*(?!(?:return|new|else|throw|assert|yield)\b)[\w.$]+(?:{_GEN})?(?:\s*\[\s*\])*\s+(?P<name>{_ID}))\s*(?=\()"),
    ],
    "javascript": [
        ("class", rf"{_AT}{_JS_OUT}(?P<at>(?:abstract\s+)?class\s+(?P<name>{_ID}))"),
        ("function", rf"{_AT}{_JS_OUT}(?P<at>(?:async\s+)?function\s*\*?\s*(?P<name>{_ID}))"),
        ("variable", rf"{_AT}{_JS_OUT}(?:const|let|var)\s+(?P<at>(?P<name>{_ID}))"),
        ("method", rf"(?:^|(?<=[{{}};,]))[ \t]*(?P<at>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?[ \t]*(?P<name>\#?{_ID}))\s*(?:{_GEN})?\s*(?=\()"),
    ],
    "rust": [
        ("function", rf"{_AT}(?P<at>{_RUST_PUB}(?:(?:async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>{_ID}))"),
        ("struct", rf"{_AT}(?P<at>{_RUST_PUB}struct\s+(?P<name>{_ID}))"),
        ("trait", rf"{_AT}(?P<at>{_RUST_PUB}(?:unsafe\s+)?trait\s+(?P<name>{_ID}))"),
        ("enum", rf"{_AT}(?P<at>{_RUST_PUB}enum\s+(?P<name>{_ID}))"),
        ("impl", rf"{_AT}(?P<at>(?:unsafe\s+)?impl\b(?:{_GEN})?\s*(?:[^{{;]*?\bfor\s+)?&?(?:{_ID}::)*(?P<name>{_ID}))"),
        ("type", rf"{_AT}(?P<at>{_RUST_PUB}type\s+(?P<name>{_ID}))"),
        ("constant", rf"{_AT}(?P<at>{_RUST_PUB}const\s+(?P<name>{_ID})\s*:)"),
        ("module", rf"{_AT}(?P<at>{_RUST_PUB}mod\s+(?P<name>{_ID}))"),
    ],
    "cpp": [
        ("class", rf"{_AT}{_CPP_TEMPLATE}(?:typedef\s+|static\s+)*(?P<at>class\s+(?P<name>{_ID})(?=[^;{{}}()=]*\{{))"),
        ("struct", rf"{_AT}{_CPP_TEMPLATE}(?:typedef\s+|static\s+)*(?P<at>struct\s+(?P<name>{_ID})(?=[^;{{}}()=]*\{{))"),
        ("enum", rf"{_AT}(?:typedef\s+)?(?P<at>enum\s+(?:class\s+|struct\s+)?(?P<name>{_ID}))"),
        ("namespace", rf"{_AT}(?P<at>(?:inline\s+)?namespace\b[ \t]*(?P<name>[\w:]*))\s*(?=\{{)"),
        ("special", rf"{_AT}{_CPP_TEMPLATE}(?P<at>(?:(?:explicit|virtual|inline|constexpr)\s+)*(?:(?P<of>{_ID})(?:{_GEN})?::)*(?P<name>~?{_ID}))\s*(?=\()"),
        ("function", rf"{_AT}{_CPP_TEMPLATE}(?P<at>(?!(?:return|else|new|delete|throw|case|goto|using|typedef|class|struct|enum|namespace)\b)(?:[\w:~]+(?:{_GEN})?(?:::)?[ \t&*]+)+(?:{_ID}(?:{_GEN})?::)*(?P<name>~?{_ID}|operator\s*(?:\(\)|[^\s\w(]+)))\s*(?=\()"),
    ],
}
_PATTERNS["typescript"] = [
    *_PATTERNS["javascript"],
    ("interface", rf"{_AT}{_JS_OUT}(?P<at>interface\s+(?P<name>{_ID}))"),
    ("type", rf"{_AT}{_JS_OUT}(?P<at>type\s+(?P<name>{_ID})(?=\s*[=<]))"),
    ("enum", rf"{_AT}{_JS_OUT}(?P<at>(?:const\s+)?enum\s+(?P<name>{_ID}))"),
]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in ps] for lang, ps in _PATTERNS.items()}
_CONTAINERS = ("class", "interface", "enum", "struct", "trait", "impl")
_JAVA_TAIL = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s]+)?(?:default\b[^;{}]*)?(?=[{;])")
_CPP_TAIL = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile|mutable|try)\b\s*|&&?\s*|->\s*[\w:<>&*, ]+)*(?=[{:])")
_CPP_INITIALISER = re.compile(r"\s*[\w:]+(?:<[^;{}()]*>)?\s*(?=[({])")
_GO_WORD = re.compile(r"^[ \t]*(?P<word>type|const|var)\b[ \t]*(?P<group>\()?", re.M)
_GO_NAMES = re.compile(rf"[;\s]*(?P<names>{_ID}(?:[ \t]*,\s*{_ID})*)")
_GO_PARAMETERS = re.compile(rf"\[\s*{_ID}(?:\s*,\s*{_ID})*\s+[^\s\]]")


class _Found(NamedTuple):
    kind: str
    name: str
    start: int
    end: int
    brace: int = -1
    container: str = ""


def _go(src: _Source) -> Iterator[_Found]:
    for m in _COMPILED["go"][0][1].finditer(src.code):
        brace, end = src.body(m.end("name"))
        owner = re.sub(r"\[.*", "", m["recv"] or "").split()
        yield _Found("method" if m["recv"] is not None else "function", m["name"], m.start("at"), end, brace, owner[-1].lstrip("*") if owner else "")
    for m in _GO_WORD.finditer(src.code):
        first = m.start("word")
        if m["group"]:
            at, stop = m.end(), src.past(m.start("group")) - 1
            end = stop + 1
        else:
            at, stop = m.end(), len(src.code)
            end = None
        while spec := _GO_NAMES.match(src.code, at, stop):
            start, after = spec.start("names"), spec.end("names")
            at = max(src.statement(after), after)
            if m["word"] == "type":
                if _GO_PARAMETERS.match(src.code, after):
                    after = src.past(after)
                head = re.compile(r"[ \t]*(=|struct\b|interface\b|\S)").match(src.code, after)
                if head and head[1] != "=":
                    brace = src.code.find("{", head.end()) if head[1] in ("struct", "interface") else -1
                    yield _Found(head[1] if brace >= 0 else "type", spec["names"], start, at, brace)
            else:
                for name in dict.fromkeys(re.split(r"\s*,\s*", spec["names"])):
                    yield _Found("constant" if m["word"] == "const" else "variable", name, start, at)
            if end is None:
                end = at
                break
        if m["word"] == "type" and end:
            yield _Found("declaration of types", "", first, end)


def _typescript_body(src: _Source, at: int) -> int:
    """The brace of a body after parameters, past a declared type of the result; -1 where there is none."""
    m = re.compile(r"\s*([{:])").match(src.code, at)
    if not m or m[1] == "{":
        return m.end() - 1 if m else -1
    i = m.end()
    while m := re.compile(r"[{;}]|=(?!>)").search(src.code, i):
        if m[0] != "{":
            return -1
        i = src.past(m.start())
        if not re.compile(r"\s*(?:[{>|&]|\[\])").match(src.code, i):
            return m.start()
    return -1


def _cpp_body(src: _Source, at: int) -> int:
    """The brace of a body after parameters, past qualifiers and initialisers."""
    tail = _CPP_TAIL.match(src.code, at)
    if not tail:
        return -1
    i = tail.end()
    if src.code[i] == "{":
        return i
    i += 1
    while m := _CPP_INITIALISER.match(src.code, i):
        i = src.past(m.end())
        more = re.compile(r"\s*([,{])").match(src.code, i)
        if not more:
            return -1
        i = more.end()
        if more[1] == "{":
            return i - 1
    return -1


def _declared(src: _Source) -> Iterator[_Found]:
    """Declarations of the languages other than Go; members know their owners by the brace around them."""
    lang, code = src.language, src.code
    owners: dict[int, str] = {}
    taken: set[int] = set()
    for kind, pattern in _COMPILED[lang]:
        for m in pattern.finditer(code):
            name, start = m["name"], m.start("at")
            if start in taken or (lang != "rust" and name in _NOT_NAMES):
                continue
            around = src.around(start)
            if kind == "variable":
                word = re.compile(r"(const|let|var)\s+$").search(code, max(0, start - 40), start)
                whole = start - len(word[0])
                end = start
                at = start
                while d := re.compile(rf"[,\s]*({_ID})").match(code, at):
                    end = at = max(src.statement(d.end(), True), d.end())
                    yield _Found("constant" if word[1] == "const" else "variable", d[1], d.start(1), at)
                    if code[at : at + 1] != ",":
                        break
                if word[1] != "var":
                    yield _Found("declaration", name, whole, end + (code[end : end + 1] == ";"))
                taken.add(start)
                start = whole
                brace = -1
            elif kind in ("method", "constructor", "special") or (lang == "cpp" and kind == "function"):
                at = src.past(m.end())
                if lang == "java":
                    tail = _JAVA_TAIL.match(code, at)
                    anonymous = around >= 0 and re.compile(r"\bnew\s[^;{}=]*\)\s*$").search(code, max(0, around - 300), around)
                    if not tail or not (around in owners or anonymous) or (kind == "constructor" and (owners.get(around) != name or code[tail.end()] != "{")):
                        continue
                    brace, end = src.body(tail.end())
                else:
                    brace = _cpp_body(src, at) if lang == "cpp" else _typescript_body(src, at) if around >= 0 else -1
                    if brace < 0 or (kind == "special" and name.lstrip("~") != (m["of"] or owners.get(around))):
                        continue
                    end = src.past(brace)
                    kind = "function" if lang == "cpp" else kind
                yield _Found(kind, name, start, end, brace)
            else:
                if kind == "type" and lang == "typescript":
                    brace, end = -1, src.statement(m.end())
                    end += code[end : end + 1] == ";"
                else:
                    brace, end = src.body(m.end("name"))
                if lang in ("javascript", "typescript") and kind != "type" and brace < 0:
                    continue
                inside = "method" if lang == "rust" and kind == "function" and brace < 0 else kind
                yield _Found(inside, name, start, end, brace)
                if kind in _CONTAINERS and brace >= 0:
                    owners[brace] = name
            taken.add(start)
            if lang == "cpp" and "template" in pattern.groupindex and m["template"]:
                yield _Found("template", name, m.start("template"), end, brace)
    if lang in ("javascript", "typescript"):
        for m in re.finditer(r"^export\b", code, re.M):
            brace, end = src.body(m.end())
            yield _Found("export", "", m.start(), max(end, src.statement(m.end()) if brace < 0 else end), brace)
        for m in re.finditer(rf"(?:(?P<close>\))|(?P<one>{_ID}))\s*=>\s*", code):
            start = src.open.get(m.start("close"), -1) if m["close"] else m.start("one")
            if start >= 0:
                prefix = re.compile(r"\basync\s*$").search(code, max(0, start - 12), start)
                end = src.past(m.end()) if code[m.end() : m.end() + 1] == "{" else src.statement(m.end(), True)
                yield _Found("arrow", "", prefix.start() if prefix else start, end)


def _braces(text: str, language: str) -> list[Symbol]:
    """Symbols in order of start, each with the container whose braces are the innermost around it."""
    src = _Source(text, language)
    found = sorted(set(_go(src) if language == "go" else _declared(src)), key=lambda f: (f.start, -f.end, f.kind, f.name))
    out: list[Symbol] = []
    open_owners: list[tuple[int, str]] = []
    for f in found:
        while open_owners and open_owners[-1][0] < f.end:
            open_owners.pop()
        owner = open_owners[-1][1] if open_owners else ""
        kind = "method" if owner and f.kind == "function" and language in ("rust", "cpp") else f.kind
        out.append(Symbol(f.name, kind, src.line(f.start), src.line(max(f.start, f.end - 1)), f.start, f.end, f.container or owner))
        if f.kind in _CONTAINERS:
            open_owners.append((f.end, f.name))
    return out


def python_tree(text: str) -> ast.Module:
    """The syntax tree; a text that nests too deep for the parser counts as unreadable."""
    try:
        return ast.parse(text)
    except MemoryError as e:
        raise SyntaxError(str(e)) from None


def _python(text: str) -> list[Symbol]:
    tree = python_tree(text)
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                a, b = child.lineno, child.end_lineno or child.lineno
                if child.decorator_list:
                    first = child.decorator_list[0].lineno
                    out.append(Symbol(child.name, "decorated", first, b, starts[first - 1] + child.col_offset, starts[b - 1] + len(lines[b - 1]), owner))
                out.append(Symbol(child.name, kind, a, b, starts[a - 1] + child.col_offset, starts[b - 1] + len(lines[b - 1]), owner))
                visit(child, child.name if kind == "class" else owner)
            else:
                visit(child, owner)

    visit(tree, "")
    return sorted(out, key=lambda s: (s.start, -s.end))


_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z_][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>", re.S)


def _markup(text: str, language: str) -> list[Symbol]:
    html, stack, out = language == "html", [], []
    raw_until = None

    def close(i: int, end: int) -> None:
        name, start, line = stack[i]
        kind = name.lower() if html and name.lower() in ("script", "style") else "element"
        out.append(Symbol(name, kind, line, text.count("\n", 0, max(start, end - 1)) + 1, start, end, stack[i - 1][0] if i else ""))

    for m in _TAG.finditer(text):
        if m[2] is None:
            continue
        name = m[2].lower() if html else m[2]
        if raw_until:
            if not (m[1] and name == raw_until):
                continue
            raw_until = None
        if m[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if (stack[i][0].lower() if html else stack[i][0]) == name), None)
            if at is not None:
                for i in range(len(stack) - 1, at - 1, -1):
                    close(i, m.end())
                del stack[at:]
            continue
        stack.append((m[2], m.start(), text.count("\n", 0, m.start()) + 1))
        if m[4] or (html and name in _VOID):
            close(len(stack) - 1, m.end())
            stack.pop()
        elif html and name in ("script", "style"):
            raw_until = name
    for i in range(len(stack) - 1, -1, -1):
        close(i, len(text))
    return sorted(out, key=lambda s: (s.start, -s.end))


def nodes(text: str, language: str) -> list[Symbol]:
    """All symbols and the places that only become chunks, in order of start; an unknown language has none, unparsable Python raises SyntaxError."""
    if language == "python":
        return _python(text)
    if language in ("html", "xml"):
        return _markup(text, language)
    return _braces(text, language) if language in _COMPILED else []


def symbols(text: str, language: str) -> list[Symbol]:
    """All symbols, as :func:`nodes` finds them."""
    return [s for s in nodes(text, language) if s.type not in CHUNK_ONLY]


# fixed values: kinds that a listing and an extraction admit, by language
LISTED = {
    "go": "function method struct interface type", "python": "function class", "java": "method class interface", "javascript": "function method class",
    "typescript": "function method class interface", "rust": "function method struct trait enum type impl", "cpp": "function method class struct enum", "html": "element script style", "xml": "element",
}
EXTRACTED = {
    "go": "function method struct interface type constant variable", "python": "function class", "java": "method constructor class interface enum", "javascript": "function method class constant variable",
    "typescript": "function method class interface type enum constant variable", "rust": "function method struct trait enum type constant", "cpp": "function method class struct enum", "html": "element script style", "xml": "element",
}
# fixed values: kinds that become chunks of their own, and their labels, by language
CHUNKED = {
    "go": {"function": "function", "method": "method", "declaration of types": "type"},
    "python": {"function": "function", "class": "class", "decorated": "decorated"},
    "java": {"method": "method", "class": "class", "interface": "interface", "enum": "enum", "constructor": "constructor"},
    "javascript": {"function": "function", "method": "method", "class": "class", "arrow": "function", "export": "export", "declaration": "declaration"},
    "rust": {"function": "function", "method": "function", "impl": "impl", "struct": "struct", "enum": "enum", "trait": "trait", "module": "module", "type": "type"},
    "cpp": {"function": "function", "method": "function", "class": "class", "struct": "struct", "enum": "enum", "namespace": "namespace", "template": "template"},
}
CHUNKED["typescript"] = CHUNKED["javascript"] | {"interface": "interface", "type": "type", "enum": "enum"}
#: Kinds that are places of chunks but no symbols.
CHUNK_ONLY = {"declaration of types", "decorated", "arrow", "export", "declaration", "module", "namespace", "template"}
#: Languages of chunks that are read by another one's rules.
GRAMMARS = {"tsx": "typescript", "jsx": "javascript", "c": "cpp"}


class Chunk(NamedTuple):
    start_line: int
    end_line: int
    node_type: str
    content: str


def chunks(text: str, language: str) -> list[Chunk]:
    """The outermost declarations as whole lines; none where there are none or the text can't be read."""
    grammar = GRAMMARS.get(language, language)
    labels = CHUNKED.get(grammar)
    if labels is None:
        return []
    try:
        syms = nodes(text, grammar)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, reach, lines = [], -1, text.split("\n")
    for s in syms:
        if s.type in labels and s.start >= reach:
            reach = s.end
            out.append(Chunk(s.start_line, s.end_line, labels[s.type], "\n".join(lines[s.start_line - 1 : s.end_line])))
    return out
