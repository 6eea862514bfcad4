"""Calls, declared supertypes and owned methods in a source file: by name, as there is no type checker."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from tallyglass.kernels import declarations as decl


class Call(NamedTuple):
    caller: str
    callee: str
    line: int
    declared: int  #: the line on which the caller is declared


class Super(NamedTuple):
    name: str
    parent: str
    line: int


class Member(NamedTuple):
    owner: str
    name: str
    line: int
    required: bool


class Relations(NamedTuple):
    calls: list[Call]
    supers: list[Super]
    members: list[Member]


_CALLABLE = ("function", "method", "constructor")
_CALL = re.compile(rf"(?P<name>{decl._ID})\s*(?:{decl._GEN})?\s*(?=\()")
_PARENTS = {
    "java": re.compile(r"\b(?:extends|implements)\s+([^{]*?)(?=\b(?:extends|implements|permits)\b|\{)"),
    "javascript": re.compile(r"\bextends\s+([^{]*?)(?=\{)"),
    "typescript": re.compile(r"\b(?:extends|implements)\s+([^{]*?)(?=\b(?:extends|implements)\b|\{)"),
    "cpp": re.compile(r"(?<!:):(?!:)\s*([^{;]*?)(?=\{)"),
}
_RUST_IMPL = re.compile(rf"impl\b(?:{decl._GEN})?\s*!?(?:{decl._ID}::)*({decl._ID})[^{{;]*?\bfor\s")
_GO_REQUIRED = re.compile(rf"(?:^|(?<=[{{;]))[ \t]*({decl._ID})\s*(?=\()", re.M)
_CPP_WORDS = {"public", "private", "protected", "virtual"}


def _last(name: str) -> str:
    return re.split(r"::|\.", name)[-1]


def _python(text: str) -> Relations:
    calls, supers, members = [], [], []

    def name_of(node: ast.AST) -> str:
        node = node.value if isinstance(node, ast.Subscript) else node
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""

    todo: list[tuple[ast.AST, str, str, int]] = [(decl.python_tree(text), "", "", 0)]
    while todo:
        node, caller, owner, declared = todo.pop()
        if isinstance(node, ast.Call) and caller and name_of(node.func):
            calls.append(Call(caller, name_of(node.func), node.lineno, declared))
        if isinstance(node, ast.ClassDef):
            supers += [Super(node.name, name_of(b), node.lineno) for b in node.bases if name_of(b)]
            owner = node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            if owner:
                members.append(Member(owner, node.name, node.lineno, False))
            caller, owner, declared = node.name, "", node.lineno
        todo += [(c, caller, owner, declared) for c in ast.iter_child_nodes(node)]
    return Relations(sorted(calls, key=lambda c: c.line), sorted(supers, key=lambda s: s.line), sorted(members, key=lambda m: m.line))


def _split(list_of_types: str) -> list[str]:
    """The names in a list of types, without what they are applied to."""
    flat = list_of_types
    while (shorter := re.sub(r"<[^<>]*>|\([^()]*\)", "", flat)) != flat:
        flat = shorter
    names = [[w for w in re.findall(r"[\w$:.]+", part) if w not in _CPP_WORDS] for part in flat.split(",")]
    return [_last(ws[-1]) for ws in names if ws and _last(ws[-1])]


def relations(text: str, language: str) -> Relations:
    """Calls from inside named functions, supertypes that declarations name, and methods of types (``required``: of a Go interface)."""
    if language == "python":
        return _python(text)
    if language not in decl._COMPILED:
        return Relations([], [], [])
    syms, src = decl.symbols(text, language), decl._Source(text, language)
    supers: list[Super] = []
    members: list[Member] = []
    heads: set[int] = set()
    spans = []
    for s in syms:
        if s.type in _CALLABLE:
            plain = s.name.lstrip("~#")
            head = re.compile(rf"(?<![\w$]){re.escape(plain)}\s*(?=[(<\[])").search(src.code, s.start if language != "go" or s.type != "method" else src.past(src.code.find("(", s.start)), s.end)
            if head:
                heads.add(head.start())
            spans.append((s.start, s.end, s.name, s.start_line))
            if s.container:
                members.append(Member(s.container, s.name, s.start_line, False))
        elif s.type == "impl":
            trait = _RUST_IMPL.match(src.code, src.code.find("impl", s.start))
            if trait:
                supers.append(Super(s.name, trait[1], s.start_line))
        elif s.type in ("class", "interface", "enum", "struct") and language in _PARENTS:
            brace, _ = src.body(s.start)
            if brace >= 0:
                supers += [Super(s.name, p, s.start_line) for m in _PARENTS[language].finditer(src.code, s.start, brace + 1) for p in _split(m[1])]
        elif s.type == "interface" and language == "go":
            brace = src.code.find("{", s.start)
            members += [Member(s.name, m[1], src.line(m.start(1)), True) for m in _GO_REQUIRED.finditer(src.code, brace, s.end) if src.around(m.start(1)) == brace]
    calls: list[Call] = []
    around: list[tuple[int, int, str, int]] = []
    at = 0
    for m in _CALL.finditer(src.code):
        while at < len(spans) and spans[at][0] <= m.start():
            around.append(spans[at])
            at += 1
        while around and around[-1][1] <= m.start():
            around.pop()
        if around and m.start() not in heads and m["name"] not in decl._NOT_NAMES and m["name"] not in ("func", "fn"):
            calls.append(Call(around[-1][2], m["name"], src.line(m.start()), around[-1][3]))
    return Relations(calls, supers, members)
