"""Salient slices of a definition: header, error and I/O places, return path."""

from __future__ import annotations

from typing import NamedTuple

# fixed values: what marks a line as error handling or I/O
# fixed values: labels and reasons of slices
HEADER_LABEL, ERROR_LABEL, IO_LABEL, RETURN_LABEL = ("Header slice", "function entry"), ("Error path slice", "error handling"), ("I/O site slice", "external I/O"), ("Return path slice", "return path")
ERROR_MARKS = ("if err", "catch", "except ", "rescue ")
IO_MARKS = ("Read", "Write", "Open", "Close", "Get", "Post", "Query", "Exec", "Send", "Recv")
HEADER, TAIL, SLICE, MOST_SALIENT, MOST = 12, 10, 10, 3, 4


class Slice(NamedTuple):
    label: str
    start: int
    end: int
    reason: str
    code: str


def _code(lines: list[str], a: int, b: int) -> str:
    return "\n".join(lines[a - 1 : b])


def salient(lines: list[str], start: int, end: int) -> list[Slice]:
    """Up to three places, error marks before I/O marks in a line; a slice is skipped past before the next is sought."""
    out, i = [], start
    while i <= min(end, len(lines)) and len(out) < MOST_SALIENT:
        line = lines[i - 1]
        kind = ERROR_LABEL if any(m in line for m in ERROR_MARKS) else IO_LABEL if any(m in line for m in IO_MARKS) else None
        if kind is not None:
            last = min(i + SLICE, end)
            out.append(Slice(kind[0], i, last, kind[1], _code(lines, i, last)))
            i = last
        i += 1
    return out


def definition(text: str, start: int, end: int) -> list[Slice]:
    """At most four slices: the header, the salient places after it, and the return path if the body goes on past the header and there is room."""
    lines = text.split("\n")
    end = min(end, len(lines))
    head = min(start + HEADER, end)
    out = [Slice(HEADER_LABEL[0], start, head, HEADER_LABEL[1], _code(lines, start, head))]
    out += [s for s in salient(lines, start, end) if s.start > head]
    if end - TAIL > head and len(out) < MOST:
        out.append(Slice(RETURN_LABEL[0], end - TAIL, end, RETURN_LABEL[1], _code(lines, end - TAIL, end)))
    return out[:MOST]
