"""Text renderers: string aggregation over ordered rows, one string for each report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def _ordered(order: tuple[str, ...], line: str = "text") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda s: s[line]), "\n")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def search_results(hits: DataFrame) -> DataFrame:
    """``hits`` (rank, path, start_line, end_line, score, description) as one report."""
    head = F.format_string("[%d] %s:%d-%d (score: %.2f)\n    %s", *[F.col(c) for c in ("rank", "path", "start_line", "end_line", "score", "description")])
    out = hits.withColumn("text", head).agg(_ordered(("rank",)).alias("report"))
    return out.select(F.when(F.col("report") == "", "No results found.").otherwise(F.col("report")).alias("report"))


def references(refs: DataFrame, note: str = "") -> DataFrame:
    """``refs`` (path, line, snippet) grouped by path, imports left out, with their number at the end."""
    from tallyglass.operators.refs import without_imports

    kept = without_imports(refs)
    line = F.concat(F.lit("  :"), F.col("line").cast("string"), F.lit("  "), F.col("snippet"))
    groups = kept.withColumn("text", line).groupBy("path").agg(F.count("*").alias("n"), _ordered(("line",)).alias("body"))
    groups = groups.withColumn("text", F.concat(F.col("path"), F.lit(" ("), _plural(F.col("n"), "ref", "refs"), F.lit(")\n"), F.col("body")))
    out = groups.agg(_ordered(("path",)).alias("body"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    head = F.lit(note + "\n" if note else "")
    return out.select(F.concat(head, F.when(F.col("n") > 0, F.concat("body", F.lit("\n\n"))).otherwise(""), _plural(F.col("n"), "reference found", "references found")).alias("report"))


def callers(rows: DataFrame, root: str, depth: int) -> DataFrame:
    """``rows`` (ordinal, name, path, line, depth) indented by depth below the root."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("<- "), "name", F.lit(" ("), "path", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    out = rows.withColumn("text", line).agg(_ordered(("ordinal",)).alias("body"), F.count("*").alias("n"))
    tail = F.concat(_plural(F.col("n"), "caller", "callers"), F.lit(f" (depth {depth})"))
    return out.select(F.concat(F.lit(root + "\n"), F.when(F.col("n") > 0, F.concat("body", F.lit("\n"))).otherwise(""), tail).alias("report"))


def implementations(rows: DataFrame) -> DataFrame:
    line = F.concat("name", F.lit(" ("), "path", F.lit(")"))
    out = rows.withColumn("text", line).agg(_ordered(("path", "name")).alias("body"), F.count("*").alias("n"))
    return out.select(F.concat(F.when(F.col("n") > 0, F.concat("body", F.lit("\n"))).otherwise(""), _plural(F.col("n"), "implementation found", "implementations found")).alias("report"))


def check_report(rows: DataFrame) -> DataFrame:
    """target_id, report, n of diagnostics (path, line, col, message): a header where the path changes."""
    order = ("path", "line", "col", "message")
    before = F.lag("path").over(Window.partitionBy("target_id").orderBy(*order))
    head = F.when(before.isNull() | (before != F.col("path")), F.concat("path", F.lit("\n"))).otherwise("")
    line = F.concat(head, F.lit("  "), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit("  "), "message")
    return rows.withColumn("text", line).groupBy("target_id").agg(_ordered(order).alias("report"), F.count("*").alias("n"))


def check_text(reports: DataFrame) -> DataFrame:
    """One text for a target's report with its number, or the sentence for none."""
    some = F.concat("report", F.lit("\n\n"), _plural(F.col("n"), "syntax error found", "syntax errors found"))
    return reports.select(F.when(F.col("n") == 0, "No syntax errors found").otherwise(some).alias("text"))


def symbol_table(rows: DataFrame) -> DataFrame:
    """Listed symbols (path, type, name, start_line, end_line) as tab-separated lines."""
    loc = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    line = F.concat_ws("\t", "path", "type", "name", F.format_string("L%d-L%d", F.col("start_line"), F.col("end_line")), F.concat(F.lit("LOC="), loc.cast("string")))
    return rows.withColumn("text", line).agg(_ordered(("path", "start_line", "name")).alias("report"))


# fixed values: characters that JSON output escapes beside those it must
_ESCAPED = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026"})


def _json(rows: list[dict] | dict) -> str:
    return json.dumps(rows, indent=2, ensure_ascii=False).translate(_ESCAPED)


def _match(r: Row) -> dict:
    """A definition as its JSON object; offsets count characters."""
    return {"name": r["name"], "code": r["code"], "file_path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"], "start_byte": r["start"], "end_byte": r["end"], "symbol_type": r["type"]}


def extraction(matches: list[Row], as_json: bool = False, single: bool = False) -> str:
    """Definitions of one symbol: their code below file headings, or JSON; ``single`` is for the only match of one file."""
    if as_json:
        return _json(_match(matches[0]) if single else [_match(r) for r in matches])
    return matches[0]["code"] if single else "\n\n".join(f"=== file: {r['path']} ===\n{r['code']}" for r in matches)


def symbol_json(rows: list[Row]) -> str:
    """Listed symbols with their code as JSON, in the order given."""
    return _json([_match(r) | {"loc": max(r["end_line"] - r["start_line"] + 1, 0)} for r in rows])


def summary(directory: str, rows: list[Row], warnings: list[str] | None = None, as_json: bool = False) -> str:
    """Files (path, total_lines, symbol_counts) of a directory with their lines and symbols, by path."""
    rows = sorted(rows, key=lambda r: r["path"])
    total = sum(r["total_lines"] for r in rows)
    if as_json:
        files = [{"file_path": r["path"], "total_lines": r["total_lines"], "symbol_counts": dict(sorted(r["symbol_counts"].items()))} for r in rows]
        return _json({"dir_path": directory, "file_count": len(rows), "total_lines": total, "files": files} | ({"warnings": warnings} if warnings else {}))
    head = f"{directory}  ({len(rows)} files, {total} lines)"
    wide, digits = max((len(r["path"]) for r in rows), default=0), max((len(str(r["total_lines"])) for r in rows), default=0)
    body = []
    for r in rows:
        counts = " ".join(f"{kind}({n})" for kind, n in sorted(r["symbol_counts"].items()))
        body.append(f"  {r['path']:<{wide}} {r['total_lines']:>{digits}} lines" + (f"    {counts}" if counts else ""))
    return "\n\n".join([head, "\n".join(body)]) if body else head


# fixed values: the templates of an answer's report
_TOO_LARGE = """# Error: File Too Large (`{0}`)
Reading this file will overflow your context window.

▶ To search for a specific error, you may now use grep:
`grep -n "PATTERN" {0}`
▶ To read the end of the file, you may use tail:
`tail -n 100 {0}`
"""
_NOT_FOUND = "# No Exact Symbol: `{0}`\nNo exact symbol named `{0}` was found.\n"
_SIGNATURE_CHARS, _REMAINING = 80, 6


def _fenced(language: str, code: str) -> str:
    return f"```{language}\n{code}\n```"


def _outline(members: list[Row]) -> list[str]:
    table = [f"### Member Outline ({len(members)} members)", "| Line | Kind | Visibility | Name |", "|------|------|------------|------|"]
    for m in sorted(members, key=lambda m: m["line"]):
        text = m["signature"]
        text = text[:_SIGNATURE_CHARS] + "..." if len(text) > _SIGNATURE_CHARS else text
        table.append(f"| {m['line']} | {m['type']} | {m['visibility'] or '-'} | `{text}` |")
    more = [m["name"] for m in members if m["type"] in ("method", "constructor")][:_REMAINING]
    return ["\n".join(table) + "\n", *([f"> Next most relevant methods: `{'`, `'.join(more)}`\n"] if more else [])]


def _meta(a, verbose: bool) -> list[str]:
    if not (verbose or a.hint or a.errors):
        return []
    chain = [f"- `search_chain`: `{' -> '.join(a.chain)}`"] if verbose else []
    hint = [f"- `next_hint`: `{a.hint}`"] if a.hint else []
    errors = ["- `errors`:", *[f"  - `{e}`" for e in a.errors]] if a.errors else []
    return ["\n".join(["## Meta", *chain, *hint, *errors]) + "\n"]


def _section(title: str, rows: list[str]) -> list[str]:
    return ["\n".join([title, *rows]) + "\n"] if rows else []


def answer(a, verbose: bool = False) -> str:
    """The Markdown report of an :class:`tallyglass.query.Answer`."""
    found = a.sections.get("References", [])
    if a.status == "file_too_large":
        return _TOO_LARGE.format(a.query)
    if a.status.startswith("not_found"):
        hits = [f"- `{r['path']}:{r['line']}` `{r['snippet'].strip()}`" for r in found]
        return "\n".join([_NOT_FOUND.format(a.query), *_section(f"## Text matches ({len(hits)})", hits), *_meta(a, verbose)])
    d, summary_lines = a.definition, ["## Summary"]
    if d is not None:
        summary_lines += [f"- kind: `{d['type']}`", f"- file: `{d['path']}`", *([f"- view: `{'full_body' if a.view == 'body' else a.view}`"] if verbose else [])]
    if verbose:
        summary_lines += [f"- confidence: `{a.confidence:.2f}`", f"- budget: `{a.total_lines} lines total / {a.used_lines()} used`"]
    out = [f"# Symbol: `{d['name'] if d is not None else a.query}`\n", "\n".join(summary_lines) + "\n"]
    if d is not None:
        shown = d["code"] if a.view == "body" else d["signature"]
        out.append(f"## Definition (lines {d['start_line']}-{d['end_line']})\n{_fenced(a.language, shown)}\n")
        out += _outline(a.sections["Outline"]) if a.sections.get("Outline") else []
        for s in a.sections.get("Slices", []):
            size = s["end"] - s["start"]
            out.append(f"### {s['label']} (lines {s['start']}-{s['end']})\n{_fenced(a.language, s['code'])}" + (f"\n... {size} lines shown ...\n" if size else ""))
    others, callers_, subs = (a.sections.get(k, []) for k in ("Other definitions", "Callers", "Implementations"))
    of = lambda name, rows: a.totals.get(name, len(rows))
    more = lambda name, rows: [f"- ... and {of(name, rows) - len(rows)} more"] if of(name, rows) > len(rows) else []
    listed = [f"- `{r['path']}` (`{r['type']}`, lines {r['start_line']}-{r['end_line']})" for r in others]
    out += _section(f"## Other Definitions ({of('Other definitions', others)})", listed + more("Other definitions", others))
    out += _section(f"## References ({len(found)} shown of {a.refs_total}, ranked)", [f"- `{r['path']}:{r['line']}` score `{r['score']:.0f}` reason `{r['reason']}`" for r in found])
    where = [{"path": "", "line": 0, "reason": ""} | r.asDict() for r in callers_]
    out += _section(f"## Callers ({len(callers_)} shown, ranked)", [f"- `{r['name']}` (`{r['path']}:{r['line']}`) reason `{r['reason']}`" for r in where])
    out += _section(f"## Implementations ({of('Implementations', subs)})", [f"- `{r['name']}` (`{r['path']}:{r['line']}`)" for r in subs] + more("Implementations", subs))
    for title in ("Files", "Semantic"):
        out += _section(f"## {title}", [f"- `{r['path']}`" for r in a.sections.get(title, [])])
    return "\n".join([*out, *_meta(a, verbose)])
