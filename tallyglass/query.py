"""One question in, one report out: classify, budget, fetch, score, render.

Sections are independent DataFrames, run side by side; a section that fails is
noted and doesn't take the others with it.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyglass.code_index import CodeIndex
from tallyglass.functions.paths import in_scope
from tallyglass.functions.routing import classify, has_failure_cue, is_class_like
from tallyglass.functions.routing import budget as budget_columns
from tallyglass.functions.routing import most_items
from tallyglass.operators import extract, outline, refs
from tallyglass.operators.edges import calls, type_edges
from tallyglass.functions.symbols import visibility
from tallyglass.sources.files import guards
from tallyglass.storage import stored

# fixed values: confidence of the ways an answer is found
CONFIDENCE = {"symbol": 0.85, "text": 0.50, "semantic": 0.40}
# fixed values: lines that parts of a report take beside their contents
SUMMARY_LINES, META_LINES, SLICE_LINES, OUTLINE_LINES = 5, 4, 3, 3
# fixed values: hints for the next question
NO_AST = "AST search is not yet implemented; try --mode symbol or --mode text"
RETRY = "retry with --path, or provide a fuller query"


#: Rows of a listing that a report shows; the table in ``Answer.tables`` has all.
SHOWN = 200

DETAILS = {"signature_plus_outline": "Outline", "signature_plus_slices": "Slices"}


@dataclass
class Answer:
    query: str
    mode: str
    status: str = "ok"
    confidence: float = 0.0
    definition: Row | None = None
    view: str = ""
    sections: dict[str, list[Row]] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    language: str = ""
    refs_total: int = 0
    chain: list[str] = field(default_factory=list)
    hint: str = ""
    total_lines: int = 0
    #: All rows of sections that the report shows the first ``SHOWN`` of, and their numbers.
    tables: dict[str, DataFrame] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)

    def hold(self, name: str, rows: DataFrame) -> list[Row]:
        """Keep a section's table (stored once, whole) and give the rows that are shown."""
        self.tables[name] = stored(rows, "answer")
        self.totals[name] = self.tables[name].count()
        return self.tables[name].orderBy("path").limit(SHOWN).collect()

    def used_lines(self) -> int:
        """About how many lines the report takes."""
        d, sections = self.definition, self.sections
        used = SUMMARY_LINES + META_LINES
        if d is not None and self.view == "body":
            used += d["code"].count("\n") + 1
        used += sum(r["code"].count("\n") + SLICE_LINES for r in sections.get("Slices", []))
        used += len(sections["Outline"]) + OUTLINE_LINES if sections.get("Outline") else 0
        return used + 2 * len(sections.get("References", [])) + 2 * len(sections.get("Callers", [])) + len(sections.get("Implementations", []))

    def markdown(self, verbose: bool = False) -> str:
        from tallyglass.render import answer

        return answer(self, verbose)


def _scalar(spark, *columns):
    return spark.range(1).select(*columns).first()


def ask(
    files: DataFrame, question: str, mode: str = "", budget: str = "auto", depth: int = 1, edges: DataFrame | None = None, search=None, index: CodeIndex | None = None, scope: str = ""
) -> Answer:
    """Answer ``question`` over ``files``, or the part of them in ``scope`` (a folder or file).

    With an ``index`` of the files, definitions, references, callers and implementations come from its tables and nothing is
    parsed; references are then whole identifiers.

    ``edges`` (caller, callee by name; path and line of the caller if known) gives callers, by default the calls in ``files``;
    ``search(question, k)`` gives semantic hits and may be missing.
    """
    spark, everywhere = files.sparkSession, files
    files = files.where(in_scope(F.col("path"), scope))
    lines_by = budget_columns(F.lit(budget), F.lit(depth))
    row = _scalar(spark, classify(F.lit(question), F.lit(mode)).alias("mode"), has_failure_cue(F.lit(question)).alias("failing"), *[c.alias(k) for k, c in lines_by.items()], most_items(lines_by["reference_lines"]).alias("n_refs"), most_items(lines_by["caller_lines"]).alias("n_callers"))
    answer = Answer(question, row["mode"])
    answer.total_lines = row["total_lines"]
    if row["mode"] == "ast":
        answer.status, answer.hint = "not_found", NO_AST
        return answer
    if row["mode"] == "path":
        found = guards(files.where((F.col("path") == question.strip()) | F.col("path").endswith("/" + question.strip()))).orderBy("path").take(1)
        answer.status = found[0]["status"] if found else "not_found"
        answer.sections["Files"] = found
        return answer
    if row["mode"] == "symbol":
        answer.chain.append("symbol")
        name = question.strip()
        found = extract.definitions(files.where(F.col("content").contains(name)), name) if index is None else index.definitions(name, files)
        matches = stored(found, "definitions")
        first = matches.orderBy("path").take(1)
        if first:
            others = matches.where(F.col("path") != first[0]["path"]).drop("code")
            answer.sections["Other definitions"] = answer.hold("Other definitions", others)
            _symbol(answer, files, first[0], row, edges, depth, index, scope, everywhere)
            return answer
    _text(answer, files, question.strip(), row["n_refs"], search)
    if row["mode"] == "symbol" and answer.status == "not_found":
        answer.status = "not_found_exact"
    return answer


def _symbol(answer: Answer, files: DataFrame, first: Row, row: Row, edges: DataFrame | None, depth: int, index: CodeIndex | None, scope: str, everywhere: DataFrame) -> None:
    spark = files.sparkSession
    answer.definition, answer.confidence, answer.language = first, CONFIDENCE["symbol"], first["language"]
    own = files.where(F.col("path") == first["path"])
    size = first["end_line"] - first["start_line"] + 1

    def details() -> list[Row]:
        if size <= row["definition_lines"]:
            answer.view = "body"
            return []
        if _scalar(spark, is_class_like(F.lit(first["type"])).alias("x"))["x"] and not row["failing"]:
            answer.view = "signature_plus_outline"
            members = extract.members(own, first["name"])
            members = members.withColumn("visibility", visibility(F.col("language"), F.col("name"), F.col("signature")))
            return outline.ranked(outline.capped(members)).orderBy("rank").collect()
        answer.view = "signature_plus_slices"
        span = own.withColumn("start_line", F.lit(first["start_line"])).withColumn("end_line", F.lit(first["end_line"]))
        return extract.sliced(span).collect()

    def references() -> list[Row]:
        found = refs.find(files, first["name"]) if index is None else refs.with_lines(index.references([first["name"]], scope), files)
        declared = spark.createDataFrame([(first["path"], int(first["start_line"]))], "path string, line int")
        scored = refs.score(refs.cross_check(found, declared), first["path"])
        answer.refs_total = scored.count()
        return refs.top(scored, row["n_refs"]).collect()

    def callers() -> list[Row]:
        from tallyglass.operators.callers import incoming

        near = files.where(F.col("content").contains(first["name"])) if depth <= 1 else files
        known = edges if edges is not None else index.call_edges() if index is not None else calls(near).select("caller", "callee", "path", F.col("declared").alias("line"))
        root = spark.createDataFrame([(first["name"],)], "node string")
        found = incoming(known, root, max(1, depth)).withColumnRenamed("node", "name")
        if not {"path", "line"} <= set(known.columns):
            return found.orderBy("depth", "name").limit(row["n_callers"]).collect()
        called = found.select(F.col("name").alias("callee")).unionByName(root.withColumnRenamed("node", "callee"))
        places = known.join(called, "callee", "left_semi").groupBy(F.col("caller").alias("name")).agg(F.min(F.struct("path", "line")).alias("at")).select("name", "at.*")
        scored = refs.score_callers(found.join(places, "name"), first["path"])
        return scored.orderBy(F.desc("score"), "path", "line", "name").limit(row["n_callers"]).collect()

    def implementations() -> list[Row]:
        if not _scalar(spark, is_class_like(F.lit(first["type"])).alias("x"))["x"]:
            return []
        known = type_edges(everywhere) if index is None else index.type_edges()
        subs = known.where((F.col("super") == first["name"]) & in_scope(F.col("path"), scope)).select(F.col("sub").alias("name"), "path", "line")
        return sorted(answer.hold("Implementations", subs), key=lambda r: (r["path"], r["line"], r["name"]))

    with ThreadPoolExecutor(4) as pool:
        jobs = {"Details": pool.submit(details), "References": pool.submit(references), "Callers": pool.submit(callers), "Implementations": pool.submit(implementations)}
        for name, job in jobs.items():
            try:
                rows = job.result()
                answer.sections[DETAILS.get(answer.view, name) if name == "Details" else name] = rows
            except Exception as e:  # noqa: BLE001  a section's failure is reported, the others stand
                answer.errors.append(f"{name}: {e}")


def _text(answer: Answer, files: DataFrame, question: str, k: int, search) -> None:
    answer.chain.append("text")
    hits = refs.find(files, question)
    first = hits.orderBy("path", "line").select("path").take(1)
    found = refs.top(refs.score(hits, first[0]["path"]), k).collect() if first else []
    if found:
        answer.sections["References"], answer.confidence, answer.refs_total = found, CONFIDENCE["text"], hits.count()
        return
    if search is not None:
        answer.chain.append("semantic")
    hits = search(question, max(3, k)).collect() if search is not None else []
    answer.sections["Semantic"] = hits
    answer.confidence = CONFIDENCE["semantic"] if hits else 0.0
    answer.status, answer.hint = ("ok", "") if hits else ("not_found", RETRY)
