"""References, callers, types, symbols, diagnostics, outlines and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.functions import paths, routing, symbols, text
from tallyglass.operators import callers, diagnostics, implements, multi_find, outline, refs
from tallyglass.plans import views as v
from tallyglass.plans.registry import query
from tallyglass.storage import fresh_path
from tallyglass.streaming import debounce

TERM = "ation"
_REFS = f"{v.FILES}, {v.LINES}, refs AS (SELECT DISTINCT path, line, {v.squeeze('snippet')} AS snippet FROM lines WHERE contains(snippet, '{TERM}'))"
_DEF = "definition AS (SELECT min(path) AS d FROM refs)"
_DIR = lambda p: f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"
_TEST = "(regexp_matches(path, '(_test\\.go|\\.test\\.ts|\\.test\\.js|_test\\.py)$') OR regexp_matches(path, '(^|/)test_[^/]*$') OR contains(path, '/test/') OR contains(path, '/tests/'))"
_PROX = """2.0 * (CASE WHEN split_part(path, '/', 1) <> split_part(d, '/', 1) THEN 0 WHEN split_part(path, '/', 2) <> split_part(d, '/', 2) THEN 1
  WHEN split_part(path, '/', 3) <> split_part(d, '/', 3) THEN 2 ELSE 3 END) / len(string_split(d, '/'))"""
_SCORED = f"""{_REFS}, {_DEF}, counted AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM refs, definition),
scored AS (SELECT path, line, snippet, round(CASE WHEN contains(snippet, '(') THEN 3.0 ELSE 0 END + CASE WHEN {_DIR('path')} = {_DIR('d')} THEN 2.0 ELSE 0 END + {_PROX}
    + CASE WHEN {_TEST} THEN 1.0 ELSE 0 END - CASE WHEN n > 2 THEN 2.0 ELSE 0 END, 6) AS score,
  concat_ws(' + ', CASE WHEN contains(snippet, '(') THEN 'direct call' END, CASE WHEN path = d THEN 'same file' WHEN {_DIR('path')} = {_DIR('d')} THEN 'same package' END, CASE WHEN {_TEST} THEN 'test anchor' END) AS reason
  FROM counted)"""


def _refs(spark, d):
    return refs.find(v.files(spark, d), TERM).withColumn("line", F.col("line").cast("long"))


def _definition(found) -> str:
    return found.agg(F.min("path")).first()[0] or ""


@query("grep_refs", f"WITH {_REFS} SELECT path, line, snippet FROM refs")
def grep_refs(spark, d):
    return _refs(spark, d)


@query("refs_by_file", f"WITH {_REFS} SELECT path, count(*) AS n_refs, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM refs GROUP BY path")
def refs_by_file(spark, d):
    return refs.by_path(_refs(spark, d))


@query("refs_distinct", f"WITH {v.FILES}, {v.LINES} SELECT count(*) AS n FROM (SELECT DISTINCT {v.squeeze('snippet')} AS s FROM lines WHERE contains(snippet, 'the'))")
def refs_distinct(spark, d):
    return refs.grep(v.lines(spark, d), "the").select("snippet").distinct().agg(F.count("*").alias("n"))


@query("score_refs", f"WITH {_SCORED} SELECT path, line, score, reason FROM scored")
def score_refs(spark, d):
    found = _refs(spark, d)
    return refs.score(found, _definition(found)).select("path", "line", "score", "reason")


@query("topk_refs", f"WITH {_SCORED} SELECT path, line, score FROM scored ORDER BY score DESC, path, line, snippet LIMIT 10")
def topk_refs(spark, d):
    found = _refs(spark, d)
    return refs.top(refs.score(found, _definition(found)), 10).select("path", "line", "score")


@query("path_proximity", f"WITH {v.FILES}, p AS (SELECT path, 'src1/en/doc_1_test.go' AS d FROM files) SELECT path, round({_PROX}, 6) AS proximity FROM p")
def path_proximity(spark, d):
    return v.files(spark, d).select("path", F.round(paths.proximity(F.col("path"), F.lit("src1/en/doc_1_test.go")), 6).alias("proximity"))


@query("refs_minus_imports", f"WITH {_REFS} SELECT path, line FROM refs WHERE NOT starts_with(snippet, 'import ')")
def refs_minus_imports(spark, d):
    return refs.without_imports(_refs(spark, d)).select("path", "line")


@query("cross_check_diff", f"WITH {_REFS}, decl AS (SELECT path, min(line) AS line FROM refs GROUP BY path) SELECT path, line FROM refs ANTI JOIN decl USING (path, line)")
def cross_check_diff(spark, d):
    found = _refs(spark, d)
    return refs.cross_check(found, found.groupBy("path").agg(F.min("line").alias("line"))).select("path", "line")


@query("cross_check_note", f"""WITH {_REFS}, decl AS (SELECT path, min(line) AS line FROM refs GROUP BY path), x AS (SELECT path, line FROM refs ANTI JOIN decl USING (path, line))
  SELECT (SELECT count(*) FROM x) AS total, (SELECT coalesce(string_agg(path || ':' || line, ', ' ORDER BY path, line), '') FROM (SELECT * FROM x ORDER BY path, line LIMIT 5)) AS shown,
         (SELECT greatest(count(*) - 5, 0) FROM x) AS more""")  # fmt: skip
def cross_check_note(spark, d):
    found = _refs(spark, d)
    return refs.cross_check_note(found, found.groupBy("path").agg(F.min("line").alias("line")))


@query("fallback_priority", f"""WITH {v.FILES}, {v.LINES}, c AS (SELECT 1 AS query_id, 1 AS priority, path, line FROM lines WHERE contains(snippet, 'zzzz')
  UNION ALL SELECT 1, 2, path, line FROM lines WHERE contains(snippet, '{TERM}') UNION ALL SELECT 2, 1, path, line FROM lines WHERE contains(snippet, 'Licensed') UNION ALL SELECT 2, 2, path, line FROM lines WHERE contains(snippet, '{TERM}'))
  SELECT query_id, path, line FROM c WHERE priority = (SELECT min(priority) FROM c AS e WHERE e.query_id = c.query_id)""")  # fmt: skip
def fallback_priority(spark, d):
    lines = v.lines(spark, d)
    parts = [lines.where(F.col("snippet").contains(t)).select(F.lit(q).alias("query_id"), F.lit(p).alias("priority"), "path", "line") for q, p, t in ((1, 1, "zzzz"), (1, 2, TERM), (2, 1, "Licensed"), (2, 2, TERM))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return refs.priority_fallback(union).drop("priority")


def _recursive(edges: str, root: str, depth: int) -> str:
    return f"""WITH RECURSIVE {edges}, walk(node, depth) AS (SELECT {root}, 0 UNION SELECT e.caller, w.depth + 1 FROM edges e JOIN walk w ON e.callee = w.node AND e.caller <> e.callee WHERE w.depth < {depth})
  SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node HAVING min(depth) > 0"""


@query("callers_bfs", _recursive("edges AS (SELECT p_partkey AS caller, p_partkey // 2 AS callee FROM part)", "CAST(1 AS BIGINT)", 4))
def callers_bfs(spark, d):
    return callers.incoming(v.part_edges(spark, d), spark.createDataFrame([(1,)], "node long"), 4)


@query("callers_cyclic", _recursive(v.SUPPLY_EDGES, "'s1'", 3))
def callers_cyclic(spark, d):
    return callers.incoming(v.supply_edges(spark, d), spark.createDataFrame([("s1",)], "node string"), 3)


@query("callers_by_depth", f"WITH b AS ({_recursive(v.SUPPLY_EDGES, chr(39) + 's2' + chr(39), 2)}) SELECT depth, count(*) AS n FROM b GROUP BY depth")
def callers_by_depth(spark, d):
    return callers.incoming(v.supply_edges(spark, d), spark.createDataFrame([("s2",)], "node string"), 2).groupBy("depth").agg(F.count("*").alias("n"))


@query("score_callers", f"""WITH b AS ({_recursive("edges AS (SELECT p_partkey AS caller, p_partkey // 2 AS callee FROM part)", "CAST(1 AS BIGINT)", 3)}),
  p AS (SELECT node, depth, 'src' || node % 3 || '/en/f' || node % 5 || '.go' AS path, 'src1/en/f1.go' AS d FROM b)
  SELECT node, depth, round(3.0 + CASE WHEN {_DIR('path')} = {_DIR('d')} THEN 2.0 ELSE 0 END + {_PROX} + CASE WHEN depth <= 1 THEN 1.0 ELSE 0 END, 6) AS score FROM p""")  # fmt: skip
def score_callers(spark, d):
    found = callers.incoming(v.part_edges(spark, d), spark.createDataFrame([(1,)], "node long"), 3)
    node = F.col("node")
    path = F.concat(F.lit("src"), (node % 3).cast("string"), F.lit("/en/f"), (node % 5).cast("string"), F.lit(".go"))
    return refs.score_callers(found.withColumn("path", path), "src1/en/f1.go").select("node", "depth", "score")


_TYPES = """t AS (SELECT 'c' || c_custkey AS sub, 'n' || c_nationkey AS super FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _type_edges(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sub"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("super"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sub"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("super"))
    return c.unionByName(n)


@query("implements_subtypes", f"WITH {_TYPES} SELECT super, sub FROM t WHERE super IN ('r1', 'n3')")
def implements_subtypes(spark, d):
    return implements.subtypes(_type_edges(spark, d), spark.createDataFrame([("r1",), ("n3",)], "super string"))


@query("implements_fallback", """WITH a AS (SELECT c_nationkey AS query_id, c_name AS name FROM customer WHERE c_acctbal > 9900), b AS (SELECT s_nationkey AS query_id, s_name AS name FROM supplier)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a)""")  # fmt: skip
def implements_fallback(spark, d):
    """Nations without a rich customer answer with their suppliers."""
    first = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("query_id"), F.col("c_name").alias("name"))
    return implements.with_fallback(first, spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("query_id"), F.col("s_name").alias("name")))


@query("implements_distinct", "SELECT l_orderkey AS query_id, 'p' || l_partkey AS path, l_returnflag AS name, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3")
def implements_distinct(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    found = li.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("line"))
    return implements.distinct_lines(found)


@query("symbol_match", f"WITH {v.PART_SYMBOLS}, w AS (SELECT DISTINCT name AS wanted FROM symbols) SELECT p_partkey, wanted FROM symbols JOIN w ON name = wanted OR starts_with(name, wanted || '(')")
def symbol_match(spark, d):
    s = v.part_symbols(spark, d)
    wanted = s.select(F.col("name").alias("wanted")).distinct()
    return s.withColumn("wanted", F.explode(symbols.name_keys(F.col("name")))).join(wanted, "wanted").select("p_partkey", "wanted")


@query("symbol_kind", f"WITH {v.PART_SYMBOLS} SELECT p_partkey, CASE kind WHEN 12 THEN 'function' WHEN 6 THEN 'method' WHEN 5 THEN 'class' WHEN 11 THEN 'interface' WHEN 14 THEN 'constant' ELSE 'type' END AS label, kind IN (5, 11, 10, 23, 26) AS is_type, kind IN (12, 6, 9) AS callable FROM symbols")
def symbol_kind(spark, d):
    k = F.col("kind")
    return v.part_symbols(spark, d).select("p_partkey", symbols.kind_label(k).alias("label"), symbols.kind_matches(k, "type").alias("is_type"), symbols.is_callable(k).alias("callable"))


@query("symbol_ambiguous", f"WITH {v.PART_SYMBOLS} SELECT name, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS candidates FROM symbols GROUP BY name")
def symbol_ambiguous(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return v.part_symbols(spark, d).groupBy("name").agg(F.when(F.count("*") > 1, "ambiguous").otherwise("ok").alias("status"), listed.alias("candidates"))


@query("symbol_first", f"WITH {v.PART_SYMBOLS} SELECT name, p_partkey FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, p_partkey) = 1")
def symbol_first(spark, d):
    return v.part_symbols(spark, d).groupBy("name").agg(F.min_by("p_partkey", F.struct("path", "p_partkey")).alias("p_partkey"))


# names of symbols that both engines derive from parts by the same expressions
_WORD = "split_part(p_name, ' ', 2)"
_NAMED = f"CASE p_partkey % 5 WHEN 0 THEN p_type || '.' || {_WORD} || '(int)' WHEN 1 THEN '(*' || p_type || ').' || {_WORD} WHEN 2 THEN {_WORD} WHEN 3 THEN 'pkg.' || p_type || '.' || {_WORD} ELSE {_WORD} || '()' END"
_OWNER = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_type ELSE '(*' || p_type || ')' END"


@query("caller_symbol_match", f"""WITH p AS (SELECT p_partkey, {_NAMED} AS name, {_OWNER} AS container FROM part),
  n AS (SELECT *, CASE WHEN starts_with(name, '(') THEN name ELSE regexp_replace(name, '\\(.*$', '') END AS t FROM p),
  o AS (SELECT *, split_part(t, '.', -1) AS base, regexp_replace(CASE WHEN contains(t, '.') THEN regexp_replace(t, '\\.[^.]*$', '') ELSE '' END, '[()*]', '', 'g') AS owner FROM n)
  SELECT p_partkey, base, owner, base = 'gear' AS bare, base = 'gear' AND (owner = 'ECONOMY' OR regexp_replace(container, '[()*]', '', 'g') = 'ECONOMY') AS qualified FROM o""")  # fmt: skip
def caller_symbol_match(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_NAMED).alias("name"), F.expr(_OWNER).alias("container"))
    name, c = F.col("name"), F.col("container")
    return n.select("p_partkey", symbols.base_part(name).alias("base"), symbols.container_part(name).alias("owner"), symbols.caller_matches(name, c, F.lit("gear")).alias("bare"), symbols.caller_matches(name, c, F.lit("ECONOMY.gear")).alias("qualified"))


@query("node_identity", f"WITH {v.PART_SYMBOLS} SELECT path || ':' || kind || ':' || p_partkey % 7 || ':' || name AS identity, count(*) AS n FROM symbols GROUP BY 1")
def node_identity(spark, d):
    out = v.part_symbols(spark, d).select(symbols.identity(F.col("path"), F.col("kind"), F.col("p_partkey") % 7, F.col("name")).alias("identity"))
    return out.groupBy("identity").agg(F.count("*").alias("n"))


_IDENT = f"CASE p_partkey % 4 WHEN 0 THEN upper({_WORD}) WHEN 1 THEN {_WORD} WHEN 2 THEN '__' || {_WORD} ELSE '#' || {_WORD} END"
_SIGNATURE = "CASE p_size % 5 WHEN 0 THEN 'pub fn x' WHEN 1 THEN 'private x' WHEN 2 THEN 'static protected x' WHEN 3 THEN 'public x' ELSE 'publicly x' END"


@query("visibility", f"""WITH n AS (SELECT p_partkey, {_IDENT} AS name, {_SIGNATURE} AS sig FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 'public' ELSE 'private' END AS go, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS py, CASE WHEN starts_with(sig, 'pub') THEN 'public' ELSE 'private' END AS rs,
    CASE WHEN contains(sig, 'private') THEN 'private' WHEN contains(sig, 'protected') THEN 'protected' WHEN starts_with(sig, 'public ') THEN 'public' ELSE 'package' END AS java,
    CASE WHEN contains(sig, 'private') THEN 'private' WHEN contains(sig, 'protected') THEN 'protected' WHEN starts_with(name, '#') THEN 'private' ELSE 'public' END AS ts FROM n""")  # fmt: skip
def visibility(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_IDENT).alias("name"), F.expr(_SIGNATURE).alias("sig"))
    f = lambda lang: symbols.visibility(F.lit(lang), F.col("name"), F.col("sig"))
    return n.select("p_partkey", f("go").alias("go"), f("python").alias("py"), f("rust").alias("rs"), f("java").alias("java"), f("typescript").alias("ts"))


@query("diag_latest", f"WITH {v.DIAGNOSTICS} SELECT uri, event_id, severity FROM diags QUALIFY row_number() OVER (PARTITION BY uri ORDER BY ts DESC, event_id DESC) = 1")
def diag_latest(spark, d):
    return diagnostics.latest(v.diagnostics(spark, d)).select("uri", "event_id", "severity")


_REPORT = f"SELECT DISTINCT uri % 3 AS target_id, 'f' || uri || '.go' AS path, line + 1 AS line, character + 1 AS col, {v.squeeze('message')} AS message FROM diags WHERE severity IN (0, 1)"


def _report(spark, d):
    rows = v.diagnostics(spark, d).select("severity", "line", "character", "message", (F.col("uri") % 3).alias("target_id"), F.concat(F.lit("f"), F.col("uri").cast("string"), F.lit(".go")).alias("path"))
    return diagnostics.report_lines(rows)


@query("diag_distinct", f"WITH {v.DIAGNOSTICS} {_REPORT}")
def diag_distinct(spark, d):
    return _report(spark, d)


@query("diag_report", f"""WITH {v.DIAGNOSTICS}, r AS ({_REPORT}), o AS (SELECT *, lag(path) OVER (PARTITION BY target_id ORDER BY path, line, col, message) AS prev FROM r)
  SELECT target_id, sha256(string_agg(CASE WHEN prev IS NULL OR prev <> path THEN path || chr(10) ELSE '' END || '  ' || line || ':' || col || '  ' || message, chr(10) ORDER BY path, line, col, message)) AS report, count(*) AS n FROM o GROUP BY target_id""")  # fmt: skip
def diag_report(spark, d):
    from tallyglass.render import check_report

    return check_report(_report(spark, d)).select("target_id", F.sha2("report", 256).alias("report"), "n")


_SETTLED = f"""WITH RECURSIVE {v.DIAGNOSTICS}, g AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM diags), s AS (SELECT *, CASE WHEN t - lag(t) OVER w IS NULL OR t - lag(t) OVER w > 36000 THEN 1 ELSE 0 END AS fresh FROM g WINDOW w AS (PARTITION BY uri ORDER BY ts, event_id)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY ts, event_id) AS run FROM s),
  b AS (SELECT uri, run, min(t) AS s FROM r GROUP BY uri, run UNION ALL SELECT b.uri, b.run, min(r.t) AS s FROM b JOIN r ON r.uri = b.uri AND r.run = b.run AND r.t - b.s >= 72000 GROUP BY b.uri, b.run, b.s),
  c AS (SELECT r.*, (SELECT max(b.s) FROM b WHERE b.uri = r.uri AND b.run = r.run AND b.s <= r.t) AS cut FROM r)
  SELECT uri, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, max_by(event_id, (ts, event_id)) AS event_id FROM c GROUP BY uri, run, cut"""  # fmt: skip


@query("diag_settle", _SETTLED)
def diag_settle(spark, d):
    return diagnostics.settle(v.diagnostics(spark, d), 36000, 72000)


@query("diag_settle_stream", _SETTLED)
def diag_settle_stream(spark, d):
    """The same bursts from a stream: the table as one batch, then the end of time, which closes all of them."""
    path, table = fresh_path(spark, "settled"), f"{d}/events.parquet"
    # a stream takes a table of one file only as a pattern
    events = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("uri"), "ts", "event_id")
    end = spark.createDataFrame([(None,)], "uri long").select("uri", F.lit("2200-01-01").cast(events.schema["ts"].dataType).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    end.write.parquet(f"{path}/end")
    closing = spark.readStream.schema(end.schema).parquet(f"{path}/end")
    debounce.replay(events.withColumn("event_id", F.col("event_id").cast("long")).withColumn("uri", F.col("uri").cast("long")).unionByName(closing), path, 36000, 72000)
    return spark.read.schema("uri long, first_ts timestamp, last_ts timestamp, n_events long, event_id long").parquet(f"{path}/bursts")


@query("idle_sessions", f"""WITH {v.DIAGNOSTICS}, s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM diags WINDOW w AS (PARTITION BY uri ORDER BY ts)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
  SELECT uri, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM r GROUP BY uri, run""")  # fmt: skip
def idle_sessions(spark, d):
    return diagnostics.idle_sessions(v.diagnostics(spark, d), 30)


_RANKED = f"""{v.MEMBERS}, q AS (SELECT *, end_line - line + 1 AS size, min(line) OVER (PARTITION BY owner) + (max(line) OVER (PARTITION BY owner) - min(line) OVER (PARTITION BY owner)) // 4 AS quarter FROM members),
scored AS (SELECT *, CASE WHEN kind = 'constructor' OR starts_with(name, 'New') OR lower(name) IN ('__init__', 'constructor', 'new', 'init') THEN 5 ELSE 0 END + CASE WHEN visibility = 'public' THEN 3 ELSE 0 END + CASE WHEN size BETWEEN 10 AND 40 THEN 2 ELSE 0 END
  + CASE WHEN line <= quarter THEN 1 ELSE 0 END - CASE WHEN size <= 1 THEN 1 ELSE 0 END AS rank_score FROM q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank_score DESC, line, name) AS rank FROM scored),
used AS (SELECT *, sum(size) OVER (PARTITION BY owner ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used_lines FROM ranked)"""


@query("method_rank", f"WITH {_RANKED} SELECT owner, name, line, rank_score, rank FROM ranked")
def method_rank(spark, d):
    return outline.ranked(v.members(spark, d)).select("owner", "name", "line", "rank_score", F.col("rank").cast("long"))


@query("method_budget_cut", f"WITH {_RANKED} SELECT owner, name, CAST(used_lines AS BIGINT) AS used_lines FROM used WHERE used_lines <= 60 AND rank <= 4")
def method_budget_cut(spark, d):
    return outline.expanded(outline.ranked(v.members(spark, d)), 60).select("owner", "name", "used_lines")


@query("method_remaining", f"WITH {_RANKED}, r AS (SELECT * FROM used WHERE NOT (used_lines <= 60 AND rank <= 4)) SELECT owner, name, line FROM r QUALIFY row_number() OVER (PARTITION BY owner ORDER BY line, name) <= 6")
def method_remaining(spark, d):
    r = outline.ranked(v.members(spark, d))
    return outline.remaining(r, outline.expanded(r, 60)).select("owner", "name", "line")


@query("expansion_reason", f"""WITH {v.MEMBERS} SELECT DISTINCT name, visibility, CASE WHEN starts_with(name, 'New') AND visibility = 'public' THEN 'constructor, public' WHEN starts_with(name, 'New') THEN 'constructor' WHEN visibility = 'public' THEN 'public' ELSE 'relevant' END AS reason FROM members""")
def expansion_reason(spark, d):
    return v.members(spark, d).select("name", "visibility", outline.reason(F.col("name"), F.col("visibility")).alias("reason")).distinct()


# requests that both engines derive from conversations by the same expressions
_ASKED = """CASE turn % 9 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN text WHEN 2 THEN split_part(text, ' ', 1) || ' . ' || role WHEN 3 THEN 'pkg/' || role WHEN 4 THEN role || '.PY'
  WHEN 5 THEN chr(39) || role WHEN 6 THEN role || ' {' WHEN 7 THEN ' ' ELSE role || '.' || role END"""
_MODE = "CASE conv_id % 5 WHEN 0 THEN 'symbol' WHEN 1 THEN 'path' WHEN 2 THEN 'bogus' ELSE '' END"
_EXTS = ", ".join(f"'{e}'" for e in routing.PATH_EXTENSIONS)


@query("classify_query", f"""WITH r AS (SELECT conv_id, turn, {_ASKED} AS q, {_MODE} AS m FROM conversations), s AS (SELECT *, {v.strip('q')} AS t FROM r)
  SELECT conv_id, turn, CASE WHEN m IN ('symbol', 'path', 'text', 'ast') THEN m WHEN t = '' THEN 'text' WHEN contains(t, '/') OR lower(regexp_extract(t, '(\\.[^./]*)$', 1)) IN ({_EXTS}) THEN 'path'
    WHEN starts_with(t, '"') OR starts_with(t, chr(39)) THEN 'text' WHEN contains(t, '{{') OR contains(t, '}}') THEN 'ast' WHEN contains(t, ' ') AND NOT regexp_matches(t, '^[\\p{{L}}\\p{{N}}_]+( *\\. *[\\p{{L}}\\p{{N}}_]+)+$') THEN 'text' ELSE 'symbol' END AS intent FROM s""")  # fmt: skip
def classify_query(spark, d):
    s = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.expr(_ASKED).alias("q"), F.expr(_MODE).alias("m"))
    return s.select("conv_id", "turn", routing.classify(F.col("q"), F.col("m")).alias("intent"))


_FLAG = "CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'large' WHEN 'signup' THEN 'auto' ELSE '' END"


@query("budget", f"""WITH f AS (SELECT event_id, {_FLAG} AS flag, event_id % 10 AS depth FROM events),
  b AS (SELECT *, CAST(least(CASE flag WHEN 'small' THEN 80 WHEN 'medium' THEN 120 WHEN 'large' THEN 160 ELSE CASE WHEN depth > 1 THEN 120 ELSE 80 END END + 20 * greatest(depth - 1, 0), 240) AS INT) AS total_lines FROM f),
  c AS (SELECT *, CAST(total_lines * 50 // 100 AS INT) AS definition_lines, CAST(total_lines * 25 // 100 AS INT) AS reference_lines, CAST(total_lines * 15 // 100 AS INT) AS caller_lines FROM b)
  SELECT event_id, total_lines, definition_lines, reference_lines, caller_lines, total_lines - definition_lines - reference_lines - caller_lines AS meta_lines, greatest(reference_lines // 2, 1) AS n_refs FROM c""")  # fmt: skip
def budget(spark, d):
    asked = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_FLAG).alias("flag"), (F.col("event_id") % 10).cast("int").alias("depth"))
    out = asked.select("event_id", *[c.alias(k) for k, c in routing.budget(F.col("flag"), F.col("depth")).items()])
    return out.withColumn("n_refs", routing.most_items(F.col("reference_lines")))


_CUES = " OR ".join(f"contains(lower(text), '{c}')" for c in routing.FAILURE_CUES)


@query("failure_cue", f"SELECT conv_id, turn, ({_CUES}) AS cue FROM conversations")
def failure_cue(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", routing.has_failure_cue(F.col("text")).alias("cue"))


@query("class_like", f"WITH {v.PART_SYMBOLS}, k AS (SELECT p_partkey, CASE kind WHEN 12 THEN 'Function' WHEN 6 THEN 'method' WHEN 5 THEN 'Class' WHEN 11 THEN 'INTERFACE' WHEN 10 THEN 'enum' ELSE 'struct ' END AS k FROM symbols) SELECT p_partkey, lower(k) IN ('class', 'struct', 'interface', 'module', 'trait', 'enum') AS class_like FROM k")
def class_like(spark, d):
    k = F.col("kind")
    label = F.when(k == 12, "Function").when(k == 6, "method").when(k == 5, "Class").when(k == 11, "INTERFACE").when(k == 10, "enum").otherwise("struct ")
    return v.part_symbols(spark, d).select("p_partkey", routing.is_class_like(label).alias("class_like"))


@query("request_response", "SELECT a.event_id AS request_id, min(b.event_id) AS response_id FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_id = a.event_id + 150 WHERE a.event_type = 'click' GROUP BY 1")
def request_response(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") + 150).alias("answer"))
    return asked.join(e.select(F.col("event_id").alias("answer"), "user_id", F.col("event_id").alias("response_id")), ["user_id", "answer"], "left").groupBy("request_id").agg(F.min("response_id").alias("response_id"))


_TAG = "<([a-zA-Z][a-zA-Z0-9]*)"


@query("html_symbol_list", f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS tag FROM pages) GROUP BY 1, 2")
def html_symbol_list(spark, d):
    tags = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 1)).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("symbol_summary", f"WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{_TAG}', 1))) AS tag FROM pages), c AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY 1, 2) SELECT page_id, string_agg(tag || '=' || n, ',' ORDER BY tag) AS counts, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1")
def symbol_summary(spark, d):
    tags = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit(_TAG), 1)).alias("tag"))
    c = tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("tag", "n"))), lambda s: F.concat(s["tag"], F.lit("="), s["n"].cast("string")))
    return c.groupBy("page_id").agg(F.array_join(pairs, ",").alias("counts"), F.sum("n").alias("total"))


@query("receiver_join", f"WITH {v.PART_SYMBOLS}, t AS (SELECT DISTINCT container AS type_name FROM symbols) SELECT type_name, count(*) AS n FROM t JOIN symbols ON contains(container, type_name) GROUP BY 1")
def receiver_join(spark, d):
    s = v.part_symbols(spark, d)
    owners = s.groupBy("container").agg(F.count("*").alias("n"))  # pre-aggregated: one row for each receiver
    types = s.select(F.col("container").alias("term")).distinct()
    found = multi_find.find(owners.select(F.col("container").alias("path"), F.lit(0).alias("line"), F.col("container").alias("snippet")), types)
    return found.join(owners, F.col("path") == F.col("container")).groupBy(F.col("term").alias("type_name")).agg(F.sum("n").alias("n"))


@query("grep_binary_safe", f"WITH {v.FILES}, {v.LINES} SELECT split_part(path, '/', 2) AS lang, count(*) AS n FROM lines WHERE contains(snippet, '|') GROUP BY 1")
def grep_binary_safe(spark, d):
    return v.lines(spark, d).where(F.col("snippet").contains("|")).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang")).agg(F.count("*").alias("n"))


@query("column_widths", f"WITH {v.FILES}, n AS (SELECT path, len(string_split(content, chr(10))) AS k FROM files) SELECT max(length(path)) AS path_width, max(length(CAST(k AS VARCHAR))) AS digits FROM n")
def column_widths(spark, d):
    return v.files(spark, d).select("path", text.total_lines(F.col("content")).alias("k")).agg(F.max(F.length("path")).cast("long").alias("path_width"), F.max(F.length(F.col("k").cast("string"))).cast("long").alias("digits"))


@query("union_targets", f"WITH {v.DIAGNOSTICS} SELECT 'a' AS target, count(*) AS n FROM diags WHERE severity = 1 UNION ALL SELECT 'b', count(*) FROM diags WHERE severity = 0")
def union_targets(spark, d):
    g = v.diagnostics(spark, d)
    a = g.where("severity = 1").agg(F.lit("a").alias("target"), F.count("*").alias("n"))
    return a.unionByName(g.where("severity = 0").agg(F.lit("b").alias("target"), F.count("*").alias("n")))


@query("first_per_group", f"WITH {_REFS} SELECT path, line FROM refs QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, snippet) = 1")
def first_per_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line", "snippet"))
    return _refs(spark, d).withColumn("rank", rank).where("rank = 1").select("path", "line")
