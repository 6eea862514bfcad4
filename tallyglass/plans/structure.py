"""Identifier occurrences, enclosing spans and set containment over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass import batch
from tallyglass.operators import containment, postings
from tallyglass.operators.enclosing import enclosing
from tallyglass.plans import code as _code
from tallyglass.plans import views as v
from tallyglass.plans.registry import query
from tallyglass.storage import fresh_path

_NAME = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+"
_REST = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+"
_PLACES = f"""{v.FILES}, {v.LINES},
pieces AS (SELECT path, line, unnest(p) AS token, unnest(range(1, len(p) + 1)) AS k FROM (SELECT path, line, regexp_extract_all(snippet, '{_NAME}|{_REST}') AS p FROM lines)),
placed AS (SELECT path, line, token, k, sum(length(token)) OVER (PARTITION BY path, line ORDER BY k) - length(token) + 1 AS col FROM pieces),
places AS (SELECT token, path, line, CAST(col AS BIGINT) AS col FROM placed WHERE regexp_full_match(token, '{_NAME}') AND NOT regexp_matches(token, '^[0-9]'))"""


def _postings(spark, d):
    return postings.build(v.files(spark, d), fresh_path(spark, "postings"))


@query("identifier_counts", f"WITH {_PLACES} SELECT token, count(*) AS n_refs, count(DISTINCT path) AS n_files FROM places GROUP BY token")
def identifier_counts(spark, d):
    return postings.counts(_postings(spark, d))


@query("identifier_lookup", f"WITH {_PLACES} SELECT token, path, line, col FROM places WHERE token IN ('Licensed', 'the')")
def identifier_lookup(spark, d):
    rows = _postings(spark, d)
    return postings.named(postings.decoded(postings.lookup(rows, ["Licensed", "the"])), postings.paths_of(rows))


@query("identifier_refs", f"""WITH {_PLACES}, decl AS (SELECT token, path, line, col FROM places QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, col) = 1),
  found AS (SELECT * FROM places WHERE token IN (SELECT token FROM decl))
  SELECT token, path, line, col FROM found ANTI JOIN decl USING (token, path, line, col)""")  # fmt: skip
def identifier_refs(spark, d):
    """A file declares its first identifier; references are all other places of such names."""
    files = v.files(spark, d)
    return postings.scan(files, postings.firsts(files)).where("nth > 0").select("token", "path", "line", "col")


_SPANS = """spans AS (SELECT path, 1 AS start_line, n AS end_line, 'file' AS kind FROM (SELECT path, len(string_split(content, chr(10))) AS n FROM files)
  UNION ALL SELECT path, i * 8 + 1, least(i * 8 + 8, n), 'block' FROM (SELECT path, n, unnest(range(0, (n + 7) // 8)) AS i FROM (SELECT path, len(string_split(content, chr(10))) AS n FROM files))
  UNION ALL SELECT path, i * 4 + 1, least(i * 4 + 3, n), 'inner' FROM (SELECT path, n, unnest(range(0, (n + 3) // 4)) AS i FROM (SELECT path, len(string_split(content, chr(10))) AS n FROM files)))"""
_INNERMOST = "QUALIFY row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.end_line - s.start_line, s.start_line DESC, s.kind) = 1"


@query("enclosing_spans", f"""WITH {v.FILES}, {v.LINES}, {_SPANS}, p AS (SELECT DISTINCT path, line FROM lines WHERE contains(snippet, 'a'))
  SELECT p.path, p.line, s.start_line, s.end_line, s.kind FROM p JOIN spans s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line {_INNERMOST}""")  # fmt: skip
def enclosing_spans(spark, d):
    """Lines in nested spans of their file: the whole, runs of eight lines, and three of each four."""
    sized = v.files(spark, d).select("path", F.size(F.split("content", "\n", -1)).cast("long").alias("n"))
    whole = sized.select("path", F.lit(1).cast("long").alias("start_line"), F.col("n").alias("end_line"), F.lit("file").alias("kind"))

    def runs(step, length, kind):
        i = sized.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n + {step - 1}) div {step} - 1"))).alias("i"))
        return i.select("path", (F.col("i") * step + 1).alias("start_line"), F.least(F.col("i") * step + length, "n").alias("end_line"), F.lit(kind).alias("kind"))

    spans = whole.unionByName(runs(8, 8, "block")).unionByName(runs(4, 3, "inner"))
    points = v.lines(spark, d).where(F.col("snippet").contains("a"))
    return enclosing(points, spans, carry=["kind"])


@query("enclosing_members", f"""WITH {v.MEMBERS}, s AS (SELECT owner, line AS start_line, end_line, name FROM members UNION ALL SELECT owner, min(line), max(end_line), 'class' FROM members GROUP BY owner),
  p AS (SELECT DISTINCT l_orderkey AS owner, l_suppkey * 7 % 700 AS line FROM lineitem)
  SELECT p.owner, p.line, s.start_line, s.end_line, s.name FROM p JOIN s ON s.owner = p.owner AND p.line BETWEEN s.start_line AND s.end_line
  QUALIFY row_number() OVER (PARTITION BY p.owner, p.line ORDER BY s.end_line - s.start_line, s.start_line DESC, s.name) = 1""")  # fmt: skip
def enclosing_members(spark, d):
    members = v.members(spark, d).select("owner", F.col("line").alias("start_line"), "end_line", "name")
    whole = members.groupBy("owner").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).withColumn("name", F.lit("class"))
    points = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("owner"), (F.col("l_suppkey") * 7 % 700).alias("line"))
    return enclosing(points, members.unionByName(whole), path="owner", carry=["name"])


@query("method_sets", """WITH a AS (SELECT DISTINCT l_orderkey AS small_id, l_partkey AS e FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS large_id, l_partkey AS e FROM lineitem),
  n AS (SELECT small_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT small_id, large_id, count(*) AS n FROM a JOIN b USING (e) GROUP BY 1, 2)
  SELECT small_id, large_id FROM m JOIN n USING (small_id, n)""")  # fmt: skip
def method_sets(spark, d):
    """An order asks for its parts as an interface for methods; suppliers of all of them implement it."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    small = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("element"))
    return containment.contained(small, li.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("element")))


@query("document_word_sets", f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS e FROM documents), i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS e FROM benchmark),
  n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS n FROM i JOIN w USING (e) GROUP BY 1, 2)
  SELECT item_id AS small_id, doc_id AS large_id FROM m JOIN n USING (item_id, n)""")  # fmt: skip
def document_word_sets(spark, d):
    """Documents that have all words of a benchmark item."""
    words = lambda df, key: df.select(F.col(key).alias("set_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("element"))
    return containment.contained(words(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id"), words(v.documents(spark, d), "doc_id"))


@query("ask_batch", f"""WITH {v.FILES}, {v.LINES},
  w AS (SELECT conv_id, turn, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM conversations),
  l AS (SELECT conv_id, turn, any_value(text) AS text, arg_min(word, (-length(word), word)) AS word FROM w GROUP BY 1, 2),
  q AS (SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 2 = 0 THEN word ELSE trim(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) END AS term FROM l),
  a AS (SELECT *, CASE WHEN term = '' OR contains(term, ' ') THEN 'text' ELSE 'symbol' END AS mode FROM q),
  hits AS (SELECT t.term, path, line, {v.squeeze('snippet')} AS snippet FROM (SELECT DISTINCT term FROM a WHERE term <> '') t JOIN lines ON contains(snippet, t.term)),
  known AS (SELECT term, count(*) AS refs_total, min(path) AS d FROM hits GROUP BY term),
  counted AS (SELECT hits.*, refs_total, d, count(*) OVER (PARTITION BY term, path) AS n FROM hits JOIN known USING (term)),
  scored AS (SELECT *, round(CASE WHEN contains(snippet, '(') THEN 3.0 ELSE 0 END + CASE WHEN {_code._DIR('path')} = {_code._DIR('d')} THEN 2.0 ELSE 0 END + {_code._PROX}
    + CASE WHEN {_code._TEST} THEN 1.0 ELSE 0 END - CASE WHEN n > 2 THEN 2.0 ELSE 0 END, 6) AS score FROM counted),
  best AS (SELECT term, refs_total, path, line, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, path, line, snippet) AS rank FROM scored QUALIFY rank = 1)
  SELECT query_id, mode, CASE WHEN refs_total IS NOT NULL THEN 'ok' WHEN mode = 'symbol' THEN 'not_found_exact' ELSE 'not_found' END AS status,
    CASE WHEN refs_total IS NOT NULL THEN 0.5 ELSE 0.0 END AS confidence, least(coalesce(refs_total, 0), 10) AS n_shown, coalesce(refs_total, 0) AS refs_total, path AS best_path, line AS best_line, score AS best_score
  FROM a LEFT JOIN best USING (term)""")  # fmt: skip
def ask_batch(spark, d):
    """Questions of conversations: the longest word of even turns, the first two words of odd ones."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0))
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word"))))["word"]
    two = F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0)
    asked = c.where(F.size(words) > 0).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 2 == 0, longest).otherwise(two).alias("question"))
    out = batch.ask_batch(v.files(spark, d), asked)
    return out.select("query_id", "mode", "status", "confidence", "n_shown", "refs_total", "best_path", "best_line", "best_score")
