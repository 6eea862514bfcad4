"""Chunking, embedding and index state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import index_state
from tallyglass.operators import chunk, embed, hashed
from tallyglass.operators.ivf import MAX_LISTS, IvfIndex
from tallyglass.operators.vector_search import cosine, similarity_join, top_k
from tallyglass.plans import views as v
from tallyglass.plans.registry import query
from tallyglass.plans.vectors import _SCORED, _vectors, query_vector
from tallyglass.storage import fresh_path


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""w AS (
  SELECT path, l, unnest(list_filter(range(0, len(l), {step}), lambda i: i = 0 OR i + {overlap} < len(l))) AS i
  FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)),
chunks AS (
  SELECT path, i + 1 AS start_line, least(i + {size}, len(l)) AS end_line, array_to_string(l[i + 1:i + {size}], chr(10)) AS content FROM w),
kept AS (SELECT * FROM chunks WHERE {v.strip('content')} <> '')"""


def _chunk_sql(size: int, overlap: int) -> str:
    return f"WITH {v.FILES}, {_windows(size, overlap)} SELECT path, start_line, end_line, sha256(content) AS content_sha, 'block' AS node_type FROM kept"


def _chunks(df):
    return df.select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_sha"), "node_type")


@query("chunk_lines", _chunk_sql(80, 10))
def chunk_lines(spark, d):
    return _chunks(chunk.windows(v.files(spark, d)))


@query("chunk_lines_small", _chunk_sql(20, 5))
def chunk_lines_small(spark, d):
    return _chunks(chunk.windows(v.files(spark, d), 20, 5))


@query("chunk_resplit", f"""WITH {v.FILES}, {_windows(40, 5)},
  lists AS (SELECT path, start_line AS s, content, string_split(content, chr(10)) AS l FROM kept),
  starts AS (SELECT path, s, content, l, (len(l) > 15 OR length(content) > 3000) AS big,
    unnest(CASE WHEN len(l) > 15 OR length(content) > 3000 THEN list_filter(range(0, len(l), 8), lambda i: i = 0 OR i + 2 < len(l)) ELSE [0] END) AS i FROM lists),
  parts AS (SELECT path, s + i AS start_line, s + CASE WHEN big THEN least(i + 10, len(l)) ELSE len(l) END - 1 AS end_line,
    CASE WHEN big THEN array_to_string(l[i + 1:i + 10], chr(10)) ELSE content END AS content FROM starts)
  SELECT path, start_line, end_line, sha256(content) AS content_sha, 'block' AS node_type FROM parts WHERE {v.strip('content')} <> ''""")  # fmt: skip
def chunk_resplit(spark, d):
    big = chunk.windows(v.files(spark, d), 40, 5)
    return _chunks(chunk.resplit(big, max_lines=15, max_chars=3000, size=10, overlap=2))


@query("index_totals", f"WITH {v.FILES}, {_windows(20, 5)} SELECT count(DISTINCT path) AS file_count, count(*) AS chunk_count FROM kept")
def index_totals(spark, d):
    return chunk.windows(v.files(spark, d), 20, 5).agg(F.countDistinct("path").alias("file_count"), F.count("*").alias("chunk_count"))


@query("chunk_ids_unique", f"WITH {v.FILES}, {_windows(20, 5)}, k AS (SELECT substr(sha256(path || ':' || start_line || '-' || end_line), 1, 32) AS id FROM kept) SELECT count(*) AS n, count(DISTINCT id) AS n_ids FROM k")
def chunk_ids_unique(spark, d):
    from tallyglass.functions.ids import chunk_id

    out = chunk.windows(v.files(spark, d), 20, 5).select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("largest_chunk", f"WITH {v.FILES}, {_windows(20, 5)} SELECT path, start_line, length(content) AS n FROM kept ORDER BY length(content) DESC, path, start_line LIMIT 1")
def largest_chunk(spark, d):
    out = chunk.windows(v.files(spark, d), 20, 5).select("path", F.col("start_line").cast("long"), F.length("content").cast("long").alias("n"))
    return out.orderBy(F.desc("n"), "path", "start_line").limit(1)


_TOPICS = embed.TOPICS
_COUNTS = ", ".join("CAST(" + " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{w}', ''))) // {len(w)}" for w in words) + " AS DOUBLE)" for words in _TOPICS)


@query("embed_keywords", f"""WITH {v.FILES}, {_windows(20, 5)}, e AS (SELECT path, start_line, [{_COUNTS}, 0.01] AS x FROM kept)
  SELECT path, start_line, array_to_string(list_transform(x, lambda t: CAST(CAST(round(t / sqrt(list_sum(list_transform(x, lambda u: u * u))) * 10000) AS BIGINT) AS VARCHAR)), ',') AS vector FROM e""")  # fmt: skip
def embed_keywords(spark, d):
    out = chunk.windows(v.files(spark, d), 20, 5).withColumn("v", embed.keyword_vector(F.col("content")))
    return out.select("path", F.col("start_line").cast("long"), F.array_join(F.transform("v", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("vector"))


_HASHED = f"""tok AS (SELECT path || ':' || start_line AS id, regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+') AS w FROM kept),
  parts AS (SELECT id, p // {hashed.PART_WORDS} AS part, w[p + 1:p + {hashed.PART_WORDS}] AS w FROM (SELECT *, unnest(range(0, greatest(len(w), 1), {hashed.PART_WORDS})) AS p FROM tok)),
  numbered AS (SELECT id, part, list_transform(w, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS n FROM parts),
  coded AS (SELECT id, part, unnest(list_concat(n, list_transform(range(1, len(n)), lambda i: n[i] * {hashed.PAIR} + n[i + 1]))) % {hashed.CODES} AS code FROM numbered),
  dfs AS (SELECT code, count(*) AS df FROM (SELECT DISTINCT id, part, code FROM coded) GROUP BY code),
  weights AS (SELECT code, CAST(round((1 + ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df))) * {hashed.SCALE}) AS BIGINT) AS weight FROM dfs, (SELECT count(*) AS n FROM parts)),
  sums AS (SELECT id, part, code % {hashed.DIM} AS place, CAST(sum(CASE WHEN (code // {hashed.DIM}) % 2 = 0 THEN weight ELSE -weight END) AS DOUBLE) AS x FROM coded JOIN weights USING (code) GROUP BY ALL),
  norms AS (SELECT id, part, sqrt(sum(x * x)) AS norm FROM sums GROUP BY ALL),
  means AS (SELECT id, place, sum(x / norm) AS x FROM sums JOIN norms USING (id, part) WHERE norm > 0 GROUP BY ALL),
  sizes AS (SELECT id, count(*) AS n FROM parts GROUP BY id)"""


@query("embed_hashed", f"""WITH {v.FILES}, {_windows(80, 10)}, {_HASHED},
  places AS (SELECT id, n, unnest(range(0, {hashed.DIM})) AS place FROM sizes)
  SELECT id, array_to_string(list(CAST(CAST(round(coalesce(x, 0) / n * 10000) AS BIGINT) AS VARCHAR) ORDER BY place), ',') AS vector
  FROM places LEFT JOIN means USING (id, place) GROUP BY id""")  # fmt: skip
def embed_hashed(spark, d):
    texts = chunk.windows(v.files(spark, d)).select(F.concat("path", F.lit(":"), F.col("start_line").cast("string")).alias("id"), "content")
    out = hashed.embed_hashed(texts)
    return out.select("id", F.array_join(F.transform("vector", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("vector"))


@query("vector_mean", """SELECT label, array_to_string(list(CAST(m AS VARCHAR) ORDER BY pos), ',') AS mean FROM (
  SELECT label, pos, CAST(round(avg(x) * 1000000) AS BIGINT) AS m FROM (SELECT label, unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def vector_mean(spark, d):
    vec = spark.read.parquet(f"{d}/embeddings.parquet")
    out = embed.mean_vectors(vec.select("label", F.col("embedding").alias("vector")), "label")
    return out.select("label", F.array_join(F.transform("vector", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("mean"))


@query("vector_topk_lang", f"SELECT id, language, score FROM ({_SCORED}) WHERE language = 3 ORDER BY score DESC, id LIMIT 7")
def vector_topk_lang(spark, d):
    return top_k(_vectors(spark, d), query_vector(spark, d), 7, language=3).select("id", "language", "score")


@query("search_post_ignore", f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 10) WHERE language NOT IN (7, 8)")
def search_post_ignore(spark, d):
    from pyspark.sql import Window

    hits = top_k(_vectors(spark, d), query_vector(spark, d), 10).where(~F.col("language").isin(7, 8))  # a ranking of ten rows at most
    return hits.select("id", "score", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).cast("long").alias("rank"))


@query("search_ranked", f"SELECT id, score, 'label_' || language AS description, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 10)")
def search_ranked(spark, d):
    from pyspark.sql import Window

    hits = top_k(_vectors(spark, d), query_vector(spark, d), 0)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).cast("long")
    return hits.select("id", "score", F.concat(F.lit("label_"), F.col("language").cast("string")).alias("description"), rank.alias("rank"))


_JOIN = """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q"""


@query("vector_similarity_join", f"SELECT query_id, id, score FROM ({_JOIN}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3")
def vector_similarity_join(spark, d):
    vec = _vectors(spark, d)
    return similarity_join(vec, vec.where(F.col("id") % 20 == 0), 3)


def _ivf(spark, d):
    """An index of all embeddings, in a folder of its own."""
    return IvfIndex(spark, fresh_path(spark, "ivf")).build(_vectors(spark, d))


@query("ivf_search_all_lists", f"SELECT query_id, id, score FROM ({_JOIN}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def ivf_search_all_lists(spark, d):
    asked = _vectors(spark, d).where(F.col("id") % 20 == 0)
    return _ivf(spark, d).search(asked, 5, n_probes=MAX_LISTS)


@query("ivf_search")
def ivf_search(spark, d):
    """Approximate: tests/test_ivf.py holds its recall against the exact join."""
    return _ivf(spark, d).search(_vectors(spark, d).where(F.col("id") % 20 == 0), 10)


@query("vector_score_histogram", f"SELECT CAST(floor(score * 10) AS BIGINT) AS bucket, count(*) AS n FROM ({_SCORED}) GROUP BY 1")
def vector_score_histogram(spark, d):
    scored = _vectors(spark, d).select(cosine("vector", query_vector(spark, d)).alias("score"))
    return scored.groupBy(F.floor(F.col("score") * 10).alias("bucket")).agg(F.count("*").alias("n"))


# states of an index that both engines derive from events by the same expressions
_STATES = {
    "event_id": "event_id", "has_meta": "event_id % 10 <> 9", "seconds": "event_id * 37", "files": "user_id", "chunks": "event_id",
    "commit": "CASE event_id % 6 WHEN 0 THEN ' ' ELSE ' ' || md5(CAST(user_id % 5 AS STRING)) END", "fp": "CASE event_id % 8 WHEN 0 THEN '' ELSE event_type || ' ' END",
    "cur": "CASE event_id % 7 WHEN 0 THEN '' ELSE md5(CAST(user_id % 3 AS STRING)) END", "curfp": "CASE event_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'view' ELSE event_type END",
}
_STATE_SQL = f"""e AS (SELECT {', '.join(f'{x} AS {"commit_sha" if c == "commit" else c}' for c, x in _STATES.items())} FROM events),
  s AS (SELECT event_id, has_meta, seconds, files, chunks, trim(commit_sha) AS a, trim(fp) AS x, trim(cur) AS b, trim(curfp) AS y FROM e)"""


def _states(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(*[F.expr(x).alias(c) for c, x in _STATES.items()])


_AGE = "CASE WHEN {0} < 60 THEN 'less than a minute' WHEN {0} < 3600 THEN CAST({0} // 60 AS VARCHAR) || 'm' WHEN {0} < 86400 THEN CAST({0} // 3600 AS VARCHAR) || 'h' ELSE CAST({0} // 86400 AS VARCHAR) || 'd' END"


@query("staleness", f"WITH {_STATE_SQL} SELECT event_id, (NOT has_meta OR x = '' OR y = '' OR x <> y OR a = '' OR b = '' OR a <> b) AS stale FROM s")
def staleness(spark, d):
    return _states(spark, d).select("event_id", index_state.is_stale(*[F.col(c) for c in ("has_meta", "commit", "fp", "cur", "curfp")]).alias("stale"))


@query("staleness_text", f"""WITH {_STATE_SQL}, r AS (SELECT *, {_AGE.format('(seconds // 60 * 60)')} AS age, concat_ws(' and ',
    CASE WHEN a = '' THEN 'missing indexed commit metadata' WHEN b = '' THEN 'current HEAD unavailable' WHEN a <> b THEN 'HEAD is now ' || substr(b, 1, 7) END,
    CASE WHEN x = '' THEN 'missing indexed ignore metadata' WHEN y = '' THEN 'current ignore rules unavailable' WHEN x <> y THEN 'ignore rules changed' END) AS why,
    ' (' || files || ' files, ' || chunks || ' chunks)' AS n FROM s)
  SELECT event_id, CASE WHEN NOT has_meta THEN 'not indexed' WHEN why = '' THEN 'up to date — indexed ' || age || ' ago' || n
    ELSE 'stale — indexed ' || age || ' ago' || CASE WHEN a <> '' AND b <> '' AND a <> b THEN ' at ' || substr(a, 1, 7) ELSE '' END || ', ' || why || n END AS info FROM r""")  # fmt: skip
def staleness_text(spark, d):
    return _states(spark, d).select("event_id", index_state.describe(*[F.col(c) for c in ("has_meta", "seconds", "files", "chunks", "commit", "fp", "cur", "curfp")]).alias("info"))


@query("age_bucket", f"SELECT event_id, {_AGE.format('(event_id * 37)')} AS age FROM events")
def age_bucket(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", index_state.age(F.col("event_id") * 37).alias("age"))
