"""Scans, filters and file-level scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import ids, ignore, paths, text
from tallyglass.functions.languages import CHUNK_LANGUAGES, DEFAULT_EXTENSIONS, EXTRACT_LANGUAGES, LANGUAGE_ALIASES, SERVED_LANGUAGES, lookup, sql_case
from tallyglass.plans import views as v
from tallyglass.plans.registry import query
from tallyglass.sources import files as src

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
PATTERNS = ["src1", "*_test.go", "/src2/en", "doc_1?.py", "src[34]/de", "fr/doc_7*"]
_WALK = ignore.regex(PATTERNS, walk=True).replace("'", "''")
_PATH = ignore.regex(PATTERNS).replace("'", "''")


@query("walk_files", f"WITH {v.FILES} SELECT path, bytes FROM files WHERE NOT regexp_matches(path, '{_WALK}') AND {v.EXT} IN {_IN(DEFAULT_EXTENSIONS)}")
def walk_files(spark, d):
    return src.walk(v.files(spark, d), PATTERNS).select("path", "bytes")


@query("walk_size_limit", f"WITH {v.FILES} SELECT path FROM files WHERE bytes <= 2048 AND {v.EXT} IN ('.py', '.md')")
def walk_size_limit(spark, d):
    return src.walk(v.files(spark, d), extensions=[".py", ".MD"], max_kb=2).select("path")


@query("extract_scan", f"WITH {v.FILES}, l AS (SELECT path, {sql_case(v.EXT, EXTRACT_LANGUAGES)} AS language FROM files) SELECT path, language FROM l WHERE language = 'python'")
def extract_scan(spark, d):
    return src.extract_scan(v.files(spark, d), language="python").select("path", "language")


@query("ext_language", f"WITH {v.FILES}, l AS (SELECT {sql_case(v.EXT, CHUNK_LANGUAGES)} AS language FROM files) SELECT language, count(*) AS n FROM l GROUP BY 1")
def ext_language(spark, d):
    return v.files(spark, d).groupBy(src.chunk_language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("ext_language_extract", f"WITH {v.FILES}, l AS (SELECT {sql_case(v.EXT, EXTRACT_LANGUAGES)} AS language FROM files) SELECT language, count(*) AS n FROM l GROUP BY 1")
def ext_language_extract(spark, d):
    return v.files(spark, d).groupBy(lookup(EXTRACT_LANGUAGES, paths.extension(F.col("path"))).alias("language")).agg(F.count("*").alias("n"))


@query("ignore_match", f"WITH {v.FILES} SELECT path, regexp_matches(path, '{_PATH}') AS ignored FROM files")
def ignore_match(spark, d):
    return v.files(spark, d).select("path", ignore.ignored(F.col("path"), PATTERNS).alias("ignored"))


@query("ignore_match_walk", f"WITH {v.FILES} SELECT count(*) AS n FROM files WHERE regexp_matches(path, '{_WALK}')")
def ignore_match_walk(spark, d):
    return v.files(spark, d).where(ignore.ignored(F.col("path"), PATTERNS, walk=True)).agg(F.count("*").alias("n"))


# inputs that both engines derive from the files by the same expression
_RAW = "CASE doc_id % 6 WHEN 0 THEN '  ' || path || '/ ' WHEN 1 THEN '# ' || path WHEN 2 THEN '!' || path WHEN 3 THEN ' ' WHEN 4 THEN './' || path ELSE path END"


@query("ignore_normalise", f"""WITH {v.FILES}, r AS (SELECT doc_id, {_RAW} AS raw FROM files)
  SELECT doc_id, regexp_replace(regexp_replace({v.strip('raw')}, '/$', ''), '^\\./', '') AS pattern FROM r WHERE {v.strip('raw')} <> '' AND NOT regexp_matches({v.strip('raw')}, '^[#!]')""")  # fmt: skip
def ignore_normalise(spark, d):
    return v.numbered_files(spark, d).select("doc_id", ignore.normalised(F.expr(_RAW)).alias("pattern")).where("pattern IS NOT NULL")


@query("ignore_fingerprint", "SELECT lang, sha256(array_to_string(list_sort(list_distinct(list(source))), chr(0))) AS fingerprint FROM documents GROUP BY 1")
def ignore_fingerprint(spark, d):
    return v.documents(spark, d).groupBy("lang").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("source")), "\0"), 256).alias("fingerprint"))


@query("dominant_language", f"""WITH {v.FILES}, l AS (SELECT {sql_case(v.EXT, EXTRACT_LANGUAGES)} AS language FROM files)
  SELECT language, count(*) AS count FROM l WHERE language IN {_IN(SERVED_LANGUAGES)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")  # fmt: skip
def dominant_language(spark, d):
    return src.dominant_language(v.files(spark, d))


@query("prime_file", f"WITH {v.FILES} SELECT min(path) AS path FROM files WHERE {v.EXT} IN ('.ts', '.tsx')")
def prime_file(spark, d):
    return src.prime_file(v.files(spark, d), "typescript")


@query("file_guards", f"""WITH {v.FILES}, n AS (SELECT path, bytes, len(string_split(content, chr(10))) AS total_lines FROM files)
  SELECT path, CAST(total_lines AS INT) AS total_lines, CASE WHEN bytes > 4096 OR total_lines > 10 THEN 'file_too_large' ELSE 'ok' END AS status FROM n""")  # fmt: skip
def file_guards(spark, d):
    return src.guards(v.files(spark, d), 4096, 10)


@query("binary_filter", f"WITH {v.FILES} SELECT count(*) AS n FROM files WHERE strpos(content, chr(0)) = 0")
def binary_filter(spark, d):
    return v.files(spark, d).where(~F.col("content").contains("\0")).agg(F.count("*").alias("n"))


@query("snippet_lookup", f"""WITH {v.FILES}, {v.LINES}, places AS (SELECT path, doc_id % 5 + 1 AS line FROM files)
  SELECT p.path, p.line, coalesce(l.snippet, '') AS snippet FROM places p LEFT JOIN lines l ON l.path = p.path AND l.line = p.line""")  # fmt: skip
def snippet_lookup(spark, d):
    places = v.files(spark, d).select("path", (F.regexp_extract("path", r"doc_(\d+)", 1).cast("long") % 5 + 1).alias("line"))
    return src.snippets(places, v.lines(spark, d))


@query("test_file", f"""WITH {v.FILES} SELECT path, (regexp_matches({v.BASE}, '(_test\\.go|\\.test\\.ts|\\.test\\.js|_test\\.py)$') OR regexp_matches({v.BASE}, '^test_')
  OR path LIKE '%/test/%' OR path LIKE '%/tests/%') AS is_test FROM files""")  # fmt: skip
def test_file(spark, d):
    return v.files(spark, d).select("path", paths.is_test_file(F.col("path")).alias("is_test"))


@query("path_scope", f"WITH {v.FILES} SELECT path FROM files WHERE path = 'src1' OR starts_with(path, 'src1/')")
def path_scope(spark, d):
    return v.files(spark, d).where(paths.in_scope(F.col("path"), "src1/")).select("path")


@query("relative_path", f"WITH {v.FILES} SELECT path, CASE WHEN starts_with(path, 'src3/') THEN substr(path, 6) ELSE path END AS relative FROM files")
def relative_path(spark, d):
    return v.files(spark, d).select("path", paths.relative_to(F.col("path"), "src3").alias("relative"))


@query("language_alias", f"WITH {v.FILES}, n AS (SELECT path, upper(substr({v.EXT}, 2)) || ' ' AS name FROM files) SELECT path, {sql_case(f'lower({v.strip('name')})', LANGUAGE_ALIASES)} AS language FROM n")
def language_alias(spark, d):
    name = F.concat(F.upper(F.expr("substring(ext, 2)")), F.lit(" "))
    df = v.files(spark, d).select("path", paths.extension(F.col("path")).alias("ext")).withColumn("name", name)
    return df.select("path", lookup(LANGUAGE_ALIASES, F.lower(text.strip(F.col("name")))).alias("language"))


_CSV = "CASE doc_id % 3 WHEN 0 THEN lang || ', .' || source || ',,x' WHEN 1 THEN '' ELSE '.' || lang END"


@query("ext_csv", f"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split({_CSV}, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '.') THEN x ELSE '.' || x END), ' ') AS extensions FROM documents")
def ext_csv(spark, d):
    return v.documents(spark, d).select("doc_id", F.array_join(paths.extension_list(F.expr(_CSV)), " ").alias("extensions"))


@query("project_root", f"""WITH {v.FILES}, marks AS (SELECT DISTINCT {v.DIR} AS dir FROM files WHERE {v.EXT} = '.yaml' UNION SELECT DISTINCT split_part(path, '/', 1) FROM files WHERE {v.EXT} = '.kts')
  SELECT path, coalesce(max_by(dir, length(dir)), {v.DIR}) AS root FROM files LEFT JOIN marks ON starts_with(path, dir || '/') GROUP BY path""")  # fmt: skip
def project_root(spark, d):
    """A folder with a .yaml file, or the first one above a .kts file, is a root; files belong to the nearest."""
    files = v.files(spark, d).select("path", paths.extension(F.col("path")).alias("ext"))
    marks = files.where("ext = '.yaml'").select(paths.directory(F.col("path")).alias("dir")).union(files.where("ext = '.kts'").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")))
    return paths.nearest_roots(files.select("path"), marks)


@query("doc_id", f"WITH {v.FILES} SELECT path, substr(sha256(path || ':' || '1' || '-' || CAST(len(string_split(content, chr(10))) AS VARCHAR)), 1, 32) AS id FROM files")
def doc_id(spark, d):
    return v.files(spark, d).select("path", ids.chunk_id(F.col("path"), F.lit(1), text.total_lines(F.col("content"))).alias("id"))


@query("content_cut", f"WITH {v.FILES} SELECT path, length(substr(content, 1, 2000)) AS n FROM files")
def content_cut(spark, d):
    return v.files(spark, d).select("path", F.length(ids.content_cut(F.col("content"), 2000)).cast("long").alias("n"))


@query("collection_name", f"SELECT source, coalesce(nullif({v.strip('o')}, ''), 'code_' || substr(sha256(source), 1, 16)) AS name FROM (SELECT DISTINCT source, CASE WHEN source = 'src1' THEN ' mine ' ELSE ' ' END AS o FROM documents)")
def collection_name(spark, d):
    df = v.documents(spark, d).select("source", F.when(F.col("source") == "src1", " mine ").otherwise(" ").alias("o")).distinct()
    return df.select("source", ids.collection_name(F.col("source"), F.col("o")).alias("name"))


@query("state_key", "SELECT DISTINCT source, lang, substr(sha256(source || chr(0) || lang), 1, 16) AS key FROM documents")
def state_key(spark, d):
    return v.documents(spark, d).select("source", "lang", ids.state_key(F.col("source"), F.col("lang")).alias("key")).distinct()


@query("build_fingerprint", f"WITH {v.FILES} SELECT split_part(path, '/', 1) AS root, sha256(array_to_string(list_sort(list(path || ' ' || sha256(content))), chr(10))) AS fingerprint FROM files GROUP BY 1")
def build_fingerprint(spark, d):
    parts = F.concat_ws(" ", "path", F.sha2("content", 256))
    return v.files(spark, d).groupBy(F.substring_index("path", "/", 1).alias("root")).agg(ids.rows_fingerprint(parts).alias("fingerprint"))


@query("describe_chunk", f"""WITH {v.FILES}, f AS (SELECT path, {v.strip("split_part(content, chr(10), 1)")} AS s FROM files)
  SELECT path, 'block — ' || CASE WHEN length(s) > 120 THEN substr(s, 1, 120) || '...' ELSE s END AS description FROM f""")  # fmt: skip
def describe_chunk(spark, d):
    return v.files(spark, d).select("path", text.describe(F.col("content"), F.lit(" ")).alias("description"))


@query("display_truncate", f"""WITH {v.FILES}, l AS (SELECT path, content, string_split(content, chr(10)) AS l FROM files)
  SELECT path, sha256(CASE WHEN len(l) <= 3 THEN content ELSE array_to_string(l[1:3], chr(10)) || chr(10) || '...' END) AS shown FROM l""")  # fmt: skip
def display_truncate(spark, d):
    return v.files(spark, d).select("path", F.sha2(text.display(F.col("content")), 256).alias("shown"))


@query("extract_lines", f"""WITH {v.FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files)
  SELECT path, sha256(array_to_string(l[2:least(4, len(l))], chr(10))) AS code FROM l""")  # fmt: skip
def extract_lines(spark, d):
    return v.files(spark, d).select("path", F.sha2(text.line_range(F.col("content"), F.lit(2), F.lit(4)), 256).alias("code"))


@query("signature_line", f"WITH {v.FILES} SELECT path, regexp_replace(split_part(content, chr(10), 1), '[\\r\\n]+$', '') AS signature FROM files")
def signature_line(spark, d):
    return v.files(spark, d).select("path", text.signature(F.col("content")).alias("signature"))


@query("total_lines", f"WITH {v.FILES} SELECT path, len(string_split(content, chr(10))) AS total_lines FROM files")
def total_lines(spark, d):
    return v.files(spark, d).select("path", text.total_lines(F.col("content")).cast("long").alias("total_lines"))


@query("json_round_trip", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, json_keys(props)[1] AS first_key FROM events")
def json_round_trip(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    m = F.from_json("props", "map<string,string>")
    key = F.element_at(F.json_object_keys("props"), 1)
    return e.select("event_id", F.try_element_at(m, key).alias("first_value"), key.alias("first_key"))


@query("env_merge", "SELECT user_id, event_type AS k, arg_max(props, event_id) AS v FROM events GROUP BY 1, 2")
def env_merge(spark, d):
    """The latest setting of each key of each user wins."""
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.col("event_type").alias("k")).agg(F.max_by("props", "event_id").alias("v"))


_VERSION = "CASE WHEN p_partkey % 7 = 0 THEN '1.x' ELSE '1.' || CAST(p_size AS STRING) || '.' || CAST(p_partkey AS STRING) END"


@query("version_max", f"SELECT p_brand, max_by(p_partkey, list_transform(string_split({_VERSION}, '.'), lambda x: CAST(x AS INT))) AS newest FROM part WHERE regexp_matches({_VERSION}, '^[0-9]+([.][0-9]+)*$') GROUP BY p_brand")
def version_max(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", F.expr(_VERSION).alias("version"))
    return parts.groupBy("p_brand").agg(F.max_by("p_partkey", ids.version_key(F.col("version"))).alias("newest")).where("newest IS NOT NULL")


@query("duration_format", "SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' ELSE CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' END AS shown FROM (SELECT event_id, event_id * 37 AS s FROM events)")
def duration_format(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.duration(F.col("event_id") * 37).alias("shown"))


@query("cap_min", "SELECT l_orderkey, l_linenumber, CASE WHEN a <= 0 THEN b WHEN b <= 0 THEN a ELSE least(a, b) END AS cap FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 3 AS a, l_suppkey % 9 - 2 AS b FROM lineitem)")
def cap_min(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = F.col("l_linenumber").cast("long") - 3, F.col("l_suppkey") % 9 - 2
    return li.select("l_orderkey", "l_linenumber", text.least_cap(a, b).alias("cap"))
