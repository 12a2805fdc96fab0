"""Ingestion: which files are read, how they're cut, hashed, cached and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.functions import paths, text
from loamstone.operators import chunking, embedding
from loamstone.plans import sqltext as q
from loamstone.session import table
from loamstone.sources.files import scan_counts


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files that were scanned already."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("path").alias("relative_path"), F.col("text").alias("content"), F.octet_length("text").alias("length"))


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return f.select("doc_id", F.coalesce(paths.skip_reason(F.col("relative_path"), F.col("length"), F.col("content")), F.lit("read")).alias("reason"))


def file_filter_chunk_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select("repo_id", "file_path").distinct()
    return p.select("repo_id", "file_path", F.coalesce(paths.skip_reason(F.col("file_path"), F.lit(0)), F.lit("read")).alias("reason"))


def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    return scan_counts(_files(spark, d))


def language_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select("file_path")
    n = p.groupBy(paths.language(F.col("file_path")).alias("language"), paths.display_language(F.col("file_path")).alias("display")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("highlight", paths.highlight_language(F.col("display")))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select("repo_id", "file_path").distinct()
    return p.select("repo_id", "file_path", paths.relative(F.col("file_path")).alias("relative_path"), paths.is_safe(F.col("file_path")).alias("safe"))


def repo_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories").distinct()
    return r.select("id", text.repo_name(F.col("url")).alias("name"), text.upload_name(F.col("url")).alias("upload_name"), text.collection_name(F.col("id")).alias("collection"))


def sliding_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.sliding_windows(docs)


def sliding_window_chunks_small(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.sliding_windows(docs, 8, 2).select("doc_id", "start_line", "end_line", F.length("content").alias("n"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Contents of chunks as files."""
    return table(spark, d, "chunks").select("chunk_id", F.lower("language").alias("language"), "content").distinct()


def structural_chunks_python(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.structural_chunks(_code(spark, d).filter("language = 'python'"))
    return found.select("chunk_id", "start_line", "end_line", "chunk_type", "name", text.hash16(F.col("content")).alias("digest"))


def structural_chunks_js(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.structural_chunks(_code(spark, d).filter("language IN ('javascript', 'typescript')"))
    return found.select("chunk_id", "start_line", "end_line", "chunk_type", "name", text.hash16(F.col("content")).alias("digest"))


def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    files = _code(spark, d).select(F.lit("r").alias("repo_id"), F.col("chunk_id").alias("file_path"), "language", "content")
    return chunking.chunk_files(files).select("chunk_id", "file_path", "start_line", "end_line", "chunk_type")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    made = text.chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line"))
    return c.select("chunk_id", made.alias("made"), (F.col("chunk_id") == made).alias("same"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    return embedding.with_hash(c).select("chunk_id", "content_hash", F.length(text.embedding_text(*(F.col(x) for x in ("file_path", "language", "start_line", "end_line", "name", "chunk_type", "content")))).alias("n"))


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with their hashes; and as the cache the hashes that begin with 0 .. 7 and some that no chunk has."""
    chunks = embedding.with_hash(table(spark, d, "chunks").distinct())
    known = chunks.filter(F.substring("content_hash", 1, 1) < "8").select("repo_id", "content_hash")
    stale = table(spark, d, "facts").filter(F.col("fact").isNotNull()).select("repo_id", text.hash16(F.col("fact")).alias("content_hash"))
    return chunks, known.unionAll(stale).withColumn("embedding", F.array(F.lit(1.0).cast("float")))


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    chunks, cache = _cache(spark, d)
    return embedding.cache_lookup(chunks, cache).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    chunks, cache = _cache(spark, d)
    r = embedding.hit_rate(embedding.cache_lookup(chunks, cache))
    return r.select("total", "hits", F.round("percent", 4).alias("percent"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    chunks, cache = _cache(spark, d)
    return embedding.cache_misses(chunks, cache).select("chunk_id", "content_hash")


def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    chunks, cache = _cache(spark, d)
    return embedding.cache_prune(cache, chunks).select("repo_id", "content_hash").distinct()


def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("repo_id", "chunk_id").distinct()
    return embedding.batches(c, ["chunk_id"])


def embed_with_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the stand-in, a sum over each with its coordinates' numbers; those of the cache are zeros here."""
    chunks = table(spark, d, "chunks").distinct()
    cache = embedding.with_hash(chunks).filter(F.substring("content_hash", 1, 1) < "8").select("repo_id", "content_hash", F.array_repeat(F.lit(0.0).cast("float"), 16).alias("embedding"))
    done, _ = embedding.embed_chunks(chunks, cache, embedding.HashEmbedder(16))
    told = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0.0), lambda s, i: s + i * F.element_at("embedding", i).cast("double"))
    return done.select("chunk_id", "content_hash", F.size("embedding").alias("dimensions"), (F.round(told, 4) + F.lit(0.0)).alias("told"))


def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories").distinct()
    return r.select("id", text.progress_percent(F.col("ingestion_progress"), F.col("ingestion_total_chunks")).alias("percent"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    return c.groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))


_REASON = f"""CASE WHEN list_has_any(string_split({q.slashes("p")}, '/'), [{q.strings(paths.SKIP_DIRS["scan"])}]) THEN 'directory'
    WHEN {q.file_name("p")} IN ({q.strings(paths.SKIP_NAMES)}) THEN 'name'
    WHEN regexp_matches({q.file_name("p")}, '({"|".join(e.replace(".", "[.]") for e in paths.SKIP_BUILT)})$') THEN 'built'
    WHEN regexp_matches({q.file_name("p")}, '({"|".join(e.replace(".", "[.]") for e in paths.SKIP_TESTS)})$') OR regexp_matches({q.file_name("p")}, '^test_.*[.]py$') THEN 'test'
    WHEN {q.extension("p")} NOT IN ({q.strings(paths.EXTENSIONS)}) THEN 'extension'
    WHEN size > 102400 THEN 'size' WHEN {q.line_count("content")} < 5 THEN 'lines' ELSE 'read' END"""
_FILES = f"SELECT doc_id, {_REASON} AS reason FROM (SELECT doc_id, path AS p, text AS content, strlen(text) AS size FROM documents)"

_WINDOWS = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS L FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, L, unnest(generate_series(0, greatest(len(L) - {overlap} - 1, 0), {step})) AS st FROM l),
w AS (SELECT doc_id, st + 1 AS start_line, least(st + {size}, len(L)) AS end_line, {strip} AS content FROM s)
SELECT doc_id, start_line, end_line, {value} FROM w WHERE content <> ''"""

_LINES = f"""l0 AS (SELECT chunk_id, string_split(content, chr(10)) AS L FROM f),
l1 AS (SELECT chunk_id, L, unnest(generate_series(1, len(L))) AS i FROM l0),
l2 AS (SELECT chunk_id, i, L[i] AS line, {q.indent("L[i]")} AS depth, {q.strip("L[i]")} AS bare, regexp_replace(L[i], '^[\\s\\v\\x1c-\\x1f\\p{{Z}}]+', '') AS s, len(L) AS n FROM l1),
l AS (SELECT *, NOT (bare = '' OR starts_with(bare, '#') OR starts_with(bare, '//')) AS solid FROM l2)"""
_PYTHON = f"""WITH f AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE lower(language) = 'python'), {_LINES},
d AS (SELECT * FROM l WHERE regexp_matches(s, '^(class |def |async def )')),
e AS (SELECT d.*, coalesce((SELECT min(x.i) FROM l x WHERE x.chunk_id = d.chunk_id AND x.i > d.i AND x.solid AND x.depth <= d.depth), d.n + 1) AS closer FROM d),
o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.chunk_id = e.chunk_id AND y.i < e.i AND y.closer > e.i))
SELECT chunk_id, i AS start_line, closer - 1 AS end_line, CASE WHEN starts_with(s, 'class ') THEN 'class' ELSE 'function' END AS chunk_type,
  nullif({q.strip("CASE WHEN starts_with(s, 'class ') THEN regexp_extract(s[7:], '^[^(:]*') ELSE regexp_extract(regexp_replace(s, '^(async )?def ', ''), '^[^(]*') END")}, '') AS name,
  substr(sha256({q.strip("(SELECT array_to_string(L[o.i:o.closer - 1], chr(10)) FROM l0 WHERE l0.chunk_id = o.chunk_id)")}), 1, 16) AS digest FROM o"""
_JS = f"""WITH f AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE lower(language) IN ('javascript', 'typescript')), {_LINES},
d AS (SELECT *, min(depth) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least
      FROM l WHERE regexp_matches(s, '^(export )?((async )?function|class) ')),
o AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY chunk_id ORDER BY i), n + 1) AS closer FROM d WHERE least IS NULL OR depth <= least)
SELECT chunk_id, i AS start_line, closer - 1 AS end_line, CASE WHEN regexp_matches(s, '^(export )?class ') THEN 'class' ELSE 'function' END AS chunk_type,
  nullif({q.strip("CASE WHEN regexp_matches(s, '^(export )?class ') THEN regexp_extract(regexp_replace(s, '^(export )?class ', ''), '^[^{( ]*') ELSE regexp_extract(regexp_replace(s, '^(export )?(async )?function ', ''), '^[^(]*') END")}, '') AS name,
  substr(sha256({q.strip("(SELECT array_to_string(L[o.i:o.closer - 1], chr(10)) FROM l0 WHERE l0.chunk_id = o.chunk_id)")}), 1, 16) AS digest FROM o"""
_DISPATCH = f"""WITH p AS ({_PYTHON}), j AS ({_JS}), s AS (SELECT chunk_id, start_line, end_line, chunk_type FROM p UNION ALL SELECT chunk_id, start_line, end_line, chunk_type FROM j),
r AS (SELECT DISTINCT chunk_id, lower(language) AS language, content FROM chunks), rest AS (SELECT * FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM s)),
l AS (SELECT chunk_id, string_split(content, chr(10)) AS L FROM rest WHERE content IS NOT NULL),
w0 AS (SELECT chunk_id, L, unnest(generate_series(0, greatest(len(L) - 11, 0), 40)) AS st FROM l),
w AS (SELECT chunk_id, st + 1 AS start_line, least(st + 50, len(L)) AS end_line, 'block' AS chunk_type FROM w0 WHERE {q.strip("array_to_string(L[st + 1:st + 50], chr(10))")} <> ''),
a AS (SELECT * FROM s UNION ALL SELECT * FROM w)
SELECT substr(sha256('r:' || chunk_id || ':' || start_line), 1, 16) AS chunk_id, chunk_id AS file_path, start_line, end_line, chunk_type FROM a"""

_TEXT = "'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || 'Lines: ' || start_line || '-' || end_line || chr(10) || CASE WHEN coalesce(name, '') <> '' THEN 'Name: ' || name || chr(10) ELSE '' END || 'Type: ' || chunk_type || chr(10) || '---' || chr(10) || content"
_HASHED = f"c AS (SELECT DISTINCT * FROM chunks), h AS (SELECT *, substr(sha256({_TEXT}), 1, 16) AS content_hash FROM c)"
_CACHED = f"WITH {_HASHED}, k AS (SELECT DISTINCT repo_id, content_hash FROM h WHERE content_hash[1] < '8' UNION SELECT repo_id, substr(sha256(fact), 1, 16) FROM facts WHERE fact IS NOT NULL)"
_HIT = "EXISTS (SELECT 1 FROM k WHERE k.repo_id = h.repo_id AND k.content_hash = h.content_hash)"

QUERIES = {
    f.__name__: f
    for f in (
        file_filter, file_filter_chunk_paths, scan_counters, language_map, relative_paths, repo_names, sliding_window_chunks, sliding_window_chunks_small, structural_chunks_python, structural_chunks_js,
        chunk_dispatch, chunk_ids, content_hash, cache_hit_miss, cache_hit_rate, cache_misses, cache_prune, batch_assignment, embed_with_cache, progress_percent, chunk_counts,
    )
}
ORACLE = {
    "file_filter": _FILES,
    "file_filter_chunk_paths": f"SELECT repo_id, file_path, {_REASON} AS reason FROM (SELECT DISTINCT repo_id, file_path, file_path AS p, repeat(chr(10), 9) AS content, 0 AS size FROM chunks)",
    "scan_counters": f"SELECT reason, count(*) AS n FROM ({_FILES}) GROUP BY 1",
    "language_map": f"SELECT *, CASE WHEN display IN {paths.HIGHLIGHTED} THEN display ELSE 'text' END AS highlight FROM (SELECT {q.case(q.extension('file_path'), paths.LANGUAGES, 'text')} AS language, {q.case(q.extension('file_path'), paths.DISPLAY_LANGUAGES, 'plaintext')} AS display, count(*) AS n FROM chunks GROUP BY 1, 2)",
    "relative_paths": f"SELECT DISTINCT repo_id, file_path, {q.slashes('file_path')} AS relative_path, NOT regexp_matches({q.slashes('file_path')}, '^(/|[A-Za-z]:)|(^|/)[.][.](/|$)') AS safe FROM chunks",
    "repo_names": r"""SELECT DISTINCT id, CASE WHEN url IS NULL THEN NULL ELSE coalesce(nullif(regexp_replace(list_last(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')), '\.git$', ''), ''), 'unknown_repo') END AS name,
        replace(list_last(string_split(url, '/')), '.git', '') AS upload_name, substr('repo_' || replace(id, '-', '_'), 1, 63) AS collection FROM repositories""",
    "sliding_window_chunks": _WINDOWS.format(size=50, overlap=10, step=40, strip=q.strip("array_to_string(L[st + 1:st + 50], chr(10))"), value="content"),
    "sliding_window_chunks_small": _WINDOWS.format(size=8, overlap=2, step=6, strip=q.strip("array_to_string(L[st + 1:st + 8], chr(10))"), value="length(content) AS n"),
    "structural_chunks_python": _PYTHON,
    "structural_chunks_js": _JS,
    "chunk_dispatch": _DISPATCH,
    "chunk_ids": "SELECT chunk_id, m AS made, chunk_id = m AS same FROM (SELECT DISTINCT *, substr(sha256(repo_id || ':' || file_path || ':' || start_line), 1, 16) AS m FROM chunks)",
    "embed_with_cache": f"""WITH {_HASHED}, v AS ({q.vectors(f"SELECT DISTINCT content_hash, {_TEXT} AS t FROM h WHERE NOT content_hash[1] < '8'", "content_hash", 16)}),
        s AS (SELECT content_hash, sum((i + 1) * CAST(x AS DOUBLE)) AS told FROM v GROUP BY 1)
        SELECT chunk_id, content_hash, 16 AS dimensions, round(coalesce(told, 0.0), 4) + 0.0 AS told FROM h LEFT JOIN s USING (content_hash) WHERE content_hash IS NOT NULL
        UNION ALL SELECT chunk_id, content_hash, NULL, NULL FROM h WHERE content_hash IS NULL""",
    "content_hash": f"WITH {_HASHED} SELECT chunk_id, content_hash, length({_TEXT}) AS n FROM h",
    "cache_hit_miss": f"{_CACHED} SELECT {_HIT} AS hit, count(*) AS n FROM h GROUP BY 1",
    "cache_hit_rate": f"{_CACHED} SELECT count(*) AS total, count(*) FILTER ({_HIT}) AS hits, round(100.0 * count(*) FILTER ({_HIT}) / count(*), 4) AS percent FROM h",
    "cache_misses": f"{_CACHED} SELECT chunk_id, content_hash FROM h WHERE NOT {_HIT}",
    "cache_prune": f"{_CACHED} SELECT repo_id, content_hash FROM k WHERE EXISTS (SELECT 1 FROM h WHERE k.repo_id = h.repo_id AND k.content_hash = h.content_hash)",
    "batch_assignment": "SELECT repo_id, chunk_id, CAST(floor((row_number() OVER (PARTITION BY repo_id ORDER BY chunk_id) - 1) / 32) AS INTEGER) AS batch FROM (SELECT DISTINCT repo_id, chunk_id FROM chunks)",
    "progress_percent": "SELECT DISTINCT id, CASE WHEN ingestion_total_chunks > 0 THEN CAST(least(floor(ingestion_progress / ingestion_total_chunks * 100), 99) AS INTEGER) ELSE 0 END AS percent FROM repositories",
    "chunk_counts": "SELECT repo_id, count(DISTINCT file_path) AS files, count(*) AS chunks FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1",
}
