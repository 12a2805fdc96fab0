"""Reading tools and states: listings, trees, ranges of lines, symbols, edits, phases, memory, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import paths, text
from loamstone.operators import checks, history, tools
from loamstone.operators.ann import ann_topk
from loamstone.operators.topk import topk_matrix
from loamstone.plans import sqltext as q
from loamstone.session import table
from loamstone.streaming import state

#: The time that queries of memory take for now.
NOW = "2024-01-20 00:00:00"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("repo_id", F.regexp_replace(paths.relative(F.col("file_path")), "^[.]/", "").alias("path")).distinct()


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    return tools.directory_entries(_paths(spark, d)).select("repo_id", "name", "type", "place")


def subdirectory_listing(spark: SparkSession, d: str) -> DataFrame:
    return tools.directory_entries(_paths(spark, d), "core").select("repo_id", "name", "path", "type", "place")


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tools.tree_nodes(_paths(spark, d)).select("repo_id", "path", "parent", "name", "type", "depth", "is_last")


def tree_texts(spark: SparkSession, d: str) -> DataFrame:
    t = tools.tree_text(tools.tree_nodes(_paths(spark, d)))
    return t.select("repo_id", F.size(F.split("text", "\n")).alias("lines"))


def file_contents(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", "path", F.col("text").alias("content"))
    return tools.viewable(f).select("doc_id", "language", F.length("content").alias("n"))


def line_range_reader(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    return c.select("chunk_id", text.line_range(F.col("content"), 3, 7).alias("body"))


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", text.line_count(F.col("text")).alias("lines"), text.token_estimate(F.col("text")).alias("tokens"), F.element_at(text.lines(F.col("text")), 1).alias("first"))


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    found = tools.find_definitions(c.select("chunk_id", "file_path", "content"), "storeRow")
    return found.select("chunk_id", "line_no", "line", "pattern", text.hash16(F.col("snippet")).alias("digest"))


def edit_once(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    status, edited = text.edit_once(F.col("text"), F.lit("because"), F.lit("since"))
    return docs.select("doc_id", text.occurrences(F.col("text"), F.lit("because")).alias("n"), status.alias("status"), text.hash16(edited).alias("digest"))


def error_sanitizer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", text.hash16(text.error_summary(F.col("text"))).alias("digest"))


def test_commands(spark: SparkSession, d: str) -> DataFrame:
    """Each repository has a root file made of its first character, so that all kinds occur."""
    r = table(spark, d, "repositories").select("id").distinct()
    names = ["setup.py", "package.json", "Cargo.toml", "go.mod", "pom.xml", "README"]
    made = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.ascii("id"), F.lit(6)) + 1).cast("int"))
    return tools.test_command(r.select(F.col("id").alias("repo_id"), made.alias("path")))


def _writes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props", F.col("event_id").cast("string").alias("value"))


def latest_phase(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_phase(_writes(spark, d), "user_id", "event_type")


def ttl_memory(spark: SparkSession, d: str) -> DataFrame:
    kept = history.alive(_writes(spark, d), F.lit(NOW).cast("timestamp"), 86_400, ("user_id", "event_type"), at="ts", tie="event_id")
    return kept.select("user_id", "event_type", "value")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    found = state.rate_limited(_writes(spark, d), "user_id", "ts", "1 hour", 1)
    return found.select("user_id", F.unix_timestamp("window_start").alias("window_start"), "n")


def json_field(spark: SparkSession, d: str) -> DataFrame:
    return _writes(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event rows as lines of a stream, some of which carry no data or broken JSON."""
    e = _writes(spark, d)
    body = F.concat(F.lit('{"type":"'), "event_type", F.lit('","id":'), F.col("event_id").cast("string"), F.when(F.pmod("event_id", F.lit(7)) == 0, "").otherwise("}"))
    lines = e.select("event_id", F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit(": "), body)).otherwise(F.concat(F.lit("data: "), body)).alias("value"))
    return state.parse_sse(lines).select("event_id", "type")


def sse_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents as fragments of three characters each would arrive; here each word is a fragment."""
    docs = table(spark, d, "facts").filter("fact IS NOT NULL").select(F.xxhash64("repo_id", "fact").alias("stream_id"), "fact").distinct()
    parts = docs.select("stream_id", F.posexplode(F.split(F.concat("fact", F.lit(" \n")), " ")).alias("seq", "text"))
    return state.reassemble(parts).select("line")


def vector_topk_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    queries = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return topk_matrix(queries, v, 10).select("qid", "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


def vector_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: the index finds most of the nearest, not all."""
    v = table(spark, d, "embeddings")
    queries = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return ann_topk(queries, v, 10).select("qid", "vec_id", F.round("dist", 6).alias("dist"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.sum("value"), 2).alias("value"))


def ranked_names(spark: SparkSession, d: str) -> DataFrame:
    """The five names that most chunks of each language have."""
    c = table(spark, d, "chunks").distinct().filter("name IS NOT NULL AND language IS NOT NULL")
    n = c.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "name"))
    return n.withColumn("rank", rank).filter("rank <= 5")


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    counted = [checks.violations(table(spark, d, name), name) for name in checks.CONSTRAINTS]
    return counted[0].unionAll(counted[1]).unionAll(counted[2]).unionAll(counted[3])


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    m, c, r = table(spark, d, "messages"), table(spark, d, "conversations"), table(spark, d, "repositories")
    lost = checks.dangling(m, "conversation_id", c).select(F.lit("messages").alias("table"), F.col("id"))
    return lost.unionAll(checks.dangling(c, "repo_id", r).select(F.lit("conversations"), F.col("id"))).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


_P = f"p AS (SELECT DISTINCT repo_id, regexp_replace({q.slashes('file_path')}, '^[.]/', '') AS path FROM chunks)"
_SHOWN = f"({q.strings(paths.SKIP_DIRS['listing'])})"
_ENTRIES = "e AS (SELECT DISTINCT repo_id, string_split(r, '/')[1] AS name, CASE WHEN len(string_split(r, '/')) > 1 THEN 'directory' ELSE 'file' END AS type FROM x)"
_PLACE = "row_number() OVER (PARTITION BY repo_id ORDER BY type <> 'directory', lower(name), name) AS place"
_WRITES = "w AS (SELECT event_id, user_id, event_type, ts, CAST(event_id AS VARCHAR) AS value FROM events)"

QUERIES = {
    f.__name__: f
    for f in (
        directory_listing, subdirectory_listing, tree_nodes, tree_texts, file_contents, line_range_reader, line_stats, symbol_search, edit_once, error_sanitizer, test_commands, latest_phase, ttl_memory,
        rate_limit, json_field, sse_parse, sse_reassembly, vector_topk_matrix, vector_topk_indexed, event_counts, ranked_names, constraint_violations, dangling_references,
    )
}
ORACLE = {
    "directory_listing": f"WITH {_P}, x AS (SELECT repo_id, path AS r FROM p), {_ENTRIES} SELECT repo_id, name, type, {_PLACE} FROM e WHERE name <> '' AND name NOT IN {_SHOWN}",
    "subdirectory_listing": f"WITH {_P}, x AS (SELECT repo_id, substr(path, 6) AS r FROM p WHERE starts_with(path, 'core/')), {_ENTRIES} SELECT repo_id, name, 'core/' || name AS path, type, {_PLACE} FROM e WHERE name <> '' AND name NOT IN {_SHOWN}",
    "tree_nodes": f"""WITH {_P}, s AS (SELECT repo_id, string_split(path, '/') AS L FROM p), k AS (SELECT * FROM s WHERE NOT list_has_any(L[1:len(L) - 1], [{q.strings(paths.SKIP_DIRS["tree"])}])),
        u AS (SELECT repo_id, L, unnest(generate_series(1, least(len(L), 3))) AS i FROM k),
        n AS (SELECT DISTINCT repo_id, array_to_string(L[1:i], '/') AS path, array_to_string(L[1:i - 1], '/') AS parent, L[i] AS name, CASE WHEN i < len(L) THEN 'directory' ELSE 'file' END AS type, CAST(i AS INTEGER) AS depth FROM u)
        SELECT *, lead(name) OVER (PARTITION BY repo_id, parent ORDER BY type <> 'directory', lower(name), name) IS NULL AS is_last FROM n""",
    "file_contents": f"""SELECT doc_id, {q.case(q.extension("path"), paths.DISPLAY_LANGUAGES, "plaintext")} AS language, length(text) AS n FROM documents
        WHERE strlen(text) <= 5242880 AND path IS NOT NULL AND NOT regexp_matches({q.slashes("path")}, '^(/|[A-Za-z]:)|(^|/)[.][.](/|$)')""",
    "line_range_reader": """SELECT chunk_id, CASE WHEN len(L) >= 3 THEN array_to_string(list_transform(range(3, least(len(L), 7) + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || L[i]), chr(10)) END AS body
        FROM (SELECT chunk_id, string_split(content, chr(10)) AS L FROM (SELECT DISTINCT * FROM chunks))""",
    "line_stats": f"SELECT doc_id, {q.line_count('text')} AS lines, length(text) // 4 AS tokens, string_split(text, chr(10))[1] AS first FROM documents WHERE text IS NOT NULL",
    "symbol_search": r"""WITH f AS (SELECT DISTINCT chunk_id, file_path, string_split(content, chr(10)) AS L FROM chunks WHERE contains(content, 'storeRow')),
        l AS (SELECT chunk_id, L, lower(regexp_extract(file_path, '(\.[^.]+)$', 1)) AS ext, unnest(generate_series(1, len(L))) AS i FROM f WHERE NOT regexp_matches(replace(file_path, '\', '/'), '(^|/)([.]git|__pycache__|node_modules|[.]venv|venv|dist|build|[.]next|vendor|target)(/|$)')),
        p(ext, pattern, rx) AS (VALUES """
    + ", ".join(f"('{e}', {k}, '{p.replace('{name}', 'storeRow')}')" for e, ps in tools.DEFINITIONS.items() for k, p in enumerate(ps))
    + """) SELECT chunk_id, CAST(i AS INTEGER) AS line_no, L[i] AS line, pattern, substr(sha256(array_to_string(list_transform(range(greatest(i - 2, 1), least(i + 12, len(L)) + 1), lambda j: lpad(CAST(j AS VARCHAR), 5, ' ') || ' | ' || L[j]), chr(10))), 1, 16) AS digest
        FROM l JOIN p USING (ext) WHERE regexp_matches(L[i], rx)""",
    "edit_once": "WITH c AS (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'because', ''))) // 7 AS INTEGER) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'edited' END AS status, substr(sha256(CASE WHEN n = 1 THEN replace(text, 'because', 'since') ELSE text END), 1, 16) AS digest FROM c",
    "error_sanitizer": f"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS L FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, L, unnest(generate_series(1, len(L))) AS i FROM l),
        s AS (SELECT doc_id, i, {q.strip("L[i]")} AS x FROM u), g AS (SELECT doc_id, x, min(i) AS i FROM s WHERE x <> '' AND NOT regexp_matches(x, '{text.NOISE}') AND NOT regexp_matches(x, '{text.PERCENT_LINE}') GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), t AS (SELECT doc_id, 'Clone failed: ' || string_agg(x, '; ' ORDER BY i) AS t FROM r WHERE k <= 5 GROUP BY 1)
        SELECT l.doc_id, substr(sha256(coalesce(t.t, '{text.NO_ERROR_LINES}')), 1, 16) AS digest FROM l LEFT JOIN t USING (doc_id)""",
    "test_commands": "SELECT DISTINCT id AS repo_id, CASE ascii(id) % 6 WHEN 0 THEN 'python -m pytest --tb=short -q' WHEN 1 THEN 'npm test' WHEN 2 THEN 'cargo test' WHEN 3 THEN 'go test ./...' WHEN 4 THEN 'mvn test' END AS command FROM repositories",
    "latest_phase": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "ttl_memory": f"WITH {_WRITES}, l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM w WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2) SELECT user_id, event_type, value FROM l WHERE ts + INTERVAL 86400 SECONDS > TIMESTAMP '{NOW}'",
    "rate_limit": "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "sse_parse": "SELECT event_id, event_type AS type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "sse_reassembly": "SELECT unnest(string_split(replace(fact, ' ', ''), chr(10))) AS line FROM (SELECT DISTINCT repo_id, fact FROM facts WHERE fact IS NOT NULL)",
    "constraint_violations": """WITH r AS (SELECT 'repositories' AS t, unnest([{'rule': 'id', 'ok': id IS NOT NULL}, {'rule': 'name', 'ok': length(name) BETWEEN 1 AND 255}, {'rule': 'url', 'ok': url IS NULL OR length(url) BETWEEN 1 AND 1024}, {'rule': 'status', 'ok': status IN ('pending', 'ingesting', 'ready', 'failed')},
        {'rule': 'phase', 'ok': ingestion_phase IS NULL OR ingestion_phase IN ('clone', 'parse', 'embed', 'store', 'done', 'failed')}, {'rule': 'counts', 'ok': file_count >= 0 AND chunk_count >= 0 AND ingestion_progress >= 0}, {'rule': 'times', 'ok': updated_at >= created_at}]) AS x FROM repositories
        UNION ALL SELECT 'conversations', unnest([{'rule': 'id', 'ok': id IS NOT NULL}, {'rule': 'repo', 'ok': repo_id IS NOT NULL}, {'rule': 'title', 'ok': length(title) BETWEEN 1 AND 512}, {'rule': 'times', 'ok': updated_at >= created_at}]) FROM conversations
        UNION ALL SELECT 'messages', unnest([{'rule': 'id', 'ok': id IS NOT NULL}, {'rule': 'role', 'ok': role IN ('user', 'assistant', 'system', 'tool')}, {'rule': 'content', 'ok': length(content) >= 1}, {'rule': 'time', 'ok': created_at IS NOT NULL}]) FROM messages
        UNION ALL SELECT 'chunks', unnest([{'rule': 'id', 'ok': regexp_full_match(chunk_id, '[0-9a-f]{16}')}, {'rule': 'lines', 'ok': start_line >= 1 AND end_line >= start_line}, {'rule': 'type', 'ok': chunk_type IN ('function', 'class', 'block')}, {'rule': 'content', 'ok': length(content) >= 1}]) FROM chunks)
        SELECT t AS "table", x.rule AS rule, count(*) FILTER (NOT coalesce(x.ok, false)) AS n FROM r GROUP BY 1, 2""",
    "dangling_references": """SELECT 'messages' AS "table", count(*) AS n FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL) HAVING count(*) > 0
        UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE repo_id IS NOT NULL AND repo_id NOT IN (SELECT id FROM repositories WHERE id IS NOT NULL) HAVING count(*) > 0""",
    "event_counts": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "ranked_names": "WITH n AS (SELECT language, name, count(*) AS n FROM (SELECT DISTINCT * FROM chunks) WHERE name IS NOT NULL AND language IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, name) AS rank FROM n) SELECT * FROM r WHERE rank <= 5",
}
