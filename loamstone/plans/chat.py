"""Questions and answers: budgets, prompts, histories, pages, agents and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import text
from loamstone.operators import agent, context, embedding, history, retrieval
from loamstone.operators.topk import relevance, topk
from loamstone.plans import sqltext as q
from loamstone.plans.ingest import _TEXT
from loamstone.session import table
from loamstone.streaming import state


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").distinct()


#: Coordinates of the stand-in for an embedding service in the queries here.
_DIMENSIONS = 64


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Titles of conversations as questions to their repositories."""
    c = table(spark, d, "conversations").distinct().filter("repo_id IS NOT NULL AND id IS NOT NULL")
    return c.select(F.col("id").alias("qid"), "repo_id", F.col("title").alias("question"))


def _hits(spark: SparkSession, d: str, questions: DataFrame | None = None) -> DataFrame:
    """The ten nearest chunks of each question in its repository: questions and chunks embedded, searched, ranked and joined."""
    c = table(spark, d, "chunks").distinct()
    embedder = embedding.HashEmbedder(_DIMENSIONS)
    body = text.embedding_text(*(F.col(x) for x in ("file_path", "language", "start_line", "end_line", "name", "chunk_type", "content")))
    vectors = embedding.embed(c.select("repo_id", "chunk_id", body.alias("text")).filter("text IS NOT NULL"), embedder)
    return retrieval.retrieve(_questions(spark, d) if questions is None else questions, c, vectors, embedder).drop("repo_id")


def retrieved_chunks(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return h.select("qid", "rank", "chunk_id", "file_path", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


def token_budget_context(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter("conversation_id IS NOT NULL").withColumn("tokens", text.token_estimate(F.col("content")))
    return context.within_budget(m, ["conversation_id"], ["created_at", "id"], budget=200).select("conversation_id", "id", "used")


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return context.context_text(_hits(spark, d), budget=1500).select("qid", F.length("context").alias("n"), text.hash16(F.col("context")).alias("digest"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).filter("rank <= 8")
    return h.select("qid", "rank", text.hash16(context.result_block(F.col("rank"))).alias("digest"))


def source_lists(spark: SparkSession, d: str) -> DataFrame:
    s = context.sources(_hits(spark, d))
    return s.select("qid", F.size("sources").alias("n"), F.col("sources")[0]["file_path"].alias("first_path"), F.get_json_object("metadata_json", "$.sources[0].file_path").alias("json_path"))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The last messages of each conversation as the history of a prompt with its title as the question."""
    m = history.last_n(_messages(spark, d).filter("conversation_id IS NOT NULL"), 6)
    h = m.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
    c = table(spark, d, "conversations").distinct().select(F.col("id").alias("conversation_id"), "title")
    p = h.join(c, "conversation_id").withColumn("messages", context.prompt_messages(F.col("history"), context.user_content(F.coalesce("title", F.lit("")), F.lit(""), F.lit("")), "system"))
    return p.select("conversation_id", F.size("messages").alias("n"), context.prompt_tokens(F.col("messages")).alias("tokens"), text.hash16(F.array_join(F.transform("messages", lambda x: F.concat_ws(": ", x["role"], x["content"])), "\n")).alias("digest"))


def ordered_transcript(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter("conversation_id IS NOT NULL AND content IS NOT NULL AND created_at IS NOT NULL")
    return m.groupBy("conversation_id").agg(context.ordered_concat("content", ["created_at", "id"], "\n").alias("t")).select("conversation_id", text.hash16(F.col("t")).alias("digest"))


def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    return history.last_n(_messages(spark, d), 4).select("conversation_id", "turn", "id")


def list_repositories(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories").distinct()
    return history.page(r, [F.col("created_at").desc_nulls_last(), F.col("id")], 2, 10).select("id", "name")


def list_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").distinct().filter("repo_id IS NOT NULL")
    return history.page(c, [F.col("updated_at").desc_nulls_last(), F.col("id")], 3, 20).select("id", "title")


def history_page(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter(F.col("created_at").isNotNull())
    return history.page(m, [F.col("created_at"), F.col("id")], 1, 50).select("id", "role")


def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    return history.page_envelope(table(spark, d, "documents").filter("lang = 'en'"), 2, 20)


def owner_filter(spark: SparkSession, d: str) -> DataFrame:
    """For each user how many repositories may be read by id and how many are listed."""
    r = table(spark, d, "repositories").distinct()
    ownerless = r.filter(F.col("user_id").isNull()).agg(F.count(F.lit(1)).alias("open"))
    listed = r.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count_if(history.owned_by(F.col("user_id"))).alias("listed"))
    return listed.crossJoin(F.broadcast(ownerless)).select("user_id", "listed", (F.col("listed") + F.col("open")).alias("readable"))  # the right side is one row


def ready_repositories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories").distinct().filter(history.ready()).select("id", "status")


def conversation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages and the last one's id of each conversation that exists."""
    m, c = _messages(spark, d), table(spark, d, "conversations").select("id").distinct().withColumnRenamed("id", "conversation_id")
    counted = m.groupBy("conversation_id").agg(F.count("id").alias("n"), F.max("id").alias("greatest"))
    return c.join(counted, "conversation_id", "left").select("conversation_id", F.coalesce("n", F.lit(0)).alias("n"), "greatest")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    t = {"repositories": table(spark, d, "repositories").distinct(), "conversations": table(spark, d, "conversations").distinct(), "messages": _messages(spark, d)}
    gone = t["repositories"].filter("status = 'failed'").select("id")
    left = history.cascade_delete(t, gone, [("conversations", "repo_id", "repositories", "id"), ("messages", "conversation_id", "conversations", "id")], "repositories")
    counts = [left[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in t]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def titles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").distinct()
    return c.select("id", text.chat_title(F.col("title")).alias("chat"), text.task_title(F.col("title")).alias("task"), text.renamed_title(F.col("title")).alias("renamed"))


def fact_set(spark: SparkSession, d: str) -> DataFrame:
    return history.fact_set(table(spark, d, "facts"))


def facts_text(spark: SparkSession, d: str) -> DataFrame:
    return history.facts_text(table(spark, d, "facts"))


def role_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).groupBy(agent.message_class(F.col("role")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def tool_gate(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).filter("content IS NOT NULL").groupBy(text.asks_for_more(F.col("content")).alias("asks")).agg(F.count(F.lit(1)).alias("n"))


def message_sources(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter("metadata_json IS NOT NULL")
    return m.select("id", F.get_json_object("metadata_json", "$.sources[0].file_path").alias("first")).filter("first IS NOT NULL")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Questions as runs; a reply of the planner is made of each: JSON, fenced JSON or none, by the length of the question."""
    m = _messages(spark, d).filter("role = 'user' AND length(trim(content)) > 0 AND id IS NOT NULL")
    n = F.pmod(F.length("content"), F.lit(3))
    reply = F.concat(F.lit('{"plan": ["read '), F.length("content").cast("string"), F.lit('", "answer"], "needs_tools": '), F.when(F.pmod(F.length("content"), F.lit(2)) == 0, "true").otherwise("false"), F.lit("}"))
    return m.select(F.col("id").alias("run_id"), F.col("content").alias("user_query"), F.when(n == 0, reply).when(n == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).otherwise("I would read it.").alias("plan_reply"))


def plan_parse(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_id", agent.parse_plan(F.col("plan_reply")).alias("p")).select("run_id", F.col("p.plan")[0].alias("first_step"), F.size("p.plan").alias("steps"), "p.needs_tools", "p.reasoning")


def agent_trace(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the questions in conversations, on what is retrieved for them. Rows only: answers come from a stand-in."""
    runs = _runs(spark, d)
    of = _messages(spark, d).select(F.col("id").alias("run_id"), "conversation_id")
    repos = table(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.min("repo_id").alias("repo_id"))
    asked = runs.join(of, "run_id").join(repos, "conversation_id").select(F.col("run_id").alias("qid"), "repo_id", F.col("user_query").alias("question"))
    return agent.run_agents(runs, _hits(spark, d, asked).withColumnRenamed("qid", "run_id"))


def agent_events(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).withColumn("stages", agent.route(agent.parse_plan(F.col("plan_reply"))["needs_tools"]))
    return state.agent_events(runs)


def chat_events(spark: SparkSession, d: str) -> DataFrame:
    """Each answer as a stream of events, one for each of its words."""
    m = _messages(spark, d).filter("role = 'assistant' AND content IS NOT NULL AND conversation_id IS NOT NULL")
    e = state.chat_events(m.select("conversation_id", F.split("content", " ", -1).alias("pieces")))
    return e.groupBy("conversation_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def step_log(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).select("run_id", F.struct(F.lit("planner").alias("agent"), F.length("user_query").alias("length"), F.lit(True).alias("ok")).alias("s"))
    return runs.select("run_id", agent.step_text(F.col("s"), ["agent", "length", "ok"]).alias("j"))


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).filter("role = 'user' AND content IS NOT NULL").select("id", text.hash16(text.query_text(F.col("content"))).alias("digest"))


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    hits = topk(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), v, 11).filter("vec_id <> qid")
    return hits.groupBy("qid").agg(F.round(F.max(relevance(F.col("dist"))), 6).alias("best"))


def answer_html(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter("role = 'assistant' AND content IS NOT NULL")
    return m.select("id", text.hash16(text.answer_html(F.col("content"))).alias("digest"))


def memory_bundles(spark: SparkSession, d: str) -> DataFrame:
    b = context.memory_bundle(_messages(spark, d), table(spark, d, "facts"), table(spark, d, "conversations"))
    return b.select("conversation_id", F.size("bundle.history").alias("turns"), F.size("bundle.facts").alias("facts"), F.array_join("bundle.facts", "|").alias("joined"))


def top_files(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("p"))
    return h.select("qid", F.array_join(agent.top_files(F.col("p")), "|").alias("files"))


def executor_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).withColumn("p", agent.parse_plan(F.col("plan_reply")))
    return r.select("run_id", text.hash16(agent.executor_prompt(F.col("user_query"), F.col("p.plan"), F.lit(""), F.col("p.reasoning"), F.lit(None).cast("string"))).alias("digest"))


_M = "m AS (SELECT DISTINCT * FROM messages)"
_HITS = f"""c AS (SELECT DISTINCT * FROM chunks), ask AS (SELECT DISTINCT id AS qid, repo_id, title FROM conversations WHERE repo_id IS NOT NULL AND id IS NOT NULL AND length(trim(title, ' ')) > 0),
    cv AS ({q.vectors(f"SELECT repo_id, chunk_id, {_TEXT} AS t FROM c", "repo_id, chunk_id", _DIMENSIONS)}), qv AS ({q.vectors(f"SELECT repo_id, qid, '{text.QUERY_PREFIX}' || title AS t FROM ask", "repo_id, qid", _DIMENSIONS)}),
    cn AS (SELECT repo_id, chunk_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM cv GROUP BY ALL), qn AS (SELECT repo_id, qid, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM qv GROUP BY ALL),
    met AS (SELECT qv.qid, cv.chunk_id, sum(CAST(qv.x AS DOUBLE) * cv.x) AS s FROM qv JOIN cv ON qv.repo_id = cv.repo_id AND qv.i = cv.i GROUP BY ALL),
    near AS (SELECT qn.qid, cn.chunk_id, round(1 - coalesce(s, 0.0) / (qn.n * cn.n), 9) AS dist FROM qn JOIN cn USING (repo_id) LEFT JOIN met ON met.qid = qn.qid AND met.chunk_id = cn.chunk_id),
    hr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rank FROM near),
    h AS (SELECT qid, rank, dist, c.*, greatest(0.0, 1 - dist) AS rel FROM hr JOIN c USING (chunk_id) WHERE rank <= 10)"""
_BLOCK = "'### ' || file_path || ' (L' || start_line || '–L' || end_line || ') [' || chunk_type || ']' || CASE WHEN coalesce(name, '') <> '' THEN ' — ' || name ELSE '' END || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10) || 'Relevance: ' || format('{:.4f}', rel) || chr(10) || chr(10)"
_RESULT = "'### Result ' || rank || ': ' || file_path || CASE WHEN coalesce(name, '') <> '' THEN ' (' || name || ')' ELSE '' END || chr(10) || 'Lines ' || start_line || '–' || end_line || ' | ' || chunk_type || ' | Relevance: ' || format('{:.2f}', rel * 100) || '%' || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10)"
_REPLY = """SELECT id AS run_id, content, length(content) % 3 AS k, length(content) AS n FROM m WHERE role = 'user' AND length(trim(content, ' ')) > 0 AND id IS NOT NULL"""
_PHRASES = " OR ".join("contains(lower(content), '" + p.replace("'", "''") + "')" for p in text.NEED_PHRASES)


def _html() -> str:
    """The steps of the column function, for RE2."""
    x = "content"
    for pattern, replacement in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (r"(?m)^```(\w*)\n([\s\S]*?)\n?```$", r'<pre><code class="language-\1">\2</code></pre>'), (r"`([^`\n]+)`", r"<code>\1</code>"), (r"\*\*([^*\n]+)\*\*", r"<strong>\1</strong>"),
        (r"\*([^*\n]+)\*", r"<em>\1</em>"), ("(?m)^### (.+)$", r"<h4>\1</h4>"), ("(?m)^## (.+)$", r"<h3>\1</h3>"), ("(?m)^# (.+)$", r"<h2>\1</h2>"), (r"(?m)^(?:- |[0-9]+\. )(.+)$", r"<li>\1</li>"), (r"((?:<li>[^\n]*</li>\n?)+)", r"<ul>\1</ul>"), (r"\n\n", "</p><p>"), (r"\n", "<br/>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


_HTML = _html()

QUERIES = {
    f.__name__: f
    for f in (
        token_budget_context, retrieved_chunks, context_blocks, search_results, source_lists, prompt_assembly, ordered_transcript, last_n_history, list_repositories, list_conversations, history_page, page_envelope,
        owner_filter, ready_repositories, conversation_counts, cascade_delete, titles, fact_set, facts_text, role_mapping, tool_gate, message_sources, plan_parse, agent_trace, agent_events, chat_events, step_log, query_texts, best_scores, answer_html, memory_bundles, top_files, executor_prompts,
    )
}
ORACLE = {
    "token_budget_context": f"WITH {_M}, r AS (SELECT conversation_id, id, sum(coalesce(length(content) // 4, 0)) OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS used FROM m WHERE conversation_id IS NOT NULL) SELECT conversation_id, id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 200",
    "retrieved_chunks": f"WITH {_HITS} SELECT qid, rank, chunk_id, file_path, round(dist, 6) + 0.0 AS dist FROM h",
    "context_blocks": f"WITH {_HITS}, b AS (SELECT qid, rank, {_BLOCK} AS block FROM h), r AS (SELECT *, sum(length(block) // 4) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM b), t AS (SELECT qid, chr(10) || chr(10) || '## Retrieved Code Context' || chr(10) || chr(10) || string_agg(block, '' ORDER BY rank) AS t FROM r WHERE used <= 1500 GROUP BY qid) SELECT qid, length(t) AS n, substr(sha256(t), 1, 16) AS digest FROM t",
    "search_results": f"WITH {_HITS} SELECT qid, rank, substr(sha256({_RESULT}), 1, 16) AS digest FROM h WHERE rank <= 8",
    "source_lists": f"WITH {_HITS} SELECT qid, CAST(count(*) AS INTEGER) AS n, arg_min(file_path, rank) AS first_path, arg_min(file_path, rank) AS json_path FROM h WHERE rank <= 5 GROUP BY qid",
    "prompt_assembly": f"""WITH {_M}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST) AS back FROM m WHERE conversation_id IS NOT NULL),
        h AS (SELECT conversation_id, count(*) AS k, sum(coalesce(length(content) // 4, 0)) AS toks, string_agg(CASE WHEN role IS NULL THEN coalesce(content, '') WHEN content IS NULL THEN role ELSE role || ': ' || content END, chr(10) ORDER BY back DESC) AS t FROM b WHERE back <= 6 GROUP BY 1),
        c AS (SELECT DISTINCT * FROM conversations)
        SELECT conversation_id, CAST(k + 2 AS INTEGER) AS n, CAST(toks + length('system') // 4 + length(coalesce(title, '')) // 4 AS BIGINT) AS tokens, substr(sha256('system: system' || chr(10) || t || chr(10) || 'user: ' || coalesce(title, '')), 1, 16) AS digest FROM h JOIN c ON c.id = conversation_id""",
    "ordered_transcript": f"WITH {_M} SELECT conversation_id, substr(sha256(string_agg(content, chr(10) ORDER BY created_at, id)), 1, 16) AS digest FROM m WHERE conversation_id IS NOT NULL AND content IS NOT NULL AND created_at IS NOT NULL GROUP BY 1",
    "last_n_history": f"WITH {_M}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST) AS back FROM m) SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC) AS turn, id FROM b WHERE back <= 4",
    "list_repositories": "SELECT id, name FROM (SELECT DISTINCT * FROM repositories) ORDER BY created_at DESC NULLS LAST, id NULLS FIRST LIMIT 10 OFFSET 10",
    "list_conversations": "SELECT id, title FROM (SELECT DISTINCT * FROM conversations) WHERE repo_id IS NOT NULL ORDER BY updated_at DESC NULLS LAST, id NULLS FIRST LIMIT 20 OFFSET 40",
    "history_page": f"WITH {_M} SELECT id, role FROM m WHERE created_at IS NOT NULL ORDER BY created_at, id NULLS FIRST LIMIT 50",
    "page_envelope": "SELECT count(*) AS total, 2 AS page, 20 AS per_page, CAST(greatest(least(count(*) - 20, 20), 0) AS BIGINT) AS items, 20 + greatest(least(count(*) - 20, 20), 0) < count(*) AS has_more FROM documents WHERE lang = 'en'",
    "owner_filter": "WITH r AS (SELECT DISTINCT * FROM repositories) SELECT user_id, count(*) AS listed, count(*) + (SELECT count(*) FROM r WHERE user_id IS NULL) AS readable FROM r WHERE user_id IS NOT NULL GROUP BY 1",
    "ready_repositories": "SELECT id, status FROM (SELECT DISTINCT * FROM repositories) WHERE status = 'ready'",
    "conversation_counts": f"WITH {_M}, c AS (SELECT DISTINCT id FROM conversations) SELECT c.id AS conversation_id, count(m.id) AS n, max(m.id) AS greatest FROM c LEFT JOIN m ON m.conversation_id = c.id GROUP BY 1",
    "cascade_delete": f"""WITH {_M}, r AS (SELECT DISTINCT * FROM repositories), c AS (SELECT DISTINCT * FROM conversations), g AS (SELECT id FROM r WHERE status = 'failed'), gc AS (SELECT id FROM c WHERE repo_id IN (SELECT id FROM g))
        SELECT 'repositories' AS name, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = r.id) UNION ALL SELECT 'conversations', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = c.repo_id) UNION ALL SELECT 'messages', count(*) FROM m WHERE NOT EXISTS (SELECT 1 FROM gc WHERE gc.id = m.conversation_id)""",
    "titles": f"SELECT id, substr(title, 1, 100) AS chat, 'Agent: ' || substr(title, 1, 80) AS task, nullif(substr({q.strip('title')}, 1, 512), '') AS renamed FROM (SELECT DISTINCT * FROM conversations)",
    "fact_set": "SELECT DISTINCT repo_id, fact FROM facts WHERE fact IS NOT NULL AND repo_id IS NOT NULL",
    "facts_text": "WITH f AS (SELECT DISTINCT repo_id, fact FROM facts WHERE fact IS NOT NULL AND repo_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fact) AS n FROM f) SELECT repo_id, string_agg('- ' || fact, chr(10) ORDER BY fact) AS text FROM r WHERE n <= 10 GROUP BY 1",
    "role_mapping": f"WITH {_M} SELECT CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'ai' ELSE 'human' END AS class, count(*) AS n FROM m GROUP BY 1",
    "tool_gate": f"WITH {_M} SELECT {_PHRASES} AS asks, count(*) AS n FROM m WHERE content IS NOT NULL GROUP BY 1",
    "message_sources": f"WITH {_M} SELECT id, first FROM (SELECT id, json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.sources[0].file_path') AS first FROM m WHERE metadata_json IS NOT NULL) WHERE first IS NOT NULL",
    "plan_parse": f"""WITH {_M}, r AS ({_REPLY}) SELECT run_id, CASE WHEN k < 2 THEN 'read ' || n ELSE 'Search the codebase for relevant code' END AS first_step, CASE WHEN k < 2 THEN 2 ELSE 3 END AS steps,
        k < 2 AND n % 2 = 0 AS needs_tools, CASE WHEN k < 2 THEN '' ELSE 'Fallback plan due to parsing failure.' END AS reasoning FROM r""",
    "agent_events": f"""WITH {_M}, r AS ({_REPLY}), s AS (SELECT run_id, CASE WHEN k < 2 AND n % 2 = 0 THEN ['metadata', 'planner', 'retrieval', 'tool_agent', 'executor', 'done'] ELSE ['metadata', 'planner', 'retrieval', 'executor', 'done'] END AS e FROM r),
        u AS (SELECT run_id, e, unnest(generate_series(1, len(e))) AS i FROM s) SELECT run_id, CAST(i - 1 AS INTEGER) AS seq, CASE WHEN e[i] IN ('metadata', 'done') THEN e[i] WHEN e[i] = 'executor' THEN 'final_answer' ELSE 'agent_step' END AS type, CASE WHEN e[i] NOT IN ('metadata', 'done') THEN e[i] END AS agent FROM u""",
    "chat_events": f"""WITH {_M}, w AS (SELECT conversation_id, len(string_split(content, ' ')) AS k FROM m WHERE role = 'assistant' AND content IS NOT NULL AND conversation_id IS NOT NULL)
        SELECT conversation_id, 'metadata' AS type, count(*) AS n, CAST(0 AS BIGINT) AS seqs FROM w GROUP BY 1 UNION ALL SELECT conversation_id, 'content', CAST(sum(k) AS BIGINT), CAST(sum(k * (k + 1) // 2) AS BIGINT) FROM w GROUP BY 1 UNION ALL SELECT conversation_id, 'done', count(*), CAST(sum(k + 1) AS BIGINT) FROM w GROUP BY 1""",
    "step_log": f"""WITH {_M}, r AS ({_REPLY}) SELECT run_id, '{{"length":' || n || ',"ok":true}}' AS j FROM r""",
    "query_texts": f"WITH {_M} SELECT id, substr(sha256('{text.QUERY_PREFIX}' || content), 1, 16) AS digest FROM m WHERE role = 'user' AND content IS NOT NULL",
    "answer_html": "WITH " + _M + ", h AS (SELECT id, " + _HTML + " AS t FROM m WHERE role = 'assistant' AND content IS NOT NULL) SELECT id, substr(sha256('<p>' || t || '</p>'), 1, 16) AS digest FROM h",
    "memory_bundles": f"""WITH {_M}, t AS (SELECT conversation_id, least(count(*), 20) AS turns FROM m WHERE conversation_id IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT repo_id, fact FROM facts WHERE fact IS NOT NULL AND repo_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fact) AS n FROM f), k AS (SELECT repo_id, count(*) AS facts, string_agg(fact, '|' ORDER BY fact) AS joined FROM r WHERE n <= 10 GROUP BY 1), c AS (SELECT DISTINCT id, repo_id FROM conversations)
        SELECT c.id AS conversation_id, CAST(coalesce(turns, 0) AS INTEGER) AS turns, CAST(coalesce(facts, 0) AS INTEGER) AS facts, coalesce(joined, '') AS joined FROM c LEFT JOIN t ON t.conversation_id = c.id LEFT JOIN k ON k.repo_id = c.repo_id""",
    "top_files": f"WITH {_HITS}, d AS (SELECT DISTINCT qid, file_path FROM h WHERE rank <= 5) SELECT qid, string_agg(file_path, '|' ORDER BY file_path) AS files FROM d GROUP BY 1",
    "executor_prompts": f"""WITH {_M}, r AS ({_REPLY}) SELECT run_id, substr(sha256('## User Question' || chr(10) || chr(10) || content || chr(10) || chr(10) || chr(10) || '## Execution Plan' || chr(10) || chr(10) ||
        CASE WHEN k < 2 THEN '1. read ' || n || chr(10) || '2. answer' ELSE '1. Search the codebase for relevant code' || chr(10) || '2. Analyze the retrieved code' || chr(10) || '3. Generate a comprehensive response' END || chr(10) || chr(10) || chr(10) ||
        CASE WHEN k < 2 THEN '' ELSE chr(10) || '## Initial Analysis' || chr(10) || chr(10) || 'Fallback plan due to parsing failure.' || chr(10) || chr(10) END), 1, 16) AS digest FROM r""",
    "best_scores": """WITH h AS (SELECT q.vec_id AS qid, 1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) AS dist
        FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) SELECT qid, round(greatest(0.0, 1 - min(dist)), 6) AS best FROM h GROUP BY 1""",
}
