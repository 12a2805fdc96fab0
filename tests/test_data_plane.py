import pytest
from pyspark.sql import functions as F

from loamstone.operators import agent, context, embedding, history, tools
from loamstone.operators.ann import ann_topk
from loamstone.operators.topk import topk_expr, topk_matrix
from loamstone.sources import files as source_files
from loamstone.sources import stores

CHUNK = "chunk_id string, repo_id string, file_path string, language string, content string, start_line int, end_line int, chunk_type string, name string"


def chunks(spark, n=6):
    return spark.createDataFrame([(f"c{i}", "r", f"f{i}.py", "python", f"body {i}", 1, 2, "block", None if i % 2 else "n") for i in range(n)], CHUNK)


def test_cache_cold_warm_and_empty(spark):
    empty = spark.createDataFrame([], "repo_id string, content_hash string, embedding array<float>")
    done, cache = embedding.embed_chunks(chunks(spark), empty, embedding.HashEmbedder(8))
    assert done.filter("embedding IS NULL").count() == 0 and cache.count() == 6
    cache = cache.cache()
    hashed = embedding.with_hash(chunks(spark))
    assert embedding.cache_misses(hashed, cache).count() == 0
    assert tuple(embedding.hit_rate(embedding.cache_lookup(hashed, cache)).first()) == (6, 6, 100.0)
    fewer = embedding.with_hash(chunks(spark, 2))
    assert embedding.cache_prune(cache, fewer).count() == 2
    none = chunks(spark, 0)
    assert tuple(embedding.hit_rate(embedding.cache_lookup(embedding.with_hash(none), cache)).first()) == (0, 0, 0.0)


def test_hash_follows_place_unless_body_only(spark):
    moved = chunks(spark, 1).withColumn("start_line", F.lit(5))
    both = chunks(spark, 1).unionAll(moved)
    assert embedding.with_hash(both).select("content_hash").distinct().count() == 2
    assert embedding.with_hash(both, body_only=True).select("content_hash").distinct().count() == 1


def test_retries():
    waits, calls = [], []

    def service(texts):
        calls.append(1)
        if len(calls) == 1:
            raise embedding.Busy(500)
        if len(calls) == 2:
            raise TimeoutError
        return [[1.0]] * len(texts)

    assert embedding.with_retries(service, sleep=waits.append)(["a"]) == [[1.0]]
    assert waits == [60.0, 10.0]
    with pytest.raises(embedding.Busy):
        embedding.with_retries(lambda t: (_ for _ in ()).throw(embedding.Busy()), attempts=2, sleep=lambda s: None)(["a"])


def test_budget_stops_and_does_not_skip(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, 6), ("q", 3, 1), ("p", 1, None)], "k string, o int, tokens int")
    kept = lambda b: sorted((r.k, r.o) for r in context.within_budget(rows, ["k"], ["o"], budget=b).collect())
    assert kept(10) == [("p", 1), ("q", 1)]
    assert kept(11) == [("p", 1), ("q", 1), ("q", 2)]
    assert kept(4) == [("p", 1)]


def test_prompt_messages(spark):
    turns = [("user", str(i)) for i in range(30)]
    df = spark.createDataFrame([(turns, "q")], "h array<struct<role: string, content: string>>, q string")
    m = df.select(context.prompt_messages(F.col("h"), F.col("q"), "s").alias("m")).first().m
    assert [x.content for x in m] == ["s", *map(str, range(10, 30)), "q"]
    short = spark.createDataFrame([([("user", "a")], "q")], "h array<struct<role: string, content: string>>, q string")
    assert len(short.select(context.prompt_messages(F.col("h"), F.col("q")).alias("m")).first().m) == 3
    assert context.user_content(F.lit("q"), F.lit("c"), F.lit("a")) is not None


def test_last_n_and_pages(spark):
    rows = spark.createDataFrame([("c", "b", 1), ("c", "a", 1), ("c", "d", 3), ("e", "x", None)], "conversation_id string, id string, created_at int")
    got = sorted((r.conversation_id, r.turn, r.id) for r in history.last_n(rows, 2).collect())
    assert got == [("c", 1, "b"), ("c", 2, "d"), ("e", 1, "x")]
    many = spark.range(45)
    seen = [r.id for n in (1, 2, 3) for r in history.page(many, [F.col("id")], n, 20).collect()]
    assert seen == list(range(45))
    assert tuple(history.page_envelope(many, 3, 20).first()) == (45, 3, 20, 5, False)
    assert tuple(history.page_envelope(many, 2, 20).first()) == (45, 2, 20, 20, True)
    with pytest.raises(ValueError):
        history.page(many, [F.col("id")], 0)


def test_owners_and_memory(spark):
    r = spark.createDataFrame([(1, "u"), (2, None), (3, "v")], "id int, user_id string")
    assert sorted(x.id for x in r.filter(history.visible_to("u")).collect()) == [1, 2]
    assert [x.id for x in r.filter(history.owned_by("u")).collect()] == [1]
    w = spark.sql("SELECT * FROM VALUES ('r','k','old',TIMESTAMP'2024-01-01 00:00:00'), ('r','k','new',TIMESTAMP'2024-01-01 12:00:00'), ('r','z','gone',TIMESTAMP'2023-12-30 00:00:00') AS t(repo_id, key, value, written_at)")
    got = history.alive(w, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert [(x.key, x.value) for x in got] == [("k", "new")]


def test_tokens_hold_until_they_expire(spark):
    rows = [("a", "a", 5), ("a", "a", 4), ("a", "a", None), ("a", "b", 9), (None, None, 9), ("a", None, None)]
    df = spark.createDataFrame(rows, "given string, stored string, expires int")
    got = df.select(history.holds(F.col("given"), F.col("stored"), F.col("expires"), F.lit(5)).alias("h")).collect()
    assert [r.h for r in got] == [True, False, True, False, False, False]


def test_linked_account(spark):
    users = spark.createDataFrame([("1", "a@x.test", "gh", "7"), ("2", "b@x.test", None, None)], "id string, email string, oauth_provider string, oauth_id string")
    logins = spark.createDataFrame([(1, "z@x.test", "gh", "7"), (2, "b@x.test", "gh", "9"), (3, "n@x.test", "gh", "1")], "login_id int, email string, oauth_provider string, oauth_id string")
    assert sorted((r.login_id, r.user_id) for r in history.linked_account(users, logins).collect()) == [(1, "1"), (2, "2"), (3, None)]


def test_tools(spark):
    text = "\n".join(["# x"] * 5 + ["class Foo(Bar):", "    def go(self):", "        pass"])
    f = spark.createDataFrame([("r", "a/b.py", text), ("r", "node_modules/c.py", text), ("r", "t.md", text)], "repo_id string, file_path string, content string")
    got = tools.find_definitions(f, " Foo ").collect()
    assert [(r.file_path, r.line_no) for r in got] == [("a/b.py", 6)] and got[0].snippet.startswith("    4 | # x") and got[0].snippet.endswith("        pass")
    with pytest.raises(ValueError):
        tools.find_definitions(f, " ")
    p = spark.createDataFrame([("r", x) for x in ("b/x.py", "b/c/y.py", "a.md", ".git/z", "C/w")], "repo_id string, path string")
    listed = [(r.name, r.type) for r in tools.directory_entries(p).orderBy("place").collect()]
    assert listed == [("b", "directory"), ("C", "directory"), ("a.md", "file")]
    drawn = tools.tree_text(tools.tree_nodes(p)).first().text
    assert drawn.split("\n") == ["📁 .", "├── 📁 b/", "│   ├── 📁 c/", "│   │   └── 📄 y.py", "│   └── 📄 x.py", "├── 📁 C/", "│   └── 📄 w", "└── 📄 a.md"]
    t = spark.createDataFrame([("1", "go.mod"), ("1", "package.json"), ("2", "a/setup.py"), ("3", "setup.py")], "repo_id string, path string")
    assert sorted((r.repo_id, r.command) for r in tools.test_command(t).collect()) == [("1", "npm test"), ("2", None), ("3", "python -m pytest --tb=short -q")]


def test_plans(spark):
    replies = ['{"plan": ["a"], "needs_tools": true}', '```json\n{"plan": ["b"]}\n```', "no json", "[1]", '{"needs_tools": null}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, r string")
    got = [r.p for r in df.orderBy("i").select(agent.parse_plan(F.col("r")).alias("p")).collect()]
    assert [list(p.plan) for p in got] == [["a"], ["b"], list(agent.FALLBACK_PLAN), list(agent.FALLBACK_PLAN), list(agent.DEFAULT_PLAN)]
    assert [p.needs_tools for p in got] == [True, False, False, False, False]
    step = df.limit(1).select(agent.plan_step(F.array(F.lit("x")), F.lit(0)), agent.plan_step(F.array(F.lit("x")), F.lit(1))).first()
    assert tuple(step) == ("x", agent.DEFAULT_STEP)


def test_agent_runs_log_every_step(spark):
    runs = spark.createDataFrame([("a", "why?", '{"plan": ["s"], "needs_tools": true}'), ("b", "how?", "none")], "run_id string, user_query string, plan_reply string")
    hits = spark.createDataFrame([("a", 1, "f", 1, 2, 0.5)], "run_id string, rank int, file_path string, start_line int, end_line int, relevance_score double")
    got = {r.run_id: r for r in agent.run_agents(runs, hits).collect()}
    assert len(got["a"].steps_log) == 4 and len(got["b"].steps_log) == 3
    assert list(got["b"].stages) == ["planner", "retrieval", "executor"] and got["a"].current_step == 2


def test_call_tools(spark):
    calls = spark.createDataFrame([("a", "echo", "x"), ("a", "nope", "y")], "run_id string, tool string, args string")
    got = agent.call_tools(calls, {"echo": lambda c: c.withColumn("result", F.repeat("args", 5000))}).collect()
    assert [(r.tool, len(r.result)) for r in got] == [("echo", 4000)]


def vectors(spark, n=400, dim=16):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(n, dim)) + 3 * rng.normal(size=(8, dim))[rng.integers(0, 8, n)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")


def test_topk_forms_agree_and_index_recalls(spark):
    v = vectors(spark).unionAll(spark.createDataFrame([(1000, None), (1001, [0.0] * 16), (1002, [1.0])], "vec_id long, embedding array<float>"))
    q = v.filter("vec_id % 50 = 0 AND vec_id < 1000").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r.qid, r.vec_id) for r in topk_expr(q, v, 5).collect()}
    assert {(r.qid, r.vec_id) for r in topk_matrix(q, v, 5).collect()} == exact
    assert {(r.qid, r.vec_id) for r in topk_matrix(q, v, 5, max_query_bytes=256).collect()} == exact
    found = {(r.qid, r.vec_id) for r in ann_topk(q, v, 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    none = v.limit(0)
    assert topk_expr(q, none).count() == topk_matrix(q, none).count() == ann_topk(q, none).count() == 0
    assert topk_matrix(q.limit(0), v).count() == 0


def test_stores(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert stores.load_cache(spark, path).count() == 0
    c = spark.createDataFrame([("r", "h1", [1.0]), ("s", "h2", [2.0])], "repo_id string, content_hash string, embedding array<float>")
    assert stores.save_cache(c, path) == 2
    assert stores.save_cache(c.filter("repo_id = 'r'").unionAll(spark.createDataFrame([("r", "h3", [3.0])], c.schema)), path) == 2
    assert sorted(r.content_hash for r in stores.load_cache(spark, path).collect()) == ["h1", "h2", "h3"]
    assert stores.drop_partition(spark, path, "r") and not stores.drop_partition(spark, path, "r")
    assert [r.repo_id for r in stores.load_cache(spark, path).collect()] == ["s"]
    with pytest.raises(ValueError):
        stores.drop_partition(spark, path, "../x")
    v = chunks(spark, 3).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert stores.load_vectors(spark, str(tmp_path / "v")).count() == 0
    assert stores.store_vectors(v, str(tmp_path / "v")) == 3 and stores.store_vectors(v.limit(2), str(tmp_path / "v")) == 2
    assert stores.load_vectors(spark, str(tmp_path / "v"), "r").count() == 2
    stores.append(v.select("chunk_id"), str(tmp_path / "ids"))
    stores.append(v.select("chunk_id"), str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 6
    stores.create_tables(spark, str(tmp_path / "db"))
    stores.create_tables(spark, str(tmp_path / "db"))
    assert stores.read_table(spark, str(tmp_path / "db"), "messages").count() == 0


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "k int, name string")
    for part in (rows.filter("k < 25"), rows.filter("k >= 25")):
        stores.write_jdbc(part, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = stores.read_jdbc(spark, url, "things", "K", 4, 0, 40, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"n{i}") for i in range(40)]
    pushed = got.filter("K < 3")._jdf.queryExecution().executedPlan().toString()
    assert "*LessThan(k,3)" in pushed


def test_scan_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("\n".join("12345"))
    (tmp_path / "src" / "short.py").write_text("x")
    (tmp_path / "src" / "b.bin").write_bytes(b"\xff" * 10)
    (tmp_path / "src" / "big.py").write_text("x\n" * 60_000)
    got = source_files.parsed_files(source_files.scan_files(spark, str(tmp_path))).collect()
    assert [(r.relative_path, r.language, r.line_count) for r in got] == [("src/a.py", "python", 5)]
    counts = {r.reason: r.n for r in source_files.scan_counts(source_files.scan_files(spark, str(tmp_path))).collect()}
    assert counts == {"read": 1, "lines": 1, "extension": 1}


def test_materialized_tables(spark):
    from loamstone.session import drop_materialized, materialize

    df = materialize(spark.range(5).withColumn("k", F.col("id") % 2))
    assert df.count() == 5 and df.inputFiles()
    assert materialize(df.limit(0)).count() == 0
    assert drop_materialized(spark) >= 2 and drop_materialized(spark) == 0


def test_constraints(spark):
    from loamstone.operators import checks

    rows = spark.createDataFrame([("0123456789abcdef", 1, 2, "block", "x"), ("x", 0, 2, "other", ""), (None, None, None, None, None)], "chunk_id string, start_line int, end_line int, chunk_type string, content string")
    assert {r.rule: r.n for r in checks.violations(rows, "chunks").collect()} == {"id": 2, "lines": 2, "type": 2, "content": 2}
    assert checks.sound(rows, "chunks").count() == 1
    assert checks.dangling(rows, "chunk_id", rows.filter("chunk_id = 'x'"), "chunk_id").count() == 1
