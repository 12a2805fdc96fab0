import json
import time

from pyspark.sql import functions as F

from loamstone.streaming import state


def drain(query, seconds=90):
    query.processAllAvailable()
    end = time.time() + seconds
    while query.isActive and query.status["isDataAvailable"] and time.time() < end:
        time.sleep(0.2)
    query.stop()


def test_sse_lines_in_a_stream(spark, tmp_path):
    lines = ["data: " + json.dumps({"type": "content", "content": "a"}), ": ping", "data: {bad", "data: [1]", "", "data: " + json.dumps({"type": "done"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(lines))
    stream = state.parse_sse(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sse").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted(r.type for r in spark.table("sse").collect()) == ["content", "done"]
    batch = state.parse_sse(spark.read.text(str(tmp_path / "in")))
    assert sorted(r.type for r in batch.collect()) == ["content", "done"] and state.known_events(batch).count() == 2


def test_reassembly(spark):
    rows = spark.createDataFrame([("s", 2, "b\nc"), ("s", 1, "a"), ("s", 3, "d\n"), ("s", 4, "open")], "stream_id string, seq int, text string")
    assert sorted(r.line for r in state.reassemble(rows).collect()) == ["ab", "cd"]


def test_rate_limit_stream_is_batch(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:01'), ('a', TIMESTAMP'2024-01-01 00:00:30'), ('a', TIMESTAMP'2024-01-01 00:01:01'), ('b', TIMESTAMP'2024-01-01 00:00:05') AS t(client, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in state.rate_limited(rows, "client", "ts", "1 minute", 1).collect()}
    stream = state.rate_limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "client", "ts", "1 minute", 1, "10 minutes")
    q = stream.writeStream.format("memory").queryName("limits").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert {tuple(r) for r in spark.table("limits").collect()} == batch and len(batch) == 1


def test_latest_phase_stream_is_batch(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('r', 'clone', TIMESTAMP'2024-01-01 00:00:01', 1), ('r', 'parse', TIMESTAMP'2024-01-01 00:00:01', 2), ('s', 'failed', TIMESTAMP'2024-01-01 00:00:09', 3) AS t(repo_id, phase, ts, event_id)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = state.latest_phase(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("phases").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted(map(tuple, spark.table("phases").collect())) == [("r", "parse"), ("s", "failed")] == sorted(map(tuple, state.latest_phase(rows).collect()))


def test_memory_expires_and_writes_renew(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda n, rows: (folder / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": v, "t": t}) for k, v, t in rows))
    put(1, [("a", "1", "2024-01-01T00:00:00Z"), ("b", "1", "2024-01-01T00:00:00Z")])
    stream = state.remember(spark.readStream.schema("k string, v string, t timestamp").option("maxFilesPerTrigger", 1).json(str(folder)), "k", "v", "t", ttl_s=60, late="1 second")
    q = stream.writeStream.format("memory").queryName("memory").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    put(2, [("a", "2", "2024-01-01T00:00:50Z")])
    q.processAllAvailable()
    put(3, [("z", "1", "2024-01-01T00:01:30Z")])
    q.processAllAvailable()
    put(4, [("z", "2", "2024-01-01T00:01:31Z")])
    drain(q)
    got = [(r.key, r.value, r.expired) for r in spark.table("memory").collect()]
    assert ("b", "1", True) in got and ("a", "2", False) in got and ("a", "1", True) not in got


def test_events_of_answers_and_runs(spark):
    a = spark.createDataFrame([("c", ["x", "y"])], "conversation_id string, pieces array<string>")
    got = [(r.seq, r.type) for r in state.chat_events(a).orderBy("seq").collect()]
    assert got == [(0, "metadata"), (1, "content"), (2, "content"), (3, "done")]
    r = spark.createDataFrame([("r", ["planner", "executor"])], "run_id string, stages array<string>")
    assert [(x.type, x.agent) for x in state.agent_events(r).orderBy("seq").collect()] == [("metadata", None), ("agent_step", "planner"), ("final_answer", "executor"), ("done", None)]


def test_batches_can_be_written_again(spark, tmp_path):
    write = state.batch_folders(str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("id")).first()[0] == 3
