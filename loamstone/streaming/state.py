"""Streams of events: lines of server-sent events, phases of ingestion, memory with a lifetime, limits of requests.

Each has a batch form over the same rows; results are equal once a stream has seen them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamstone.config import SETTINGS

#: Kinds of events, and the mark of a line of server-sent events that carries data.
EVENT_TYPES = ("metadata", "content", "done", "agent_step", "final_answer", "error")
DATA_MARK = "data: "


def parse_sse(lines: DataFrame, line: str = "value") -> DataFrame:
    """type, payload of the lines that carry JSON objects; others are ignored. Batch and stream."""
    body = F.substring(F.col(line), len(DATA_MARK) + 1, 1 << 30)
    data = lines.filter(F.col(line).startswith(DATA_MARK)).withColumn("payload", body)
    good = data.filter(F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{"))
    return good.withColumn("type", F.get_json_object("payload", "$.type"))


def known_events(events: DataFrame) -> DataFrame:
    """Events of the known kinds."""
    return events.filter(F.col("type").isin(*EVENT_TYPES))


def reassemble(fragments: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "text") -> DataFrame:
    """key, line of text that arrived in fragments: joined in order, cut at line feeds. What follows the last one isn't finished and is left out. One answer's fragments are one group."""
    joined = fragments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "").alias("_text"))
    split = F.split("_text", "\n", -1)
    return joined.select(key, F.posexplode(F.slice(split, 1, F.size(split) - 1)).alias("at", "line"))


def chat_events(answers: DataFrame, pieces: str = "pieces") -> DataFrame:
    """key, seq, type, payload of each answer: metadata, its contents, done."""
    metadata = F.struct(F.lit("metadata").alias("type"), F.to_json(F.struct(F.lit("metadata").alias("type"), "conversation_id")).alias("payload"))
    contents = F.transform(pieces, lambda p: F.struct(F.lit("content").alias("type"), F.to_json(F.struct(F.lit("content").alias("type"), p.alias("content"))).alias("payload")))
    done = F.struct(F.lit("done").alias("type"), F.lit('{"type":"done","message_id":"saved"}').alias("payload"))
    return answers.select("conversation_id", F.posexplode(F.concat(F.array(metadata), contents, F.array(done))).alias("seq", "e")).select("conversation_id", "seq", "e.type", "e.payload")


def agent_events(runs: DataFrame) -> DataFrame:
    """run_id, seq, type, agent of each run: metadata, a step for each stage, the last of which is the answer, done."""
    steps = F.transform("stages", lambda s: F.struct(F.when(s == "executor", "final_answer").otherwise("agent_step").alias("type"), s.alias("agent")))
    edge = lambda t: F.array(F.struct(F.lit(t).alias("type"), F.lit(None).cast("string").alias("agent")))
    return runs.select("run_id", F.posexplode(F.concat(edge("metadata"), steps, edge("done"))).alias("seq", "e")).select("run_id", "seq", "e.type", "e.agent")


def latest_phase(events: DataFrame, key: str = "repo_id", phase: str = "phase", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, phase: the last phase of each. In a stream, use it with output mode complete or update."""
    return events.groupBy(key).agg(F.max_by(phase, F.struct(at, tie)).alias(phase))


def rate_limited(hits: DataFrame, client: str, at: str, window: str = "1 minute", most: int = 5, late: str | None = None) -> DataFrame:
    """client, window_start, n of the windows in which a client came more often than allowed. at must be a timestamp with a zone in a stream; late is how long rows may come late there."""
    timed = hits.withWatermark(at, late) if late else hits
    counted = timed.groupBy(F.window(at, window), client).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > most).select(client, F.col("window.start").alias("window_start"), "n")


def remember(writes: DataFrame, key: str, value: str, at: str, ttl_s: int = SETTINGS.memory_ttl_s, late: str = "10 minutes") -> DataFrame:
    """A stream of key, value, written_at, expired: each write as it comes, and the last one again when its lifetime is over by the watermark. A later write starts the lifetime again; an earlier one that comes late is ignored."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, ms = state.get
            state.remove()
            yield pd.DataFrame({"key": [group[0]], "value": [last], "written_at": [pd.Timestamp(ms, unit="ms", tz="UTC")], "expired": [True]})
            return
        last, newest = state.get if state.exists else (None, -1)
        fresh = []
        for frame in frames:
            for v, t in frame.sort_values("at")[["value", "at"]].itertuples(index=False):
                ms = int(pd.Timestamp(t).value // 1_000_000)
                if ms >= newest:
                    last, newest = v, ms
                    fresh.append((v, ms))
        state.update((last, newest))
        state.setTimeoutTimestamp(max(newest + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [group[0]] * len(fresh), "value": [v for v, _ in fresh], "written_at": pd.to_datetime([m for _, m in fresh], unit="ms", utc=True), "expired": [False] * len(fresh)})

    keyed = writes.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, value string, written_at timestamp, expired boolean", "value string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def batch_folders(target: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch that keeps one folder for each micro-batch, so that a batch that is tried again writes over what it wrote before."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch:010d}")

    return write
