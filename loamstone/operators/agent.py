"""Agent runs as rows: a run is a struct that passes through static stages; the model is a function with a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamstone.config import SETTINGS
from loamstone.functions.text import asks_for_more, truncated

#: Plans where a reply lacks one, and where it can't be read; and the step where a plan is too short.
DEFAULT_PLAN = ("Search codebase", "Analyze results", "Respond")
FALLBACK_PLAN = ("Search the codebase for relevant code", "Analyze the retrieved code", "Generate a comprehensive response")
FALLBACK_REASON = "Fallback plan due to parsing failure."
DEFAULT_STEP = "Analyze the retrieved context"

Generator = Callable[[list[str]], list[str]]


def echo_generator(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a language model: it tells what it was asked, no more."""
    return [f"Answer to: {p.strip().splitlines()[-1] if p and p.strip() else ''}" for p in prompts]


def generate(rows: DataFrame, prompt: str, generator: Generator = echo_generator, out: str = "answer") -> DataFrame:
    """Adds the generator's texts, called with an Arrow batch of prompts at a time."""
    at = rows.columns.index(prompt)
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(generator([p or "" for p in b.column(at).to_pylist()]), pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def unfenced(reply: Column) -> Column:
    """A reply without the fence around it, and without the word json that may open it."""
    bare = F.regexp_replace(reply, r"(?U)^\s+|\s+\z", "")
    inner = F.regexp_replace(F.regexp_replace(F.element_at(F.split(bare, "```"), 2), "^json", ""), r"(?U)^\s+|\s+\z", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def parse_plan(reply: Column) -> Column:
    """struct<plan, needs_tools, reasoning> of a model's reply. Fields that are absent take defaults; what is no JSON object takes the fallback."""
    text = unfenced(reply)
    parsed = F.from_json(text, "plan array<string>, needs_tools boolean, reasoning string")
    valid = F.coalesce(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.lit(False))
    array = lambda xs: F.array(*map(F.lit, xs))
    return F.struct(
        F.when(valid, F.coalesce(parsed["plan"], array(DEFAULT_PLAN))).otherwise(array(FALLBACK_PLAN)).alias("plan"),
        F.when(valid, F.coalesce(parsed["needs_tools"], F.lit(False))).otherwise(False).alias("needs_tools"),
        F.when(valid, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise(FALLBACK_REASON).alias("reasoning"),
    )


def route(needs_tools: Column) -> Column:
    """The stages of a run, in order."""
    return F.when(needs_tools, F.array(*map(F.lit, ("planner", "retrieval", "tool_agent", "executor")))).otherwise(F.array(*map(F.lit, ("planner", "retrieval", "executor"))))


def plan_step(plan: Column, at: Column) -> Column:
    """The step of a plan at a place from 0, or a default behind its end."""
    return F.coalesce(F.try_element_at(plan, at + 1), F.lit(DEFAULT_STEP))


def message_class(role: Column) -> Column:
    """system, ai or human; whatever is unknown is human."""
    return F.when(role == "system", "system").when(role == "assistant", "ai").otherwise("human")


def step_text(step: Column, keys: list[str]) -> Column:
    """A step as JSON, without the name of its agent."""
    return F.to_json(F.struct(*(step[k].alias(k) for k in keys if k != "agent")))


def numbered_plan(plan: Column) -> Column:
    return F.array_join(F.transform(plan, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def top_files(paths: Column) -> Column:
    """Different paths among the first few, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.slice(paths, 1, SETTINGS.sources)))


def executor_prompt(query: Column, plan: Column, context: Column, analysis: Column, tools: Column) -> Column:
    """The sections of the last prompt; those without content are left out."""
    section = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n\n"), text, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("## User Question\n\n"), query, F.lit("\n\n\n## Execution Plan\n\n"), numbered_plan(plan), F.lit("\n\n"), section("Retrieved Code", context), F.lit("\n"), section("Initial Analysis", analysis), section("Tool Investigation Results", tools))


def call_tools(calls: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """run_id, tool, args, result of calls (run_id, tool, args): each tool is a function of its calls that returns (run_id, args, result). Unknown tools are ignored, results are cut."""
    out = None
    for name, tool in sorted(tools.items()):
        part = tool(calls.filter(F.col("tool") == name).select("run_id", "args")).select("run_id", F.lit(name).alias("tool"), "args", truncated(F.col("result"), SETTINGS.tool_result_chars).alias("result"))
        out = part if out is None else out.unionByName(part)
    return calls.sparkSession.createDataFrame([], "run_id string, tool string, args string, result string") if out is None else out


def run_agents(runs: DataFrame, hits: DataFrame, generator: Generator = echo_generator, tool_gate: bool = True) -> DataFrame:
    """run_id, plan, needs_tools, stages, top_files, tool_analysis, wants_tools, final_answer, current_step, steps_log of runs (run_id, user_query, plan_reply).

    hits: run_id, rank, file_path, start_line, end_line, relevance_score; at most k a run. tool_gate: tools are asked for only by a run
    without context. All steps are logged, one JSON text each.
    """
    planned = runs.withColumn("_p", parse_plan(F.col("plan_reply"))).select("run_id", "user_query", "_p.plan", "_p.needs_tools", "_p.reasoning")
    found = hits.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "start_line", "end_line", "relevance_score"))).alias("_c"))
    state = planned.join(found, "run_id", "left").withColumn("_paths", F.coalesce(F.transform("_c", lambda x: x["file_path"]), F.array().cast("array<string>")))
    context = F.array_join(F.transform(F.slice(F.coalesce("_c", F.array().cast("array<struct<rank: int, file_path: string, start_line: int, end_line: int, relevance_score: double>>")), 1, SETTINGS.tool_context), lambda x: F.concat(x["file_path"], F.lit(":"), x["start_line"].cast("string"))), "\n")
    state = state.withColumn("_context", context).withColumn("_tool_prompt", F.concat_ws("\n", "_context", plan_step(F.col("plan"), F.lit(1))))
    state = generate(state, "_tool_prompt", generator, "_analysis")
    state = state.withColumn("tool_analysis", F.when(F.col("needs_tools"), F.col("_analysis")).otherwise(""))
    wants = F.col("needs_tools") & asks_for_more(F.col("tool_analysis"))
    state = state.withColumn("wants_tools", wants & (F.col("_context") == "") if tool_gate else wants)
    state = state.withColumn("_last_prompt", executor_prompt(F.col("user_query"), F.col("plan"), F.col("_context"), F.col("tool_analysis"), F.lit("")))
    state = generate(state, "_last_prompt", generator, "final_answer")
    log = F.array_compact(
        F.array(
            F.to_json(F.struct("plan", "needs_tools", "reasoning")),
            F.to_json(F.struct(F.size("_paths").alias("chunks_found"), top_files(F.col("_paths")).alias("top_files"))),
            F.when(F.col("needs_tools"), F.to_json(F.struct(truncated(F.col("tool_analysis"), SETTINGS.analysis_chars).alias("analysis")))),
            F.to_json(F.struct(F.length("final_answer").alias("answer_length"))),
        )
    )
    return state.select("run_id", "plan", "needs_tools", route(F.col("needs_tools")).alias("stages"), top_files(F.col("_paths")).alias("top_files"), "tool_analysis", "wants_tools", "final_answer", F.when(F.col("needs_tools"), 2).otherwise(1).alias("current_step"), log.alias("steps_log"))
