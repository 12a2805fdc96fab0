"""Prompts from retrieved chunks: blocks, a budget of tokens, histories and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.text import token_estimate

#: Headings of the parts of a prompt.
CONTEXT_HEADER = "\n\n## Retrieved Code Context\n\n"
QUESTION_HEADER = "\n\n## User Question\n\n"
ADDITIONAL_HEADER = "\n\n## Additional Context\n\n"
#: The instructions that open a prompt; any text will do.
SYSTEM_PROMPT = "You answer questions about a code base. Use the code in the context, name the files and lines you rely on, and say so if the context doesn't suffice."


def chunk_block(c: Column | None = None) -> Column:
    """A chunk as a block of a prompt, with its relevance to four places."""
    col = (lambda n: c[n]) if c is not None else F.col
    name = F.when(F.coalesce(col("name"), F.lit("")) != "", F.concat(F.lit(" — "), col("name"))).otherwise("")
    return F.concat(
        F.lit("### "), col("file_path"), F.lit(" (L"), col("start_line").cast("string"), F.lit("–L"), col("end_line").cast("string"), F.lit(") ["), col("chunk_type"), F.lit("]"), name,
        F.lit("\n```"), col("language"), F.lit("\n"), col("content"), F.lit("\n```\nRelevance: "), F.format_string("%.4f", col("relevance_score")), F.lit("\n\n"),
    )


def result_block(rank: Column) -> Column:
    """A hit of the search tool, with its rank from 1 and its relevance in percent."""
    name = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("name"), F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("### Result "), rank.cast("string"), F.lit(": "), F.col("file_path"), name, F.lit("\nLines "), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.lit(" | "), F.col("chunk_type"),
        F.lit(" | Relevance: "), F.format_string("%.2f", F.col("relevance_score") * 100), F.lit("%\n```"), F.col("language"), F.lit("\n"), F.col("content"), F.lit("\n```\n"),
    )


def within_budget(rows: DataFrame, key: list[str], order: list[str], tokens: str = "tokens", budget: int = SETTINGS.context_tokens) -> DataFrame:
    """The rows of each key, in order, up to the first that would exceed the budget, and used, the tokens up to each. What follows isn't tried, even if it would fit. A budget of 0 means the default.

    Tokens aren't negative, so a running sum says it; order must be total, or ties are broken anyhow. A null counts as 0.
    """
    budget = budget or SETTINGS.context_tokens
    running = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).filter(F.col("used") <= budget)


def ordered_concat(text: str, order: list[str], separator: str = "") -> Column:
    """An aggregate: the texts of a group in order, joined."""
    collected = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(collected, lambda s: s["_text"]), separator)


def context_text(hits: DataFrame, key: str = "qid", budget: int = SETTINGS.context_tokens) -> DataFrame:
    """key, context: the blocks of the hits of a question in order of rank, within the budget, under their heading. A question whose first block is too long gets no row; the number of hits of a question is bounded by its k."""
    blocks = hits.withColumn("block", chunk_block()).withColumn("tokens", token_estimate(F.col("block")))
    kept = within_budget(blocks, [key], ["rank"], budget=budget)
    return kept.groupBy(key).agg(F.concat(F.lit(CONTEXT_HEADER), ordered_concat("block", ["rank"])).alias("context"))


def user_content(question: Column, context: Column, additional: Column) -> Column:
    asked = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit(QUESTION_HEADER), question)).otherwise(question)
    return F.when(F.coalesce(additional, F.lit("")) != "", F.concat(asked, F.lit(ADDITIONAL_HEADER), additional)).otherwise(asked)


def prompt_messages(history: Column, content: Column, system: str = SYSTEM_PROMPT) -> Column:
    """array<struct<role, content>>: the system's, the last of the history, then the user's."""
    recent = F.slice(history, F.greatest(F.size(history) - SETTINGS.history + 1, F.lit(1)), SETTINGS.history)
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    return F.concat(one("system", F.lit(system)), F.coalesce(recent, F.array().cast("array<struct<role: string, content: string>>")), one("user", content))


def prompt_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(token_estimate(m["content"]), F.lit(0)))


def sources(hits: DataFrame, key: str = "qid") -> DataFrame:
    """key, sources, metadata_json: the first few hits of each question with their places, relevance to four places, and as JSON; chat and agent share one form."""
    few = hits.filter(F.col("rank") <= SETTINGS.sources)
    fields = F.struct("file_path", "language", "start_line", "end_line", "chunk_type", F.coalesce("name", F.lit("")).alias("name"), F.round("relevance_score", 4).alias("relevance_score"))
    listed = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", fields.alias("s")))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["s"]).alias("sources")).withColumn("metadata_json", F.when(F.size("sources") > 0, F.to_json(F.struct("sources"))))


def memory_bundle(messages: DataFrame, facts: DataFrame, conversations: DataFrame) -> DataFrame:
    """conversation_id, bundle: the last turns of each conversation and the first facts of its repository, as one struct."""
    from loamstone.operators.history import fact_set, last_n

    turns = last_n(messages.filter(F.col("conversation_id").isNotNull()))
    history = turns.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
    few = fact_set(facts).withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy("fact"))).filter(F.col("_n") <= SETTINGS.facts)
    known = few.groupBy("repo_id").agg(F.array_sort(F.collect_list("fact")).alias("facts"))
    both = conversations.select(F.col("id").alias("conversation_id"), "repo_id").distinct().join(history, "conversation_id", "left").join(known, "repo_id", "left")
    empty = F.array().cast("array<struct<role: string, content: string>>")
    return both.select("conversation_id", F.struct(F.coalesce("history", empty).alias("history"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts")).alias("bundle"))
