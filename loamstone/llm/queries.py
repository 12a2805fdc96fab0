"""Queries of the text operators, with DuckDB SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import boilerplate, conversations, credentials, defects, handwritten, leaks, markup, packing, personal, split
from loamstone.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.file_reasons(table(spark, sf_dir, "chunks")).select("repo_id", "file_path")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.file_reasons(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuilt_turns(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def p2_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as two exporters have it in files of twelve hours, put together again where they overlap."""
    out = conversations.assembled_exports(conversations.exports(table(spark, sf_dir, "messages")), 1_000)
    return out.select("conversation_id", "whole", "messages")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defective_answers(table(spark, sf_dir, "messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.marked_up(table(spark, sf_dir, "messages")).select("message_id")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_messages(table(spark, sf_dir, "messages"))


def p4_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What messages share with others of their repository, by suffix arrays: the method named for problem 4, kept for its figures."""
    hosts = table(spark, sf_dir, "conversations").filter("id IS NOT NULL").groupBy("id").agg(F.min("repo_id").alias("host")).withColumnRenamed("id", "conversation")
    rows = table(spark, sf_dir, "messages").select("id", "conversation_id", "content").join(hosts, F.col("conversation_id") == F.col("conversation"), "left")
    return boilerplate.without_repeats(rows, "host", "id", "content").select(F.col("page_id").alias("message_id"), "tokens", "covered")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf_dir, "chunks"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "chunks"), with_text=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "chunks")).filter("piece = 0").select("chunk_id", "cut")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "chunks"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = table(spark, sf_dir, "pack_budgets")
    return packing.fill_report(packing.containers(table(spark, sf_dir, "documents"), budgets), budgets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replacement under a key replaces. The key of a query is no secret; a job is given its own."""
    return personal.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), b"query").select("doc_id", "kind", "start_pos")


def p10_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that several documents hold, by their pseudonyms."""
    found = personal.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), b"query")
    linked = found.groupBy("kind", "pseudonym").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("cases"))
    return linked.filter("documents > 1")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_information(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), key=b"query")
    return found.select("doc_id", "kinds", "clean")


_SQL_P7 = """SELECT DISTINCT chunk_id, CASE WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > 2048 THEN 'inner' ELSE 'line' END AS cut
    FROM chunks WHERE length(content) > 2048"""
_SQL_P2 = r"""
WITH m AS (SELECT DISTINCT * FROM messages WHERE conversation_id IS NOT NULL),
n AS (SELECT conversation_id, id, created_at, content,
        CASE WHEN lower(trim(role, e' \t\n\r')) IN ('system', 'user', 'tool', 'assistant') THEN lower(trim(role, e' \t\n\r')) END AS r,
        regexp_matches(coalesce(content, ''), '[^\s\p{Z}\p{Cc}\p{Cf}]') AS seen FROM m),
b AS (SELECT DISTINCT conversation_id FROM n WHERE r IS NULL OR created_at IS NULL),
s AS (SELECT conversation_id, string_agg(r[1], '' ORDER BY created_at, CASE r WHEN 'user' THEN 1 ELSE 2 END, id) AS letters
      FROM n WHERE seen AND r IN ('user', 'assistant') GROUP BY 1),
good AS (SELECT conversation_id FROM s WHERE regexp_full_match(letters, '(ua)+')
         AND conversation_id NOT IN (SELECT conversation_id FROM b) AND conversation_id IN (SELECT id FROM conversations))"""

QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p2_found": p2_found, "p2_turns": p2_turns, "p2_exports": p2_exports, "p3_found": p3_found, "p4_found": p4_found, "p4_clean": p4_clean, "p4_repeated": p4_repeated, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_linked": p10_linked, "p10_redacted": p10_redacted}
_P2_WIDTH = 12 * 3_600_000_000
ORACLE = {
    "p7_found": _SQL_P7,
    "p2_exports": _SQL_P2
    + f""", e AS (SELECT conversation_id, epoch_us(created_at) AS us, row_number() OVER w AS i, lag(epoch_us(created_at)) OVER w AS before
        FROM n WHERE r IS NOT NULL AND created_at IS NOT NULL
        WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, CASE r WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'tool' THEN 3 ELSE 4 END, id)),
    linked AS (SELECT *, before IS NULL OR us // {_P2_WIDTH} = before // {_P2_WIDTH} OR (us + {_P2_WIDTH // 2}) // {_P2_WIDTH} = (before + {_P2_WIDTH // 2}) // {_P2_WIDTH} AS l FROM e)
    SELECT conversation_id, bool_and(l) AS whole, CASE WHEN bool_and(l) THEN count(*) END AS messages FROM linked GROUP BY 1""",
    "p2_found": _SQL_P2
    + """, ids AS (SELECT conversation_id FROM m UNION SELECT id FROM conversations WHERE id IS NOT NULL)
SELECT conversation_id FROM ids WHERE conversation_id NOT IN (SELECT conversation_id FROM good)""",
    "p2_turns": _SQL_P2
    + """ SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at,
        CASE r WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'tool' THEN 2 ELSE 3 END, id) AS turn, id AS message_id, r AS role, content
    FROM n WHERE conversation_id IN (SELECT conversation_id FROM good)""",
}
