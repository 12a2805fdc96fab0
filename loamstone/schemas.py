"""Explicit schemas of the records; nothing is inferred."""

from __future__ import annotations

#: Each as DDL, which readers and createDataFrame take.
SCHEMAS = {
    "users": "id string, email string, name string",
    "repositories": "id string, user_id string, name string, url string, local_path string, status string, file_count int, chunk_count int, ingestion_progress int, ingestion_total_chunks int, ingestion_cached_chunks int, ingestion_phase string, error_message string, created_at timestamp, updated_at timestamp",
    "conversations": "id string, user_id string, repo_id string, title string, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, metadata_json string, created_at timestamp",
    "raw_files": "path string, length long, content binary",
    "files": "path string, relative_path string, content string, language string, line_count int",
    "chunks": "chunk_id string, repo_id string, file_path string, language string, content string, start_line int, end_line int, chunk_type string, name string",
    "embedding_cache": "repo_id string, content_hash string, embedding array<float>",
    "vectors": "chunk_id string, repo_id string, file_path string, language string, content string, start_line int, end_line int, chunk_type string, name string, embedding array<float>",
    "hits": "query_id string, chunk_id string, distance double, relevance_score double",
    "prompt_messages": "messages array<struct<role: string, content: string>>",
    "plan": "plan array<string>, needs_tools boolean, reasoning string",
    "agent_state": "user_query string, repo_id string, repo_path string, plan array<string>, retrieved_context array<struct<file_path: string, start_line: int, end_line: int, relevance_score: double>>, tool_results array<struct<tool: string, args: string, result: string>>, tool_analysis string, final_answer string, current_step int, needs_tools boolean, error string, steps_log array<string>",
    "memory": "repo_id string, key string, value string, written_at timestamp, ttl_s int",
    "facts": "repo_id string, fact string",
    "tree_nodes": "path string, parent string, name string, type string, depth int",
    "page": "total long, page int, per_page int, has_more boolean",
    "sse_events": "seq long, type string, payload string",
    "ingestion_result": "repo_name string, local_path string, file_count int, chunk_count int, success boolean, error string",
}

#: Domains of the enumerated columns.
STATUSES = ("pending", "ingesting", "ready", "failed")
ROLES = ("user", "assistant", "system", "tool")
PHASES = ("clone", "parse", "embed", "store", "done", "failed")
CHUNK_TYPES = ("function", "class", "block")
