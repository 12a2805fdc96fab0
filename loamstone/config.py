"""Settings, as one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes and limits of the data plane. Lines for windows, bytes for files, characters for texts, seconds for lifetimes."""

    window_lines: int = 50
    window_overlap: int = 10
    max_file_bytes: int = 102_400
    min_lines: int = 5
    hash_length: int = 16
    embed_batch: int = 32
    embed_in_flight: int = 10
    embed_retries: int = 5
    embed_delay_s: float = 10.0
    embed_timeout_s: float = 120.0
    embed_max_wait_s: float = 60.0
    store_batch: int = 500
    embedding_dimensions: int = 384
    top_k: int = 10
    tool_top_k: int = 8
    context_tokens: int = 12_000
    history: int = 20
    facts: int = 10
    sources: int = 5
    tool_context: int = 8
    tool_result_chars: int = 4_000
    analysis_chars: int = 1_000
    definition_results: int = 10
    snippet_before: int = 2
    snippet_after: int = 12
    tree_depth: int = 3
    tree_lines: int = 200
    view_bytes: int = 5 * 1024 * 1024
    output_chars: int = 8_000
    error_chars: int = 2_000
    error_lines: int = 5
    chat_title_chars: int = 100
    task_title_chars: int = 80
    title_chars: int = 512
    memory_ttl_s: int = 86_400
    session_ttl_s: int = 3_600
    page_size: int = 20
    history_page_size: int = 50
    max_page_size: int = 100
    connections: int = 30


SETTINGS = Settings()
