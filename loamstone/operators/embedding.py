"""Embedding chunks behind a cache of vectors by content hash."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from loamstone.config import SETTINGS
from loamstone.functions.text import embedding_text, hash16


class Embedder(Protocol):
    """Texts to vectors of one length. It's sent to the executors, so it must pickle."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic local stand-in for an embedding service: hashed words, signed, of unit length, as SQL can make them too. It has no model's quality."""

    def __init__(self, dimensions: int = SETTINGS.embedding_dimensions) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for word in text.lower().split():
                h = hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).digest()
                v[int.from_bytes(h[:4], "big") % self.dimensions] += 1 if h[4] >> 7 else -1
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return out


class Busy(Exception):
    """A service that asks to come back; after may be the seconds it estimates."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__(after)
        self.after = after


def with_retries(call: Callable[[list[str]], list[list[float]]], attempts: int = SETTINGS.embed_retries, delay: float = SETTINGS.embed_delay_s, most: float = SETTINGS.embed_max_wait_s, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """call, tried again when it is Busy or times out: after the service's estimate up to most seconds, else after delay. The last failure is raised."""

    def tried(texts: list[str]) -> list[list[float]]:
        for attempt in range(attempts):
            try:
                return call(texts)
            except (Busy, TimeoutError) as e:
                if attempt == attempts - 1:
                    raise
                after = e.after if isinstance(e, Busy) else None
                sleep(delay if after is None else min(after, most))
        raise AssertionError

    return tried


def with_hash(chunks: DataFrame, body_only: bool = False) -> DataFrame:
    """Adds content_hash. By default it covers the header with path and lines, so that a moved chunk has another; body_only covers the content alone."""
    text = F.col("content") if body_only else embedding_text(F.col("file_path"), F.col("language"), F.col("start_line"), F.col("end_line"), F.col("name"), F.col("chunk_type"), F.col("content"))
    return chunks.withColumn("content_hash", hash16(text))


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with the cached embedding, null if there is none, and hit. Keys are (repo_id, content_hash); a null in a key is no hit. Equal keys in the cache count once."""
    cached = cache.select("repo_id", "content_hash", "embedding").dropDuplicates(["repo_id", "content_hash"])
    joined = chunks.join(cached.withColumn("hit", F.lit(True)), ["repo_id", "content_hash"], "left")
    return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("repo_id", "content_hash"), ["repo_id", "content_hash"], "left_anti")


def cache_prune(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cache without keys that no chunk has any more. Always done, also when nothing was missed."""
    return cache.join(chunks.select("repo_id", "content_hash"), ["repo_id", "content_hash"], "left_semi")


def hit_rate(looked_up: DataFrame) -> DataFrame:
    """total, hits, percent (0 of nothing)."""
    counted = looked_up.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"))
    return counted.withColumn("percent", F.coalesce(F.try_divide(F.col("hits") * 100, F.col("total")), F.lit(0.0)))


def batches(rows: DataFrame, order: list[str], size: int = SETTINGS.embed_batch, within: str = "repo_id") -> DataFrame:
    """Adds batch, from 0, of size rows each, by order within a key."""
    place = F.row_number().over(Window.partitionBy(within).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", size: int = SETTINGS.embed_batch) -> DataFrame:
    """Adds embedding: the embedder is called with size texts at a time where the rows are. As many calls run at once as there are tasks; repartition before to change that. A null text is embedded as an empty one."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    at = rows.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column(at).to_pylist()]
            vectors: list[list[float]] = []
            for i in range(0, len(texts), size):
                vectors += embedder(texts[i : i + size])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def embed_chunks(chunks: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, the cache after it). Only what the cache lacks is embedded, each hash once, and vectors meet chunks by key, never by position."""
    hashed = with_hash(chunks)
    text = embedding_text(F.col("file_path"), F.col("language"), F.col("start_line"), F.col("end_line"), F.col("name"), F.col("chunk_type"), F.col("content"))
    missing = cache_misses(hashed, cache).select("repo_id", "content_hash", text.alias("text")).dropDuplicates(["repo_id", "content_hash"])
    fresh = embed(missing, embedder).select("repo_id", "content_hash", "embedding")
    after = cache_prune(cache.select("repo_id", "content_hash", "embedding"), hashed).unionByName(fresh)
    return cache_lookup(hashed, after).drop("hit"), after
