"""Retrieval inside a repository: a question's vector against the vectors of its own repository, and hits with their chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.text import query_text
from loamstone.operators.embedding import Embedder, embed
from loamstone.operators.topk import _matrix, rank_hits, relevance

#: Vectors, and queries, of one key that meet in one task.
PART = 20_000
#: Distances that agree to so many places are ties, which go by id.
PLACES = 9


def _search(k: int):
    empty = pa.table({"qid": pa.array([], pa.string()), "vec_id": pa.array([], pa.string()), "dist": pa.array([], pa.float64())})

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty
        vectors, queries = left.column("embedding").combine_chunks(), right.column("qvec").combine_chunks()
        ids, qids = np.array(left.column("vec_id").to_pylist()), np.array(right.column("qid").to_pylist())
        out = []
        for dim in np.unique(np.asarray(pa.compute.list_value_length(queries).drop_null())).tolist():
            (rows, m), (q_rows, q) = _matrix(vectors, dim), _matrix(queries, dim)
            if not len(rows) or not len(q_rows):
                continue
            place = np.argsort(np.argsort(ids[rows], kind="stable"), kind="stable")
            for i in range(0, len(q), max(1, 4_000_000 // len(rows))):
                d = np.round(1 - q[i : i + max(1, 4_000_000 // len(rows))] @ m.T, PLACES)
                order = np.lexsort((np.broadcast_to(place, d.shape), d), axis=1)[:, :k]
                out.append((np.repeat(qids[q_rows[i : i + len(d)]], order.shape[1]), ids[rows[order]].ravel(), np.take_along_axis(d, order, 1).ravel()))
        if not out:
            return empty
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"qid": pa.array(cols[0].tolist(), pa.string()), "vec_id": pa.array(cols[1].tolist(), pa.string()), "dist": pa.array(cols[2] + 0.0, pa.float64())})

    return run


def topk_within(queries: DataFrame, vectors: DataFrame, k: int = SETTINGS.top_k, part: int = PART) -> DataFrame:
    """qid, vec_id, dist, rank: the k nearest of each query among the vectors of its own key, exactly. queries: qid, key, qvec; vectors: key, vec_id, embedding; ids are strings.

    A key's vectors and queries are counted first and parted by their hashes, so that of a key with a large share of all rows no
    task has more than part of either; each of its tasks keeps k hits a query, so what moves on is queries x parts x k rows.
    Null keys and ids, and vectors that are null, zero or of another length, give no hits; distances that agree to nine places are
    ties and go by id. An empty side gives no rows.
    """
    k = k or SETTINGS.top_k
    v = vectors.filter("key IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL").select("key", "vec_id", "embedding")
    q = queries.filter("key IS NOT NULL AND qid IS NOT NULL AND qvec IS NOT NULL").select("key", "qid", "qvec")
    parts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias(name))
    sizes = parts(v, "v_parts").join(parts(q, "q_parts"), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    v = v.join(sizes, "key").select("key", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.col("v_parts")).alias("v_part"), every("q_parts").alias("q_part"))
    q = q.join(sizes, "key").select("key", "qid", "qvec", F.pmod(F.xxhash64("qid"), F.col("q_parts")).alias("q_part"), every("v_parts").alias("v_part"))
    group = ("key", "v_part", "q_part")
    hits = v.groupBy(*group).cogroup(q.groupBy(*group)).applyInArrow(_search(k), "qid string, vec_id string, dist double")
    return rank_hits(hits, k)


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, embedder: Embedder, k: int = SETTINGS.top_k) -> DataFrame:
    """qid, rank, dist, relevance_score and the columns of the chunks of each question's k nearest chunks in its repository.

    questions: qid, repo_id, question; chunks: one row for each chunk_id; vectors: repo_id, chunk_id, embedding, as the vector store
    keeps them. A question that is null or blank finds nothing.
    """
    asked = questions.filter(F.length(F.trim("question")) > 0).select(F.col("qid").cast("string").alias("qid"), F.col("repo_id").alias("key"), query_text(F.col("question")).alias("text"))
    asked = embed(asked, embedder).withColumnRenamed("embedding", "qvec")
    hits = topk_within(asked, vectors.select(F.col("repo_id").alias("key"), F.col("chunk_id").alias("vec_id"), "embedding"), k)
    found = hits.withColumnRenamed("vec_id", "chunk_id").join(chunks, "chunk_id")
    return found.withColumn("relevance_score", relevance(F.col("dist")))
