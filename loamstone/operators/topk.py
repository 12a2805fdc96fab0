"""Exact and indexed nearest-neighbour search by cosine distance.

Two exact forms share one contract. topk_expr keeps everything in JVM expressions and suits a few queries; topk_matrix multiplies
blocks of queries and vectors with numpy inside Arrow batches and suits many. Either keeps at most k rows per query and task
before anything is shuffled, so the exchange carries queries x k x tasks rows, not queries x vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query sides are fetched in blocks of so many bytes; up to the second number topk takes the form that broadcasts them.
MAX_QUERY_BYTES = 64 << 20
MAX_BROADCAST_BYTES = 4 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relevance(distance: Column) -> Column:
    """max(0, 1 - distance)."""
    return F.greatest(F.lit(0.0), 1 - distance)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by vec_id."""
    w = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_expr(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """qid, vec_id, dist, rank. queries: qid, qvec (few rows, which the caller knows of, see topk); vectors: vec_id, embedding. k=0 means the default of 10.

    Vectors that are null, of another length or zero are no hits; an empty side gives no rows. The window keeps a group limit
    below its exchange, so each task sends k rows per query.
    """
    k = k or 10
    # norms are a matter of a row, not of a pair
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    left = vectors.select("vec_id", "embedding", norm("embedding").alias("_v")).filter(F.col("_v") > 0)
    right = queries.select("qid", "qvec", norm("qvec").alias("_q")).filter(F.col("_q") > 0)
    pairs = left.join(F.broadcast(right), F.size("embedding") == F.size("qvec"))
    return rank_hits(pairs.select("qid", "vec_id", (1 - dot(F.col("qvec"), F.col("embedding")) / (F.col("_q") * F.col("_v"))).alias("dist")), k)


def topk(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The exact hits of either form. The queries are measured first: few go into expressions, more are multiplied in blocks, so that nothing that grows with the data is broadcast whole."""
    size = queries.select(F.sum(F.size("qvec") * 8).alias("b")).first()["b"] or 0
    return topk_expr(queries, vectors, k) if size <= MAX_BROADCAST_BYTES else topk_matrix(queries, vectors, k)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of length dim: their positions and the matrix of unit rows."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(lengths == dim)
    taken = column.take(pa.array(rows))
    flat = np.asarray(pc.cast(taken.flatten(), pa.float64()).fill_null(np.nan), dtype=float).reshape(-1, dim)
    norms = np.sqrt((flat * flat).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 0)
    return rows[fine], flat[fine] / norms[fine, None]


def topk_matrix(queries: DataFrame, vectors: DataFrame, k: int = 10, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """As topk_expr, for many queries. The queries are fetched in blocks of at most max_query_bytes each and sent with the task; every block is one pass over the vectors."""
    k = k or 10
    spark = vectors.sparkSession
    first = queries.filter(F.col("qvec").isNotNull()).select(F.max(F.size("qvec")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    schema = "qid long, vec_id long, dist double"
    if not first["n"]:
        return spark.createDataFrame([], schema + ", rank int")
    dim = first["dim"]
    blocks = max(1, -(-first["n"] * dim * 8 // max_query_bytes))
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "qvec").toPandas()
        own = own[[v is not None and len(v) == dim for v in own.qvec]]
        if len(own):
            parts.append(_search_block(vectors, own.qid.to_numpy(), np.stack([np.asarray(v, dtype=float) for v in own.qvec]), dim, k, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionAll(p)
    return rank_hits(hits, k)


def _search_block(vectors: DataFrame, qids: np.ndarray, q: np.ndarray, dim: int, k: int, schema: str) -> DataFrame:
    norms = np.sqrt((q * q).sum(axis=1))
    fine = norms > 0
    sent = vectors.sparkSession.sparkContext.broadcast((qids[fine], q[fine] / norms[fine, None]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = sent.value
        best_d = np.empty((len(ids), 0))
        best_v = np.empty((len(ids), 0), dtype=np.int64)
        for batch in batches:
            rows, m = _matrix(batch.column(1), dim)
            if not len(rows):
                continue
            vec_ids = np.asarray(batch.column(0))[rows]
            d = np.concatenate([best_d, 1 - unit @ m.T], axis=1)
            v = np.concatenate([best_v, np.broadcast_to(vec_ids, (len(ids), len(vec_ids)))], axis=1)
            order = np.lexsort((v, d), axis=1)[:, :k]
            best_d, best_v = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
        n = best_d.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_v.ravel()), pa.array(best_d.ravel())], names=["qid", "vec_id", "dist"])

    return vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "embedding").mapInArrow(search, schema)
