"""Approximate nearest neighbours: an inverted index of cells, fitted on a bounded sample, that holds every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.operators.topk import _matrix, rank_hits
from loamstone.session import scratch

#: The sample that centres are fitted on is at most so many vectors; the index itself holds all.
SAMPLE = 20_000


def fit_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of cells by spherical k-means on a sample drawn by the hash of vec_id, so that it's the same in every run."""
    rows = vectors.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample).select("embedding").toArrow()
    column = rows.column(0).combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    lengths = np.asarray(pc.list_value_length(column))
    _, m = _matrix(column, int(np.bincount(lengths).argmax()))
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        near = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        norms = np.sqrt((sums * sums).sum(axis=1))
        full = norms > 0
        centres[full] = sums[full] / norms[full, None]
    return centres


def _assign(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = _matrix(b.column(1), centres.shape[1])
            if not len(rows):
                continue
            near = np.argpartition(-(m @ centres.T), min(probes, len(centres)) - 1, axis=1)[:, :probes]
            n = near.shape[1]
            take = pa.array(np.repeat(rows, n))
            unit = pa.array(np.repeat(m, n, axis=0).astype(np.float32).tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), unit, pa.array(near.ravel().astype(np.int32))], names=["id", "unit", "cell"])

    return run


#: Vectors of a cell that meet the queries in one task.
PART = 50_000
_SCHEMA = "id long, unit array<float>, cell int"


def write_index(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes the index of all vectors to a folder: the centres, and the vectors by cell. cells is by default the square root of the number of vectors, 16 at least and 4096 at most."""
    spark = vectors.sparkSession
    n = vectors.count()
    centres = fit_centres(vectors, cells or int(min(4096, max(16, n**0.5))))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    indexed = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(_assign(centres, 1), _SCHEMA) if centres.size else spark.createDataFrame([], _SCHEMA)
    indexed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def search_index(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, part: int = PART) -> DataFrame:
    """qid, vec_id, dist, rank: the nearest of the vectors in the cells nearest to each query, from an index that write_index made. Only the cells that some query looks into are read.

    probes is by default a third of the cells, up to 64. A cell's vectors are counted, and a large one parted by ids, so it's no
    single group: queries meet each of its parts, and each part keeps k a query.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "qid long, vec_id long, dist double, rank int")
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most 4096, see write_index
    if not rows:
        return empty
    centres = np.array([r.centre for r in rows])
    probes = probes or min(64, max(1, len(centres) // 3))
    asked = queries.filter("qid IS NOT NULL").select("qid", "qvec").mapInArrow(_assign(centres, probes), _SCHEMA)
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # at most as many as there are centres
    if not wanted:
        return empty
    held = spark.read.schema(_SCHEMA).parquet(f"{path}/cells").filter(F.col("cell").isin(wanted))
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # a row for each centre at most
    indexed = held.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        dense = lambda t: np.asarray(t.column("unit").combine_chunks().flatten(), dtype=np.float64).reshape(len(t), -1)
        ids, vecs, qids, qs = np.asarray(left.column("id")), dense(left), np.asarray(right.column("id")), dense(right)
        out = []
        step = max(1, 4_000_000 // len(ids))
        for i in range(0, len(qids), step):
            d = 1 - qs[i : i + step] @ vecs.T
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            out.append((np.repeat(qids[i : i + step], order.shape[1]), ids[order].ravel(), np.take_along_axis(d, order, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"qid": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    hits = indexed.groupBy("cell", "salt").cogroup(asked.groupBy("cell", "salt")).applyInArrow(search, "qid long, vec_id long, dist double")
    return rank_hits(hits, k)


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """search_index over an index written for this call. Many searches of the same vectors write one and keep it."""
    path = scratch(vectors.sparkSession)
    write_index(vectors, path, cells)
    return search_index(queries, path, k, probes)
