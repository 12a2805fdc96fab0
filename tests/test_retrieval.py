import numpy as np
import pytest

from loamstone.operators import ann
from loamstone.operators.embedding import HashEmbedder
from loamstone.operators.retrieval import retrieve, topk_within


@pytest.mark.parametrize("part", [20_000, 7])
def test_nearest_of_each_key_against_all(spark, part):
    rng = np.random.default_rng(5)
    vectors = [(f"k{min(i % 9, 2)}", f"v{i:03}", rng.normal(size=6).round(1).tolist()) for i in range(120)]
    queries = [(f"q{i}", f"k{i % 4}", rng.normal(size=6).tolist()) for i in range(20)]
    extra = [(None, "x", [1.0] * 6), ("k0", None, [1.0] * 6), ("k0", "zero", [0.0] * 6), ("k0", "short", [1.0]), ("k0", "none", None)]
    v = spark.createDataFrame(vectors + extra, "key string, vec_id string, embedding array<float>").selectExpr("*", "'x' AS qid", "1 AS q_part")
    q = spark.createDataFrame([*queries, (None, "k0", [1.0] * 6), ("n", None, [1.0] * 6), ("z", "k0", [0.0] * 6)], "qid string, key string, qvec array<double>")
    got = {}
    for r in topk_within(q, v, 5, part).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, round(r.dist, 6)))
    unit = lambda x: np.array(x, dtype=np.float32).astype(float) / np.linalg.norm(np.array(x, dtype=np.float32).astype(float))
    want = {}
    for qid, key, qvec in queries:
        near = sorted((round(1 - float(np.array(qvec) / np.linalg.norm(qvec) @ unit(e)), 9), i) for k, i, e in vectors if k == key)
        if near:
            want[qid] = [(i, round(d, 6)) for d, i in near[:5]]
    assert got == want
    assert topk_within(q.limit(0), v).count() == 0 and topk_within(q, v.limit(0)).count() == 0


def test_retrieve(spark):
    chunks = spark.createDataFrame([("r", "c1", "open the lease"), ("r", "c2", "close the queue"), ("s", "c3", "open the lease")], "repo_id string, chunk_id string, content string")
    vectors = spark.createDataFrame([(r.repo_id, r.chunk_id, HashEmbedder(64)([r.content])[0]) for r in chunks.collect()], "repo_id string, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", "r", "open lease"), ("blank", "r", "  "), ("none", "t", "open lease"), ("null", "r", None)], "qid string, repo_id string, question string")
    got = [(r.qid, r["rank"], r.chunk_id, r.content) for r in retrieve(asked, chunks, vectors, HashEmbedder(64), 2).orderBy("rank").collect()]
    assert got == [("q", 1, "c1", "open the lease"), ("q", 2, "c2", "close the queue")]


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 50 = 0").selectExpr("vec_id AS qid", "embedding AS qvec")
    path = f"file://{tmp_path}/index"
    ann.write_index(vectors, path, 16)
    whole = {(r.qid, r.vec_id) for r in ann.search_index(queries, path, 5, probes=16, part=9).collect()}
    m = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 400, 50) for j in np.argsort(1 - m @ m[i], kind="stable")[:5]}
    assert whole == want
    some = {(r.qid, r.vec_id) for r in ann.search_index(queries, path, 5, probes=8).collect()}
    assert len(some & want) >= 0.8 * len(want)
    ann.write_index(vectors.limit(0), path)
    assert ann.search_index(queries, path).count() == 0
