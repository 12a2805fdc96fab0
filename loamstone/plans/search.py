"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.operators.topk import relevance, topk
from loamstone.session import table

_SQL_HITS = """
    SELECT q.vec_id AS qid, v.vec_id AS vec_id,
           1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) AS dist
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {where}"""


def _queries(v: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 50."""
    return v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk(_queries(v), v, 10).select("qid", "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk(_queries(v), v.filter(F.col("label") == 2), 10).select("qid", "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk(_queries(v), v, 10).select("qid", "vec_id", F.round(relevance(F.col("dist")), 4).alias("relevance"))


def _top(where: str, value: str) -> str:
    return f"""WITH h AS ({_SQL_HITS.format(where=where)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM h)
    SELECT qid, vec_id, {value} FROM r WHERE rn <= 10"""


QUERIES = {"vector_topk": vector_topk, "vector_topk_filtered": vector_topk_filtered, "relevance_score": relevance_score}
ORACLE = {
    "vector_topk_matrix": _top("", "round(dist, 6) + 0.0 AS dist"),
    "vector_topk": _top("", "round(dist, 6) + 0.0 AS dist"),
    "vector_topk_filtered": _top("AND v.label = 2", "round(dist, 6) + 0.0 AS dist"),
    "relevance_score": _top("", "round(greatest(0.0, 1 - dist), 4) AS relevance"),
}
