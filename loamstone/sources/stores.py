"""Tables in a folder, a partition for each repository: the cache of embeddings and the store of vectors."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.schemas import SCHEMAS


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_cache(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """The cached embeddings, of one repository if named: the filter is on the partition, so others aren't read."""
    cache = read_or_empty(spark, path, SCHEMAS["embedding_cache"])
    return cache if repo_id is None else cache.filter(F.col("repo_id") == repo_id)


def replace_partitions(rows: DataFrame, path: str, key: str = "repo_id") -> int:
    """Writes rows over the partitions they have keys of, and no others; the number of rows written, from the write itself. Rows are brought to their partitions first, so that each has few files."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.repartition(key, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return seen.get["n"]


def save_cache(cache: DataFrame, path: str) -> int:
    return replace_partitions(cache.select("content_hash", "embedding", "repo_id"), path)


def store_vectors(vectors: DataFrame, path: str) -> int:
    """The vectors of the repositories in them, in place of what was stored of these before; their number."""
    return replace_partitions(vectors.select([c for c in vectors.columns if c != "repo_id"] + ["repo_id"]), path)


def load_vectors(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    vectors = read_or_empty(spark, path, SCHEMAS["vectors"])
    return vectors if repo_id is None else vectors.filter(F.col("repo_id") == repo_id)


def drop_partition(spark: SparkSession, path: str, repo_id: str, key: str = "repo_id") -> bool:
    """Deletes a repository's partition; False if there was none."""
    if "/" in repo_id or repo_id in ("", ".", ".."):
        raise ValueError("not an id")
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{key}={repo_id}")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(target) and fs.delete(target, True))
    except Py4JJavaError as e:
        raise OSError(str(e.java_exception)) from e


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def create_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ("repositories", "conversations", "messages", "chunks", "facts")) -> None:
    """Empty tables for those that aren't there. Columns that are added later are read as null from older files."""
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        try:
            spark.read.parquet(path)
        except AnalysisException:
            spark.createDataFrame([], SCHEMAS[name]).write.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).option("mergeSchema", "true").parquet(f"{folder.rstrip('/')}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int, low: int, high: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of a numeric key. The driver's jar must be there."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, numPartitions=str(parts), lowerBound=str(low), upperBound=str(high), **options).load()


def write_jdbc(rows: DataFrame, url: str, name: str, most_connections: int = SETTINGS.connections, **options: str) -> None:
    """Append rows to a table of a relational database, over at most so many connections.

    A task that is lost and run again may have written some of its rows: write to a table with a key, or to one that is merged after.
    """
    rows.write.format("jdbc").options(url=url, dbtable=name, numPartitions=str(most_connections), **options).mode("append").save()
