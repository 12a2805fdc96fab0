"""Session helpers: settings every job needs, and a shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loamstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and UTC. Cluster settings given elsewhere are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only in local mode, where it may be unset, is a folder of this machine taken."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="loamstone-")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: cuts the lineage and lets several consumers share one computation; lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, which drop_materialized deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Deletes the tables that materialize wrote in this process, once nothing reads them any more; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loamstone-ship-")) / "loamstone_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("loamstone", p.relative_to(root)))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; tz-aware timestamps stay TIMESTAMP."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_clash(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Projects df to the needed columns under the operator's own names, so that further columns of the input, whatever their names, can't clash. needed: own name -> input column."""
    return df.select(*(F.col(f"`{src}`").alias(own) for own, src in needed.items()))
