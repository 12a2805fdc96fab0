"""Reading a tree of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.paths import language, relative, skip_reason
from loamstone.functions.text import line_count, valid_utf8


def scan_files(spark: SparkSession, root: str, path_glob: str | None = None) -> DataFrame:
    """path, relative_path, length, content of every regular file below root, at any depth. Files that can't be read are skipped; a root that doesn't exist is an error.

    The size limit is a filter on the listing and reaches the scan, so larger files are never opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    files = reader.load(root).filter(F.col("length") <= SETTINGS.max_file_bytes)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return files.select("path", relative(plain, F.lit(base.replace("file://", "file:"))).alias("relative_path"), "length", valid_utf8(F.col("content")).alias("content"))


def parsed_files(files: DataFrame, path: str = "relative_path", content: str = "content", size: str = "length") -> DataFrame:
    """path, relative_path, content, language, line_count of the files worth reading."""
    kept = files.filter(skip_reason(F.col(path), F.col(size), F.col(content)).isNull() & F.col(content).isNotNull())
    return kept.select(F.col(path).alias("path"), relative(F.col(path)).alias("relative_path"), F.col(content).alias("content"), language(F.col(path)).alias("language"), line_count(F.col(content)).alias("line_count"))


def scan_counts(files: DataFrame, path: str = "relative_path", content: str = "content", size: str = "length") -> DataFrame:
    """reason, n: how many files are read (reason read) and skipped, by reason."""
    reason = F.coalesce(skip_reason(F.col(path), F.col(size), F.col(content)), F.lit("read"))
    return files.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
