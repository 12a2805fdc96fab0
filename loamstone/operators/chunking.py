"""Cutting files into chunks: by definitions where the language has them, else by overlapping windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.text import chunk_id, indent, lines, strip

#: Languages with a structural chunker.
STRUCTURED = ("python", "javascript", "typescript")


def sliding_windows(files: DataFrame, size: int = SETTINGS.window_lines, overlap: int = SETTINGS.window_overlap, content: str = "content") -> DataFrame:
    """start_line, end_line, content for windows of size lines that share overlap lines; the last one ends at the end of the file. Columns of files but the content are kept.

    Blank windows are dropped; null contents give none. One row is worked on at a time, and nothing is shuffled.
    """
    step = max(size - overlap, 1)
    kept = [c for c in files.columns if c != content]
    split = files.select(*(F.col(f"`{c}`") for c in kept), lines(F.col(content)).alias("_lines")).filter(F.col("_lines").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("_lines") - F.lit(overlap) - 1, F.lit(0)), F.lit(step))
    windows = split.withColumn("_start", F.explode(starts))
    end = F.least(F.col("_start") + size, F.size("_lines"))
    body = strip(F.array_join(F.slice("_lines", F.col("_start") + 1, F.lit(size)), "\n"))
    return windows.select(*(F.col(f"`{c}`") for c in kept), (F.col("_start") + 1).alias("start_line"), end.alias("end_line"), body.alias("content")).filter(F.col("content") != "")


def definition(line: Column, python: Column) -> tuple[Column, Column]:
    """(kind, name) of a line without its leading blanks: function or class if it opens a definition, else null. An empty name is null."""
    up_to = lambda text, stops: strip(F.regexp_extract(text, f"^[^{stops}]*", 0))
    after = lambda prefix: F.regexp_replace(line, f"^{prefix}", "")
    function = r"(?:export )?(?:async )?function "
    classes = r"(?:export )?class "
    kind = F.when(
        python,
        F.when(line.startswith("class "), "class").when(line.startswith("def ") | line.startswith("async def "), "function"),
    ).otherwise(F.when(line.rlike("^" + function), "function").when(line.rlike("^" + classes), "class"))
    name = F.when(
        python,
        F.when(line.startswith("class "), up_to(after("class "), "(:")).otherwise(up_to(after("(?:async )?def "), "(")),
    ).otherwise(F.when(line.rlike("^" + function), up_to(after(function), "(")).otherwise(up_to(after(classes), "{( ")))
    return kind, F.when(kind.isNotNull() & (name != ""), name)


def structural_chunks(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """start_line, end_line, chunk_type, name, content of the definitions of python, javascript and typescript files; files without any give no rows.

    A chunk opens at a definition and goes on over blank and comment lines; other lines end it that aren't deeper than it opened,
    in javascript and typescript only if they're definitions themselves. Nested definitions belong to the outer chunk, lines outside
    of definitions to none. One fold over the lines of a row, which carries what is open: no shuffle, no Python.
    """
    kept = [c for c in files.columns if c != content]
    source = files.filter(F.col(language).isin(*STRUCTURED) & F.col(content).isNotNull())
    source = source.select(*(F.col(f"`{c}`") for c in kept), lines(F.col(content)).alias("_lines"), (F.col(language) == "python").alias("_python"))
    chunk = "struct<start: int, stop: int, kind: string, name: string>"
    state = F.struct(F.lit(0).alias("line"), F.lit(0).alias("open"), F.lit(0).alias("base"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"), F.array().cast(f"array<{chunk}>").alias("done"))

    def finished(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["open"].alias("start"), s["line"].alias("stop"), s["kind"].alias("kind"), s["name"].alias("name"))))

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+", "")
        skipped = (bare == "") | bare.startswith("#") | bare.startswith("//")
        kind, name = definition(bare, F.col("_python"))
        depth = indent(line)
        ends = (s["open"] > 0) & ~skipped & (depth <= s["base"]) & (F.col("_python") | kind.isNotNull())
        opens = ((s["open"] == 0) | ends) & kind.isNotNull()
        number = s["line"] + 1
        return F.struct(
            number.alias("line"),
            F.when(opens, number).when(ends, 0).otherwise(s["open"]).alias("open"),
            F.when(opens, depth).otherwise(s["base"]).alias("base"),
            F.when(opens, kind).otherwise(s["kind"]).alias("kind"),
            F.when(opens, name).otherwise(s["name"]).alias("name"),
            F.when(ends, finished(s)).otherwise(s["done"]).alias("done"),
        )

    folded = F.aggregate("_lines", state, step, lambda s: F.when(s["open"] > 0, finished(s)).otherwise(s["done"]))
    found = source.withColumn("_chunk", F.explode(folded))
    body = strip(F.array_join(F.slice("_lines", F.col("_chunk.start"), F.col("_chunk.stop") - F.col("_chunk.start") + 1), "\n"))
    return found.select(*(F.col(f"`{c}`") for c in kept), F.col("_chunk.start").alias("start_line"), F.col("_chunk.stop").alias("end_line"), F.col("_chunk.kind").alias("chunk_type"), F.col("_chunk.name").alias("name"), body.alias("content"))


def chunk_files(files: DataFrame, size: int = SETTINGS.window_lines, overlap: int = SETTINGS.window_overlap) -> DataFrame:
    """All chunks of files (repo_id, file_path, language, content) in the form of the chunks table: structural if a file has definitions, else windows.

    Whether a file has any is decided in its row, so the two ways need no join between them.
    """
    structured = structural_chunks(files.select("repo_id", "file_path", "language", "content"))
    python = F.col("language") == "python"
    any_definition = F.exists(lines(F.col("content")), lambda x: definition(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", ""), python)[0].isNotNull())
    plain = files.filter(~(F.col("language").isin(*STRUCTURED) & any_definition) | F.col("language").isNull())
    windows = sliding_windows(plain.select("repo_id", "file_path", "language", "content"), size, overlap).withColumns({"chunk_type": F.lit("block"), "name": F.lit(None).cast("string")})
    columns = ("repo_id", "file_path", "language", "content", "start_line", "end_line", "chunk_type", "name")
    both = structured.select(*columns).unionByName(windows.select(*columns))
    return both.select(chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line")).alias("chunk_id"), *columns)
