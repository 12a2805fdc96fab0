"""Reading tools over a table of files: symbols, listings, trees, line ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.paths import extension, file_name, in_skipped_dir, is_safe, parts
from loamstone.functions.text import lines, numbered

#: How definitions look, by extension; {name} is the symbol. They're matched line by line.
DEFINITIONS = {
    ".py": (r"^\s*(?:async\s+)?def\s+{name}\s*\(.*?\)", r"^\s*class\s+{name}\s*[\(:]"),
    ".js": (r"^\s*(?:export\s+)?(?:async\s+)?function\s+{name}\s*\(", r"^\s*(?:export\s+)?class\s+{name}\s*[\{]", r"^\s*const\s+{name}\s*=\s*(?:async\s+)?\("),
    ".ts": (r"^\s*(?:export\s+)?(?:async\s+)?function\s+{name}\s*[\(<]", r"^\s*(?:export\s+)?class\s+{name}\s*[\{<]", r"^\s*(?:export\s+)?(?:const|let)\s+{name}\s*[=:]"),
    ".java": (r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+{name}\s*\(", r"^\s*(?:public|private|protected)?\s*class\s+{name}\s*"),
    ".go": (r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?{name}\s*\(", r"^type\s+{name}\s+struct"),
    ".rs": (r"^\s*(?:pub\s+)?fn\s+{name}\s*[\(<]", r"^\s*(?:pub\s+)?struct\s+{name}\s*"),
    ".cpp": (r"^\s*(?:\w+\s+)+{name}\s*\(", r"^\s*class\s+{name}\s*"),
}
#: Which file of a repository tells how its tests are run, the first that is there.
TEST_COMMANDS = (
    (("pytest.ini", "pyproject.toml", "setup.py"), "python -m pytest --tb=short -q"),
    (("package.json",), "npm test"),
    (("Cargo.toml",), "cargo test"),
    (("go.mod",), "go test ./..."),
    (("pom.xml",), "mvn test"),
)


def find_definitions(files: DataFrame, name: str, path: str = "file_path", content: str = "content") -> DataFrame:
    """line_no, line, pattern, snippet of each line that defines the symbol, and the columns of files but the content. A line that fits two patterns gives two rows, as each is a finding of its own. A blank name is an error.

    A cheap test for the name comes before any line is looked at, so files without it are never split.
    """
    name = name.strip()
    if not name:
        raise ValueError("no symbol to look for")
    quoted = re.escape(name)
    kept = [c for c in files.columns if c != content]
    likely = files.filter(F.col(content).contains(name) & extension(F.col(path)).isin(*DEFINITIONS) & ~in_skipped_dir(F.col(path), "symbols"))
    split = likely.select(*(F.col(f"`{c}`") for c in kept), lines(F.col(content)).alias("_lines"))
    rows = split.select("*", F.posexplode("_lines").alias("_at", "line")).filter(F.col("line").contains(name))
    ext = extension(F.col(path))
    hits = F.array(*(F.when((ext == e) & F.col("line").rlike(p.replace("{name}", quoted)), F.lit(k)) for e, ps in DEFINITIONS.items() for k, p in enumerate(ps)))
    found = rows.withColumn("pattern", F.explode(F.array_compact(hits)))
    start = F.greatest(F.col("_at") - SETTINGS.snippet_before, F.lit(0))
    size = F.least(F.col("_at") + 1 + SETTINGS.snippet_after, F.size("_lines")) - start
    snippet = F.array_join(F.transform(F.slice("_lines", start + 1, size), lambda x, i: numbered(x, i + start + 1)), "\n")
    return found.select(*(F.col(f"`{c}`") for c in kept), (F.col("_at") + 1).alias("line_no"), "line", "pattern", snippet.alias("snippet"))


def directory_entries(files: DataFrame, directory: str = "", path: str = "path", key: str = "repo_id") -> DataFrame:
    """key, name, path, type: what lies in one directory of each repository, directories first, then by name without case. Skipped directories are left out; a directory that isn't there gives no rows."""
    base = directory.strip("/")
    prefix = base + "/" if base else ""
    inside = files.filter(F.col(path).startswith(prefix)) if prefix else files.filter(F.col(path).isNotNull())
    rest = F.substring(F.col(path), len(prefix) + 1, 1 << 30) if prefix else F.col(path)
    split = F.split(rest, "/")
    entries = inside.select(key, F.element_at(split, 1).alias("name"), F.when(F.size(split) > 1, "directory").otherwise("file").alias("type")).filter(F.col("name") != "").distinct()
    shown = entries.filter(~in_skipped_dir(F.col("name"), "listing"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.col("type") != "directory", F.lower("name"), "name"))
    return shown.select(key, "name", F.concat(F.lit(prefix), F.col("name")).alias("path"), "type", order.alias("place"))


def tree_nodes(files: DataFrame, depth: int = SETTINGS.tree_depth, path: str = "path", key: str = "repo_id", size: str | None = None) -> DataFrame:
    """key, path, parent, name, type, depth, bytes, is_last of the nodes of each repository down to a depth. A node is last if no sibling follows, directories coming first."""
    split = parts(F.col(path))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(split), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(split, 1, i), "/").alias("path"), F.array_join(F.slice(split, 1, i - 1), "/").alias("parent"), F.element_at(split, i).alias("name"), (i < F.size(split)).alias("directory"), i.alias("depth")))
    shown = files.filter(F.col(path).isNotNull() & ~F.coalesce(F.arrays_overlap(F.slice(split, 1, F.size(split) - 1), F.array(*map(F.lit, _tree_skip()))), F.lit(False)))
    nodes = shown.select(key, F.explode(levels).alias("n"), (F.col(size) if size else F.lit(None).cast("long")).alias("_size"))
    nodes = nodes.groupBy(key, F.col("n.path").alias("path"), F.col("n.parent").alias("parent"), F.col("n.name").alias("name"), F.col("n.directory").alias("directory"), F.col("n.depth").alias("depth")).agg(F.max("_size").alias("_size"))
    siblings = Window.partitionBy(key, "parent").orderBy(~F.col("directory"), F.lower("name"), "name")
    last = F.lead("name").over(siblings).isNull()
    return nodes.select(key, "path", "parent", "name", F.when(F.col("directory"), "directory").otherwise("file").alias("type"), "depth", F.when(~F.col("directory"), F.col("_size")).alias("bytes"), last.alias("is_last"))


def _tree_skip() -> tuple[str, ...]:
    from loamstone.functions.paths import SKIP_DIRS

    return SKIP_DIRS["tree"]


def tree_text(nodes: DataFrame, key: str = "repo_id", most: int = SETTINGS.tree_lines) -> DataFrame:
    """key, text: the tree of each repository, drawn, cut after so many lines. Nodes are numbered first, so no more than the lines shown are brought together."""
    by_path = {r: F.col(r) for r in ("path", "parent", "is_last")}
    ancestors = nodes.select(key, by_path["path"].alias("a_path"), by_path["is_last"].alias("a_last"), F.when(F.col("type") == "directory", 0).otherwise(1).alias("a_kind"), F.lower("name").alias("a_low"), F.col("name").alias("a_name"))
    split = F.split("path", "/")
    chain = nodes.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.array_join(F.slice(split, 1, i), "/"))).alias("_level", "a_path"))
    joined = chain.join(ancestors, [key, "a_path"])
    lined = joined.groupBy(key, "path", "name", "type", "bytes", "is_last").agg(F.array_sort(F.collect_list(F.struct("_level", "a_kind", "a_low", "a_name", "a_last"))).alias("c"))
    stems = F.array_join(F.transform(F.slice("c", 1, F.size("c") - 1), lambda x: F.when(x["a_last"], "    ").otherwise("│   ")), "")
    tail = F.when(F.col("type") == "directory", F.concat(F.lit("📁 "), F.col("name"), F.lit("/"))).otherwise(F.concat(F.lit("📄 "), F.col("name"), F.when(F.col("bytes").isNotNull(), F.concat(F.lit(" ("), F.format_string("%.1f", F.col("bytes") / 1024), F.lit(" KB)"))).otherwise("")))
    drawn = lined.select(key, F.transform("c", lambda x: F.struct(x["a_kind"], x["a_low"], x["a_name"])).alias("sort"), F.concat(stems, F.when(F.col("is_last"), "└── ").otherwise("├── "), tail).alias("line"))
    numbered_lines = drawn.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("sort")))
    total = numbered_lines.groupBy(key).agg(F.max("n").alias("total"))
    few = numbered_lines.filter(F.col("n") < most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).join(total, key)
    body = F.concat(F.lit("📁 .\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return few.select(key, F.when(F.col("total") >= most, F.concat(body, F.lit(f"\n\n... (truncated, showing {most} of more entries)"))).otherwise(body).alias("text"))


def viewable(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files that may be shown: below their root and not too long, with language for display."""
    from loamstone.functions.paths import display_language

    fine = files.filter(is_safe(F.col(path)) & (F.octet_length(content) <= SETTINGS.view_bytes))
    return fine.withColumn("language", display_language(F.col(path)))


def test_command(files: DataFrame, path: str = "path", key: str = "repo_id") -> DataFrame:
    """key, command: how the tests of each repository are run, by the files in its root; null if nothing tells. Nothing is run."""
    root = F.when(F.size(parts(F.col(path))) == 1, file_name(F.col(path)))
    has = files.groupBy(key).agg(*(F.bool_or(F.coalesce(root.isin(*names), F.lit(False))).alias(f"_{i}") for i, (names, _) in enumerate(TEST_COMMANDS)))
    command: Column = F.lit(None).cast("string")
    for i, (_, text) in reversed(list(enumerate(TEST_COMMANDS))):
        command = F.when(F.col(f"_{i}"), text).otherwise(command)
    return has.select(key, command.alias("command"))
