"""Column functions on paths: names, extensions, languages, and which files are worth reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.functions.text import line_count

#: Extensions that are read.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".cpp", ".c", ".h", ".hpp", ".java", ".go", ".rs", ".html", ".css", ".scss", ".sql", ".proto", ".sh", ".bash")
#: File names that are skipped.
SKIP_NAMES = (
    "package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", ".env", ".env.example",
    ".env.local", ".gitignore", ".gitattributes", ".prettierrc", ".eslintrc", ".editorconfig", "LICENSE", "CHANGELOG.md", "CONTRIBUTING.md",
)
#: Endings of file names that are skipped, of built files and of tests.
SKIP_BUILT = (".min.js", ".min.css", ".bundle.js", ".chunk.js", ".map", ".d.ts")
SKIP_TESTS = (
    "Test.java", "Tests.java", "IT.java", "Spec.java", "_test.go", "_test.py", "test_.py", ".test.js", ".test.ts", ".test.jsx", ".test.tsx",
    ".spec.js", ".spec.ts", ".spec.jsx", ".spec.tsx", "_spec.rb",
)
#: Directories that are skipped, by what is done with them.
SKIP_DIRS = {
    "scan": (
        ".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".next", ".nuxt",
        "coverage", ".idea", ".vscode", "vendor", "target", "bin", "obj", "out", "public", "static", "assets", "images", "fonts",
        "migrations", ".github", "test", "tests", "__tests__", "spec", "specs", "e2e", "testdata", "test-fixtures", "testresources",
        "fixtures", "mocks", "mock", "__mocks__", "generated", "docs", "doc", "samples", "examples",
    ),
    "tree": (
        ".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".next", ".nuxt",
        "coverage", ".idea", ".vscode", "vendor", "target", "bin", "obj",
    ),
    "symbols": (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".next", "vendor", "target"),
    "listing": (".git", "__pycache__", "node_modules", ".venv", "venv"),
}
#: Language of each extension, for chunking and for display. The two disagree on purpose.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".cpp": "cpp", ".c": "c", ".h": "c",
    ".hpp": "cpp", ".java": "java", ".go": "go", ".rs": "rust", ".html": "html", ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell",
    ".bash": "shell", ".proto": "protobuf",
}
DISPLAY_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java", ".go": "go",
    ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".r": "r", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".less": "less",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".md": "markdown", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".ps1": "powershell", ".dockerfile": "dockerfile", ".toml": "toml",
}
#: Display languages that are highlighted by their own name; all others are highlighted as text.
HIGHLIGHTED = (
    "javascript", "typescript", "python", "java", "go", "rust", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "html", "css",
    "scss", "json", "yaml", "xml", "markdown", "bash", "sql",
)


def relative(path: Column, root: Column | None = None) -> Column:
    """The path below root, with slashes."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is None:
        return p
    base = F.concat(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(p, base), F.substring(p, F.length(base) + 1, F.length(p))).otherwise(p)


def parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def _mapped(ext: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit(default))


def language(path: Column) -> Column:
    return _mapped(extension(path), LANGUAGES, "text")


def display_language(path: Column) -> Column:
    return _mapped(extension(path), DISPLAY_LANGUAGES, "plaintext")


def highlight_language(display: Column) -> Column:
    """The highlighter's name of a display language; text for null and for what it doesn't know."""
    return F.when(display.isin(*HIGHLIGHTED), display).otherwise("text")


def in_skipped_dir(path: Column, profile: str = "scan") -> Column:
    """Whether a part of the path below the root, the name included, is skipped. Null paths are in none."""
    return F.coalesce(F.arrays_overlap(parts(path), F.array(*map(F.lit, SKIP_DIRS[profile]))), F.lit(False))


def is_safe(path: Column) -> Column:
    """Whether a relative path stays below its root: not absolute, and never above by its .. parts."""
    depth = F.aggregate(
        F.filter(parts(path), lambda x: ~x.isin("", ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")),
    )
    return F.coalesce((depth["least"] >= 0) & ~F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"^(/|[A-Za-z]:)"), F.lit(False))


def _ends_with(name: Column, endings: tuple[str, ...]) -> Column:
    return name.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def skip_reason(path: Column, size: Column, content: Column | None = None) -> Column:
    """Why a file isn't read: directory, name, built, test, extension, size, lines; null if it is. Cheap reasons come first, so content is looked at last."""
    name = file_name(path)
    reason = (
        F.when(in_skipped_dir(path), "directory")
        .when(name.isin(*SKIP_NAMES), "name")
        .when(_ends_with(name, SKIP_BUILT), "built")
        .when(_ends_with(name, SKIP_TESTS) | (name.startswith("test_") & name.endswith(".py")), "test")
        .when(~extension(path).isin(*EXTENSIONS), "extension")
        .when(size > SETTINGS.max_file_bytes, "size")
    )
    if content is not None:
        reason = reason.when(line_count(content) < SETTINGS.min_lines, "lines")
    return reason
