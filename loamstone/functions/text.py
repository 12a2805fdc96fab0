"""Column functions on texts. They're compositions of built-in expressions and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.config import SETTINGS

#: White space at either end, by Unicode, with the four information separators.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
#: Prefix of a query for retrieval.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Lines that report progress and are no errors.
NOISE = r"(?i)(Updating files:|POST git-upload-pack|Cloning into|remote:|Receiving objects:|Resolving deltas:|Unpacking objects:|cmdline:)"
PERCENT_LINE = r"^[0-9]+%\s*\([0-9]+/[0-9]+\)$"
NO_ERROR_LINES = "Failed to clone repository. The repository may contain files with paths that are too long for this system."
#: Phrases by which an analysis asks for more.
NEED_PHRASES = ("need to read", "need to examine", "let me check", "i'll look at", "need more information", "insufficient context")


def strip(s: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(s, _ENDS, "")


def lines(s: Column) -> Column:
    """The lines, split at line feeds; a text without any is one line."""
    return F.split(s, "\n", -1)


def line_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + 1


def valid_utf8(raw: Column) -> Column:
    """Bytes as text, with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def hash16(s: Column, length: int = SETTINGS.hash_length) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, length)


def chunk_id(repo_id: Column, path: Column, start_line: Column) -> Column:
    return hash16(F.concat(repo_id, F.lit(":"), path, F.lit(":"), start_line.cast("string")))


def indent(line: Column) -> Column:
    """Leading blanks, a tab being four, up to the first other character."""
    return F.length(F.replace(F.regexp_extract(line, "^[ \\t]*", 0), F.lit("\t"), F.lit("    ")))


def token_estimate(s: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(s) / 4).cast("long")


def embedding_text(path: Column, language: Column, start: Column, end: Column, name: Column, kind: Column, content: Column) -> Column:
    """What is embedded of a chunk: a header of its place, then the content. A null or empty name has no line."""
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("Name: "), name, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\nLanguage: "), language, F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), named, F.lit("Type: "), kind, F.lit("\n---\n"), content)


def query_text(query: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), query)


def numbered(line: Column, number: Column) -> Column:
    """A line with its number in five places, or more if it needs them."""
    n = number.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.lit(5), F.length(n)), F.lit(" ")), F.lit(" | "), line)


def line_range(content: Column, start: Column | int, end: Column | int) -> Column:
    """Numbered lines start .. end of a text, from 1, both included; 0 leaves an end open. Null if the range is empty."""
    all_lines = lines(content)
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    first = F.greatest(F.when(start > 0, start).otherwise(1), F.lit(1))
    last = F.least(F.when(end > 0, end).otherwise(F.size(all_lines)), F.size(all_lines))
    body = F.transform(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), lambda line, i: numbered(line, i + first))
    return F.when(first <= last, F.array_join(body, "\n"))


def repo_name(url: Column) -> Column:
    """The last part of a URL's path without .git; unknown_repo if there is none."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.git$", "")
    return F.when(url.isNotNull(), F.when(last == "", "unknown_repo").otherwise(last))


def upload_name(url: Column) -> Column:
    """What stands behind the last slash, without any .git."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".git"), F.lit(""))


def collection_name(repo_id: Column) -> Column:
    return F.substring(F.concat(F.lit("repo_"), F.replace(repo_id, F.lit("-"), F.lit("_"))), 1, 63)


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percent, 99 at most, since 100 means stored; 0 of nothing."""
    return F.when(total > 0, F.least(F.floor(done / total * 100), F.lit(99))).otherwise(0).cast("int")


def chat_title(message: Column) -> Column:
    return F.substring(message, 1, SETTINGS.chat_title_chars)


def task_title(task: Column) -> Column:
    return F.concat(F.lit("Agent: "), F.substring(task, 1, SETTINGS.task_title_chars))


def renamed_title(title: Column) -> Column:
    """A new title, stripped and cut; null if it is blank."""
    bare = strip(title)
    return F.when(bare != "", F.substring(bare, 1, SETTINGS.title_chars))


def asks_for_more(analysis: Column) -> Column:
    low = F.lower(analysis)
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(p) for p in NEED_PHRASES)), F.lit(False))


def error_summary(raw: Column, most: int = SETTINGS.error_lines) -> Column:
    """The first few different lines of a message that are neither blank nor progress, joined; a fixed text if there are none. Works inside the row, in the order of the lines."""
    useful = F.filter(F.transform(F.split(raw, "\r\n|\n|\r", -1), strip), lambda x: (x != "") & ~x.rlike(NOISE) & ~x.rlike(PERCENT_LINE))
    distinct = F.array_distinct(useful)
    return F.when(F.size(distinct) == 0, NO_ERROR_LINES).otherwise(F.concat(F.lit("Clone failed: "), F.array_join(F.slice(distinct, 1, most), "; ")))


def occurrences(content: Column, needle: Column) -> Column:
    """How often needle occurs, without overlaps; an empty one counts once for each character and once more."""
    return F.when(F.length(needle) == 0, F.length(content) + 1).otherwise(((F.length(content) - F.length(F.replace(content, needle, F.lit("")))) / F.length(needle)).cast("int"))


def edit_once(content: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """(status, text): the one occurrence of old replaced. None is missing; several are ambiguous, and the text stays. Nothing is written anywhere."""
    n = occurrences(content, old)
    status = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("edited")
    return status, F.when(n == 1, F.replace(content, old, new)).otherwise(content)


def truncated(s: Column, most: int) -> Column:
    return F.substring(s, 1, most)


def answer_html(s: Column) -> Column:
    """A Markdown answer as HTML for display: fences, code, bold, italics, headings, lists, paragraphs. All signs of HTML in the text are escaped before anything is made of it, so nothing of it can become an element."""
    steps = (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        (r"(?m)^```(\w*)\n([\s\S]*?)\n?```$", "<pre><code class=\"language-$1\">$2</code></pre>"),
        (r"`([^`\n]+)`", "<code>$1</code>"),
        (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"),
        (r"\*([^*\n]+)\*", "<em>$1</em>"),
        (r"(?m)^### (.+)$", "<h4>$1</h4>"),
        (r"(?m)^## (.+)$", "<h3>$1</h3>"),
        (r"(?m)^# (.+)$", "<h2>$1</h2>"),
        (r"(?m)^(?:- |[0-9]+\. )(.+)$", "<li>$1</li>"),
        (r"((?:<li>[^\n]*</li>\n?)+)", "<ul>$1</ul>"),
        (r"\n\n", "</p><p>"),
        (r"\n", "<br/>"),
    )
    for pattern, replacement in steps:
        s = F.regexp_replace(s, pattern, replacement)
    return F.concat(F.lit("<p>"), s, F.lit("</p>"))


def edit_lines(s: Column) -> Column:
    """How many lines a replaced text takes: its line feeds and one."""
    return F.regexp_count(s, F.lit("\n")) + 1
