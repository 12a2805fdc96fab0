"""Files that nobody on the project wrote by hand: generated, minified, vendored, or bulk data stored as source.

A file's chunks are brought together once and Re-Pair grammars inferred of its tokens, of its tokens with every literal as one
symbol (its skeleton), and of its literals alone (grammar.py). They decide: a grammar much smaller than what files of this size
and language have means that rules are used again and again, as a generator does; a file of little but literals that no rule
shortens is a blob, and a skeleton of few rules with literals in their slots is a table; and rules of the grammar that all files
share which are held by several repositories are vendored code. Paths and opening comments that say what a file is only add.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm import grammar as g
from loamstone.session import materialize, strip_clash

#: Directories that hold other people's code, and a library's name with its version as a directory.
VENDOR_PATH = re.compile(
    r"(?i)(?:^|/)(?:vendor|vendors|vendored|node_modules|jspm_packages|bower_components|third[_-]?party|3rd[_-]?party|godeps|_workspace|externals?|extern|deps|site-packages|pods)/|(?:^|/)[A-Za-z][\w.]*-v?\d+\.\d+(?:\.\d+)*/"
)
#: Directories and names that generators use.
GENERATED_PATH = re.compile(
    r"(?i)(?:^|/)(?:generated|__generated__|gen-src|autogen|autogenerated|generated-sources|codegen_out)/|(?:^|/)zz_|(?:\.pb\.(?:go|cc|h|c)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|rb)|outerclass\.java|\.tab\.[ch]|\.yy\.c|[._-](?:gen|generated|autogen)\.\w+|\.g\.(?:dart|cs)|\.designer\.cs)$"
)
#: Names that minifiers and bundlers give.
MINIFIED_PATH = re.compile(r"(?i)(?:[.-]min|\.bundle|\.chunk|\.prod|[.-]es5|\.packed)\.(?:js|mjs|cjs|css)$")
#: How an opening comment says that a file is generated. The comment starts with it; a comment about generators doesn't.
BANNER = re.compile(
    r"(?i)^\W{0,8}(?:@generated\b|<?auto-?generated\b|(?:code )?(?:automatically |machine[- ])?generated (?:by|from|automatically|with|using)\b|automatically generated\b|machine[- ]made\b|"
    r"(?:this|the) (?:file|code|module|class)(?: (?:was|is|has been))? (?:an? )?(?:automatically |auto-?|machine[- ])?(?:generated|created)\b)"
)
#: How an opening comment says that a file is somebody else's: that it's a copy, or a library's name and version with its licence or source.
THIRD_PARTY = re.compile(r"(?i)^\W{0,8}third[- ]party (?:copy|code|library|source|file)\b|\bvendored (?:copy|from)\b|\bcopied verbatim from\b|^\W{0,8}@?[\w./-]+ (?:version )?v?\d+\.\d+\.\d+\b.*(?:\bupstream\b|\blicen[cs]ed?\b|https?://)")
#: Comments by which generators mark what they wrote inside of a file.
MARKER = re.compile(r"(?im)^[ \t]*(?://|#|--|/\*+|\*|;|\"\"\"|''')[ \t]*(?:@generated\b|(?:auto-?|code )?generated (?:by|from)\b)[^\n]{0,80}$")
BUNDLER = re.compile(r"/\*\*\*\*\*\*/|/\*\*\*/ |__webpack_require__|\bparcelRequire\b|//[#@] sourceMappingURL=")
COMMENT_LINE = re.compile(r"^\s*(?://|#|--|/\*|<!--|\*|;|%|\"\"\"|''')")

#: A segment of a file by its lines, so that no file is one group of any size, and the bytes of a piece of a segment, cut at a
#: line's end. All features are sums over pieces, and what is expected of a grammar goes by the size of each piece.
LINES_PER_SEGMENT = 50_000
BLOCK = 8 << 20
#: Groups that rows without a repository, path or line are spread over, since they say nothing of a file.
LOOSE = 256
#: Bytes of files that are worked on at once at least, few enough for their arrays to stay in a processor's cache.
BATCH = 1 << 20
#: Rules of fewer tokens say nothing about where code comes from.
LEAST_RULE = 12

#: Decisions, all on sums over a file's parts.
REUSE = 0.7  # grammar size to what is expected at this size and language
MINIFIED_LINE, MINIFIED_SPACE, MINIFIED_CODE = 250, 0.1, 0.08  # characters a line, shares of space and of words of code
BLOB_CODE, BLOB_LITERAL, BLOB_GRAMMAR = 0.12, 0.45, 0.85  # shares of words of code and of literals, grammar size to tokens of the literals
TABLE_REUSE, TABLE_LITERAL = 0.6, 0.25  # the skeleton's grammar to what is expected, share of literals
COPY_SHARE, COPY_TOKENS = 0.4, 60  # share of a file's rules that other repositories hold, and their tokens
LEAST_BYTES = 200
#: What a grammar is expected to have: the median over all pieces of its size, and over all files of its language, each drawn to a
#: fixed one by so many pieces or files, so that small corpora are judged too. The fixed one is that of code written by hand.
SIZE_WEIGHT, LANGUAGE_WEIGHT = 20, 5

COUNTS = ("bytes", "lines", "spaces", "tokens", "grammar", "weight", "code", "literal", "skeleton", "skeleton_grammar", "literals", "literal_grammar", "rule_tokens", "markers", "banner", "third_party", "bundler")
FEATURES = "repo_id string, file_path string, segment long, " + ", ".join(f"{c} long" for c in COUNTS) + ", rules array<struct<symbol: long, tokens: int>>"
_RULE = pa.struct([("symbol", pa.int64()), ("tokens", pa.int32())])
_ARROW = pa.schema([("repo_id", pa.string()), ("file_path", pa.string()), ("segment", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("rules", pa.list_(_RULE))])

_OPAQUE = np.isin(np.arange(256), [43, 47, 61, *range(48, 58), *range(65, 91), *range(97, 123)])
_OPAQUE_RUN = 60
_QUOTES = (34, 39, 96)
_LITERAL = np.uint64(7)


def _opaque_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes lie in a run of letters and digits so long that it is no word."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], _OPAQUE[data].view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= _OPAQUE_RUN
    change = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long], -1)
    return np.cumsum(change)[:-1] > 0


def _merged(symbols: np.ndarray, owner: np.ndarray, literal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The skeleton of each sequence: neighbouring literals are one symbol, whatever they say."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = ~(literal[1:] & literal[:-1] & (owner[1:] == owner[:-1]))
    return np.where(literal, _LITERAL, symbols)[keep], owner[keep]


class _Part:
    __slots__ = ("repo", "path", "segment", "text", "banner", "third", "markers", "bundler")

    def __init__(self, key: tuple, text: bytes, signs: tuple[int, int, int, int]) -> None:
        self.repo, self.path, self.segment, _ = key
        self.text = text
        self.banner, self.third, self.markers, self.bundler = signs


#: What opens a comment of several lines at the start of a line, and what closes it.
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def _opening_comment(text: str) -> Iterator[tuple[str, str]]:
    """(line, the comment's line before it) of all comments before a file's first other line, however long, those inside of block comments too."""
    closing, before, at = None, "", 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end == -1 else end
        line, at = text[at:end], end + 1
        body = line.strip()
        if closing is None:
            if not body:
                before = ""
                continue
            if not COMMENT_LINE.match(line):
                return
            opening, closing = next((x for x in _BLOCKS if body.startswith(x[0])), ("", None))
            inside = body[len(opening) :]
        else:
            inside = body
        yield line, before
        before = body
        if closing is not None and closing in inside:
            behind = inside.split(closing, 1)[1].strip()
            closing = None
            if behind and not COMMENT_LINE.match(behind):
                return


def _signs(text: str, opens: bool) -> tuple[int, int, int, int]:
    """(banner, third-party mark, markers, bundler marks) of the text of a segment. opens: whether it starts the file."""
    banner = third = 0
    for line, before in _opening_comment(text) if opens else ():
        said = line.strip().lstrip("#/*-;!<% \"'")
        # a line of prose in a block comment may go on with the sentence of the line before it, and starts with nothing then
        goes_on = said[:1].islower() and before[-1:].isalnum() and not COMMENT_LINE.match(line)
        banner |= not goes_on and bool(BANNER.match(said))
        third |= bool(THIRD_PARTY.search(line))
    markers = len(MARKER.findall(text)) if "enerated" in text.lower() else 0
    bundler = len(BUNDLER.findall(text)) if "*/" in text or "//#" in text or "require" in text else 0
    return int(banner), int(third), markers, bundler


def _features(parts: list[_Part]) -> pa.RecordBatch:
    n = len(parts)
    data = np.frombuffer(b"\n".join(p.text for p in parts) + b"\n", dtype=np.uint8)
    offsets = np.cumsum([0] + [len(p.text) + 1 for p in parts])
    symbol, exact, start, length = g.tokenize(data)
    owner = np.searchsorted(offsets, start, side="right") - 1
    grammar, _ = g.repair(symbol, owner, n)
    newline = symbol == g.NEWLINE_SYMBOL
    quote = np.isin(symbol, np.array(_QUOTES, dtype=np.uint64))
    # inside quotes: an odd number of quotes before, in the line
    quotes = np.cumsum(quote)
    line = np.cumsum(newline)
    base = np.concatenate([[0], quotes[np.flatnonzero(newline)]])[line] if len(symbol) else quotes
    quoted = ((quotes - base) % 2 == 1) & ~quote
    number = symbol == 48
    opaque = _opaque_bytes(data)
    in_opaque = opaque[start] if len(start) else np.zeros(0, dtype=bool)
    wordy = symbol > 255
    literal = (quoted | number | in_opaque) & ~newline
    code = wordy & ~literal
    said = literal & (wordy | number)
    weigh = lambda mask: np.bincount(owner[mask], weights=length[mask], minlength=n).astype(np.int64)
    skeleton, skeleton_owner = _merged(symbol, owner, literal)
    skeleton_grammar, _ = g.repair(skeleton, skeleton_owner, n)
    literal_grammar, _ = g.repair(exact[said], owner[said], n)
    spaces = np.add.reduceat((g._CLASS[data] <= g.NEWLINE).astype(np.int64), offsets[:-1]) - 1
    ps, po, pt = g.corpus_rules(*g.line_symbols(symbol, owner))
    long = pt >= LEAST_RULE
    ps, po, pt = ps[long], po[long], pt[long]
    bounds = np.searchsorted(po, np.arange(n + 1))
    values = {
        "bytes": np.diff(offsets) - 1,
        "lines": np.bincount(owner[newline], minlength=n),
        "spaces": spaces,
        "tokens": np.bincount(owner, minlength=n),
        "grammar": grammar,
        "weight": weigh(~newline),
        "code": weigh(code),
        "literal": weigh(literal),
        "skeleton": np.bincount(skeleton_owner, minlength=n),
        "skeleton_grammar": skeleton_grammar,
        "literals": np.bincount(owner[said], minlength=n),
        "literal_grammar": literal_grammar,
        "rule_tokens": np.bincount(po, weights=pt, minlength=n).astype(np.int64),
        "markers": [p.markers for p in parts],
        "banner": [p.banner for p in parts],
        "third_party": [p.third for p in parts],
        "bundler": [p.bundler for p in parts],
    }
    rules = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(ps.view(np.int64)), pa.array(pt.astype(np.int32))], fields=list(_RULE)))
    return pa.RecordBatch.from_arrays([pa.array([p.repo for p in parts], pa.string()), pa.array([p.path for p in parts], pa.string()), pa.array([p.segment for p in parts], pa.int64()), *(pa.array(np.asarray(values[c], dtype=np.int64)) for c in COUNTS), rules], schema=_ARROW)


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > BLOCK:
        end = raw.rfind(b"\n", at, at + BLOCK) + 1
        end = end if end > at else at + BLOCK
        yield raw[at:end]
        at = end
    yield raw[at:]


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the files in rows that come by file and line (repo_id, file_path, segment, loose, start_line, content): one pass that holds a segment and a block at a time."""
    parts: list[_Part] = []
    held = 0
    key = None
    texts: list[str] = []
    opens = False

    def close() -> Iterator[_Part]:
        text = "\n".join(texts)
        signs = _signs(text, opens)
        for i, raw in enumerate(_pieces(text.encode("utf-8", "replace"))):
            # a mark of the first piece holds for all, whose rules are a library's then; other signs are counted once
            yield _Part(key, raw, signs if i == 0 else (0, signs[1], 0, 0))

    for batch in batches:
        for repo, path, segment, loose, line, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (repo, path, segment, loose) != key:
                if key is not None:
                    for p in close():
                        parts.append(p)
                        held += len(p.text)
                        if held >= BATCH:
                            yield _features(parts)
                            parts, held = [], 0
                key, texts, opens = (repo, path, segment, loose), [], line is None or line <= 3
            texts.append(text.replace("\r\n", "\n") if "\r" in text else text)
    if key is not None:
        parts += close()
    if parts:
        yield _features(parts)


def file_features(chunks: DataFrame) -> DataFrame:
    """Sums and rules of each piece of each file (FEATURES). Texts are moved once: a segment's rows meet as a set, which tasks build of their own rows first, so that repeated rows count once and many copies of one are no hot group. Rows without a repository, path or line are spread by their text."""
    rows = strip_clash(chunks, {c: c for c in ("repo_id", "file_path", "start_line", "content")}).filter(F.length("content") > 0)
    unplaced = F.col("repo_id").isNull() | F.col("file_path").isNull() | F.col("start_line").isNull()
    rows = rows.withColumns({"segment": F.coalesce(F.floor(F.col("start_line") / LINES_PER_SEGMENT), F.lit(0)).cast("long"), "loose": F.when(unplaced, F.pmod(F.xxhash64("content"), F.lit(LOOSE))).otherwise(F.lit(0)).cast("int")})
    files = rows.groupBy("repo_id", "file_path", "segment", "loose").agg(F.array_sort(F.collect_set(F.struct("start_line", "content"))).alias("rows"))
    placed = files.select("repo_id", "file_path", "segment", "loose", F.inline("rows"))
    return placed.mapInArrow(_read_files, FEATURES)


def _path_like(pattern: re.Pattern) -> Column:
    return F.coalesce(F.translate("file_path", "\\", "/").rlike(pattern.pattern), F.lit(False))


def _usual(tokens: Column) -> Column:
    """Grammar size to tokens of code written by hand, by its length."""
    return F.greatest(F.lit(0.4), 1 / (1 + F.pow(tokens / 1100, F.lit(0.85))))


def _size(tokens: Column) -> Column:
    """Half powers of two."""
    return F.floor(2 * F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def _expected(features: DataFrame) -> DataFrame:
    """features with expected and skeleton_expected: the grammar sizes usual for pieces of that size."""
    one = lambda kind, size, grammar: F.struct(F.lit(kind).alias("kind"), _size(F.col(size)).alias("size"), (F.col(grammar) / F.col(size)).alias("ratio"))
    ratios = features.filter("tokens > 0").select(F.inline(F.array(one(0, "tokens", "grammar"), one(1, "skeleton", "skeleton_grammar"))))
    medians = ratios.groupBy("kind", "size").agg(F.percentile_approx("ratio", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("n"))
    out = features
    for kind, size, name in ((0, "tokens", "expected"), (1, "skeleton", "skeleton_expected")):
        # a row for each half power of two that occurs, so never more than 128
        here = medians.filter(F.col("kind") == kind).select(F.col("size").alias("_size"), F.col("median").alias("_median"), F.col("n").alias("_n"))
        out = out.withColumn("_size", _size(F.col(size))).join(F.broadcast(here), "_size", "left")
        n = F.coalesce("_n", F.lit(0))
        ratio = (n * F.coalesce("_median", F.lit(0.0)) + SIZE_WEIGHT * _usual(F.col(size))) / (n + SIZE_WEIGHT)
        out = out.withColumn(name, F.col(size) * ratio).drop("_size", "_median", "_n")
    return out


def _by_language(sums: DataFrame) -> DataFrame:
    """sums with reuse and skeleton_reuse: grammar sizes to those expected at this size and language. A language whose files have smaller grammars than others is judged by its own; one whose files have larger ones by all."""
    name = F.regexp_extract(F.lower(F.coalesce("file_path", F.lit(""))), r"\.(\w+)$", 1)
    rel = sums.withColumns({"language": name, "reuse": F.col("grammar") / F.greatest("expected", F.lit(1e-9)), "skeleton_reuse": F.col("skeleton_grammar") / F.greatest("skeleton_expected", F.lit(1e-9))})
    known = rel.filter("tokens > 0").groupBy("language").agg(F.count(F.lit(1)).alias("_n"), *(F.percentile_approx(c, 0.5, 1000).alias(f"_{c}") for c in ("reuse", "skeleton_reuse")))
    own = lambda c: F.least(F.lit(1.0), (F.col("_n") * F.col(f"_{c}") + LANGUAGE_WEIGHT) / (F.col("_n") + LANGUAGE_WEIGHT))
    factors = known.select("language", own("reuse").alias("_reuse"), own("skeleton_reuse").alias("_skeleton"))
    joined = rel.join(factors, "language", "left")
    return joined.withColumns({"reuse": F.col("reuse") / F.coalesce("_reuse", F.lit(1.0)), "skeleton_reuse": F.col("skeleton_reuse") / F.coalesce("_skeleton", F.lit(1.0))}).drop("_reuse", "_skeleton", "language")


def _copies(features: DataFrame, files: DataFrame, marks: bool) -> DataFrame:
    """file, check of files of which enough lies in rules that several repositories hold, or that a file marked as a third party's holds.

    The repositories of a rule are counted by the least and the greatest of them, which tasks find for their own rows first; then
    files' rules meet the shared ones one to one, however often either occurs. No pair of files is built.
    """
    key = (F.xxhash64("repo_id", "file_path").alias("file"), F.hash("file_path", "repo_id").alias("check"))
    marked = _path_like(VENDOR_PATH) | (F.col("third_party") > 0) if marks else F.lit(False)
    held = features.select(F.xxhash64("repo_id").alias("repo"), marked.alias("marked"), F.explode("rules.symbol").alias("symbol"))
    if marks:
        # a mark stands in a file's first segment and holds for all; files of several segments are few
        later = features.filter("segment > 0").select(*key, F.xxhash64("repo_id").alias("repo"), "rules")
        later = later.join(files.filter("marked").select("file", "check"), ["file", "check"], "left_semi")
        held = held.unionAll(later.select("repo", F.lit(True), F.explode("rules.symbol")))
    shared = held.groupBy("symbol").agg(F.min("repo").alias("low"), F.max("repo").alias("high"), F.max("marked").alias("marked"))
    shared = shared.filter((F.col("low") != F.col("high")) | F.col("marked")).select("symbol")
    own = features.select(*key, F.explode("rules").alias("r")).select("file", "check", F.col("r.symbol").alias("symbol"), F.col("r.tokens").alias("tokens"))
    met = own.join(shared, "symbol", "left_semi").groupBy("file", "check").agg(F.sum("tokens").alias("shared")).filter(F.col("shared") >= COPY_TOKENS)
    return met


def file_reasons(chunks: DataFrame, marks: bool = True) -> DataFrame:
    """repo_id, file_path, reasons of each file that isn't hand-written: generated, minified, vendored, data.

    marks: whether paths and comments that say what a file is count too; without them the grammars alone decide. Code that lies in
    several repositories is vendored in all of them, since nothing tells where it is at home. A null repo_id or file_path is a key
    like others; a null path says nothing. Rows with null or empty content add nothing, files of such rows alone can't be judged
    and are none. Chunks of a file may overlap or have gaps. Empty tables give an empty result, other columns are ignored. The
    files' features are written to the shared folder, since they're used several times.
    """
    features = materialize(file_features(chunks))
    sums = _expected(features.drop("rules")).groupBy("repo_id", "file_path").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "expected", "skeleton_expected")))
    sums = _by_language(sums)
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    big = F.col("bytes") >= LEAST_BYTES
    said = lambda c: c if marks else F.lit(False)
    minified = big & (share("bytes", "lines") >= MINIFIED_LINE) & (share("spaces", "bytes") <= MINIFIED_SPACE) & (share("code", "weight") > MINIFIED_CODE)
    minified = minified | said(_path_like(MINIFIED_PATH) | (F.col("bundler") >= 3))
    literals = share("literal", "weight")
    blob = (share("code", "weight") <= BLOB_CODE) & (literals >= BLOB_LITERAL) & (share("literal_grammar", "literals") >= BLOB_GRAMMAR)
    # a language whose files are mostly tables doesn't make those less so that are mostly literals
    rows = (F.col("skeleton_reuse") <= TABLE_REUSE) & (literals >= TABLE_LITERAL) | (F.col("skeleton_grammar") <= TABLE_REUSE * F.col("skeleton_expected")) & (literals >= BLOB_LITERAL)
    data = big & (blob | rows)
    generated = big & (F.col("reuse") <= REUSE) & (share("bytes", "lines") < MINIFIED_LINE) & ~data
    generated = generated | said(_path_like(GENERATED_PATH) | (F.col("banner") > 0) | (F.col("markers") >= 2))
    marked = said(_path_like(VENDOR_PATH) | (F.col("third_party") > 0))
    key = (F.xxhash64("repo_id", "file_path").alias("file"), F.hash("file_path", "repo_id").alias("check"))
    judged = sums.select("repo_id", "file_path", "rule_tokens", generated.alias("generated"), minified.alias("minified"), data.alias("data"), marked.alias("marked"), *key)
    found = judged.join(_copies(features, judged, marks), ["file", "check"], "left")
    vendored = F.col("marked") | F.coalesce(F.col("shared") >= COPY_SHARE * F.col("rule_tokens"), F.lit(False))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in (("generated", F.col("generated")), ("minified", F.col("minified")), ("vendored", vendored), ("data", F.col("data"))))))
    return found.select("repo_id", "file_path", reasons.alias("reasons")).filter(F.size("reasons") > 0)
