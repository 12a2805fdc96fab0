import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import grammar as G
from loamstone.llm import handwritten as H

RNG = random.Random(4)
WORDS = [a + b.title() for a in ("warm", "cold", "raw", "lazy", "safe", "open", "next", "prev") for b in ("row", "queue", "lease", "index", "page", "span", "rule", "plan", "tree", "batch")]


def hand(n=40):
    w = lambda: RNG.choice(WORDS)
    forms = (lambda: f"let {w()} = {w()}({w()}, {w()});", lambda: f"if ({w()} && !{w()}) return {w()};", lambda: f"for (const {w()} of {w()}) {w()}({w()});", lambda: f"{w()}.push({w()} + {w()});", lambda: f"// {w()} comes before {w()}")
    return "\n".join(RNG.choice(forms)() for _ in range(n))


def getters(n=12):
    return "\n\n".join(f"func (x *Store) GetF{i}() string {{\n\tif x != nil {{ return x.F{i} }}\n\treturn \"\"\n}}" for i in range(n))


LIBRARY = hand(60)
CHANGED = LIBRARY.replace(LIBRARY.split("\n")[20], "let other = changed(line);")
FILES = {
    ("r1", "core/a.js"): None, ("r1", "core/b.js"): None,
    ("r1", "vendor/lib/x.js"): "vendored", ("r2", "src/util/x.js"): "vendored", ("r3", "src/own.js"): None, ("r1", "lib-1.2.3/y.js"): "vendored", ("r1", "vendor_portal/z.js"): None,
    ("r1", "core/get.go"): "generated", ("r1", "core/x.pb.go"): "generated", ("r1", "core/banner.js"): "generated", ("r1", "core/talks.js"): None, ("r1", "core/generator.js"): None, ("r1", "a\\generated\\b.js"): "generated",
    ("r1", "web/app.js"): "minified", ("r1", "web/x.min.css"): "minified", ("r1", "web/pack.js"): "minified",
    ("r1", "core/table.py"): "data", ("r1", "core/seed.sql"): "data", ("r1", "core/blob.js"): "data", ("r1", "core/some.py"): None,
}
TEXTS = {
    "core/get.go": getters(), "vendor/lib/x.js": LIBRARY, "src/util/x.js": CHANGED, "core/banner.js": "// Code generated by tool v1. DO NOT EDIT.\n" + hand(), "core/talks.js": "// Writes the DO NOT EDIT banner for generated clients.\n" + hand(),
    "web/app.js": ";".join(f"function {a}(x,y){{return x.{b}?y(x):void 0}}" for a in "abcdefgh" for b in WORDS[:9]), "web/x.min.css": ".a{b:c}", "web/pack.js": "/******/ (function(m) {\n" + "\n".join(f'/***/ "./a{i}.js":\n' + hand(3) for i in range(4)),
    "core/table.py": "T = [\n" + "\n".join(f"  {RNG.randrange(10**6)}, {RNG.random():.6f}, {RNG.randrange(10**6)}," for _ in range(60)) + "\n]", "core/seed.sql": "\n".join(f"INSERT INTO t VALUES ({i}, 'w{RNG.randrange(99)}', {RNG.randrange(10**5)});" for i in range(40)),
    "core/blob.js": 'x = "' + '",\n"'.join("".join(RNG.choice("abcXYZ0189+/") for _ in range(90)) for _ in range(20)) + '"', "core/some.py": "def f(a):\n    x = [1, 2, 3]\n    return a.b(x)\n" * 2 + hand(10),
}


def frame(spark, size=10, **extra):
    rows = []
    for repo, path in FILES:
        lines = TEXTS.get(path) or hand()
        lines = lines.split("\n")
        rows += [(f"{repo}{path}{i}", repo, path, "\n".join(lines[i : i + size]), i + 1) for i in range(0, len(lines), size)]
    RNG.shuffle(rows)
    return spark.createDataFrame(rows + rows[:30], "chunk_id string, repo_id string, file_path string, content string, start_line int").selectExpr("*", "1 AS tokens", "'x' AS symbol", "2 AS file", "3 AS segment", "'d' AS digest")


def test_reasons(spark):
    got = {(r.repo_id, r.file_path): list(r.reasons) for r in H.file_reasons(frame(spark)).collect()}
    for key, want in FILES.items():
        assert got.get(key, []) == ([want] if want else []), (key, got.get(key))


def test_nulls_and_empty(spark):
    rows = [("1", None, None, "x", None), ("2", "r", None, None, 1), ("3", "r", "vendor/a.py", "", 1), ("4", None, "vendor/b.py", "x = 1", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, content string, start_line int")
    assert [(r.repo_id, r.file_path, list(r.reasons)) for r in H.file_reasons(df).collect()] == [(None, "vendor/b.py", ["vendored"])]
    assert H.file_reasons(df.limit(0)).count() == 0


def test_segments_and_long_texts(spark):
    rows = [(str(i), "r", "core/get.go", getters(40), i * 60_000 + 1) for i in range(3)] + [("9", "r", "core/long.js", "a(b);" * 1_200_000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, content string, start_line int")
    got = {r.file_path: list(r.reasons) for r in H.file_reasons(df).collect()}
    assert got == {"core/get.go": ["generated"], "core/long.js": ["minified"]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(300, 304), max_size=40), min_size=1, max_size=5))
def test_grammars_are_never_longer(sequences):
    s = np.array([x for q in sequences for x in q], dtype=np.uint64)
    o = np.repeat(np.arange(len(sequences)), [len(q) for q in sequences])
    size, rules = G.repair(s, o, len(sequences))
    assert all(size <= np.array([len(q) for q in sequences]) + 2 * rules)


def test_repetition_shrinks():
    q = np.tile(np.arange(300, 316, dtype=np.uint64), 64)
    size, _ = G.repair(q, np.zeros(len(q), dtype=int), 1)
    assert size[0] < 120


def test_tokens():
    data = np.frombuffer("a1 = foo_2(12, 'é')\n b".encode(), dtype=np.uint8)
    symbol, exact, start, length = G.tokenize(data)
    words = [bytes(data[s : s + n]).decode(errors="replace") for s, n in zip(start, length, strict=True)]
    assert words == ["a1", "=", "foo_2", "(", "12", ",", "'", "é", "'", ")", "\n", "b"]
    other, whole, _, _ = G.tokenize(np.frombuffer(b"a7 = foo_9", dtype=np.uint8))
    assert list(other) == list(symbol[:3]) and whole[1] == exact[1] and whole[0] != exact[0] and whole[2] != exact[2]
    long = [G.tokenize(np.frombuffer(b"a" * 80 + end, dtype=np.uint8))[0][0] for end in (b"bc", b"cb")]
    assert long[0] != long[1]


def test_shared_rules_survive_a_changed_line():
    def parsed(text):
        s = G.tokenize(np.frombuffer(text.encode(), dtype=np.uint8))[0]
        symbols, _, tokens = G.corpus_rules(*G.line_symbols(s, np.zeros(len(s), dtype=int)))
        assert tokens.sum() == (s != G.NEWLINE_SYMBOL).sum()
        return dict(zip(symbols.tolist(), tokens.tolist(), strict=True))

    a, b, inside = parsed(LIBRARY), parsed(CHANGED), parsed(hand(30) + "\n" + LIBRARY + "\n" + hand(30))
    for other in (b, inside):
        assert sum(a[s] for s in a.keys() & other.keys()) >= 0.6 * sum(a.values())


def test_long_runs_are_done_soon():
    for q in ([300] * 100_000, [300, 301] * 50_000, [300, 301, 302] * 30_000):
        s = np.array(q, dtype=np.uint64)
        assert G.repair(s, np.zeros(len(s), dtype=int), 1)[0][0] < 80


COPIED = {("r5", "src/one.js"): hand(60), ("r6", "core/two.js"): None, ("r5", "src/mine.js"): hand(60), ("r6", "src/theirs.js"): hand(60)}
COPIED["r6", "core/two.js"] = COPIED["r5", "src/one.js"].replace("{", "{", 1)


def test_unmarked_copies_in_two_repositories(spark):
    rows = [("x", r, p, t, 1) for (r, p), t in COPIED.items()] + [("y", "r5", "lib/again.js", COPIED["r5", "src/mine.js"], 1)]
    df = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, content string, start_line int")
    for marks in (True, False):
        got = {(r.repo_id, r.file_path): list(r.reasons) for r in H.file_reasons(df, marks).collect()}
        assert got == {("r5", "src/one.js"): ["vendored"], ("r6", "core/two.js"): ["vendored"]}  # a copy inside of one repository is nobody else's


def test_grammars_decide_without_marks(spark):
    got = {(r.repo_id, r.file_path): list(r.reasons) for r in H.file_reasons(frame(spark), marks=False).collect()}
    assert {p: v for (r, p), v in got.items()} == {
        "core/get.go": ["generated"], "web/app.js": ["minified"], "core/table.py": ["data"], "core/seed.sql": ["data"], "core/blob.js": ["data"],
        "vendor/lib/x.js": ["vendored"], "src/util/x.js": ["vendored"],
    }


def test_pieces_of_a_long_text(spark, monkeypatch):
    assert b"".join(H._pieces(b"ab\n" * 50)) == b"ab\n" * 50
    monkeypatch.setattr(H, "BLOCK", 16)
    for raw in (b"", b"abc", b"ab\n" * 50, b"x" * 100, b"x" * 16):
        pieces = list(H._pieces(raw))
        assert b"".join(pieces) == raw and all(len(p) <= 16 for p in pieces)


def test_rows_without_a_place_are_spread(spark):
    rows = [("x", None, None, f"{hand(8)}\n// {i}", None) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, content string, start_line int")
    features = H.file_features(df.unionAll(df))
    assert features.count() > 100 and features.agg({"bytes": "sum"}).first()[0] > 300 * 100
    assert H.file_reasons(df).count() == 0


def test_counts_and_distinct_are_exact():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 4_000)], np.arange(3_000, dtype=np.uint64) % np.uint64(700), np.zeros(9, dtype=np.uint64), np.zeros(0, dtype=np.uint64)):
        _, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
        assert (G.counts(values) == n[inverse]).all()
        assert sorted(values[G.distinct(values)].tolist()) == np.unique(values).tolist()


def test_a_grammar_does_not_depend_on_the_others():
    rng = np.random.default_rng(6)
    texts = [b"x = f(a, b)\n" * 40, bytes(rng.integers(32, 127, 3_000).astype(np.uint8)), b"", b"get(1)\nset(2)\n" * 9, b"a"]
    symbols = [G.tokenize(np.frombuffer(t, dtype=np.uint8))[0] for t in texts]
    alone = [int(G.repair(s, np.zeros(len(s), dtype=np.int64), 1)[0][0]) for s in symbols]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in symbols])
    assert G.repair(np.concatenate(symbols), owner, len(texts))[0].tolist() == alone


LICENCE = "\n".join(f"// Line {i} of the licence, which goes on for long and grants nothing that anybody would want to have of it." for i in range(60))


def test_whole_opening_comment():
    code = "\nlet a = b(c);"
    assert H._signs(LICENCE + "\n\n// Code generated by x. DO NOT EDIT." + code, True)[0] == 1
    assert H._signs(LICENCE + "\n// Vendored from upstream." + code, True)[1] == 1
    assert H._signs("/*\n" + LICENCE.replace("// ", "") + "\nVendored from upstream.\n*/" + code, True)[1] == 1
    assert H._signs('"""\nA reader.\n\nGenerated by x.\n"""\na = 1', True)[0] == 1
    assert H._signs("/* Copyright. */" + code + "\n// Code generated by x. DO NOT EDIT.", True) == (0, 0, 1, 0)
    assert H._signs("/* Copyright. */ let a = b(c);\n// Vendored from upstream.", True)[:2] == (0, 0)
    assert H._signs('"""\nReads the files which are\ngenerated by x.\n"""\na = 1', True)[0] == 0


def test_library_of_several_segments(spark):
    later = hand(60)
    rows = [("1", "r1", "core/big.js", "// Vendored from upstream.\n" + hand(20), 1), ("2", "r1", "core/big.js", later, H.LINES_PER_SEGMENT + 1), ("3", "r2", "src/copy.js", later, 1), ("4", "r2", "src/own.js", hand(60), 1)]
    df = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, content string, start_line int")
    got = {r.file_path: list(r.reasons) for r in H.file_reasons(df).collect()}
    assert got == {"core/big.js": ["vendored"], "src/copy.js": ["vendored"]}
