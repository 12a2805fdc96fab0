import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.operators import chunking


def windows(spark, n, size=50, overlap=10):
    files = spark.createDataFrame([("\n".join(map(str, range(1, n + 1))),)], "content string")
    return [(r.start_line, r.end_line) for r in chunking.sliding_windows(files, size, overlap).orderBy("start_line").collect()]


@pytest.mark.parametrize(("n", "want"), [(1, [(1, 1)]), (49, [(1, 49)]), (50, [(1, 50)]), (51, [(1, 50), (41, 51)]), (90, [(1, 50), (41, 90)]), (91, [(1, 50), (41, 90), (81, 91)])])
def test_windows(spark, n, want):
    assert windows(spark, n) == want


def test_windows_of_blank_and_null_texts(spark):
    files = spark.createDataFrame([("\n\n",), (None,), ("",)], "content string")
    assert chunking.sliding_windows(files).count() == 0


def scan(lines, python):
    """The structural rule, written as a scanner."""
    out, i = [], 0

    def kind(line):
        s = line.lstrip()
        starts = ("class ", "def ", "async def ") if python else ("function ", "async function ", "export function ", "export async function ", "export class ", "class ")
        return s.startswith(starts)

    def depth(line):
        n = 0
        for c in line:
            if c == " ":
                n += 1
            elif c == "\t":
                n += 4
            else:
                break
        return n

    while i < len(lines):
        if not kind(lines[i]):
            i += 1
            continue
        base, j = depth(lines[i]), i + 1
        while j < len(lines):
            s = lines[j].strip()
            if s and not s.startswith(("#", "//")) and depth(lines[j]) <= base and (python or kind(lines[j])):
                break
            j += 1
        out.append((i + 1, j))
        i = j
    return out


LINE = st.builds(lambda d, b: " " * d + b, st.integers(0, 4), st.sampled_from(["def a(x):", "class B:", "x = 1", "# c", "// c", "", "function f() {", "export class C {", "}", "async def z():", "async function q() {"]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(LINE, max_size=14), min_size=1, max_size=25))
def test_fold_is_the_scanner(spark, files):
    rows = [(i, "\n".join(f), lang) for i, f in enumerate(files) for lang in ("python", "javascript")]
    df = spark.createDataFrame(rows, "i int, content string, language string")
    got = {}
    for r in chunking.structural_chunks(df).collect():
        got.setdefault((r.i, r.language), []).append((r.start_line, r.end_line))
    for i, f in enumerate(files):
        for lang in ("python", "javascript"):
            assert sorted(got.get((i, lang), [])) == scan("\n".join(f).split("\n"), lang == "python")


def test_python_golden(spark):
    text = "import os\n@dec\ndef a(x):\n    # c\n    return 1\n\nclass B(C):\n    def m(self):\n        pass\n\nasync def c(\n    x,\n):\n    return 2\nprint(1)"
    df = spark.createDataFrame([(text, "python")], "content string, language string")
    got = [(r.start_line, r.end_line, r.chunk_type, r.name) for r in chunking.structural_chunks(df).orderBy("start_line").collect()]
    assert got == [(3, 6, "function", "a"), (7, 10, "class", "B"), (11, 12, "function", "c")]


def test_every_file_is_cut_one_way(spark):
    rows = [("r", "a.py", "python", "x = 1\ny = 2"), ("r", "b.py", "python", "def f():\n    pass"), ("r", "c.md", "text", "hello"), ("r", "d", None, "def f():\n  x"), ("r", "e.py", "python", None)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")
    got = sorted((r.file_path, r.chunk_type) for r in chunking.chunk_files(df).collect())
    assert got == [("a.py", "block"), ("b.py", "function"), ("c.md", "block"), ("d", "block")]


def test_windows_cover_and_overlap(spark):
    for _ in range(3):
        n, size, overlap = random.randint(1, 200), random.randint(3, 30), random.randint(0, 2)
        w = windows(spark, n, size, overlap)
        assert w[0][0] == 1 and w[-1][1] == n
        assert all(a[1] - b[0] + 1 == overlap for a, b in zip(w, w[1:], strict=False))
