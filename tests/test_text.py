import hashlib

from pyspark.sql import functions as F

from loamstone.functions import paths, text


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def values(spark, xs, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, {schema}").orderBy("i").select(f(F.col("x"))).collect()]


def test_repo_names(spark):
    urls = ["https://h/o/r.git/", "https://h/", "https://h/o/r", None, "https://h/o/r.git?x=1", ""]
    assert values(spark, urls, text.repo_name) == ["r", "unknown_repo", "r", None, "r", "unknown_repo"]
    assert values(spark, ["a/b.git.git", "x"], text.upload_name) == ["b", "x"]
    assert values(spark, ["a-b-" + "c" * 80], text.collection_name) == [("repo_a_b_" + "c" * 80)[:63]]


def test_strip_is_unicode(spark):
    assert values(spark, ["\u00a0\t a b \u2003\x1f", "", None], text.strip) == ["a b", "", None]


def test_indent_and_lines(spark):
    assert values(spark, ["\t\t x", "x", "  y", ""], text.indent) == [9, 0, 2, 0]
    assert values(spark, ["", "a", "a\n", "a\nb"], text.line_count) == [1, 1, 2, 2]


def test_hash_and_chunk_id(spark):
    want = hashlib.sha256(b"r:a/b.py:7").hexdigest()[:16]
    assert one(spark, "r string, p string, s int", ("r", "a/b.py", 7), text.chunk_id(F.col("r"), F.col("p"), F.col("s"))) == (want,)


def test_line_range(spark):
    body = "a\nb\nc"
    got = lambda a, b: one(spark, "x string", (body,), text.line_range(F.col("x"), a, b))[0]
    assert got(2, 0) == "    2 | b\n    3 | c"
    assert got(0, 1) == "    1 | a"
    assert got(5, 9) is None
    assert got(3, 2) is None


def test_error_summary(spark):
    raw = "Cloning into 'x'\nfatal: a\n\n 12% (1/9)\nfatal: a\nb\nc\nd\ne\nf"
    assert values(spark, [raw, "remote: x\n", ""], text.error_summary) == ["Clone failed: fatal: a; b; c; d; e", text.NO_ERROR_LINES, text.NO_ERROR_LINES]


def test_edit_once(spark):
    status, edited = text.edit_once(F.col("x"), F.lit("ab"), F.lit("Z"))
    rows = spark.createDataFrame([(0, "xaby"), (1, "xy"), (2, "abab")], "i int, x string").orderBy("i").select(status, edited).collect()
    assert [tuple(r) for r in rows] == [("edited", "xZy"), ("missing", "xy"), ("ambiguous", "abab")]


def test_progress(spark):
    rows = spark.createDataFrame([(0, 0), (1, 3), (3, 3)], "a int, b int")
    assert sorted(r[0] for r in rows.select(text.progress_percent(F.col("a"), F.col("b"))).collect()) == [0, 33, 99]


def test_invalid_utf8(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xc3(b"),)], "b binary")
    assert raw.select(text.valid_utf8(F.col("b"))).first()[0] == "a\ufffd(b"


def test_extension_language_and_filters(spark):
    names = [".env", "a.min.js", "test_x.py", "x_test.go", "Foo.PY", "a.tsx", "docs/a.py", "a.unknown", "LICENSE"]
    assert values(spark, names, paths.extension) == ["", ".js", ".py", ".go", ".py", ".tsx", ".py", ".unknown", ""]
    reasons = values(spark, names, lambda c: paths.skip_reason(c, F.lit(10)))
    assert reasons == ["name", "built", "test", "test", None, None, "directory", "extension", "name"]
    assert values(spark, ["a.py"], lambda c: paths.skip_reason(c, F.lit(102_401))) == ["size"]
    assert values(spark, ["a.py"], lambda c: paths.skip_reason(c, F.lit(102_400), F.lit("1\n2\n3\n4"))) == ["lines"]
    assert values(spark, ["a.py"], lambda c: paths.skip_reason(c, F.lit(102_400), F.lit("1\n2\n3\n4\n5"))) == [None]


def test_paths_stay_below_their_root(spark):
    got = values(spark, ["a/b", "../a", "a/../../b", "a/../b", "/a", "C:\\x", "a\\b", None], paths.is_safe)
    assert got == [True, False, False, True, False, False, True, False]
    assert one(spark, "p string, r string", ("/r/ab/c", "/r/a"), paths.relative(F.col("p"), F.col("r"))) == ("/r/ab/c",)
    assert one(spark, "p string, r string", ("/r/a\\c", "/r/a/"), paths.relative(F.col("p"), F.col("r"))) == ("c",)


def test_html_is_escaped(spark):
    got = values(spark, ["**a** <script>x</script>\n\n- b\n- c\n\n```js\nx < 1\n```"], text.answer_html)
    assert got == ['<p><strong>a</strong> &lt;script&gt;x&lt;/script&gt;</p><p><ul><li>b</li><br/><li>c</li><br/></ul><br/><pre><code class="language-js">x &lt; 1</code></pre></p>']
    assert values(spark, ["a\nb", ""], text.edit_lines) == [2, 1]
