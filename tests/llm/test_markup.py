import pytest

from loamstone.llm.markup import clean_messages, clean_text, marked_up

MARKED = [
    "<p>See <code>a</code>.</p>", "a &lt; b &amp;&amp; c", "Line one<br/>two", "<H2 STYLE='color:#333'>Note</H2>", "# Overview\n\nText.", "## Next steps", "Cause\n=====\n\nText.", "- [x] done\n- [ ] open", "* one\n* two",
    "1. one\n2. two", "> quoted", "| a | b |\n| --- | ---: |\n| c | d |", "This is *not* it.", "~~gone~~ here", "__Foo proper__ here", "**bold**", "use `x` here", "[a](src/b.ts#L3)", "![alt](docs/a.png)", "```\nx\n```", "~~~go\nx := 1\n~~~",
    "== Usage ==\nText.", "See [[File:a.svg|thumb|the cache]].", "''emphasis'' here", "{{Note|text}}", "{| class=\"wikitable\"\n! a !! b\n|-\n| c || d\n|}", "\\section{Overview}\nText.", "\\emph{it} comes first", "\\begin{itemize}\n\\item a\n\\end{itemize}",
    "The cost is $O(v \\log v)$ here.", "\\[ T(n) = \\frac{n^2}{7} \\]", "$$ a = b $$", "Text.\n\n***\n\nMore.", "a<ref>b/c.ts</ref>", "x <!-- draft --> y",
]
PLAIN = [
    None, "", "   ", "Storage costs $5 per unit and $8 with replication.", "Set $HOME and $CACHE_DIR before it runs.", "The signature is List<String> f(Map<String, Integer> m).", "Use std::vector<int> where it took a pointer.",
    "a_b == c_d is evaluated for each row.", "2 * 44 * 37 workers were enough.", "Pass **kwargs through.", "The name f clashes with __init__ in a/b.rs.", "The guard reads a < b && c > d here.", "The pattern [a-z]+_(\\d+) matches each row.",
    "Issue #24 and issue #41 are one.", "The path was D:\\work\\next_job\\lazy_row.", "# expects a sorted row\nx = max(a, 1)\ny.append((b, 2))", "for f in repo/*.log; do\n  plan \"$f\"\ndone", "-- needs this for a row\nUPDATE x SET y = 1;", "if not a:\n    return None",
    "for _, x := range y {\n\trun(_)\n}", "a[0](b)", "x = {{1, 2}, {3}}", "if [[ -n \"$x\" ]]; then", "coalesce(a, '') || coalesce(b, '')", "AT&T; R&D;", "5 > 3 and 2 < 4",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    out, found = clean_text(text)
    assert found and out != text


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert clean_text(text) == (text, frozenset())


def test_structure_is_kept():
    text = "# Title\n\nSome **bold** text with $a^2$.\n\n- one\n- two\n\n```python\nx = '*'\n```\n\n| a | b |\n| - | - |\n| c | d |\n\n> said\n\n[link](http://h.test/x)"
    out, _ = clean_text(text)
    assert out == "Heading 1: Title\n\nSome bold text with ⟨a^2⟩.\n\n• one\n• two\n\nCode (python):\n    x = '*'\n\na\tb\nc\td\n\n│ said\n\nlink (http://h.test/x)"


def test_latex_and_html_blocks():
    assert clean_text("\\begin{verbatim}\nx = 1\n\\end{verbatim}")[0] == "Code:\n    x = 1"
    assert "Formula: E = mc^2" in clean_text("\\begin{equation}\nE = mc^2\n\\end{equation}")[0]
    assert clean_text('<pre><code class="language-python">a &lt; 1</code></pre>')[0] == "Code (python):\n    a < 1"
    assert [x for x in clean_text("<ul><li>a</li><li>b</li></ul>")[0].split("\n") if x] == ["• a", "• b"]


def test_long_text_and_open_blocks():
    assert clean_text("word " * 200_000)[1] == frozenset()
    assert clean_text("```\nopen")[0] == "Code:\n    open"
    assert clean_text("\\begin{itemize}\n\\item a")[1]


def test_frame(spark):
    rows = [("1", "**a**", "x"), ("1", "**a**", "x"), ("2", "a", "x"), ("3", None, "x"), (None, "`a`", "x")]
    df = spark.createDataFrame(rows, "id string, content string, message_id string")
    assert sorted((r.message_id or "", r.clean) for r in marked_up(df).collect()) == [("", "a"), ("1", "a")]
    assert sorted((r.message_id or "", r.clean or "") for r in clean_messages(df).collect()) == [("", "a"), ("1", "a"), ("2", "a"), ("3", "")]
    assert marked_up(df.limit(0)).count() == 0


LONG = "word " * 1_500


@pytest.mark.parametrize(
    "text",
    [
        f"**{LONG}end**", f"__{LONG}end__", f"~~{LONG}end~~", f"'''{LONG}end'''", f"`{LONG}end`", f"$$ x^2 = {LONG} $$", f"\\[ x^2 = {LONG} \\]", "so $x = " + "a + " * 200 + "b$ holds",
        "{|\n" + "|-\n| a || b\n" * 800 + "|}", "1. first\n" + "plain text\n" * 60 + "2. second",
    ],
)
def test_constructs_of_any_length(text):
    assert clean_text(text)[1] and clean_text(f"Before.\n\n{text}\n\nAfter.")[1]


@pytest.mark.parametrize("sign", ["**a ", "~~a ", "`` `", "$$", "\\[a ", "\\(a ", "''a ", "__a "])
def test_opening_signs_alone_take_linear_time(sign):
    import time

    began = time.perf_counter()
    clean_text(sign * 40_000)
    assert time.perf_counter() - began < 20


def test_repeats_of_pages(spark):
    import numpy as np

    from loamstone.llm import boilerplate as B

    rng = np.random.default_rng(2)
    for _ in range(40):
        pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 12))] for _ in range(4)]
        got = B.repeated(pages, 4)
        for k, page in enumerate(pages):
            others = {tuple(p[i : i + 4]) for j, p in enumerate(pages) if j != k for i in range(len(p) - 3)}
            want = [any(tuple(page[s : s + 4]) in others for s in range(max(0, i - 3), min(i, len(page) - 4) + 1)) for i in range(len(page))]
            assert got[k].tolist() == want
    foot = "This footer stands on each page of the host and says nothing of its own , ever and ever and ever ."
    rows = [("h", "1", f"Alpha beta.\n{foot}"), ("h", "2", f"{foot}\nGamma."), ("i", "3", foot), (None, "4", foot), ("h", "5", None), ("h", "6", "")]
    df = spark.createDataFrame(rows + rows[:1], "host string, id string, text string").selectExpr("*", "1 AS page_id", "2 AS parts")
    got = {r.page_id: (r.covered > 0, r.unique.strip()) for r in B.without_repeats(df, "host", "id", "text").collect()}
    assert got == {"1": (True, "Alpha beta."), "2": (True, "Gamma."), "3": (False, foot), "4": (False, foot)}
    assert B.without_repeats(df.limit(0), "host", "id", "text").count() == 0


def test_repeats_of_a_host_don_t_depend_on_its_parts(spark):
    import numpy as np

    from loamstone.llm import boilerplate as B

    rng = np.random.default_rng(5)
    texts = [(h, f"{h}{i}", " ".join(str(x) for x in rng.integers(0, 4, rng.integers(1, 30)))) for h in ("a", "b", None) for i in range(25)]
    texts += [("a", "equal", texts[0][2]), (None, None, texts[60][2]), ("c", "alone", texts[0][2])]
    want = {}
    for h, i, text in texts:
        words = text.split()
        others = {tuple(w[s : s + 4]) for g, j, t in texts if g == h and j != i for w in [t.split()] for s in range(len(w) - 3)}
        want[i] = sum(any(tuple(words[s : s + 4]) in others for s in range(max(0, k - 3), min(k, len(words) - 4) + 1)) for k in range(len(words)))
    df = spark.createDataFrame(texts, "host string, id string, text string")
    rows = [{(r.page_id, r.covered, r.unique) for r in B.without_repeats(df, "host", "id", "text", 4, n).collect()} for n in (20_000_000, 600, 1)]
    assert rows[0] == rows[1] == rows[2]
    assert {i: n for i, n, _ in rows[0]} == want and 0 < sum(want.values()) < sum(len(t.split()) for _, _, t in texts)


def test_fingerprints_tell_runs_of_words_in_any_part():
    import numpy as np

    from loamstone.llm import boilerplate as B

    rng = np.random.default_rng(6)
    pages = [[str(x) for x in rng.integers(0, 3, 400)] for _ in range(3)]
    one, other = B.run_prints(pages[:1], 4), B.run_prints([*pages[1:], ["x"], []], 4)
    runs = [{tuple(p[i : i + 4]) for p in some for i in range(len(p) - 3)} for some in (pages[:1], pages[1:])]
    assert [len(one), len(other)] == [len(r) for r in runs]
    assert B._among(one, other).sum() == len(runs[0] & runs[1])
    same = np.array([[1, 5], [1, 7], [2, 0]])
    assert B._among(np.array([[1, 7], [1, 6], [2, 0], [3, 0]]), same).tolist() == [True, False, True, False]
    assert len(B.run_prints([["x"], []], 4)) == 0
