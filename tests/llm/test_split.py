import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm.split import pieces, split_oversized

TEXT = st.lists(st.sampled_from(["a", "b ", "\n", "\r\n", "x" * 17, "def f():\n", ", ", "}\n", "\n\n", "é", "e\u0301"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_round_trip_and_limits(text):
    parts, cut = pieces(text, 40, 8)
    assert "".join(text[own:end] for _, own, end in parts) == text
    assert all(end - start <= 40 for start, _, end in parts)
    assert all(0 <= own - start <= 8 for start, own, _ in parts)
    if len(text) > 40:
        assert cut == (max(map(len, text.split("\n"))) > 40)


def test_cuts_at_definitions():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 130 + "\n" for i in range(4))
    parts, cut = pieces(text)
    assert not cut and len(parts) > 2
    assert sum(text[own:].startswith("def ") for _, own, _ in parts[1:]) >= 2


@pytest.mark.parametrize("n", [2048, 2049])
def test_a_line_of_the_limit_is_not_cut(n):
    text = "x" * n + "\n" + "y" * 30
    parts, cut = pieces(text)
    assert cut == (n > 2048) and all(e - s <= 2048 for s, _, e in parts)


def test_overlap_is_whole_lines():
    text = "".join(f"line {i} of this text\n" for i in range(400))
    parts, _ = pieces(text)
    for start, own, _ in parts[1:]:
        assert own > start and text[start - 1] == "\n" and own - start <= 200


def test_frame(spark):
    long = "a\n" * 1500
    rows = [("1", long, 10, 99), ("1", long, 10, 99), ("2", "short", 1, 1), ("3", None, 1, 1), ("4", "z" * 5000, None, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, start_line int, piece int")
    got = split_oversized(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id: r.cut for r in got} == {"1": "line", "4": "inner"}
    one = [r for r in got if r.chunk_id == "1"]
    assert one[0].start_line == 10 and one[-1].end_line == 10 + 1499
    assert "".join(r.content[r.overlap :] for r in one) == long
    for r in one:
        assert r.end_line - r.start_line + 1 == r.content.rstrip("\n").count("\n") + 1
    assert all(r.start_line is None for r in got if r.chunk_id == "4")
    assert split_oversized(df.limit(0)).count() == 0
