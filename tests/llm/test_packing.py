import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamstone.llm import packing as P

needs_vocabulary = pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary here")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.floats(0, 1)), max_size=60), st.integers(1, 10))
def test_pack_keeps_every_limit(items, segments):
    tokens = np.array([t for t, _ in items], dtype=np.int64)
    loss = (tokens * np.array([x for _, x in items])).astype(np.int64) if items else tokens
    limits = P.Limits(100, segments, 0.9)
    box, n = P.pack(tokens, loss, 100, limits)
    assert (box >= 0).all() and (not items or box.max() == n - 1)
    for b in range(n):
        own = box == b
        assert tokens[own].sum() <= 100 and own.sum() <= segments
        assert loss[own].sum() <= 90 or own.sum() == 1


def test_fill():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 400, 2000)
    _, n = P.pack(tokens, tokens, 1000, P.Limits(segment_tokens=1, loss_share=1.0))
    assert n <= np.ceil(tokens.sum() / 1000) * 1.01 + 1


def test_cut_only_what_is_too_long():
    ids, piece, size, loss = P._cut(np.array([1, 2, 3]), np.array([5, 10, 25]), np.array([5, 4, 20]), 10)
    assert list(zip(ids, piece, size, loss, strict=True)) == [(1, 0, 5, 5), (2, 0, 10, 4), (3, 0, 10, 5), (3, 1, 10, 10), (3, 2, 5, 5)]


@needs_vocabulary
def test_frame(spark):
    texts = ["word " * (i % 50 + 1) for i in range(300)] + ["long word " * 3000, None, "", "one\ntwo three"]
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS tokens", "'x' AS container").repartition(3)
    budgets = spark.createDataFrame([(1, "a", 64), (2, "b", 500), (2, "b", 500), (3, "c", None), (4, "d", 0)], "budget_id int, label string, capacity_tokens int")
    placed = P.containers(docs, budgets).cache()
    sums = placed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("piece").alias("p"))
    assert sums.filter("budget_id = 1 AND t > 64 OR budget_id = 2 AND t > 500 OR n > 12").count() == 0
    assert sorted(r.budget_id for r in placed.select("budget_id").distinct().collect()) == [1, 2]
    total = P.measured(docs).agg(F.sum("tokens")).first()[0]
    assert {r[1] for r in placed.groupBy("budget_id").agg(F.sum("tokens")).collect()} == {total}
    assert placed.filter("budget_id = 2 AND piece > 0").select("item_id").distinct().collect() == [(300,)]
    assert placed.filter("item_id IS NULL AND budget_id = 1").count() == 1
    report = {r.budget_id: r for r in P.fill_report(placed, budgets).collect()}
    assert report[2].fill > 0.7 and report[2].containers >= report[2].least
    assert P.containers(docs.limit(0), budgets).count() == 0 and P.containers(docs, budgets.limit(0)).count() == 0


@needs_vocabulary
def test_long_texts_are_counted_in_parts_with_the_same_tokens(monkeypatch):
    enc = P.encoder(P.VOCABULARY, P.PATTERN)
    rng = np.random.default_rng(4)
    pieces = ["some", " words", "  ", "\n", "\t", "it's", "1234", " 5", "é", "中文", "...", " (", ")", " ", "\n\n  x"]
    texts = ["".join(rng.choice(pieces, 400)) for _ in range(60)]
    whole = [len(enc.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(P, "PART", 50)
    assert [P.count_tokens(t, enc) for t in texts] == whole
    assert P.count_tokens("x" * 450_000, enc) > 0


def test_loss_and_segments_bind():
    rng = np.random.default_rng(6)
    tokens = rng.integers(5, 300, 3000)
    loss = (tokens * rng.choice([0.8, 0.9, 1.0, 1.0], 3000)).astype(int)
    limits = P.Limits(segment_tokens=100, loss_share=0.93)
    box, n = P.pack(tokens, loss, 1000, limits)
    sums, held = np.bincount(box, weights=loss), np.bincount(box)
    assert (sums >= 900).mean() > 0.2 and (held == 10).any() and (sums <= 930).all() and (held <= 10).all()
    free, m = P.pack(tokens, loss, 1000, P.Limits(segment_tokens=1, loss_share=1.0))
    assert (np.bincount(free, weights=loss) > 930).any() and n <= m * 1.1


def test_prompt():
    assert P.prompt_of("title\nbody\nmore") == "title\n" and P.prompt_of("only") == "" and P.prompt_of("> said") == "> said"
    assert P.prompt_of("title\n> said\nanswer\n  > more\na > b") == "title\n> said\n  > more\n"
