import random

import pytest

from loamstone.llm import leaks as L

RNG = random.Random(3)
VOCAB = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("amo", "eti", "uro", "ilan", "ode")]


def sentence(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, sentence(60)) for i in range(8)]
TEXTS = [(i, " ".join(w).capitalize() + ".") for i, w in ITEMS]


def leaked(text, items=TEXTS):
    a = L.SuffixAutomaton(items)
    return {a.ids[k]: v for k, v in a.leaked(text).items()}


def noise(n=40):
    return " ".join("zz" + RNG.choice(VOCAB) for _ in range(n))


@pytest.mark.parametrize("n", [11, 12, 30])
def test_twelve_words(n):
    text = f"{noise()} {' '.join(ITEMS[2][1][5 : 5 + n])} {noise()}"
    assert set(leaked(text)) == ({2} if n >= 12 else set())


@pytest.mark.parametrize(
    "join",
    [" \n", "\n> ", "\n// ", "\n * ", ", ", "** **", "</p> <p>", "&nbsp;", " ", ". ", "-- ", "\n# "],
)
def test_what_stands_between_words_does_not_count(join):
    assert set(leaked(f"{noise()} {join.join(w.upper() for w in ITEMS[1][1][:14])} {noise()}")) == {1}


def test_hyphens_and_inner_markup():
    w = ITEMS[3][1][:14]
    w[6] = w[6][:2] + "-\n> " + w[6][2:]
    assert set(leaked(" ".join(w))) == {3}
    assert set(leaked(" ".join(f"_{x}_" for x in ITEMS[3][1][:14]))) == {3}
    assert set(leaked("[" + "](a/b.md) [".join(ITEMS[3][1][:14]) + "](x)")) == {3}


@pytest.mark.parametrize(("every", "want"), [(5, True), (6, True), (3, False)])
def test_single_words_swapped(every, want):
    w = ["zz" if i % every == every - 1 else x for i, x in enumerate(ITEMS[4][1])]
    assert (4 in leaked(f"{noise()} {' '.join(w)} {noise()}")) == want


def test_words_added_and_dropped():
    w = []
    for i, x in enumerate(ITEMS[5][1]):
        if i % 10 == 3:
            continue
        w += [x, "added"] if i % 7 == 2 else [x]
    got = leaked(f"{noise()} {' '.join(w)} {noise()}")
    assert set(got) == {5} and 0.8 * 60 <= got[5][1] < 60


def in_order(item, words):
    row = [0] * (len(item) + 1)
    for w in words:
        before = 0
        for i, x in enumerate(item):
            before, row[i + 1] = row[i + 1], max(row[i + 1], row[i], before + 1 if w == x else 0)
    return row[-1]


@pytest.mark.parametrize("few", [0, 30_000])
def test_altered_passages_against_all_windows(few, monkeypatch):
    monkeypatch.setattr(L, "_FEW", few)
    rng = random.Random(11)
    item = [rng.choice(VOCAB) for _ in range(24)]
    a = L.SuffixAutomaton([(1, " ".join(item)), (2, " ".join(rng.choice(VOCAB) for _ in range(24)))])
    seen = set()
    for _ in range(150):
        passage = []
        for i, w in enumerate(item):
            x = rng.random()
            passage += [] if x < 0.12 else ["zz"] if x < 0.16 else [w, rng.choice(VOCAB)] if i % rng.choice((2, 3, 5)) == 0 else [w]
        text = [rng.choice(VOCAB) for _ in range(rng.randint(0, 30))] + passage + [rng.choice(VOCAB) for _ in range(rng.randint(0, 30))]
        most = int(len(item) * L.STRETCH)
        best = max(in_order(item, text[s : s + most]) for s in range(max(1, len(text) - most + 1)))
        got = {a.ids[k]: v for k, v in a.leaked(" ".join(text)).items()}
        if best >= L.SHARE * 24:
            assert 1 in got
            seen.add(True)
        elif in_order(item, text) < L.SHARE * 24 and (1 not in got or not got[1][0]):
            assert 1 not in got
            seen.add(False)
    assert seen == {True, False}


def test_a_word_added_after_every_second_one():
    w = [y for i, x in enumerate(ITEMS[5][1]) for y in ([x, "added"] if i % 2 else [x])]
    assert leaked(f"{noise()} {' '.join(w)} {noise()}").keys() == {5}


def test_memory_is_linear_in_the_items():
    import tracemalloc

    rng = random.Random(1)
    words = [f"w{i}" for i in range(20_000)]
    sizes = []
    for n in (500, 2_000):
        items = [(i, " ".join(words[int(rng.paretovariate(0.6)) % 20_000] for _ in range(50))) for i in range(n)]
        tracemalloc.start()
        a = L.SuffixAutomaton(items)
        sizes.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
        assert a.leaked(items[7][1])
    # 100,000 words: two million of them take less than a gigabyte
    assert sizes[1] < 5 * sizes[0] and sizes[1] * 20 < 1_000_000_000


def test_halves_far_apart_are_no_passage():
    w = [x for i, x in enumerate(ITEMS[6][1]) if i % 9]
    a, b = w[:26], w[26:]
    broken = lambda p: " ".join(x if i % 8 else "zz" for i, x in enumerate(p))
    assert leaked(f"{broken(a)} {noise(300)} {broken(b)}") == {}


def test_automaton_against_all_runs(monkeypatch):
    monkeypatch.setattr(L, "WORDS", 2)
    for _ in range(30):
        items = [(i, " ".join(RNG.choice("abc") for _ in range(RNG.randint(1, 15)))) for i in range(4)]
        a = L.SuffixAutomaton(items)
        text = [RNG.choice("abcd") for _ in range(30)]
        hits = list(a.stream([a.number.get(x, -1) for x in text]))
        got = {p: n for p, n, _ in hits}
        for p, n, state in hits:
            run = f" {' '.join(text[p - n + 1 : p + 1])} "
            assert a.items_at(state).tolist() == [i for i, s in items if run in f" {s} "]
        runs = {tuple(s.split()[i:j]) for _, s in items for i in range(len(s.split())) for j in range(i + 1, len(s.split()) + 1)}
        for p in range(len(text)):
            best = max((n for n in range(1, p + 2) if tuple(text[p - n + 1 : p + 1]) in runs), default=0)
            assert got.get(p, 0) == (best if best >= 2 else 0)


def test_positions_and_frame(spark):
    body = f"{noise()} <b>{' '.join(ITEMS[0][1][:20])}</b> {noise()}"
    docs = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, noise()), (None, body), (5, "zz " * 300_000 + body)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS longest")
    items = spark.createDataFrame([*TEXTS, TEXTS[0], (None, TEXTS[0][1]), (77, None), (78, " ")], "item_id long, text string")
    got = L.leaked_items(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id if r.item_id is not None else -1) for r in got) == [(0, -1), (0, 0), (1, -1), (1, 0), (5, -1), (5, 0)]
    r = next(r for r in got if r.doc_id == 1 and r.item_id == 0)
    assert body[r.start_pos - 1 : r.end_pos] == " ".join(ITEMS[0][1][:20]) and r.longest == 20
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_BLOCK_WORDS", 100)
    docs = spark.createDataFrame([(1, " ".join(ITEMS[0][1])), (2, " ".join(ITEMS[7][1]))], "doc_id long, text string")
    got = L.leaked_items(docs, spark.createDataFrame(TEXTS, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 7)]
