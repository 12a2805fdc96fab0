import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import defects as D


@pytest.mark.parametrize("a", [None, "", " \n\t", "\u200b", "\u00a0", "...", "…", "-", "N/A", "None", "null", "(no response)", "<no answer>", "[empty]"])
def test_empty(a):
    assert D.defect("What is it?", a) == "empty"


@pytest.mark.parametrize(
    "a",
    ["Why does foo_bar fail?", "You asked: Why does foo_bar fail?", "“why does foo_bar fail?”", "WHY DOES FOO_BAR FAIL?", "Why does foo_bar fail? Why does foo_bar fail?", "Why does foo_bar fail ."],
)
def test_copy(a):
    assert D.defect("Why does foo_bar fail?\n\nIt worked in 3.1 and the log shows nothing at all.", a) == "copy"


def test_quoting_the_question_is_no_copy():
    assert D.defect("Why does foo_bar fail?", "You asked: Why does foo_bar fail?\n\nThe lock is taken twice, once by the reader and once by the writer that follows.") is None


@pytest.mark.parametrize(
    "a",
    ["I'm sorry, but I can't help with that request.", "I must respectfully decline to explain foo.", "That request can’t be fulfilled by me, since it may be confidential.", "No, I can't do that.", "Lo siento, no puedo ayudar con esa petición.", "Es tut mir leid, dabei kann ich nicht helfen.", "Je suis désolé, je ne peux pas vous aider avec cette demande.", "很抱歉，我无法协助处理这个请求。", "Devo recusar qualquer resposta sobre foo."],
)
def test_refusal(a):
    assert D.defect("What does foo do?", a) == "refusal"


@pytest.mark.parametrize(
    "a",
    ["The scheduler declines requests that lack a row.", "No, foo can't be removed, because bar needs it.", "I can't see a second caller in the given context, so foo is used once.", "Unfortunately the poller is not allowed to write to foo, so it stays stale.", "foo can't help here, because it never sees the row.", "Sorry for the wait, foo is called from bar only.", "The rest follows in the next message.", "For safety reasons Foo rejects a blank row."],
)
def test_sound_answers_that_look_like_refusals(a):
    assert D.defect("What does foo do?", a) is None


@pytest.mark.parametrize("a", ["The reader opens the file and", "The reader opens (", "It is slow. The parser gives up at line 24,", "See this:\n\n```python\nx = 1\n", "<pre><code>x = 1", "\\begin{verbatim}\nx = 1.", "Nobody knows why it sorts by fresh_"])
def test_truncated(a):
    assert D.defect("What does the reader do here?", a) == "truncated"


@pytest.mark.parametrize("a", ["It does.\n\n```\nx = 1\n```", "It does.\n\n~~~go\nx := 1\n~~~", "| a | b |\n| --- | --- |\n| c | d |", "It does.\n\n- `a/b.py`\n- `c/d.py`", "<p>It does.</p>", "It does.\n\n\\begin{itemize}\n\\item One.\n\\end{itemize}", "It does (really).", "It “does.”", "是的，就是这样。"])
def test_whole_answers(a):
    assert D.defect(None, a) is None


def test_language():
    q, de = "What happens if the queue is empty and the lock is held?", "Das Verhalten ist gewollt, denn die Klasse darf ihre Daten nicht teilen."
    assert D.defect(q, de) == "language"
    assert D.defect(q + "\n\nPlease answer in German.", de) is None
    assert D.defect(q, "类 Foo 把状态保存在内存里，因此不需要再扫描一遍。") == "language"
    assert D.defect("  ", de) is None
    assert D.language("El componente lee las filas y las entrega al otro.") == "es"
    assert D.language("O componente lê as linhas e entrega tudo à classe, por isso não é necessário.") == "pt"
    assert D.language("Le composant lit les lignes et les transmet à la classe.") == "fr"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.lcs(list(map(str, a)), list(map(str, b))) == table[-1][-1]


def test_long_texts():
    long = "The reader opens the file and hands it on. " * 20_000
    assert D.defect(long, long) == "copy"
    assert D.defect("Why?", long) is None


def test_frame(spark):
    rows = [("1", "c", "user", "q?", 1), ("2", "c", "assistant", None, 2), ("3", "c", "assistant", None, 3), ("4", None, "user", "x", 1)]
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, s int").selectExpr("*", "timestamp_seconds(s) AS created_at", "'x' AS hash", "'y' AS next", "1 AS pos", "'z' AS question")
    got = [tuple(r) for r in D.defective_answers(df.unionAll(df)).collect()]
    assert got == [("2", "empty")]
    assert D.defective_answers(df.limit(0)).count() == 0


@pytest.mark.parametrize("a", ['The function returns "', "Set it to **", "The name is '", "It is called `", "Don't set it to '", 'It is "a" or "', 'It holds (["', "Siehe “"])
def test_ends_at_an_opening_mark(a):
    assert D.is_truncated(a)


@pytest.mark.parametrize("a", ['It is called " the reader "', "- **The reader **", "It is “read”", "- `a`, `b `", "The users’ call is \"foo()\" or \" x \""])
def test_ends_at_a_closing_mark(a):
    assert not D.is_truncated(a)


@pytest.mark.parametrize(
    "a",
    [
        "Thanks for asking. That touches the auth module. I cannot help with that.",
        "Thank you. You ask how foo sorts its rows. It belongs to the auth module. I must decline to explain foo.",
        "Given that the module which you name is one of those that hold the keys of the tenants, and that the people who look after it have asked for every question about it to go to them first and to nobody else before, I cannot help with that.",
        "Danke für die Frage. Es geht um das Modul. Dabei kann ich leider nicht helfen.",
        "The auth module signs each row. The keys lie in the vault. Sorry, this falls outside what I'm allowed to do.",
    ],
)
def test_refusal_behind_other_sentences(a):
    assert D.defect(None, a) == "refusal"


@pytest.mark.parametrize(
    "a",
    [
        "The lock is taken twice. The writer never gives it back. I cannot explain the second trace.",
        "The reader is closed first. If that is not enough, I could help with the tests.",
        "The reader is closed first. I am able to explain the second part too.",
        "Der Leser wird nicht geschlossen. Ich kann dir mit den Tests helfen, wenn du willst.",
        "It logs this:\n\n```\nI cannot help with that.\n```\n\nThe caller then gives up.",
    ],
)
def test_sound_answers_with_words_of_refusals(a):
    assert not D.is_refusal(a)
