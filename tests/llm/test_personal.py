import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import personal as P

LEXICON = P.Lexicon([("Jürgen", "given"), ("Mark", "given"), ("Will", "given"), ("Noemi", "given"), ("Zoë", "given"), ("Søren", "given"), ("Umbrecht", "family"), ("Field", "family"), ("Drozdrin", "family"), ("Juranova", "family"), ("Grace", "given"), ("Grace", "family")])
CASES = [
    ("Write to mailto:liora+link@tamholt.invalid with it.", [("email", "liora+link@tamholt.invalid")]),
    ("My mail is brunhild.ostrin [at] ulmfenn [dot] invalid.", [("email", "brunhild.ostrin [at] ulmfenn [dot] invalid")]),
    ("at noemi+x AT mail DOT velvane DOT test now", [("email", "noemi+x AT mail DOT velvane DOT test")]),
    ("cc: chase_p(at)mail.nordale.example, A.B@C.TEST", [("email", "chase_p(at)mail.nordale.example"), ("email", "A.B@C.TEST")]),
    ("Clone it from git@code.brasmark.test:ledger/x.git and use open_quota@7.17.5; see ssh://git@host.test/a, @Override.", []),
    ("Call +1-393-555-0129 or +86 10 5550 5839 or +33 1 99 57 85 24.", [("phone", "+1-393-555-0129"), ("phone", "+86 10 5550 5839"), ("phone", "+33 1 99 57 85 24")]),
    ("(311) 555-0189; 691.555.0190; 555-0179 ext. 582; 0049 (0)40 994 0432; 020 7946 0813", [("phone", x) for x in ("(311) 555-0189", "691.555.0190", "555-0179", "0049 (0)40 994 0432", "020 7946 0813")]),
    ("@@ -160,6 +152,7 @@ Lines 512-4096 of a/b.py; 2025-05-02T05:29:45Z; 10.214.235.247:8443; build 2025-04-7835; ports 8000-8010; c76482290619162338", []),
    ("The passport number 902 18 0395 and 72647770-Y and X8750064K and QQ 35 29 23 C.", [("id_number", x) for x in ("902 18 0395", "72647770-Y", "X8750064K", "QQ 35 29 23 C")]),
    ("ids: 65/723/27807; 721107-2330; ssn I73M8556A5 shows up", [("id_number", x) for x in ("65/723/27807", "721107-2330", "I73M8556A5")]),
    ("Invoices go to Saltmarketstraße 965a, 61984 Valmoret.", [("address", "Saltmarketstraße 965a")]),
    ("To Flat 17, 954 Tolliver Road, Castlewick QX7 3ZZ, attention Noemi Umbrecht.", [("address", "Flat 17, 954 Tolliver Road"), ("name", "Noemi Umbrecht")]),
    ("moved to 477 Larkspurley Lane\nEastmere 95496 and", [("address", "477 Larkspurley Lane")]),
    ("851, rue des Pinderfields, 43083 New Tarrow; Calle Saltmarket 565, 51087 Castlewick", [("address", "851, rue des Pinderfields"), ("address", "Calle Saltmarket 565")]),
    ("Thanks, Zoë", [("name", "Zoë")]), ("Hi Grace, it fails again.", [("name", "Grace")]), ("Call Dr. Juranova on Monday.", [("name", "Juranova")]), ("Ms. Field moved away.", [("name", "Field")]),
    ("Author: Drozdrin, Mark\nNext", [("name", "Drozdrin, Mark")]), ("Reviewed-by: Talulo Brockendorn", [("name", "Talulo Brockendorn")]), ("Signed-off-by: will halvargen <x@y.test>", [("name", "will halvargen"), ("email", "x@y.test")]),
    ("TODO(M. Umbrecht): bound it.", [("name", "M. Umbrecht")]), ("提交人：Jürgen Drozdrin，证件号 929-99-1132。", [("name", "Jürgen Drozdrin"), ("id_number", "929-99-1132")]), ("as SØREN DROZDRIN confirmed by phone", [("name", "SØREN DROZDRIN")]),
    ("We met Noemi Umbrecht-Field there.", [("name", "Noemi Umbrecht-Field")]),
    ("The Noemi Cache and the Zoë Scheduler start. The Noemi release train leaves. Mark the field. Will it work? The team will watch.", []),
    ("", []), ("   ", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    got = P.find(text, LEXICON)
    assert [(k, text[a:b]) for a, b, k in got] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000), st.binary(min_size=1, max_size=8))
def test_feistel_permutes(size, key):
    assert sorted(P.feistel(x, size, key, b"t") for x in range(size)) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(st.from_regex(r"\A[0-9A-Z]{1,4}[ -/]?[0-9A-Za-z]{1,8}\Z"))
def test_pseudonyms_keep_the_format(value):
    got = P.pseudonym(value, b"k", "id_number")
    shape = lambda s: ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in s]
    assert shape(got) == shape(value)
    assert got == P.pseudonym(value, b"k", "id_number")


def test_replacement_links_equal_values():
    text = "Call +1-393-555-0129 (Noemi Umbrecht). Reviewed-by: NOEMI UMBRECHT. Again +1-393-555-0129, x@y.test"
    out, made = P.replace(text, P.find(text, LEXICON), b"k")
    assert out.count("[PHONE +1-") == 2 and "393-555-0129" not in out and "Umbrecht" not in out
    assert made[0] == made[3] and made[1] == made[2]
    assert P.replace(text, P.find(text, LEXICON), b"other")[0] != out


def test_equal_values_in_other_formats_are_linked():
    digits = lambda s: "".join(c for c in s.replace("(0)", "") if c.isdigit()).removeprefix("00")
    for group in (("+1 212-555-0100", "+12125550100", "+1 (212) 555-0100", "001 212 555 0100"), ("+44 (0)20 7946 0018", "+44 20 7946 0018"), ("+351 211 555 017", "+351211555017")):
        made = {digits(P.pseudonym(v, b"k", "phone")) for v in group}
        assert len(made) == 1 and made != {digits(group[0])}
        assert made.pop().startswith(digits(group[0])[: P.country_code(digits(group[0]))])
    assert P.tag("Umbrecht, Noemi", b"k", "name") == P.tag("NOEMI\nUmbrecht", b"k", "name")
    assert P.tag("noemi.x [ at ] velvane DOT test", b"k", "email") == P.tag("Noemi.X@velvane.test", b"k", "email")
    assert len(P.tag("x", b"k", "name")) >= 16


def test_control_letters_and_dates():
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"
    for n in (12345678, 87654321, 4):
        right = f"{n:08}-{letters[n % 23]}"
        made = P.id_pseudonym(right, b"k")
        assert made != right and made[8] == "-" and letters[int(made[:8]) % 23] == made[9]
        assert P.id_pseudonym(f"{n:08}{letters[(n + 1) % 23]}", b"k") is None
    assert P.id_pseudonym("X1234567L", b"k")[0] == "X" and P.id_pseudonym("X1234567A", b"k") is None
    import datetime

    for value in ("900229-1234", "850101+0001", "991231-9999"):
        made = P.id_pseudonym(value, b"k")
        assert (made is None) == (value == "900229-1234")
        if made:
            datetime.datetime.strptime(made[:6], "%y%m%d")
    assert P.id_pseudonym("123-45-6789", b"k") and P.id_pseudonym("AB123456C", b"k") is None


def test_frame(spark):
    rows = [(1, "Thanks, Zoë\nx@y.test"), (2, None), (3, ""), (None, "x@y.test"), (4, "plain " * 200_000 + "x@y.test")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS kind", "1 AS starts", "'t' AS token")
    lexicon = spark.createDataFrame([("Zoë", "given", 1), ("Zoë", "given", 1), (None, "given", 1), ("X", None, 1)], "token string, kind string, freq int")
    got = sorted(((r.doc_id, r.kind, r.start_pos) for r in P.occurrences(docs.unionAll(docs), lexicon, b'k').collect()), key=repr)
    assert got == sorted([(1, "name", 9), (1, "email", 13), (None, "email", 1), (4, "email", 1_200_001)], key=repr)
    assert P.occurrences(docs.limit(0), lexicon, b'k').count() == 0
    assert P.occurrences(docs.filter("doc_id = 1"), lexicon.limit(0), b'k').count() == 2
    clean = {r.doc_id: r.clean for r in P.personal_information(docs, lexicon, key=b"k").collect()}
    assert clean[1].startswith("Thanks, [NAME ") and "[EMAIL " in clean[1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The Ausweisnummer L01X00T47 is wrong.", [("id_number", "L01X00T47")]),
        ("Her passport AB12345 was lost.", [("id_number", "AB12345")]),
        ("A national id GARC850101HDFRRL09 stood there.", [("id_number", "GARC850101HDFRRL09")]),
        ("passport:" + " " * 60 + "902180395", [("id_number", "902180395")]),
        ("We called Señora Lindqvar and Senora Ostrand today.", [("name", "Lindqvar"), ("name", "Ostrand")]),
        ("Mail noemi.x [ at ] velvane.test or a { at } b.test now", [("email", "noemi.x [ at ] velvane.test"), ("email", "a { at } b.test")]),
        ("Mail x@velvane [ dot ] test or y@b DOT\ntest now", [("email", "x@velvane [ dot ] test"), ("email", "y@b DOT\ntest")]),
        ("Send it to 12 Tolliver\tRoad, 61984 Valmoret.", [("address", "12 Tolliver\tRoad")]),
        ("as Ostrand Brockendorn\tsaid before", [("name", "Ostrand Brockendorn")]),
        ("Call 555-0179" + " " * 40 + "ext. 582", [("phone", "555-0179")]),
        ("Author:" + " " * 300 + "Talulo Brockendorn", [("name", "Talulo Brockendorn")]),
    ],
)
def test_forms_that_a_gate_left_out(text, want):
    assert [(k, text[a:b]) for a, b, k in P.find(text, LEXICON)] == want


PIECES = [t for t, _ in CASES if t.strip()] + ["Ausweisnummer L01X00T47", "passport AB12345", "Señora Ostrand", "[ at ]", "(dot)", " DOT ", "x@y", "12 Tolliver\tRoad, 61984 Valmoret", "as Ostrand Vale\tsaid", "555-0179  ext. 5", "Groß", "documento de identidad 12345678 de Mark Field", "word", "(", ")", "\n", "\t", ":", ",", " " * 70, "12", "345 678"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["", " ", "\n", ". "])), max_size=12))
def test_gates_change_nothing(pieces):
    text = "".join(a + b for a, b in pieces)
    assert P.find(text, LEXICON) == P.find(text, LEXICON, gated=False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I asked Noemi about the lease.", [("name", "Noemi")]),
        ("Yesterday Zoë fixed it.", [("name", "Zoë")]),
        ("So Umbrecht left, and Søren too.", [("name", "Umbrecht"), ("name", "Søren")]),
        ("The Noemi fixed it. We use Zoë here. Mark it. See Noemi.run and noemi and NOEMI. The Zoë Cache.", []),
        ("It is 12 Tolliver Road, please.", [("address", "12 Tolliver Road")]),
        ("我住在南京东路100号。然后", [("address", "南京东路100号")]),
        ("南京东路100号，谢谢", [("address", "南京东路100号")]),
        ("It takes 2 Fast Way, please.", []),
    ],
)
def test_single_names_and_addresses_without_a_place(text, want):
    assert [(k, text[a:b]) for a, b, k in P.find(text, LEXICON)] == want
