import json

from loamstone.operators.shred import entity_kinds, entity_rows, entity_table, object_paths, parse, shred, value_rows

SCHEMA = "id string, metadata_json string, kind string, node int, label string"


def messages(spark, texts):
    return spark.createDataFrame([(f"m{i}", t, "clash", 7, "clash") for i, t in enumerate(texts)], SCHEMA)


def paths(spark, texts, **kw):
    return sorted((r.record_id, r.object_path) for r in object_paths(shred(messages(spark, texts), only_objects=True), **kw).collect())


DOCS = [
    json.dumps({"s": [{"a": 1, "t": [{"x": 1}, 5, {"x": 2}]}, None, {"a": 2, "t": {"x": 3}}]}),
    json.dumps({"s": {"a": 9, "t": [{"x": 1}]}}),
    json.dumps([{"q": 1}, 3, {"q": {"r": [[{"z": 1}]]}}]),
    json.dumps(json.dumps({"s": [{"a": 1}]})),
    json.dumps({"s": json.dumps([{"a": 1}])}),
    '{"s": [{"a": 1}',
    '{"s": [{"a": NaN}]}',
    "",
    "   ",
    None,
    "null",
    '"text"',
    '{"a.b": [{"c[0]": 1}]}',
]
WANT = [
    ("m0", "$.s[0]"), ("m0", "$.s[0].t[0]"), ("m0", "$.s[0].t[2]"), ("m0", "$.s[2]"), ("m0", "$.s[2].t[0]"),
    ("m1", "$.s[0]"), ("m1", "$.s[0].t[0]"),
    ("m12", "$.a.b[0]"),
    ("m2", "$[0]"), ("m2", "$[2]"), ("m2", "$[2].q.r[0][0]"),
    ("m3", "$.s[0]"),
]


def test_paths(spark):
    assert paths(spark, DOCS) == WANT
    assert paths(spark, DOCS, max_pattern_names=0) == WANT


def test_empty_and_repeated(spark):
    assert paths(spark, []) == []
    two = messages(spark, DOCS[:1])
    assert object_paths(shred(two.unionAll(two), only_objects=True)).count() == 5


def test_null_id(spark):
    df = spark.createDataFrame([(None, '{"s": [{"a": 1}]}')], "id string, metadata_json string")
    assert [(r.record_id, r.object_path) for r in object_paths(shred(df)).collect()] == [(None, "$.s[0]")]


def test_tables_keep_links(spark):
    nodes = shred(messages(spark, DOCS[:2])).cache()
    assert entity_kinds(nodes) == ["$", "$.s", "$.s.t"]
    s = entity_table(nodes, "$.s").collect()
    t = entity_table(nodes, "$.s.t").collect()
    assert sorted((r.record_id, r.ordinal, r.f_a) for r in s) == [("m0", 0, "1"), ("m0", 2, "2"), ("m1", 0, "9")]
    parents = {(r.record_id, r.node) for r in s}
    assert len(t) == 4 and all((r.record_id, r.parent_node) in parents for r in t)


def test_deep_records_need_no_recursion(spark):
    deep = '{"a":[' * 300 + "1" + "]}" * 300
    assert len(paths(spark, [deep])) == 299
    assert parse("[" * 200_000)[0] is False


def test_long_values(spark):
    assert paths(spark, [json.dumps({"s": [{"a": "x" * 3_000_000}]})]) == [("m0", "$.s[0]")]


def test_values_of_arrays_and_parents_through_nested_arrays(spark):
    nodes = shred(messages(spark, ['{"m": [[{"a": 1}, {"a": 2, "tags": ["x", ["y", null]]}]], "plan": ["p", 2, true, null]}', "[1, [2]]", "5"]))
    rows = {(r.record_id, r.kind, r.node): r for r in entity_rows(nodes).collect()}
    assert len(rows) == 3
    first, second = sorted((r for r in rows.values() if r.kind == "$.m"), key=lambda r: r.node)
    assert (first.parent_node, first.position, first.fields) == (0, [0, 0], {"a": "1"}) and (second.parent_node, second.position) == (0, [0, 1])
    values = sorted((r.record_id, r.kind, r.parent_node, tuple(r.position), r.value) for r in value_rows(nodes.filter("record_id = 'm0'")).collect())
    assert values == [("m0", "$.m.tags", second.node, (0,), "x"), ("m0", "$.m.tags", second.node, (1, 0), "y"), ("m0", "$.plan", 0, (0,), "p"), ("m0", "$.plan", 0, (1,), "2"), ("m0", "$.plan", 0, (2,), "true")]
    assert sorted((r.parent_node, tuple(r.position), r.value) for r in value_rows(nodes.filter("record_id = 'm1'")).collect()) == [(None, (0,), "1"), (None, (1, 0), "2")]
    assert [(r.node, r.parent_node, r.ordinal, r.f_a) for r in entity_table(nodes, "$.m").orderBy("node").collect()] == [(first.node, 0, 0, "1"), (second.node, 0, 1, "2")]
