import json

from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.operators import nested

EVENTS = "event_candidate_id string, roles array<struct<role:string,entity_id:string>>, signals array<struct<name:string,details:string>>, value int"
CLAIMS = "claim_id string, qualifiers_json string, path string"


def test_leaves(spark):
    events = spark.createDataFrame(
        [
            ("e1", [("author", "Q1"), None, ("", "Q2"), (None, "Q3"), ("work", None)], [("a", '{"trigger": ["x", null, {"text": "y", "n": 3, "f": 1.5, "b": true, "e": ""}]}'), ("b", "broken"), ("c", None), None], 1),
            ("e2", None, [], 2),
            ("e3", [], None, 3),
            ("e1", [("author", "Q1"), None, ("", "Q2"), (None, "Q3"), ("work", None)], [("a", '{"trigger": ["x", null, {"text": "y", "n": 3, "f": 1.5, "b": true, "e": ""}]}'), ("b", "broken"), ("c", None), None], 1),
        ],
        EVENTS,
    )
    claims = spark.createDataFrame([("c1", '"{\\"a\\": {\\"b\\": [1, \\"z\\"]}}"', "p"), ("c2", None, "p"), ("c3", " ", "p"), ("c4", "null", "p"), ("c5", "{", "p"), ("c6", "[]", "p"), ("c7", '{"x": NaN}', "p"), ("c8", '{"k": 12345678901234567890}', "p")], CLAIMS)
    got = {tuple(r) for r in nested.nested_leaves(events, claims).collect()}
    v, c = "verified_events_text", "claims"
    assert got == {
        (v, "e1", "roles[0].role", "author"), (v, "e1", "roles[4].role", "work"),
        (v, "e1", "signals[0].details.trigger[0]", "x"), (v, "e1", "signals[0].details.trigger[2].text", "y"), (v, "e1", "signals[0].details.trigger[2].n", "3"),
        (c, "c1", "qualifiers_json.a.b[0]", "1"), (c, "c1", "qualifiers_json.a.b[1]", "z"), (c, "c8", "qualifiers_json.k", "12345678901234567890"),
    }


def test_empty_tables(spark):
    assert nested.nested_leaves(spark.createDataFrame([], EVENTS), spark.createDataFrame([], CLAIMS)).count() == 0


def test_schema_table_keeps_links(spark):
    df = spark.createDataFrame([("e1", [("author", "Q1"), ("work", None)], None, 1)], EVENTS)
    nodes = nested.dewey_nodes(df, "event_candidate_id", ["roles"])
    rows = {r.dewey: (r.parent_dewey, r.role, r.entity_id) for r in nested.schema_table(nodes, "roles[*]", ["role", "entity_id"]).collect()}
    assert rows == {"0.0": ("0", "author", "Q1"), "0.1": ("0", "work", None)}


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=3, alphabet="abc"), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(values)
def test_labels_and_parents(value):
    nodes = nested.json_text_nodes(json.dumps({"v": value}), "0", "q", "q")
    labels = [n[0] for n in nodes]
    assert len(set(labels)) == len(labels)
    assert all(x == "0" or x.rpartition(".")[0] in labels for x in labels)


def test_deep_text():
    for depth in (3000, 20_000):
        deep = "[" * depth + "1" + "]" * depth
        assert nested.json_text_nodes(deep, "0", "q", "q", scalars=True) == [("0" + ".0" * depth, "q" + "[0]" * depth, "q" + "[*]" * depth, "integer", "1")]
    assert nested.json_text_nodes('{"a": ' * 9000 + '[1, "x"]' + "}" * 9000, "0", "q", "q", scalars=True)[1][1:] == ("q" + ".a" * 9000 + "[1]", "q" + ".a" * 9000 + "[*]", "string", "x")
    assert nested.json_text_nodes("[" * 9000 + "]" * 8999, "0", "q", "q")[0][3] == "invalid"


@settings(max_examples=200, deadline=None)
@given(values, st.text(alphabet='[]{}:,"\\ 1e.-truefalsn\x01', max_size=8))
def test_deep_decoder_is_the_decoder(value, junk):
    for text in (json.dumps(value), json.dumps(value, indent=1), junk, json.dumps(value) + junk):
        try:
            want = nested._DECODER.decode(text)
        except ValueError:
            want = "error"
        try:
            got = nested.decode_deep(text)
        except ValueError:
            got = "error"
        assert got == want and json.dumps(got) == json.dumps(want)


def test_order_and_tables(spark):
    d = spark.createDataFrame([("0.10",), ("0.2",), ("0",)], "dewey string")
    assert [r.dewey for r in d.orderBy(nested.label_order(d.dewey)).collect()] == ["0", "0.2", "0.10"]
    c = spark.createDataFrame([("c1", '{"p": [{"t": "x"}, 3], "q": null}', "p"), ("c2", None, "p"), ("c3", "{", "p")], CLAIMS)
    got = sorted((r.claim_id, r.dewey, r.parent_dewey, r.name, r.kind, r.value) for r in nested.qualifier_table(c).collect())
    assert got == [("c1", "0.0.0.0", "0.0.0", "p", "string", "x"), ("c1", "0.0.1", "0.0", "p", "integer", "3"), ("c1", "0.1", "0", "q", "null", None)]
    e = spark.createDataFrame([("e1", None, [("a", '{"trigger": ["x", {"text": "y"}]}'), ("b", None)], 1)], EVENTS)
    assert sorted((r.event_candidate_id, r.signal, r.dewey, r.value) for r in nested.trigger_table(e).collect()) == [("e1", 0, "0.0.1.0.0", "x"), ("e1", 0, "0.0.1.0.1.0", "y")]
