"""Events, facts and the layers of the graph, by the rules of the original."""

from pyspark.sql import functions as F

from kgloom.operators import events, facts, graph
from kgloom.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trigger_guards(spark):
    texts = {"a": "Ada influenced the work of Bob", "b": "Ada influenced Bob", "c": "Ada was influenced by Bob", "d": "Ada influenced it", "e": "the town was influenced greatly, Ada and Bob said"}
    s = spark.createDataFrame(list(texts.items()), "sentence_id string, text string")
    m = spark.createDataFrame([(k, n, "PERSON", t.find(n), t.find(n) + 3) for k, t in texts.items() for n in ("Ada", "Bob") if n in t], "sentence_id string, entity_id string, type string, s int, e int")
    got = {r.sentence_id: (r.trigger, r.confidence, r.review_reasons, [x.entity_id for x in r.roles]) for r in events.text_events(s, m).collect()}
    assert set(got) == {"a", "b", "c"}  # one person alone makes no event; the active form after "was" is no trigger
    assert got["a"][1:3] == (0.49, ["active_influence_right_argument_in_prepositional_phrase"]) and got["b"][1:3] == (0.8, [])
    assert got["c"][0] == "was influenced by" and got["c"][3] == ["Bob", "Ada"]


EVENT = "event_candidate_id string, event_type string, status string, confidence double, roles array<struct<role:string,entity_id:string,entity_type:string,text:string>>, review_reasons string, evidence struct<doc_id:string,sentence_id:string,source_id:string,text:string>, start_time_norm string"
PAIR = [("person_a", "B", "PERSON", ""), ("person_b", "A", "PER", "")]


def _events(spark):
    e = [("1", PAIR, None, 0.6), ("2", PAIR, '{"empty_entity_roles": ["x"]}', 0.9), ("3", PAIR, '{"a": [], "b": null, "c": false}', 0.95), ("4", PAIR, "broken", None)]
    return spark.createDataFrame([(i, "CollaborationEvent", "VERIFIED", c, r, w, ("d", f"s{i}", "src", "t"), "1936") for i, r, w, c in e] + [("5", "CollaborationEvent", "REVIEW", 0.9, PAIR, None, None, None)], EVENT)


def test_verified_events(spark):
    got = {r.event_candidate_id: (r.verdict, r.confidence, [x.name for x in r.signals]) for r in events.verify(_events(spark)).collect()}
    ok = ["event_verified", "event_role_complete"]
    assert got["1"] == ("VERIFIED", 0.85, ok) and got["2"] == ("REVIEW", 0.49, []) and got["3"] == ("VERIFIED", 0.95, ok) and got["4"] == ("VERIFIED", 0.85, ok)


def test_facts_of_events(spark):
    f = events.to_facts(_events(spark), verified=True)
    assert f.count() == 4 and events.to_facts(_events(spark)).count() == 5
    v = facts.verified(f).first()
    assert (v.verdict, v.mode, v.score, v.status) == ("SUPPORTED", "offline_event_projection", 1.1, "VERIFIED")
    r = facts.verified(f, F.lit("NOT_SUPPORTED")).first()
    assert (r.score, r.status) == (-0.15, "REJECTED")
    c = f.select(F.col("event_candidate_id").alias("candidate_id"), "subject_id", "predicate", "object_id", F.lit("").alias("qualifiers"), F.coalesce("event_confidence", F.lit(0.0)).alias("score"), "evidence")
    w = facts.whole_facts(c).first()
    assert (w.fact_id, w.subject_id, w.object_id, w.n_evidence, w.prototype, w.evidence.sentence_id, w.status) == ("fact_000001", "A", "B", 3, "1", "s1", "FINAL")
    assert facts.fact_evidence(c).count() == 3


def test_verdicts(spark):
    s = "signals array<struct<name:string,score:double>>"
    d = spark.createDataFrame([([("pattern_match", 0.35)],), ([("wikidata_alignment", 0.25)],), ([("event_verified", 0.45)],), ([],)], s)
    assert [(r.verdict, r.score) for r in facts.verified(d).collect()] == [("SUPPORTED", 0.6), ("UNCERTAIN", 0.25), ("UNCERTAIN", 0.45), ("UNCERTAIN", 0.0)]


def test_canonical_json_and_compact(spark):
    d = spark.createDataFrame([('{"b": [1, 2], "a": "x\\"y", "c": null, "d": 2.5}',), ('{"a":"x\\"y","c":null,"b":[1,2],"d":2.5}',), (None,), (" ",), ("plain",)], "j string")
    got = [r.x for r in d.select(facts.canonical_json(d.j).alias("x")).collect()]
    assert got[0] == got[1] == '{"a":"x\\"y","b":[1,2],"c":null,"d":2.5}' and got[2:] == ["{}", "{}", "plain"]
    s = spark.createDataFrame([(("x", "", None, 3),)], "s struct<a:string,b:string,c:string,d:int>")
    assert s.select(facts.compact(s.s, ["a", "b", "c", "d"]).alias("m")).first().m == {"a": "x", "d": "3"}


def test_support_of_claims(spark):
    c = spark.createDataFrame([("c2", "S", "EDUCATED_AT", "O", '{"t": 1}'), ("c1", "S", "STUDIED_AT", "O", "{}"), ("c3", "S", "STUDIED_AT", None, None)], "claim_id string, subject_id string, predicate string, object_id string, qualifiers_json string")
    p = spark.createDataFrame([("p", "S", "STUDIED_AT", "O"), ("q", "S", "BORN_IN", "O")], "candidate_id string, subject_id string, predicate string, object_id string")
    got = {r.candidate_id: (r.n_claims, r.first_claim, r.qualifiers, r.support) for r in facts.distant_support(p, c).collect()}
    assert got == {"p": (2, "c1", '{"t": 1}', 0.25), "q": (0, None, None, 0.0)}


def _edge(spark, triples):
    return graph.keep_first(graph.with_identity(spark.createDataFrame([(a, b, p, "facts", "", 1.0) for a, p, b in triples], "source string, target string, label string, layer string, extra string, confidence double")))


def test_paths_use_an_edge_once(spark):
    e = _edge(spark, [("a", "p", "b"), ("b", "q", "c"), ("c", "r", "a"), ("x", "p", "y")])
    got = [(r.hops, r.middle, r.far) for r in graph.paths(e, spark.createDataFrame([("a",)], "id string"), 50).collect()]
    assert sorted(got, key=str) == sorted([(1, "b", None), (1, "c", None), (2, "b", "c"), (2, "c", "b")], key=str)
    assert graph.paths(e, spark.createDataFrame([("a",)], "id string"), 3).count() == 3


def test_layers(spark, tmp_path):
    n = spark.createDataFrame([("A", "Ada", None, None, "PERSON", None, None, None)], "entity_id string, canonical_name string, label_en string, label_zh string, entity_type string, description_en string, description_zh string, wikipedia_summary_en string")
    nodes = graph.event_nodes(_events(spark), n)
    assert {r.label for r in nodes.collect()} == {"CollaborationEvent: B -> Ada"} and {r.type for r in nodes.collect()} == {"CollaborationEvent"}
    f = spark.createDataFrame([("A", "WORKED_WITH", "B", 0.9, ("d", "s1", "src", "t"))], "subject_id string, predicate string, object_id string, confidence double, evidence struct<doc_id:string,sentence_id:string,source_id:string,text:string>")
    e = graph.evidence_edges(f)
    assert e.first().semantic_key.startswith("EVIDENCE::A::WORKED_WITH::B::") and e.first().id.startswith("evidence::")
    assert e.select(graph.display_label(e.label, e.layer)).first()[0] == "WORKED_WITH [evidence]"
    every = graph.placeholder_nodes(graph.entity_nodes(n), e)
    files.graph_json(every, e, str(tmp_path / "g"))
    assert files.read_json(str(tmp_path / "g" / "stats.json"))["layer"] == {"evidence": 1}
    assert "LIMIT 180" in files.browser_queries("A") and "node.PERSON" in files.browser_style(["PERSON"])
    g = files.gephi_tables(every, e)
    assert {(r.Id, r.degree) for r in g[0].collect()} == {("A", 1), ("B", 1)} and g[1].first().display_label == "WORKED_WITH [evidence]"
