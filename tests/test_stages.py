from pyspark.sql import Row
from pyspark.sql import functions as F

from kgloom.operators import coref, events, facts, graph, linking, mentions, metrics, model, relational, relations, structured


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_greedy_and_repeats(spark):
    df = spark.createDataFrame([(1, [(0, 3), (2, 4), (4, 6)])], "k int, spans array<struct<s:int,e:int>>")
    assert df.select(relational.greedy_spans(F.col("spans")).alias("x")).first().x == [Row(s=0, e=3), Row(s=4, e=6)]
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x")], "k string, i int, v string")
    assert [r.i for r in relational.drop_repeats(d, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 3, 5]


def test_running_ids(spark):
    d = spark.createDataFrame([(g, i) for g in "cab" for i in range(3)], "g string, i int")
    got = relational.running_ids(d, ["g"], ["i"], "x").orderBy("g", "i").collect()
    assert [r.id for r in got] == [f"x{k:06d}" for k in range(1, 10)]


def test_bio(spark):
    d = spark.createDataFrame([(["I-PER", "O", "I-ORG", "I-LOC"],), ([],), (["B-PER", "I-PER", "B-PER"],)], "l array<string>")
    got = d.select(mentions.legal_bio(F.col("l")).alias("x"), mentions.illegal_bio(F.col("l")).alias("n"), mentions.label_spans(F.col("l")).alias("s")).collect()
    assert got[0].x == ["B-PER", "O", "B-ORG", "B-LOC"] and got[0].n == 3
    assert [tuple(s) for s in got[0].s] == [(0, 1, "PER"), (2, 3, "ORG"), (3, 4, "LOC")]
    assert got[1].x == [] and got[1].s == []
    assert [tuple(s) for s in got[2].s] == [(0, 2, "PER"), (2, 3, "PER")]


def test_folds(spark):
    d = spark.createDataFrame([(["(", "a", ")", ")", "(", '"', "q", '"'],)], "t array<string>")
    r = d.select(mentions.paren_depths(F.col("t")).alias("p"), mentions.inside_quotes(F.col("t")).alias("q")).first()
    assert r.p == [1, 1, 0, 0, 1, 1, 1, 1] and r.q[6] and not r.q[5]
    spans = spark.createDataFrame([([(0, 1, "WORK"), (2, 3, "WORK"), (4, 5, "WORK")], ["A", "of", "B", "of", "C"])], "s array<struct<s:int,e:int,type:string>>, t array<string>")
    assert [tuple(x) for x in spans.select(mentions.merge_adjacent(F.col("s"), F.col("t")).alias("x")).first().x] == [(0, 3, "WORK"), (4, 5, "WORK")]
    bad = spark.createDataFrame([(["A", ",", "B"], ["B-PER", "I-PER", "I-PER"])], "t array<string>, l array<string>")
    assert bad.select(mentions.check_labels(F.col("t"), F.col("l")).alias("x")).first().x == ["too_many_entities", "span_crosses_punctuation"]


def test_dictionary(spark):
    names = spark.createDataFrame([("Automatic Computing Engine", "MACHINE"), ("Automatic", "CONCEPT"), ("Turing", "PERSON"), ("Turing", "AWARD")], "alias string, type string")
    s = spark.createDataFrame([("s1", ["The", "automatic", "computing", "engine", "of", "Turing"]), ("s2", [])], "sentence_id string, tokens array<string>")
    assert rows(mentions.longest_matches(s, mentions.alias_dictionary(names))) == [("s1", 1, 4, "automatic computing engine", "MACHINE")]


def test_coref(spark):
    anchors = spark.createDataFrame([("d", 1, 0, "E1", "PERSON"), ("d", 1, 5, "E1", "PERSON"), ("d", 2, 0, "E2", "PERSON"), ("d", 2, 3, "E3", "PERSON"), ("d", 2, 1, "M", "MACHINE")], "doc_id string, sentence_index int, token_start int, entity_id string, type string")
    targets = spark.createDataFrame([("a", "d", 2, 6, "he"), ("b", "d", 2, 0, "he"), ("c", "d", 9, 0, "he"), ("e", "d", 3, 0, "it"), ("f", "x", 1, 1, "she")], "target_id string, doc_id string, sentence_index int, token_start int, phrase string")
    got = {r.target_id: (r.entity_id, r.reason) for r in coref.resolve(targets, anchors).collect()}
    assert got["a"] == ("E3", "RULE_NEAREST_ANTECEDENT")  # the nearest token wins
    assert got["b"] == (None, "AMBIGUOUS_ANTECEDENT")  # twice at distance 1, even the same entity
    assert got["c"] == got["f"] == (None, "NO_COMPATIBLE_ANTECEDENT")
    assert got["e"] == ("M", "RULE_NEAREST_ANTECEDENT")


def test_coref_against_brute_force(spark):
    import random

    random.seed(3)
    a = [(f"d{random.randint(0, 2)}", random.randint(0, 6), random.randint(0, 9), f"E{random.randint(0, 3)}", random.choice(["PERSON", "MACHINE"])) for _ in range(60)]
    t = [(f"t{i}", f"d{random.randint(0, 2)}", random.randint(0, 8), random.randint(0, 9), random.choice(["he", "it"])) for i in range(60)]
    got = {r.target_id: (r.entity_id, r.reason) for r in coref.resolve(spark.createDataFrame(t, "target_id string, doc_id string, sentence_index int, token_start int, phrase string"), spark.createDataFrame(a, "doc_id string, sentence_index int, token_start int, entity_id string, type string")).collect()}
    for tid, doc, s, k, p in t:
        fits = sorted((s - x[1], k - x[2] if s == x[1] else -x[2], x[3]) for x in a if x[0] == doc and 0 <= s - x[1] <= 3 and (s > x[1] or x[2] < k) and (x[4] == "PERSON") == (p == "he"))
        if not fits:
            want = (None, "NO_COMPATIBLE_ANTECEDENT")
        elif len(fits) > 1 and fits[0][0] == fits[1][0] and (fits[0][0] > 0 or fits[0][1] == fits[1][1]):
            want = (None, "AMBIGUOUS_ANTECEDENT")
        else:
            want = (fits[0][2], "RULE_NEAREST_ANTECEDENT")
        assert got[tid] == want


def test_fact_scores(spark):
    c = spark.createDataFrame([("s", "p", "o", "", x) for x in (0.60, 0.55, 0.52)] + [("s2", "p", "o", "", 0.72), ("s2", "p", "o", "", 0.50), ("s3", "p", "o", "", 0.4)], "subject_id string, predicate string, object_id string, qualifiers string, score double")
    got = {r.subject_id: (r.confidence, r.status) for r in facts.aggregate(c).collect()}
    assert got == {"s": (0.7, "REVIEW"), "s2": (0.77, "FINAL")}
    f = spark.createDataFrame([("s", "BORN_IN", "a"), ("s", "BORN_IN", "b"), ("s", "WORKED_AT", "x"), ("s", "WORKED_AT", "y"), ("t", "DIED_IN", None)], "subject_id string, predicate string, object_id string")
    assert [r.subject_id for r in facts.conflicts(f).collect()] == ["s"]


def test_triggers(spark):
    c = spark.createDataFrame([("1", "She studied maths at Cambridge", "STUDIED_AT"), ("2", "nothing here", "STUDIED_AT"), ("3", "wonderful", "AWARDED"), ("4", None, "AWARDED")], "candidate_id string, text string, predicate string")
    got = {r.candidate_id: r.triggers for r in facts.trigger_signals(c, facts.patterns(spark)).collect()}
    assert "studied at" in got["1"] and "2" not in got and got["3"] == ["won"] and "4" not in got


def test_label_fold(spark):
    def fold(relations_, exact, bridge, local, sentence, reasons):
        d = spark.createDataFrame([(relations_, exact, bridge, local, sentence, reasons)], ", ".join(f"{c} array<string>" for c in "abcdef"))
        r = d.select(relations.label_fold(*[F.col(c) for c in "abcdef"]).alias("f")).select("f", relations.label_of(F.col("f")).alias("l")).first()
        return r.l, r.f.positive, r.f.unknown, r.f.reasons

    s = ["STUDIED_AT"]
    assert fold(s, s, s, s, s, [])[:2] == ("ds_strict", s)
    label, _, _, why = fold(s, s, [], [], s, [])
    assert label == "manual_review" and why == ["exact_claim_without_local_text_evidence", "sentence_trigger_not_local_to_pair"]
    assert fold(s, s, s, s, s, ["subject_skipped_pronoun"])[0] == "manual_review"
    # a reason found for an earlier relation demotes a later one
    label, positive, _, _ = fold(["A", "B"], ["A", "B"], [], ["B"], ["B"], [])
    assert (label, positive) == ("manual_review", [])
    assert fold(["A"], [], [], [], [], [])[0] == "unknown"


def test_bags(spark):
    schema = "doc_id string, subject_id string, object_id string, sentence_id string, s_mention string, o_mention string, s_start int, o_start int, labels array<string>, na boolean"
    c = spark.createDataFrame([("d", "s", "o", "s1", "m", "n", 0, 4, ["X"], False), ("d", "s", "o", "s1", "m", "n", 0, 4, [], False), ("d", "s", "p", "s1", "m", "k", 0, 6, [], True)] + [("d", "h", "o", f"s{i:02d}", "m", "n", 0, 4, ["Y"], False) for i in range(30)], schema)
    got = {r.bag_id: (len(r.evidence), r.labels) for r in relations.bags(c).collect()}
    assert got == {"d__s__o": (1, ["X"]), "d__s__p": (1, ["NA"]), "d__h__o": (16, ["Y"])}
    assert relations.class_weights(relations.bags(c)).count() == 3


def test_bridge(spark):
    un = spark.createDataFrame([("s1", "m1", "Kings College", "ORGANIZATION"), ("s1", "m2", "Kimgs Colege", "ORGANIZATION"), ("s1", "m3", "Other", "ORGANIZATION")], "sentence_id string, mention_id string, text string, type string")
    li = spark.createDataFrame([("s1", "P")], "sentence_id string, entity_id string")
    cl = spark.createDataFrame([("c1", "P", "STUDIED_AT", "K")], "claim_id string, subject_id string, predicate string, object_id string")
    su = spark.createDataFrame([("K", "Kings College", "ORGANIZATION"), ("K", "Kings College London", "ORGANIZATION")], "entity_id string, surface string, type string")
    got = {r.mention_id: (r.entity_id, r.score) for r in relations.bridges(un, li, cl, su).collect()}
    assert got["m1"] == ("K", 1.0) and got["m2"][0] == "K" and got["m2"][1] >= 0.88 and "m3" not in got


def test_event_checks(spark):
    schema = "event_candidate_id string, event_type string, status string, confidence double, roles array<struct<role:string,entity_id:string,entity_type:string,text:string>>"
    e = spark.createDataFrame(
        [
            ("1", "CollaborationEvent", "x", 0.9, [("person_a", "B", "PERSON", ""), ("person_b", "A", "PERSON", "")]),
            ("2", "BirthEvent", "x", 0.9, [("person", "", "PERSON", ""), ("birth_place", "L", "PERSON", "")]),
            ("3", "Unknown", "x", 0.9, None),
        ],
        schema,
    )
    got = {r.event_candidate_id: (r.missing, r.empty, r.wrong_type, r.verdict) for r in events.verify(e).collect()}
    assert got["1"] == ("", "", "", "VERIFIED") and got["2"] == ("", "person", "birth_place", "REVIEW") and got["3"][3] == "REVIEW"
    assert rows(events.to_facts(e).select("event_candidate_id", "subject_id", "object_id")) == [("1", "A", "B")]  # symmetric: ordered


def test_text_events(spark):
    s = spark.createDataFrame([("s", "Ada worked with Bob and Cy was influenced by Di"), ("n", None)], "sentence_id string, text string")
    m = spark.createDataFrame([("s", "A", "PERSON", 0, 3), ("s", "B", "PERSON", 16, 19), ("s", "C", "PERSON", 24, 26), ("s", "D", "PERSON", 45, 47)], "sentence_id string, entity_id string, type string, s int, e int")
    got = {r.trigger: {x.role: x.entity_id for x in r.roles} for r in events.text_events(s, m).collect()}
    assert got == {"worked with": {"person_a": "A", "person_b": "B"}, "was influenced by": {"target_person": "C", "source_person": "D"}}


def test_upsert_keeps_old(spark):
    old = spark.createDataFrame([("1", "a", "keep"), ("2", "b", None)], "id string, x string, y string")
    new = spark.createDataFrame([("1", "z", None), ("3", "c", "n")], "id string, x string, y string")
    assert rows(structured.upsert(old, new, "id", ("y",)).fillna("")) == [("1", "z", "keep"), ("2", "b", ""), ("3", "c", "n")]


def test_fusion(spark):
    e = graph.keep_first(graph.with_identity(spark.createDataFrame([("a", "c", "p", "facts", "", 1.0), ("b", "c", "p", "facts", "", 0.5), ("x", "y", "p", "facts", "", 0.5)], "source string, target string, label string, layer string, extra string, confidence double")))
    schema = "ordinal int, action string, target_key string, source string, label string, target string, old_id string, new_id string"
    fix = spark.createDataFrame([(1, "REPLACE_LINK", None, None, None, None, "a", "b"), (2, "REJECT_EDGE", None, "x", "p", "y", None, None), (3, "ADD_EDGE", None, "n", "q", "m", None, None)], schema)
    once = graph.fuse(e, fix)
    assert sorted((r.source, r.target, r.layer) for r in once.collect()) == [("b", "c", "facts"), ("n", "m", "correction")]
    twice = graph.fuse(once, fix)
    assert sorted(r.id for r in twice.collect()) == sorted(r.id for r in once.collect())


def test_decisions(spark):
    c = spark.createDataFrame([("m", 2, "A", 0.90, 1.0, "1", "normalized"), ("m", 2, "B", 0.87, 1.0, "2", "normalized"), ("n", 2, "A", 0.95, 0.0, "1", "exact"), ("o", 1, "A", 0.5, 1.0, "1", "exact"), ("p", 1, "A", 0.81, 1.0, "1", "exact")], "mention_id string, n_words int, entity_id string, link_confidence double, type_score double, ordinal string, source string")
    got = {r.mention_id: r.decision for r in linking.decide(c).collect()}
    assert got == {"m": "REVIEW", "n": "REVIEW", "o": "NIL", "p": "LINKED"}


def test_tfidf_against_brute_force(spark):
    import math
    from collections import Counter

    texts = {"e1": "alpha beta", "e2": "beta gamma", "e3": "delta"}
    q = {"q1": "alpha gamma beta", "q2": "unknown words"}
    e = spark.createDataFrame(list(texts.items()), "entity_id string, text string")
    got = {(r.query_id, r.entity_id): r.score for r in linking.tfidf_recall(spark.createDataFrame(list(q.items()), "query_id string, text string"), e).collect()}

    def grams(t):
        w = t.split()
        return w + [" ".join(x) for x in zip(w, w[1:])]

    df = Counter(g for t in texts.values() for g in set(grams(t)))
    idf = {g: math.log((1 + 3) / (1 + n)) + 1 for g, n in df.items()}

    def vec(t):
        v = {g: n * idf[g] for g, n in Counter(grams(t)).items() if g in idf}
        z = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / z for g, x in v.items()}

    want = {(i, j): round(sum(x * vec(texts[j]).get(g, 0) for g, x in vec(q[i]).items()), 6) for i in q for j in texts}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_span_measures(spark):
    g = spark.createDataFrame([("1", 0, 2, "PER"), ("1", 4, 6, "ORG"), ("1", 8, 9, "LOC")], "key string, s int, e int, type string")
    p = spark.createDataFrame([("1", 0, 2, "PER"), ("1", 4, 6, "LOC"), ("1", 20, 21, "LOC")], "key string, s int, e int, type string")
    assert tuple(metrics.span_scores(g, p).first())[:3] == (1, 2, 2)
    assert dict(rows(metrics.span_errors(g, p))) == {"correct": 1, "type": 1, "missed": 1, "spurious": 1}


def test_labeller_learns(spark):
    s = spark.createDataFrame([(f"s{i}", ["Dr", "Smith", "left", "."] if i % 2 else ["He", "met", "Dr", "Jones"], ["O", "B-PER", "O", "O"] if i % 2 else ["O", "O", "O", "B-PER"]) for i in range(20)], "sentence_id string, tokens array<string>, labels array<string>")
    m = model.train_labeller(s, width=256, iterations=20)
    got = {r.sentence_id: r.labels for r in model.label_sequences(m, s).collect()}
    assert sum(got[r.sentence_id] == r.labels for r in s.collect()) >= 18


def test_attention_forward(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    net = model.PiecewiseAttention(rng.normal(size=(10, 4)), rng.normal(size=(83, 2)), rng.normal(size=(5, 3, 8)), np.zeros(5), rng.normal(size=(2, 15)), np.zeros(2))
    d = spark.createDataFrame([("b", [1, 2, 3], [41, 42, 43], [40, 41, 42], [1, 2, 3]), ("b", [4, 5], [41, 42], [40, 41], [1, 3])], "bag_id string, token_ids array<int>, s_pos array<int>, o_pos array<int>, piece array<int>")
    got = {r.relation: r.probability for r in model.predict_bags(d, net, ["X", "Y"]).collect()}
    h = [net.encode(*map(np.array, ([1, 2, 3], [41, 42, 43], [40, 41, 42], [1, 2, 3]))), net.encode(*map(np.array, ([4, 5], [41, 42], [40, 41], [1, 3])))]
    p, a = net.bag(h)
    assert np.allclose([got["X"], got["Y"]], p) and np.allclose(a.sum(1), 1)


def linked(spark, mentions, entities=None, aliases=None):
    e = spark.createDataFrame(entities or [("E1", "Ada Byron", "PERSON", "pioneer of looms"), ("E2", "Loom House", "ORGANIZATION", "weaving school of Norden")], "entity_id string, canonical_name string, entity_type string, description_en string")
    e = e.select("*", *[F.lit(None).cast("string").alias(c) for c in ("label_en", "label_zh", "description_zh", "wikipedia_title_en", "wikipedia_summary_en")], F.lit(1.0).alias("confidence"))
    a = spark.createDataFrame(aliases or [("E1", "A. Byron")], "entity_id string, alias string")
    m = spark.createDataFrame(mentions, "mention_id string, doc_id string, text string, type string, n_words int, context string, title string, skip string").withColumn("at", F.col("mention_id"))
    named = m.filter("skip is null")
    c = linking.score_candidates(named, linking.recall(named.select("mention_id", "text", "type"), linking.alias_index(e, a)), linking.entity_profiles(e, a))
    return {(r.mention_id, r.entity_id): r for r in c.collect()}, {r.mention_id: r for r in linking.link(m, c).collect()}


def test_linking_recalls_by_text_and_title(spark):
    rows = [("m1", "d", "Ada Byron", "PERSON", 2, "Ada Byron wrote", "Looms"), ("m2", "d", "the weavers", "ORGANIZATION", 2, "a school of weaving", "Norden"), ("m3", "d", "Xyz", "PERSON", 1, "nothing known", ""), ("m4", "d", "she", "PERSON", 1, "she wrote", "")]
    c, d = linked(spark, [(*r, "SKIPPED_PRONOUN" if r[2] == "she" else None) for r in rows])
    assert c["m2", "E2"].source == "tfidf" and c["m2", "E2"].title_overlap and c["m1", "E1"].title_overlap
    assert not [k for k in c if k[0] in ("m3", "m4")]
    # context 2 of 3 words (ada, byron); topic 3 of 4 with the title; prior 1
    assert c["m1", "E1"].source == "exact" and c["m1", "E1"].local == round(0.3 + 0.2 * 2 / 3 + 0.2 + 0.075 + 0.05 + 0.1, 6)
    assert {k: r.decision for k, r in d.items()} == {"m1": "LINKED", "m2": d["m2"].decision, "m3": "NIL", "m4": "SKIPPED_PRONOUN"} and d["m3"].entity_id is None


def test_linking_keeps_five_candidates(spark):
    names = [(f"E{i}", "Sam Reed", "PERSON", f"note {i}") for i in range(7)]
    c, d = linked(spark, [("m", "d", "Sam Reed", "PERSON", 2, "Sam Reed", "", None)], names)
    assert sorted(k[1] for k in c) == ["E0", "E1", "E2", "E3", "E4"] and d["m"].entity_id == "E0"


def test_recall_in_all_scripts(spark):
    import unicodedata

    names = [("E1", "Straße", "PLACE"), ("E2", "Анна Ковач", "PERSON"), ("E3", "阿隆佐", "PERSON"), ("E4", "Ｌｏｏｍ", "ORGANIZATION"), ("E5", "Zoé", "PERSON")]
    e = spark.createDataFrame(names, "entity_id string, canonical_name string, entity_type string").select("*", F.lit(None).cast("string").alias("label_en"), F.lit(None).cast("string").alias("label_zh"))
    a = spark.createDataFrame([], "entity_id string, alias string")
    texts = ["STRASSE", "анна ковач", "阿隆佐", "Loom", "Zoe\u0301", "Ковач", "nobody"]
    m = spark.createDataFrame([(t, t, "PERSON") for t in texts], "mention_id string, text string, type string")
    exact = lambda t: " ".join(unicodedata.normalize("NFKC", t).split())
    want = {(t, i): "exact" if exact(t) == exact(n) else "normalized" for t in texts for i, n, _ in names if exact(t).casefold() == exact(n).casefold()} | {("Ковач", "E2"): "surname"}
    assert len(want) == 6 and {(r.mention_id, r.entity_id): r.source for r in linking.recall(m, linking.alias_index(e, a)).collect()} == want


def test_dictionary_of_all_names(spark):
    e = spark.createDataFrame([("E1", "Alan Turing", "A. M. Turing", None, "PERSON"), ("E2", "King's College, Cambridge", None, None, "ORGANIZATION"), ("E3", "Mark", None, None, "MACHINE"), ("E4", "Norwich", None, None, "EVENT"), ("E5", "Trinity, College Hall", None, None, "ORGANIZATION")], "entity_id string, canonical_name string, label_en string, label_zh string, entity_type string")
    a = spark.createDataFrame([("E1", "Prof"), ("E1", "Mark"), (None, "Nobody"), ("E9", "Gone")], "entity_id string, alias string")
    got = {(r.alias, r.type) for r in mentions.alias_dictionary(mentions.dictionary_names(e, a)).collect()}
    assert got == {("alan turing", "PERSON"), ("a . m . turing", "PERSON"), ("prof", "PERSON"), ("king's college", "ORGANIZATION"), ("trinity , college hall", "ORGANIZATION")}


def test_claim_times_of_all_forms(spark, tmp_path):
    import json

    from kgloom.plans.text_queries import claim_times

    forms = {"a": {"start_time": "+1931-10-01T00:00:00Z"}, "b": {"start_time": {"value": "1931-00-00"}}, "c": {"start_time": "1931"}, "d": {"end_time": "1940-01-01"}}
    texts = [(k, json.dumps(v)) for k, v in forms.items()] + [("e", json.dumps(forms["a"], indent=1)), ("f", json.dumps(json.dumps(forms["a"]))), ("g", None), ("h", "no json")]
    spark.createDataFrame(texts, "claim_id string, qualifiers_json string").write.parquet(f"{tmp_path}/claims.parquet")
    got = sorted((r.claim_id, r.start_time) for r in claim_times(spark, str(tmp_path)).collect())
    assert got == [("a", "1931-10-01"), ("b", "1931"), ("c", "1931"), ("e", "1931-10-01"), ("f", "1931-10-01")]
