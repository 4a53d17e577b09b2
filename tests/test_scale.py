"""The ways for large inputs give what the ways for small ones give; triggers by dictionary forms."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import facts, graph, linking, mentions, model, relations
from kgloom.operators.relational import numbered


def rows(df):
    return sorted(tuple(r) for r in df.collect())


LEMMAS = {
    "located": "LOCATED_IN", "Based": "LOCATED_IN", "situated": "LOCATED_IN", "proposed": "PROPOSED", "introduces": "PROPOSED", "received": "AWARDED", "won": "AWARDED", "winning": "AWARDED", "educated": "STUDIED_AT", "studies": "STUDIED_AT",
    "born": "BORN_IN", "borne": "BORN_IN", "dying": "DIED_IN", "deaths": "DIED_IN", "taught": "WORKED_AT", "employed": "WORKED_AT", "wrote": "AUTHORED", "written": "AUTHORED", "publishes": "AUTHORED", "built": "DESIGNED", "developing": "DESIGNED",
}


def test_trigger_lemmas(spark):
    d = spark.createDataFrame([(w, [w]) for w in [*LEMMAS, "bed", "basic", "passed", "won't", "winter"]], "w string, tokens array<string>")
    whole = F.struct(F.lit(0).alias("s"), F.size("tokens").alias("e"))
    got = {r.w: r.h for r in d.select("w", relations.trigger_hits(F.col("tokens"), whole).alias("h")).collect()}
    assert got == {w: [p] for w, p in LEMMAS.items()} | {w: [] for w in ("bed", "basic", "passed", "won't", "winter")}


def test_trigger_phrases(spark):
    texts = [("She passed away in London", ["DIED_IN"]), ("He was born in Paris", ["BORN_IN"]), ("passed it away", [])]
    d = spark.createDataFrame([(t, t.split()) for t, _ in texts], "t string, tokens array<string>")
    whole = F.struct(F.lit(0).alias("s"), F.size("tokens").alias("e"))
    got = {r.t: (r.h, r.w) for r in d.select("t", relations.trigger_hits(F.col("tokens"), whole).alias("h"), relations.trigger_words(F.col("tokens"), whole, "BORN_IN").alias("w")).collect()}
    assert [got[t][0] for t, _ in texts] == [h for _, h in texts]
    assert got["He was born in Paris"][1] == ["be bear in", "bear", "bear in"]
    d = spark.createDataFrame([(["studied", "at"],)], "tokens array<string>")
    assert d.select(relations.trigger_words(F.col("tokens"), F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")), "STUDIED_AT").alias("w")).first().w == ["study", "study at"]


STEMS = {"based": "based", "studied": "study", "wins": "wins", "taking": "taking", "class": "clas", "attended": "attend", "designing": "design", "works": "work", "died": "died", "tied": "tied", "using": "using", "joined": "join"}


@pytest.mark.parametrize("word,want", STEMS.items())
def test_stems_cut_where_more_than_three_letters_stay(spark, word, want):
    want = {"based": "based", "tied": "tied", "died": "died"}.get(word, want)
    assert spark.range(1).select(X.stem(F.lit(word)).alias("s")).first().s == want


def test_trigger_signals_read_tokens_and_distance(spark):
    c = spark.createDataFrame([("1", "x", ["She", "studied", "at", "K"], "STUDIED_AT", 3), ("2", "studied at", ["no"], "STUDIED_AT", 3), ("3", "studied at", None, "STUDIED_AT", None), ("4", "studied at", None, "STUDIED_AT", 25)], "candidate_id string, text string, tokens array<string>, predicate string, distance int")
    assert {r.candidate_id for r in facts.trigger_signals(c, facts.patterns(spark)).collect()} == {"1", "3"}


def test_replacements_by_joins(spark):
    rng = random.Random(2)
    for _ in range(4):
        links = [(i, f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for i in range(18)]
        links = [x for x in links if x[1] != x[2]]
        final = {}
        for _, old, new in links:  # in order, chains follow through
            for k, v in list(final.items()):
                if v == old:
                    final[k] = new
            final.setdefault(old, new)
        d = spark.createDataFrame(links, "ordinal int, old_id string, new_id string")
        assert dict(rows(graph.replacements(d))) == final
        assert dict(rows(graph.replacements(d, most=2).select("_old", "_new"))) == final
    assert graph.replacements(d.limit(0)) is None


def test_dictionary_by_automaton_and_by_joins(spark):
    rng = random.Random(4)
    words = list("abcdefg")
    names = spark.createDataFrame(sorted({(" ".join(rng.choices(words, k=rng.randint(1, 5))), "T") for _ in range(40)}), "alias string, type string")
    s = spark.createDataFrame([(f"s{i}", rng.choices(words, k=rng.randint(0, 14))) for i in range(60)], "sentence_id string, tokens array<string>")
    known = mentions.alias_dictionary(names)
    got = rows(mentions.longest_matches(s, known))
    assert got and got == rows(mentions.longest_matches(s, known, most=3))
    assert rows(mentions.longest_matches(s, known.limit(0))) == []


def test_recall_by_held_index_and_by_joins(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    e = spark.createDataFrame([(f"e{i:02d}", " ".join(rng.choices(words, k=6))) for i in range(40)], "entity_id string, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=5))) for i in range(30)] + [("none", None), ("other", "zz yy")], "query_id string, text string")
    a, b = (rows(linking.tfidf_recall(q, e, 4, postings=n).select("query_id", "entity_id", "score", "rank")) for n in (10_000, 5))
    assert a == b and max(r[3] for r in a) == 4


def test_downsample_keeps_the_least_hashes(spark):
    import hashlib

    bags = [(f"p{i}", ["A"]) for i in range(10)] + [(f"n{i}", ["NA"]) for i in range(100)]
    d = spark.createDataFrame(bags, "bag_id string, labels array<string>")
    want = sorted((f"n{i}" for i in range(100)), key=lambda b: hashlib.md5(f"42{b}".encode()).hexdigest())[:30]
    assert {r.bag_id for r in relations.downsample_na(d).collect()} == {f"p{i}" for i in range(10)} | set(want)
    assert relations.downsample_na(d, ratio=100.0).count() == 110


def test_numbers_without_one_sort(spark):
    d = spark.createDataFrame([(f"t{i:03d}",) for i in random.Random(1).sample(range(500), 500)], "token string").repartition(7)
    assert rows(numbered(d, "token", "id", 2).select("token", "id")) == [(f"t{i:03d}", i + 2) for i in range(500)]


def test_bag_support(spark):
    s = spark.createDataFrame([("b", f"s{i}", "R", i / 10, True) for i in range(9)] + [("b", "x", "R", 0.99, False), ("b", "s1", "Q", 0.2, True)], "bag_id string, sentence_id string, relation string, probability double, allowed boolean")
    got = {(r.bag_id, r.relation): (r.probability, r.supporting) for r in model.bag_predictions(s, 0.5, {"Q": 0.1}).collect()}
    assert got == {("b", "R"): (0.8, ["s8", "s7", "s6"]), ("b", "Q"): (0.2, ["s1"])}


def test_bridges_against_brute_force(spark):
    un = spark.createDataFrame([("s1", "m1", "Loom House", "ORGANIZATION"), ("s1", "m2", "House", "ORGANIZATION"), ("s2", "m3", "Loom Hose", "ORGANIZATION"), ("s2", "m4", "Xyz", "PLACE")], "sentence_id string, mention_id string, text string, type string")
    li = spark.createDataFrame([("s1", "E1"), ("s2", "E1"), ("s2", "E1")], "sentence_id string, entity_id string")
    cl = spark.createDataFrame([("c1", "E1", "WORKED_AT", "E2"), ("c2", "E3", "WORKED_AT", "E1"), ("c3", "E1", "WORKED_AT", None)], "claim_id string, subject_id string, predicate string, object_id string")
    su = spark.createDataFrame([("E2", "Loom House", "ORGANIZATION"), ("E3", "House of Looms", "ORGANIZATION"), ("E2", "Xyz", "ORGANIZATION")], "entity_id string, surface string, type string")
    got = {(r.mention_id, r.entity_id): (r.claim_id, round(r.score, 3)) for r in relations.bridges(un, li, cl, su).collect()}
    assert got == {("m1", "E2"): ("c1", 1.0), ("m2", "E2"): ("c1", 0.9), ("m2", "E3"): ("c2", 0.9), ("m3", "E2"): ("c1", 0.947)}


@pytest.mark.parametrize("longest", [64, 9])
def test_near_texts_meet_by_pieces(spark, longest):
    from difflib import SequenceMatcher

    pick, letters = random.Random(5), "abcdefgh "
    surfaces = {"".join(pick.choices(letters, k=pick.choice((1, 4, 5, 9, 14, 20, 33)))) for _ in range(120)}
    texts = set()
    for x in sorted(surfaces):
        y = list(x)
        for _ in range(pick.randint(0, 1 + len(x) // 8)):
            y[pick.randrange(len(y)) if y else 0 : pick.randrange(len(y)) + 1 if y and pick.random() < 0.3 else 0] = pick.choice(["", "z", pick.choice(letters)])
        at = pick.randrange(len(x))
        texts |= {"".join(y), x[:at] + x[at + 1 :], x[:at] + "q" + x[at:], x[:at] + "q" + x[at + 1 :], x[at:] + x[:at]}
    t = spark.createDataFrame([("WORK", x) for x in sorted(texts)], "type string, low string")
    s = spark.createDataFrame([("WORK", x) for x in sorted(surfaces)] + [("PLACE", x) for x in sorted(texts)], "type string, s_low string")
    got = rows(relations.near_texts(t, s, 0.88, longest))
    near = {("WORK", a, b) for a in texts for b in surfaces if a and SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert len(near) > 150 and near <= set(got) and len(got) == len(set(got)) < 0.2 * len(texts) * len(surfaces)


def test_bridges_of_a_hub(spark):
    """A hub with claims to all entities: its neighbours' texts aren't paired with all surfaces, the best surface and first claim count."""
    names = [f"{a}{b}{c} {b}{c}{a}" for a in ("Ba", "Cedo", "Difu") for b in ("ka", "lemi", "nor") for c in ("pa", "ritu", "sol")]
    un = spark.createDataFrame([(f"s{i}", f"m{i}", n[:3] + "x" + n[3:], "PERSON") for i, n in enumerate(names)] + [("s0", "mw", names[0].split()[0], "PERSON"), ("s0", "mt", names[0], "PLACE")], "sentence_id string, mention_id string, text string, type string")
    li = spark.createDataFrame([(f"s{i}", "H") for i in range(len(names))], "sentence_id string, entity_id string")
    cl = spark.createDataFrame([(f"c{k}{i}", *(("H", "P", f"E{i}") if k else (f"E{i}", "P", "H"))) for i in range(len(names)) for k in (1, 0)], "claim_id string, subject_id string, predicate string, object_id string")
    su = spark.createDataFrame([(f"E{i}", x, "PERSON") for i, n in enumerate(names) for x in (n, n.upper(), n[:3] + n[4:])], "entity_id string, surface string, type string")
    got = {(r.mention_id, r.entity_id): (r.claim_id, r.surface) for r in relations.bridges(un, li, cl, su).collect()}
    from difflib import SequenceMatcher

    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {}
    for i, n in enumerate(names):
        for j, m in enumerate(names):
            best = min((-ratio(n[:3] + "x" + n[3:], x), x) for x in (m, m.upper(), m[:3] + m[4:]))
            if -best[0] >= 0.88:
                want[f"m{i}", f"E{j}"] = (f"c0{j}", best[1])
    assert got == want | {("mw", "E0"): ("c00", min(x for x in (names[0], names[0].upper())))}


def test_support_is_one_row_a_mention(spark):
    """Candidates of a mention stay together: its support is found by keys, hot documents and surfaces included."""
    schema = "mention_id string, doc_id string, surface string, entity_id string, local double, source string, type_score double, n_words int, title_overlap boolean, ordinal string, at int"
    rows_ = [("m1", "d", "x", "A", 0.9, "exact", 1.0, 1, True), ("m1", "d", "x", "B", 0.8, "tfidf", 0.0, 1, False), ("m2", "d", "x", "B", 0.7, "exact", 1.0, 1, False), ("m2", "d", "x", "A", 0.69, "surname", 1.0, 1, None), ("m3", "e", "x", "A", 0.5, "exact", 1.0, 2, False)]
    c = spark.createDataFrame([(*r, r[3], int(r[0][1])) for r in rows_], schema)
    got = {r.mention_id: [(x.entity_id, -x.minus, x.source) for x in r.ranked] for r in linking.document_support(c).collect()}
    # the last exact one of the surface in the document is B; A has one anchor
    assert got == {"m1": [("A", 0.95, "exact"), ("B", 0.85, "tfidf")], "m2": [("B", 0.75, "exact"), ("A", 0.71, "surname")], "m3": [("A", 0.5, "exact")]}
    m = spark.createDataFrame([("m1", None), ("m2", None), ("m4", None), ("m5", "PRONOUN")], "mention_id string, skip string")
    tops = {r.mention_id: (r.decision, r.entity_id, r.top) for r in linking.link_tops(m, c).collect()}
    assert tops == {"m1": ("LINKED", "A", ["A", "B"]), "m2": ("REVIEW", None, ["B", "A"]), "m4": ("NIL", None, None), "m5": ("PRONOUN", None, None)}


def test_linking_eval_keeps_candidates_once(spark, monkeypatch):
    """Decisions and ranks come from one pass: candidates are kept as one row a mention, not as rows besides."""
    from kgloom.plans import more_queries

    kept = []
    keep = linking.durable
    for m in (linking, more_queries):
        monkeypatch.setattr(m, "durable", lambda df: (kept.append(df.columns), keep(df))[1])
    assert more_queries.linking_eval(spark, "/root/testdata/sf0.001").first().n > 0
    assert not [c for c in kept if {"mention_id", "local"} <= set(c)] and len([c for c in kept if "c" in c]) == 1


def test_linking_tops_joins_mentions_once(spark, monkeypatch):
    from kgloom.plans import kg_queries, more_queries

    made, make = [], kg_queries._link_mentions
    monkeypatch.setattr(kg_queries, "_link_mentions", lambda *a: (made.append(a), make(*a))[1])
    assert more_queries.linking_tops(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1


def test_decoding_keeps_sequences_whole(spark):
    """The labels are read once for the rows and once for the words asked of the dictionary, and the plan stays small for the driver."""
    from kgloom.plans import stage_queries

    plan = stage_queries.decoded_mentions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "token_spans#" in x for x in plan.splitlines()) == 2
    assert plan.count("Join ") == 3


def test_decoding_against_brute_force(spark):
    rng = random.Random(9)
    words = ["ace", "Of", "and", "-", "Pilot", "tape", "é", None]
    kinds = ["MACHINE", "WORK", "CONCEPT"]
    names = {f"{a} {b} {c}": rng.choice(kinds[1:]) for a in ("ace", "tape", "pilot") for b in ("of", "and", "and of") for c in ("ace", "tape", "pilot")}
    for _ in range(150):
        names[" ".join(w.lower() for w in rng.choices(words[:-1], k=rng.choice((1, 2, 2, 3, 3, 4))))] = rng.choice(kinds)
    rows_, want = [], set()
    for i in range(300):
        n = rng.randint(0, 12)
        tokens = rng.choices(words, [5, 4, 4, 1, 5, 5, 1, 0.2], k=n)
        labels = [rng.choice(["O", "O", *(f"{p}-{k}" for p in "BI" for k in kinds)]) for _ in tokens]
        if i % 2:  # half of them with linking words between neighbours of one type
            labels = ["O" if t in ("Of", "and") else f"B-{kinds[i % 3]}" for t in tokens]
        text, offsets, at = " ".join(t or "" for t in tokens), [], 0
        for t in tokens:
            offsets.append([at, at + len(t or "")])
            at += len(t or "") + 1
        rows_.append((None if i == 7 else f"s{i}", text, tokens, offsets, labels, None))
        if i == 7:
            continue
        spans, before = [], "O"
        for k, x in enumerate(labels):
            if x != "O" and (x[0] == "B" or before[2:] != x[2:]):
                spans.append([k, k + 1, x[2:]])
            elif x != "O":
                spans[-1][1] = k + 1
            before = x
        said = lambda s, e: " ".join(t.lower() for t in tokens[s:e] if t is not None)  # noqa: B023, E731
        for x in spans:
            grown = [z for z in range(x[1], min(x[0] + 8, n) + 1) if x[2] == "MACHINE" and names.get(said(x[0], z)) == "MACHINE" and " " in said(x[0], z)]
            x[1] = max(grown, default=x[1])
        spans = [x for x in spans if x[1] - x[0] > 1 or tokens[x[0]] is not None and tokens[x[0]] != "-"]
        k = 0
        while k < len(spans):
            s, e, kind = spans[k]
            if k + 1 < len(spans) and kind != "MACHINE" and spans[k + 1][2] == kind and 1 <= spans[k + 1][0] - e <= 2 and all((t or "").lower() in mentions.BRIDGES for t in tokens[e : spans[k + 1][0]]) and names.get(said(s, spans[k + 1][1])) == kind:
                e, k = spans[k + 1][1], k + 1
            want.add((f"s{i}", kind, s, e, offsets[s][0], offsets[e - 1][1], text[offsets[s][0] : offsets[e - 1][1]]))
            k += 1
    s = spark.createDataFrame(rows_, "sentence_id string, text string, tokens array<string>, token_spans array<array<int>>, labels array<string>, confidences array<double>")
    known = spark.createDataFrame([(a, a.count(" ") + 1, k) for a, k in names.items()], "alias string, n_tokens int, type string")
    got = [tuple(r) for r in mentions.decode(s, known).select("sentence_id", "mention_type", "s", "e", "char_start", "char_end", "text").collect()]
    plain = {tuple(r) for r in mentions.decode(s, known.limit(0)).select("sentence_id", "mention_type", "s", "e", "char_start", "char_end", "text").collect()}
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want - plain) > 20 and {"MACHINE", "WORK", "CONCEPT"} == {x[1] for x in want - plain}
