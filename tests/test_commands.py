"""Commands, settings, the repository, and the parts of stages that they use."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom import cli, config
from kgloom.functions import text as X
from kgloom.operators import mentions, relations, sampling, structured
from kgloom.sources import files, remote
from kgloom.sources.repository import COLUMNS, Repository

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_command_parses():
    p = cli.build_parser()
    stages = [(g, c) for g, cs in cli.OTHERS.items() for c in cs] + list(cli.STAGES)
    assert len(set(stages)) == 26
    for g, c in stages:
        more = ["--root", "r"] if g == "structured" else ["--pages", "p"] if g == "unstructured" else []
        assert p.parse_args([g, c, "--out", "o", "--tables", "t", *more]).stage == c
    with pytest.raises(SystemExit):
        p.parse_args(["facts", "nope"])


@pytest.mark.parametrize("stage", [("facts", "aggregate"), ("facts", "run"), ("relations", "weak-label"), ("events", "extract"), ("linking", "mine-gaps")])
def test_stages_write_a_result_and_a_summary(spark, tmp_path, stage):
    assert cli.main([*stage, "--tables", DATA, "--out", str(tmp_path / "x")]) == 0
    summary = files.read_json(str(tmp_path / "x.summary.json"))
    assert summary["rows"] == spark.read.parquet(str(tmp_path / "x")).count()


def test_structured_commands(spark, tmp_path):
    root = str(tmp_path / "db")
    assert cli.main(["structured", "init-db", "--root", root]) == 0
    assert cli.main(["structured", "build", "--root", root, "--tables", DATA]) == 0
    r = Repository(spark, root)
    assert r.table("entities").count() == 2750 and r.table("event_candidates").count() > 0 and r.table("aliases").count() > 0
    assert cli.main(["structured", "export-csv", "--root", root, "--out", str(tmp_path / "csv")]) == 0
    assert files.read_csv(spark, str(tmp_path / "csv" / "claims")).columns == COLUMNS["claims"].split()
    assert cli.main(["structured", "validate", "--root", root]) in (0, 1)


def test_repository(spark, tmp_path):
    r = Repository(spark, str(tmp_path / "db"))
    assert r.init() == list(COLUMNS) and r.init() and r.table("claims").count() == 0
    e = lambda *x: spark.createDataFrame(list(x), "entity_id string, canonical_name string, wikipedia_summary_en string, entity_type string, retrieved_at string")
    r.upsert("entities", e(("1", "A", "old", "PERSON", "1"), ("2", "B", None, "PLACE", "1")), ("wikipedia_summary_en",))
    r.upsert("entities", e(("1", "A2", None, "PERSON", "2"), ("1", "A1", None, "PERSON", "1")), ("wikipedia_summary_en",))
    assert [(x.entity_id, x.canonical_name, x.wikipedia_summary_en) for x in r.listed("entities").collect()] == [("1", "A2", "old"), ("2", "B", None)]
    assert [x.entity_id for x in r.listed("entities", "PLACE").collect()] == ["2"]
    a = lambda *x: spark.createDataFrame(list(x), "entity_id string, alias string, alias_lang string, normalized_alias string")
    r.replace("aliases", a(("1", "x", "en", "x"), ("1", "y", "en", "y"), ("2", "z", "en", "z")))
    r.replace_aliases(a(("1", "w", "en", "w")))
    assert [(x.entity_id, x.alias) for x in r.listed("aliases").collect()] == [("1", "w"), ("2", "z")]
    # a table of an older version lacks columns
    spark.createDataFrame([("e1", "BirthEvent")], "event_candidate_id string, event_type string").write.mode("overwrite").parquet(f"{tmp_path}/db/event_candidates")
    assert r.table("event_candidates").columns == COLUMNS["event_candidates"].split() and r.table("event_candidates").first().confidence is None
    r.replace("event_candidates", r.table("event_candidates").limit(0))
    assert r.table("event_candidates").count() == 0


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"page_size": 7, "languages": ["de"]}))
    c = config.load(config.FetchConfig, str(p))
    assert (c.page_size, c.languages, c.hops) == (7, ("de",), 2) and config.load(config.LinkingConfig, None).top_k == 5
    p.write_text(json.dumps({"nope": 1}))
    with pytest.raises(ValueError):
        config.load(config.RelationConfig, str(p))
    assert config.Layout("/w").documents == "/w/unstructured/documents" and config.as_dict(c)["page_size"] == 7


def test_extract_by_kind(spark, tmp_path):
    (tmp_path / "a.html").write_text("<body><p>The archive keeps letters of the first operators.</p></body>")
    (tmp_path / "b.txt").write_text("Plain  text.")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.path.rpartition("/")[2]: (r.source_type, r.text, r.error) for r in files.extract(files.read_pages(spark, str(tmp_path))).collect()}
    assert got == {"a.html": ("html", "The archive keeps letters of the first operators.", None), "b.txt": ("text", "Plain text.", None), "c.pdf": ("pdf", None, "unsupported_source_type:pdf")}
    cli.main(["preprocess", "--pages", str(tmp_path), "--out", str(tmp_path / "out")])
    assert files.read_json(str(tmp_path / "out" / "errors.summary.json"))["rows"] == 1
    with pytest.raises(ValueError):
        cli.main(["preprocess", "--pages", str(tmp_path / "*.*"), "--out", str(tmp_path / "out2"), "--strict"])


def test_summaries(spark, tmp_path):
    assert remote.summary_address("https://x/summary/", "A b/c") == "https://x/summary/A_b%2Fc"
    (tmp_path / "A_b.json").write_text(json.dumps({"extract": "text"}))
    t = spark.createDataFrame([("1", "A b"), ("2", "gone"), ("3", None)], "entity_id string, title string")
    assert rows(remote.summaries(t, "https://x", str(tmp_path)).select("entity_id", "extract", "error").fillna("")) == [("1", "text", ""), ("2", "", "missing"), ("3", "", "")]


def test_decoding_chain(spark):
    tokens = ["The", "Analytical", "Engine", "and", "theory", "of", "tapes", "-", "Ada"]
    text, spans, at = " ".join(tokens), [], 0
    for t in tokens:
        spans.append([at, at + len(t)])
        at += len(t) + 1
    labels = ["O", "I-MACHINE", "O", "O", "B-CONCEPT", "O", "I-CONCEPT", "B-AWARD", "I-PER"]
    s = spark.createDataFrame([("s", text, tokens, spans, labels, [None, 0.5, 0.7, None, 0.2, None, 0.4, 1.0, None])], "sentence_id string, text string, tokens array<string>, token_spans array<array<int>>, labels array<string>, confidences array<double>")
    names = spark.createDataFrame([("analytical engine", 2, "MACHINE"), ("theory of tapes", 3, "CONCEPT")], "alias string, n_tokens int, type string")
    got = {(r.mention_type, r.text, r.confidence) for r in mentions.decode(s, names).collect()}
    assert got == {("MACHINE", "Analytical Engine", 0.6), ("CONCEPT", "theory of tapes", 0.3), ("PER", "Ada", None)}
    apart = {(r.mention_type, r.text) for r in mentions.decode(s, names.limit(1)).collect()}
    assert ("CONCEPT", "theory") in apart and ("CONCEPT", "tapes") in apart


@pytest.mark.parametrize("n,pair,want", [(10, (1, 2, 5, 6), (0, 10)), (40, (10, 11, 14, 15), (7, 19)), (40, (0, 1, 3, 4), (0, 12)), (40, (36, 37, 38, 40), (28, 40)), (40, (5, 6, 30, 31), (19, 31))])
def test_windows_around_pairs(spark, n, pair, want):
    w = relations.crop_window(F.lit(n), *map(F.lit, pair), 12)
    assert tuple(spark.range(1).select(w.alias("w")).first().w) == want


def test_counted_split_and_keywords(spark):
    d = spark.createDataFrame([(f"r{i}", f"g{i % 4}", "a machine" if i % 5 == 0 else "other") for i in range(103)], "id string, g string, t string")
    assert sampling.counted_split(d, "id", 0.2).filter("split = 'dev'").count() == 20
    assert sampling.counted_split(d.limit(1), "id", 0.2).first().split == "train" and sampling.counted_split(d.limit(2), "id", 0.01).filter("split = 'dev'").count() == 1
    k = sampling.keyword_sample(d, "g", "id", "t", {"machine": 6}, 15).collect()
    assert len(k) == 15 and sum(r.t == "a machine" for r in k) >= 6


def test_constraints_are_26(spark):
    c = structured.ontology_constraints()
    assert len(c) == 26 and [x["type"] for x in c].count("event_role_required") == 10


def test_claim_events_have_times_and_places(spark):
    c = spark.createDataFrame([("c1", "P", "BORN_IN", "L", '{"point_in_time": "+1912-06-23T00:00:00Z"}', "1"), ("c2", "P", "WORKED_AT", "O", '{"start_time": {"value": "1936-00-00"}, "end_time": "1938"}', "1"), ("c3", "P", "WORKED_AT", None, None, "1")], "claim_id string, subject_id string, predicate string, object_id string, qualifiers_json string, retrieved_at string")
    e = spark.createDataFrame([("P", "PERSON"), ("L", "PLACE"), ("O", "ORGANIZATION")], "entity_id string, entity_type string")
    got = {r.claim_id: (r.event_type, r.start, r.end, r.location_id) for r in structured.claim_events(c, e).collect()}
    assert got == {"c1": ("BirthEvent", "1912-06-23", None, "L"), "c2": ("EmploymentEvent", "1936", "1938", None)}


def test_name_likeness(spark):
    pairs = [("Alan Turing", "alan turing", 1.0), ("Turing", "Alan Turing", 0.86), ("", "x", 0.0), ("Loom House", "House Loom", 1.0)]
    d = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [round(r.x, 6) for r in d.select(X.name_similarity(d.a, d.b).alias("x")).collect()] == [x for *_, x in pairs]
    assert spark.createDataFrame([("-",), ("a",), ("--/",), ("é",), (".",), ("ab",)], "t string").filter(mentions.meaningless(F.col("t"))).count() == 3


def test_labels_against_the_dictionary(spark):
    names = spark.createDataFrame([("analytical engine", 2, "MACHINE"), ("norden", 1, "PLACE"), ("turing machine", 2, "MACHINE"), ("ada", 1, "PERSON")], "alias string, n_tokens int, type string")
    rows_ = [
        ("ok", ["Ada", "left", "it", "."], ["B-PER", "O", "O", "O"]), ("fix", ["Ada", "left", "it", "."], ["I-PER", "O", "O", "O"]), ("core", ["the", "Analytical", "Engine", "ran"], ["O", "O", "O", "O"]), ("type", ["Ada", "left", "it", "."], ["B-ORG", "O", "O", "O"]),
        ("org", ["at", "Norden", "Technical", "College", "there", "."], ["O", "B-ORG", "I-ORG", "I-ORG", "O", "O"]), ("list", ["a", "Turing", "machine", "halts", "."], ["O", "B-CONCEPT", "I-CONCEPT", "O", "O"]), ("many", ["Ada", "B", "C"], ["B-PER"] * 3), ("mark", ["A", ",", "B", "c", "d", "e"], ["B-PER", "I-PER", "O", "O", "O", "O"]),
    ]
    s = spark.createDataFrame(rows_, "sentence_id string, tokens array<string>, labels array<string>")
    got = {r.sentence_id: (r.reason or r.stage, r.confidence) for r in mentions.check_with_dictionary(s, names).collect()}
    assert got == {
        "ok": ("auto_checked", 0.92), "fix": ("auto_checked_with_bio_fix", 0.81), "core": ("core_name_not_covered", None), "type": ("type_conflict", None), "org": ("auto_checked_with_context_exemption", 0.76), "list": ("auto_checked", 0.92),
        "many": ("too_many_entities", None), "mark": ("span_crosses_punctuation", None),
    }


def test_features_of_names(spark):
    from kgloom.operators import model

    s = spark.createDataFrame([("s", ["At", "(", "Pilot", "ACE", ")"])], "sentence_id string, tokens array<string>")
    names = spark.createDataFrame([("pilot ace", 2, "MACHINE")], "alias string, n_tokens int, type string")
    d = model.with_names(s, names)
    f = d.select(mentions.context_features(F.col("tokens"), F.col("known")).alias("f")).first().f
    assert [x.name for x in f] == ["O", "O", "MACHINE", "MACHINE", "O"] and f[2].name_start and f[3].name_end and f[3].name_length == 2
    assert f[3].upper and f[2].title and f[3].bracket and f[0].first and f[0].preposition and f[1].p1 == "at"


def test_small_parts(spark):
    from kgloom.operators import coref, extract, relational

    d = spark.createDataFrame([("m1", "LINKED"), ("m2", "NIL"), ("m3", "REVIEW")], "mention_id string, decision string")
    assert {k: v.count() for k, v in extract.split_outputs(d).items()} == {"LINKED": 1, "REVIEW": 1, "NIL": 1}
    ids = spark.createDataFrame([(f"Q{i}",) for i in range(100)], "entity_id string")
    b = structured.batches(ids, 20)
    assert b.select("batch").distinct().count() == 5 and b.count() == 100 and structured.batches(ids.limit(0), 20).count() == 0
    t = spark.createDataFrame([("he",), ("The school",), ("Ada",), (None,)], "t string")
    assert [r.x for r in t.select(coref.is_target(t.t).alias("x")).collect()] == [True, True, False, False]
    e = spark.createDataFrame([("k", i, v) for i, v in enumerate([True, False, True, True])], "k string, i int, new boolean")
    assert [r.island for r in relational.islands(e, ["k"], ["i"], F.col("new")).orderBy("i").collect()] == [1, 1, 2, 3]
    assert spark.range(1).select(X.spans_overlap(F.lit(0), F.lit(2), F.lit(1), F.lit(3)).alias("a"), X.spans_overlap(F.lit(0), F.lit(2), F.lit(2), F.lit(3)).alias("b")).first() == (True, False)


def test_keeping_old_aliases_and_summaries(spark):
    e = spark.createDataFrame([("1", "old", "1", "a"), ("2", None, "1", "b")], "entity_id string, wikipedia_summary_en string, retrieved_at string, source_name string")
    s = spark.createDataFrame([("2", "new", "3", "rest"), ("2", "older", "2", "rest"), ("9", "x", "3", "rest")], "entity_id string, wikipedia_summary_en string, retrieved_at string, source_name string")
    assert rows(structured.update_summaries(e, s)) == [("1", "old", "1", "a"), ("2", "new", "3", "rest")]
