"""Queries over the knowledge-graph stages: structured records, graph, facts, relations, events, linking, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.operators import coref, events, facts, graph, linking, mentions, metrics, relations, structured
from kgloom.operators.relational import count_by, drop_repeats, first_rows, latest, top_k
from kgloom.plans.kg_sql import SQL  # noqa: F401  (part of the register)
from kgloom.session import durable, table

TABLES = ("entities", "aliases", "claims", "verified_events_text", "distant_labeled", "sentences", "document_records", "relation_bags")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table without its repeats: one copy of each id (copies differ in the time they were taken at most)."""
    key = {"aliases": "alias_id", "claims": "claim_id", "verified_events_text": "event_candidate_id", "distant_labeled": "candidate_id", "sentences": "sentence_id", "document_records": "doc_id"}.get(name)
    df = table(spark, d, name)
    return df.dropDuplicates([key]) if key else df


# --- structured records ---------------------------------------------------------------
def orphan_objects(spark, d):
    """Objects of claims that a catalogue of people and places lacks (the whole one lacks none)."""
    return structured.missing_objects(table(spark, d, "claims"), table(spark, d, "entities").filter("entity_type in ('PERSON', 'PLACE')"))


def latest_claims(spark, d):
    c = table(spark, d, "claims").select("claim_id", "subject_id", "predicate", "object_id", "retrieved_at")
    return latest(c, ["claim_id"], ["retrieved_at"])


def upsert_labels(spark, d):
    old = table(spark, d, "entities").select("entity_id", F.col("label_en").alias("label"), F.col("description_en").alias("note"))
    new = table(spark, d, "aliases").filter("entity_id is not null").groupBy("entity_id").agg(F.min("alias").alias("label"), F.max("alias_lang").alias("note"))
    return structured.upsert(old, new, "entity_id", ("note",))


def frontier_expand(spark, d):
    c = table(spark, d, "claims")
    return structured.expand(c.filter("predicate = 'WORKED_WITH'").select(F.col("subject_id").alias("entity_id")), c)


def structured_checks(spark, d):
    return structured.validate(*[table(spark, d, n) for n in ("entities", "aliases", "claims", "verified_events_text")])


def claim_records(spark, d):
    c = table(spark, d, "claims")
    return c.select("claim_id", structured.claim_id(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("statement_id")).alias("made_id")).distinct()


def alias_records(spark, d):
    a = _t(spark, d, "aliases").filter("entity_id is not null and alias is not null").join(table(spark, d, "entities").select("entity_id", "canonical_name"), "entity_id")
    return structured.alias_records(a.select("entity_id", "canonical_name", "alias", F.coalesce("alias_lang", F.lit("")).alias("alias_lang"), F.col("alias_id").alias("pos")))


def grouped_records(spark, d):
    a = _t(spark, d, "aliases").filter("entity_id is not null")
    return structured.group_bindings(a, "entity_id", ["alias"], ["alias_lang"], "alias_id").select("entity_id", "alias", F.array_join("alias_lang", ",").alias("langs"))


def job_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_key"), F.col("event_type").alias("status"), F.col("event_id").alias("updated_at"))
    return structured.ledger(e)


def constraint_counts(spark, d):
    rules = [{"type": "required_attribute", "attribute": "canonical_name"}, {"type": "required_attribute", "attribute": "label_en"}, {"type": "required_attribute", "attribute": "description_en"}, {"type": "value_range", "attribute": "confidence", "min": 0.5, "max": 1.0}]
    e = table(spark, d, "entities")
    return e.agg(*[F.count_if(structured.compile_constraint(r)).alias(f"n_{i}") for i, r in enumerate(rules)])


# --- graph ----------------------------------------------------------------------------
def _edges(spark, d):
    """All three layers: claims, event arguments, and final facts of texts with their first evidence."""
    f = facts.whole_facts(_event_candidates(spark, d)).filter("status = 'FINAL'")
    layers = (graph.fact_edges(latest(table(spark, d, "claims"), ["claim_id"], ["retrieved_at"])), graph.event_edges(_t(spark, d, "verified_events_text")), graph.evidence_edges(f))
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


def _nodes(spark, d):
    """Entities and events."""
    e = table(spark, d, "entities")
    return graph.entity_nodes(e).unionByName(graph.event_nodes(_t(spark, d, "verified_events_text"), e))


def evidence_edges(spark, d):
    return _edges(spark, d).filter("layer = 'evidence'").select("id", "source", "target", "label", "semantic_key", "confidence")


def event_nodes(spark, d):
    return graph.event_nodes(_t(spark, d, "verified_events_text"), table(spark, d, "entities"))


def display_labels(spark, d):
    return _edges(spark, d).groupBy(graph.display_label(F.col("label"), F.col("layer")).alias("display_label")).agg(F.count("*").alias("n"))


def two_hop_paths(spark, d):
    """The first 180 paths of one or two edges from the awards (a report of bounded length)."""
    seeds = table(spark, d, "entities").filter("entity_type = 'AWARD'").select(F.col("entity_id").alias("id"))
    return graph.paths(_edges(spark, d), seeds, 180)


def graph_nodes(spark, d):
    return graph.placeholder_nodes(_nodes(spark, d), _edges(spark, d).select("source", "target"))


def fact_edges(spark, d):
    return graph.fact_edges(table(spark, d, "claims")).select("id", "source", "target", "label", F.col("confidence"))


def event_edges(spark, d):
    return graph.event_edges(_t(spark, d, "verified_events_text")).select("id", "source", "target", "label", "semantic_key")


def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


def graph_stats(spark, d):
    return graph.stats(_nodes(spark, d), _edges(spark, d))


def hub_edges(spark, d):
    return graph.hubs(_edges(spark, d), 30)


def induced_edges(spark, d):
    return graph.induced_top(_edges(spark, d), 300).select("id", "source", "target")


def two_hop(spark, d):
    seeds = table(spark, d, "entities").filter("entity_type = 'AWARD'").select(F.col("entity_id").alias("id"))
    return graph.neighbourhood(_edges(spark, d), seeds, 2)


def adjacency_sets(spark, d):
    return graph.adjacency(table(spark, d, "claims"))


def layer_edges(spark, d):
    """The edges of the facts and of the evidence layer between named entities."""
    e, n = _edges(spark, d).filter("layer in ('facts', 'evidence')"), table(spark, d, "entities").select("entity_id", "canonical_name")
    a, b = n.select(F.col("entity_id").alias("source"), F.col("canonical_name").alias("source_name")), n.select(F.col("entity_id").alias("target"), F.col("canonical_name").alias("target_name"))
    return e.join(a, "source").join(b, "target").select("id", "layer", "source_name", "label", "target_name")


def event_network(spark, d):
    """The edges at events, with the type of the event."""
    v = event_nodes(spark, d).select(F.col("id").alias("source"), F.col("type").alias("event_type"))
    return _edges(spark, d).filter("layer = 'event'").join(v, "source").select("id", "source", "event_type", "label", "target")


def type_audit(spark, d):
    e = _edges(spark, d)
    return e.groupBy(graph.clean_type(F.col("label")).alias("rel_type"), "layer").agg(F.count("*").alias("n"))


def _corrections(spark, d):
    """Corrections made from the tables: one hot entity is replaced, every REJECTED event's edges go, one edge is added."""
    rows = [(1, "REPLACE_LINK", None, None, None, None, "QX100043", "QX_NEW"), (2, "REPLACE_LINK", None, None, None, None, "QX_NEW", "QX_NEWER"), (3, "ADD_EDGE", None, "QX_A", "RELATED_TO", "QX_B", None, None)]
    schema = "ordinal int, action string, target_key string, source string, label string, target string, old_id string, new_id string"
    fixed = spark.createDataFrame(rows, schema)
    rejected = table(spark, d, "claims").filter("object_id is not null and predicate = 'LOCATED_IN'").select(F.lit(9).alias("ordinal"), F.lit("REJECT_EDGE").alias("action"), F.lit(None).cast("string").alias("target_key"), F.col("subject_id").alias("source"), F.col("predicate").alias("label"), F.col("object_id").alias("target"), F.lit(None).cast("string").alias("old_id"), F.lit(None).cast("string").alias("new_id"))
    return fixed.unionByName(rejected.distinct())


def fused_edges(spark, d):
    return graph.fuse(graph.fact_edges(table(spark, d, "claims")), _corrections(spark, d)).select("id", "source", "target", "label", "layer")


# --- facts ----------------------------------------------------------------------------
def _candidates(spark, d):
    c = _t(spark, d, "distant_labeled").filter("subject_entity_id is not null and object_entity_id is not null and predicate is not null")
    return c.select("candidate_id", "sentence_id", "text", F.col("subject_entity_id").alias("subject_id"), "predicate", F.col("object_entity_id").alias("object_id"))


def claim_alignment(spark, d):
    return facts.align(_candidates(spark, d), table(spark, d, "claims")).select("candidate_id", "n_claims", F.coalesce(F.array_join("claim_ids", ","), F.lit("")).alias("claim_ids"))


def trigger_matches(spark, d):
    c = _t(spark, d, "distant_labeled").filter("subject_entity_id is not null and object_entity_id is not null and predicate is not null")
    far = X.token_distance(F.col("subject_token_start"), F.col("subject_token_end"), F.col("object_token_start"), F.col("object_token_end"))
    known = F.col("subject_token_start").isNotNull() & F.col("subject_token_end").isNotNull() & F.col("object_token_start").isNotNull() & F.col("object_token_end").isNotNull()
    c = c.select("candidate_id", "text", "tokens", "predicate", F.when(known, far).alias("distance"))
    return facts.trigger_signals(c, facts.patterns(spark)).select("candidate_id", F.size("triggers").alias("n_triggers"), F.array_join("triggers", ",").alias("triggers"))


def fact_aggregate(spark, d):
    c = table(spark, d, "verified_events_text").dropDuplicates(["event_candidate_id"])
    f = events.to_facts(c, verified=True).select("subject_id", "predicate", "object_id", F.lit("").alias("qualifiers"), F.coalesce("event_confidence", F.lit(0.0)).alias("score"))
    return facts.aggregate(f)


def fact_conflicts(spark, d):
    return facts.conflicts(table(spark, d, "claims"))


def signal_rollup(spark, d):
    return facts.signal_summary(_t(spark, d, "verified_events_text"), ["event_type"])


def fact_verdicts(spark, d):
    e = _t(spark, d, "verified_events_text").filter("signals is not null")
    v = facts.verified(e.select("event_candidate_id", F.filter("signals", lambda x: x.isNotNull()).alias("signals")))
    return v.select("event_candidate_id", "verdict", "mode", "score", "status")


def event_fact_candidates(spark, d):
    """The facts of verified events with their signals, judged."""
    f = facts.verified(events.to_facts(_t(spark, d, "verified_events_text"), verified=True))
    return f.select("event_candidate_id", "subject_id", "predicate", "object_id", F.array_join(F.transform("signals", lambda x: x["name"]), ",").alias("names"), "verdict", "score", "status")


def _event_candidates(spark, d):
    f = events.to_facts(_t(spark, d, "verified_events_text"), verified=True)
    return f.select(F.col("event_candidate_id").alias("candidate_id"), "subject_id", "predicate", "object_id", F.lit("").alias("qualifiers"), F.coalesce("event_confidence", F.lit(0.0)).alias("score"), "evidence")


def whole_facts(spark, d):
    f = facts.whole_facts(_event_candidates(spark, d))
    return f.select("fact_id", "subject_id", "predicate", "object_id", "n_evidence", "confidence", "status", "prototype", F.col("evidence.sentence_id").alias("sentence_id"))


def fact_evidence(spark, d):
    """Every piece of evidence of every fact, with its place in it."""
    e = facts.fact_evidence(_event_candidates(spark, d))
    w = W.partitionBy("subject_id", "predicate", "object_id").orderBy("candidate_id")
    return e.select("subject_id", "predicate", "object_id", "candidate_id", F.col("evidence.sentence_id").alias("sentence_id"), F.row_number().over(w).alias("pos"))


def distant_support(spark, d):
    return facts.distant_support(_candidates(spark, d), table(spark, d, "claims")).select("candidate_id", "n_claims", "first_claim", "support", "qualifiers")


# --- relations ------------------------------------------------------------------------
def _mentions(spark, d):
    t = _t(spark, d, "distant_labeled")
    one = lambda p: t.select("doc_id", "sentence_id", "sentence_index_in_doc", F.col(f"{p}_mention_id").alias("mention_id"), F.col(f"{p}_entity_id").alias("entity_id"), X.entity_type(F.col(f"{p}_entity_type")).alias("type"), F.col(f"{p}_text").alias("text"), F.col(f"{p}_token_start").alias("s"), F.col(f"{p}_token_end").alias("e"))
    m = one("subject").unionByName(one("object")).filter("mention_id is not null and s is not null and e is not null")
    return m.dropDuplicates(["sentence_id", "mention_id", "s", "e", "entity_id", "type", "text"])


def mention_pairs(spark, d):
    m = _mentions(spark, d).filter("entity_id is not null").select("sentence_id", "mention_id", "entity_id", "type", "s", "e").distinct()
    p = relations.mention_pairs(m)
    p = relations.candidate_relations(p.select("sentence_id", "s_mention_id", "o_mention_id", F.col("s_type"), F.col("o_type"), "distance"))
    return p.filter(F.size("relations") > 0).groupBy("s_type", "o_type", F.array_join("relations", ",").alias("relations")).agg(F.count("*").alias("n"), F.sum("distance").cast("bigint").alias("total_distance"))


def local_windows(spark, d):
    t = _t(spark, d, "distant_labeled").filter("tokens is not null and subject_token_start is not null and object_token_start is not null and subject_token_end is not null and object_token_end is not null")
    w = relations.local_window(F.col("subject_token_start"), F.col("subject_token_end"), F.col("object_token_start"), F.col("object_token_end"), F.size("tokens"))
    return t.select("candidate_id", w["s"].alias("window_start"), w["e"].alias("window_end"), F.array_join(F.slice("tokens", w["s"] + 1, F.greatest(w["e"] - w["s"], F.lit(0))), " ").alias("window_text"))


def trigger_hits(spark, d):
    t = _t(spark, d, "distant_labeled").filter("tokens is not null and subject_token_start is not null and object_token_start is not null and subject_token_end is not null and object_token_end is not null")
    w = relations.local_window(F.col("subject_token_start"), F.col("subject_token_end"), F.col("object_token_start"), F.col("object_token_end"), F.size("tokens"))
    return t.select("candidate_id", F.array_join(relations.trigger_hits(F.col("tokens"), w), ",").alias("hits"))


def weak_labels(spark, d):
    """Labels of all candidates by the fold over their fitting relations."""
    t = _t(spark, d, "distant_labeled").withColumn("s_type", X.entity_type(F.col("subject_entity_type"))).withColumn("o_type", X.entity_type(F.col("object_entity_type")))
    t = relations.candidate_relations(t.filter("tokens is not null"))
    n = F.size("tokens")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    w = relations.local_window(z("subject_token_start"), z("subject_token_end"), z("object_token_start"), z("object_token_end"), n)
    none = F.array().cast("array<string>")
    exact = F.when(F.coalesce("exact_claim_match", F.lit(False)) & F.col("predicate").isNotNull(), F.array("predicate")).otherwise(none)
    why = F.array_compact(F.array(F.when(X.low_information(F.col("subject_text")).isNotNull(), F.concat(F.lit("subject_"), F.lower(X.low_information(F.col("subject_text"))))), F.when(X.low_information(F.col("object_text")).isNotNull(), F.concat(F.lit("object_"), F.lower(X.low_information(F.col("object_text")))))))
    whole = F.struct(F.lit(0).alias("s"), n.alias("e"))
    # each input is a column of its own, so the fold doesn't compute it again at every step
    t = t.withColumns({"x_exact": exact, "x_bridge": F.coalesce("bridge_predicates", none), "x_why": why, "x_local": relations.trigger_hits(F.col("tokens"), w), "x_all": relations.trigger_hits(F.col("tokens"), whole)})
    fold = relations.label_fold(*[F.col(c) for c in ("relations", "x_exact", "x_bridge", "x_local", "x_all", "x_why")])
    t = t.withColumn("f", fold)
    return t.select("candidate_id", relations.label_of(F.col("f")).alias("label"), F.array_join("f.positive", ",").alias("positive"), F.array_join("f.reasons", ",").alias("reasons"))


def _bag_rows(spark, d):
    t = _t(spark, d, "distant_labeled").filter("subject_entity_id is not null and object_entity_id is not null and doc_id is not null")
    return t.select("doc_id", F.col("subject_entity_id").alias("subject_id"), F.col("object_entity_id").alias("object_id"), "sentence_id", F.col("subject_mention_id").alias("s_mention"), F.col("object_mention_id").alias("o_mention"), F.coalesce("subject_token_start", F.lit(0)).alias("s_start"), F.coalesce("object_token_start", F.lit(0)).alias("o_start"), F.coalesce("positive_predicates", F.array().cast("array<string>")).alias("labels"), (F.col("weak_label") == "hard_negative").alias("na"))


def bag_merge(spark, d):
    b = relations.bags(_bag_rows(spark, d))
    return b.select("bag_id", F.size("evidence").cast("bigint").alias("n_evidence"), F.array_join("labels", ",").alias("labels"))


def na_downsample(spark, d):
    b = relations.bags(_bag_rows(spark, d))
    return relations.downsample_na(b).select("bag_id", F.array_join("labels", ",").alias("labels"))


def class_weights(spark, d):
    return relations.class_weights(relations.bags(_bag_rows(spark, d)))


def bag_split(spark, d):
    b = _bag_rows(spark, d).select("doc_id", F.concat_ws("__", "doc_id", "subject_id", "object_id").alias("bag_id")).distinct()
    return relations.split_by_document(b).select("bag_id", "split")


def vocabulary(spark, d):
    return relations.vocabulary(_t(spark, d, "distant_labeled").filter("tokens is not null").select("tokens"), 2)


def claim_bridges(spark, d):
    m = _mentions(spark, d)
    a = _t(spark, d, "aliases").filter("entity_id is not null and alias is not null").join(table(spark, d, "entities").select("entity_id", F.col("entity_type").alias("type")), "entity_id").select("entity_id", F.col("alias").alias("surface"), "type").distinct()
    return relations.bridges(m.filter("entity_id is null and text is not null").select("sentence_id", "mention_id", "text", "type"), m.filter("entity_id is not null").select("sentence_id", "entity_id"), latest(table(spark, d, "claims").select("claim_id", "subject_id", "predicate", "object_id", "retrieved_at"), ["claim_id"], ["retrieved_at"]), a)


def exact_claim_pairs(spark, d):
    t = _t(spark, d, "distant_labeled").filter("subject_entity_id is not null and object_entity_id is not null")
    own = F.array_compact(F.array(F.col("bridge_details.subject.bridge_claim_id"), F.col("bridge_details.object.bridge_claim_id")))
    p = t.select(F.col("candidate_id").alias("pair_id"), F.col("subject_entity_id").alias("subject_id"), X.predicate(F.col("predicate")).alias("predicate"), F.col("object_entity_id").alias("object_id"), own.alias("bridge_ids"))
    return relations.exact_claims(p, table(spark, d, "claims")).select("pair_id", F.array_join("claim_ids", ",").alias("claim_ids"))


def pair_positions(spark, d):
    t = _t(spark, d, "distant_labeled").filter("tokens is not null and size(tokens) > 0 and subject_token_start is not null and object_token_start is not null")
    f = relations.pair_features(F.col("tokens"), F.col("subject_token_start"), F.col("object_token_start"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint")
    return t.select("candidate_id", total(f["s_pos"]).alias("s_sum"), total(f["o_pos"]).alias("o_sum"), total(f["piece"]).alias("piece_sum"))


def review_queue(spark, d):
    q = relations.review_queue(_t(spark, d, "distant_labeled"))
    return q.select("candidate_id", "weak_label", F.array_join("review_reasons", ",").alias("reasons"))


# --- events ---------------------------------------------------------------------------
def event_arguments(spark, d):
    return events.arguments(_t(spark, d, "verified_events_text"))


def event_verify(spark, d):
    v = events.verify(_t(spark, d, "verified_events_text"))
    return v.withColumn("signals", F.array_join(F.transform("signals", lambda x: x["name"]), ","))


def event_facts(spark, d):
    return events.to_facts(_t(spark, d, "verified_events_text"), verified=True).select("event_candidate_id", "predicate", "subject_id", "object_id")


def claim_events(spark, d):
    return events.from_claims(table(spark, d, "claims"), table(spark, d, "entities"))


def event_support(spark, d):
    e = _t(spark, d, "verified_events_text").filter("roles is not null").select(F.col("event_candidate_id").alias("event_id"), F.col("evidence.sentence_id").alias("sentence_id"), F.array_distinct(F.array_compact(F.transform("roles", lambda r: r["entity_id"]))).alias("entity_ids"))
    c = _t(spark, d, "distant_labeled").select("candidate_id", "sentence_id", F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id"))).alias("entity_ids"))
    # one entity in common is asked for here: no pair of the tables shares two
    return events.same_sentence_support(e.filter("sentence_id is not null"), c, 1).select("event_id", F.array_join("candidate_ids", ",").alias("candidate_ids"))


def text_events(spark, d):
    t = _t(spark, d, "distant_labeled").filter("token_spans is not null")
    span = lambda p: F.struct(F.get(F.get("token_spans", F.col(f"{p}_token_start")), F.lit(0)).alias("s"), F.get(F.get("token_spans", F.col(f"{p}_token_end") - 1), F.lit(1)).alias("e"), F.col(f"{p}_entity_id").alias("entity_id"), X.entity_type(F.col(f"{p}_entity_type")).alias("type"))
    m = t.select("sentence_id", F.explode(F.array(span("subject"), span("object"))).alias("m")).select("sentence_id", "m.*").filter("s is not null and e is not null").distinct()
    return events.text_events(_t(spark, d, "sentences").filter("text is not null").select("sentence_id", "text"), m)


# --- coreference ----------------------------------------------------------------------
def _coref_tokens(spark, d):
    return _t(spark, d, "sentences").filter("text is not null and doc_id is not null and sentence_index_in_doc is not null").select("doc_id", "sentence_id", F.col("sentence_index_in_doc").alias("sentence_index"), X.tokens(F.col("text")).alias("tokens"))


def coref_targets(spark, d):
    return coref.scan_targets(_coref_tokens(spark, d))


def coref_resolve(spark, d):
    t = coref.scan_targets(_coref_tokens(spark, d)).withColumn("target_id", F.concat_ws(":", "sentence_id", F.col("token_start").cast("string")))
    a = _mentions(spark, d).filter("entity_id is not null and doc_id is not null and sentence_index_in_doc is not null").select("doc_id", F.col("sentence_index_in_doc").alias("sentence_index"), F.col("s").alias("token_start"), "entity_id", "type").distinct()
    return coref.resolve(t, a)


def coref_report(spark, d):
    return coref.report(durable(coref_resolve(spark, d)), table(spark, d, "entities"))


# --- label sequences ------------------------------------------------------------------
def _labels(spark, d, *more):
    t = _t(spark, d, "distant_labeled").filter("tokens is not null and size(tokens) > 0 and subject_token_start is not null and object_token_start is not null and subject_token_end > subject_token_start and object_token_end > object_token_start")
    kind = lambda p: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"PERSON": "PER", "ORGANIZATION": "ORG", "PLACE": "LOC"}.items() for x in kv]), X.entity_type(F.col(f"{p}_entity_type"))), X.entity_type(F.col(f"{p}_entity_type")))
    span = lambda p: F.struct(F.col(f"{p}_token_start").alias("s"), F.col(f"{p}_token_end").alias("e"), kind(p).alias("type"))
    t = t.filter("subject_token_end <= object_token_start or object_token_end <= subject_token_start").withColumn("spans", F.array_sort(F.array(span("subject"), span("object"))))
    return t.filter(F.forall("spans", lambda s: s["e"] <= F.size("tokens"))).select("candidate_id", "tokens", "spans", mentions.token_labels(F.col("spans"), F.size("tokens")).alias("labels"), *more)


def bio_round_trip(spark, d):
    t = _labels(spark, d)
    back = mentions.label_spans(F.col("labels"))
    return t.select("candidate_id", F.size(back).cast("bigint").alias("n_spans"), F.aggregate(back, F.lit(0), lambda a, s: a + s["s"] * 100 + s["e"]).cast("bigint").alias("checksum"))


def bio_legalize(spark, d):
    t = _labels(spark, d).withColumn("inside", F.transform("labels", lambda x: F.regexp_replace(x, "^B-", "I-")))
    return t.select("candidate_id", F.array_join(mentions.legal_bio(F.col("inside")), " ").alias("legal"), mentions.illegal_bio(F.col("inside")).cast("bigint").alias("n_illegal"))


def title_runs(spark, d):
    t = _t(spark, d, "distant_labeled").filter("tokens is not null")
    return t.select("candidate_id", F.explode(mentions.title_runs(F.col("tokens"))).alias("r")).select("candidate_id", "r.s", "r.e")


def paren_depths(spark, d):
    t = _t(spark, d, "sentences").filter("text is not null").select("sentence_id", X.tokens(F.col("text")).alias("tokens"))
    return t.select("sentence_id", F.coalesce(F.array_max(mentions.paren_depths(F.col("tokens"))), F.lit(0)).cast("bigint").alias("deepest")).filter("deepest > 0")


def dictionary_matches(spark, d):
    words = mentions.alias_dictionary(mentions.dictionary_names(table(spark, d, "entities"), table(spark, d, "aliases")))
    s = _t(spark, d, "sentences").filter("text is not null").select("sentence_id", X.tokens(F.col("text")).alias("tokens"))
    return mentions.longest_matches(s, words)


def repeated_sentences(spark, d):
    s = _t(spark, d, "sentences").filter("doc_id is not null and text is not null").select("doc_id", "sentence_index_in_doc", "sentence_id", "text")
    return drop_repeats(s, ["doc_id"], ["sentence_index_in_doc", "sentence_id"], "text").groupBy("doc_id").agg(F.count("*").alias("n_kept"))


# --- linking --------------------------------------------------------------------------
def _index(spark, d):
    return linking.alias_index(table(spark, d, "entities"), table(spark, d, "aliases"))


def alias_index_sizes(spark, d):
    return _index(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def alias_recall(spark, d):
    m = _mentions(spark, d).select("mention_id", "text", "type").distinct()
    return linking.recall(m, _index(spark, d)).select("mention_id", "entity_id", "source", F.col("alias_score"))


def tfidf_recall(spark, d):
    e = table(spark, d, "entities").select("entity_id", F.concat_ws(" ", "canonical_name", "description_en").alias("text"))
    q = _t(spark, d, "aliases").filter("alias is not null").select(F.col("alias_id").alias("query_id"), F.col("alias").alias("text"))
    return linking.tfidf_recall(q, e).select("query_id", "entity_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _link_mentions(spark, d):
    """Each mention once, with its sentence, the title of its document, and why it names nothing, if so."""
    m = _mentions(spark, d)
    m = m.select("mention_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "sentence_id", "text", "type", (F.col("e") - F.col("s")).alias("n_words"), F.struct("doc_id", "sentence_index_in_doc", "s").alias("at"), X.low_information(F.col("text")).alias("skip"))
    m = first_rows(m, ["mention_id"], ["at", "text", "type"])
    s = _t(spark, d, "sentences").select("sentence_id", F.col("text").alias("context"))
    t = _t(spark, d, "document_records").select("doc_id", F.trim("title").alias("title"))
    return m.join(s, "sentence_id", "left").join(t, "doc_id", "left").fillna("", ["context", "title"])


def _scored(spark, d, mentions):
    m = mentions.filter("skip is null")
    r = linking.recall(m.select("mention_id", "text", "type"), _index(spark, d))
    return linking.score_candidates(m, r, durable(linking.entity_profiles(table(spark, d, "entities"), _t(spark, d, "aliases"))))


def link_scored(spark, d):
    return _scored(spark, d, durable(_link_mentions(spark, d))).select("mention_id", "doc_id", "entity_id", "source", "local", "type_score")


def link_decisions(spark, d):
    m = durable(_link_mentions(spark, d))  # sentences and titles are joined once, not for recall, scores and decisions each
    return linking.link(m, _scored(spark, d, m))


def _gap_rows(spark, d):
    m = _mentions(spark, d).filter("text is not null")
    t = _t(spark, d, "sentences").select("sentence_id", F.col("text").alias("context"))
    n = F.col("entity_id").isNull()
    return m.join(t, "sentence_id", "left").select("text", "type", "doc_id", F.when(n, "NIL").otherwise("LINKED").alias("decision"), F.when(n, 0).otherwise(1).alias("n_candidates"), "context")


def link_gaps(spark, d):
    return linking.gaps(_gap_rows(spark, d))


def link_gap_contexts(spark, d):
    rows = durable(_gap_rows(spark, d))
    return linking.gap_contexts(rows.filter("decision = 'NIL'"), linking.gaps(rows))


# --- measures -------------------------------------------------------------------------
def _spans(spark, d):
    gold = _labels(spark, d).select(F.col("candidate_id").alias("key"), F.explode("spans").alias("x")).select("key", "x.*")
    runs = _labels(spark, d).select(F.col("candidate_id").alias("key"), F.explode(mentions.title_runs(F.col("tokens"))).alias("x")).select("key", "x.s", "x.e", F.lit("PER").alias("type"))
    return gold, runs


def span_prf(spark, d):
    return metrics.span_scores(*_spans(spark, d), by="type")


def type_confusion(spark, d):
    return metrics.confusion(*_spans(spark, d))


def span_errors(spark, d):
    return metrics.span_errors(*_spans(spark, d))


def confidence_buckets(spark, d):
    return metrics.confidence_buckets(_t(spark, d, "verified_events_text"), "confidence")


def relation_prf(spark, d):
    t = _t(spark, d, "distant_labeled").filter("predicate is not null")
    gold = t.select(F.col("candidate_id").alias("bag_id"), F.explode("positive_predicates").alias("label"))
    return metrics.relation_scores(t.select(F.col("candidate_id").alias("bag_id"), F.col("predicate").alias("label")), gold)


def relation_summary(spark, d):
    """Micro and macro means over all relations of the ontology, also those without a row."""
    t = _t(spark, d, "distant_labeled").filter("predicate is not null")
    gold = t.select(F.col("candidate_id").alias("bag_id"), F.explode("positive_predicates").alias("label"))
    labels = spark.createDataFrame([(x,) for x in sorted(K.RELATION_TYPES)], "label string")
    return metrics.relation_summary(metrics.relation_scores(t.select(F.col("candidate_id").alias("bag_id"), F.col("predicate").alias("label")), gold, labels))


def illegal_counts(spark, d):
    t = _labels(spark, d).select(F.transform("labels", lambda x: F.regexp_replace(x, "^B-", "I-")).alias("labels"))
    return metrics.illegal_counts(t)


def targeted_slices(spark, d):
    """Span measures over the texts that hold some phrases."""
    gold, runs = _spans(spark, d)
    texts = _labels(spark, d).select(F.col("candidate_id").alias("key")).join(_t(spark, d, "distant_labeled").select(F.col("candidate_id").alias("key"), "text"), "key")
    return metrics.slice_scores(texts.filter("text is not null"), gold, runs, ["university of", "machine", "no such phrase"])


def closed_gold(spark, d):
    t = _t(spark, d, "distant_labeled").filter("predicate is not null")
    gold = t.filter("weak_label in ('ds_strict', 'hard_negative')").select(F.col("candidate_id").alias("bag_id"), F.col("predicate").alias("label"), F.when(F.col("weak_label") == "ds_strict", "positive").otherwise("negative").alias("verdict"))
    return metrics.closed_scores(t.filter("exact_claim_match").select(F.col("candidate_id").alias("bag_id"), F.col("predicate").alias("label")), gold)


def label_counts(spark, d):
    return count_by(_t(spark, d, "distant_labeled"), F.col("weak_label"), "label").select("label", "n")


def top_mentions(spark, d):
    """The twenty most frequent surfaces of each type."""
    m = _mentions(spark, d).filter("text is not null").groupBy("type", "text").agg(F.count("*").alias("n"))
    return top_k(m, ["type"], [F.desc("n"), F.col("text")], 20).select("type", "text", "n", F.col("rank").cast("bigint").alias("rank"))


NAMES = """orphan_objects latest_claims upsert_labels frontier_expand structured_checks claim_records alias_records grouped_records job_ledger constraint_counts
graph_nodes fact_edges event_edges node_degree graph_stats hub_edges induced_edges two_hop adjacency_sets layer_edges event_network type_audit fused_edges evidence_edges event_nodes display_labels two_hop_paths
claim_alignment trigger_matches fact_aggregate fact_conflicts signal_rollup fact_verdicts event_fact_candidates whole_facts fact_evidence distant_support
mention_pairs local_windows trigger_hits weak_labels bag_merge na_downsample class_weights bag_split vocabulary claim_bridges exact_claim_pairs pair_positions review_queue
event_arguments event_verify event_facts claim_events event_support text_events coref_targets coref_resolve coref_report
bio_round_trip bio_legalize title_runs paren_depths dictionary_matches repeated_sentences
alias_index_sizes alias_recall tfidf_recall link_scored link_decisions link_gaps link_gap_contexts
span_prf type_confusion span_errors confidence_buckets relation_prf relation_summary illegal_counts targeted_slices closed_gold label_counts top_mentions""".split()
QUERIES = {n: globals()[n] for n in NAMES}

