"""Queries over samples, spans, profiles and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import spans
from kgloom.functions import text as X
from kgloom.operators import extract, facts, graph, linking, metrics, sampling
from kgloom.operators.relational import top_k
from kgloom.plans import kg_queries as Q
from kgloom.plans import kg_sql as S
from kgloom.session import durable, table


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """All labels of the set, also those that never occur."""
    every = spark.createDataFrame([("O",)] + [(f"{p}-{t}",) for t in K.MENTION_LABELS for p in "BI"], "label string")
    n = Q._labels(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return every.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def hash_sample(spark, d):
    """A sampling operator: 100 sentences in hash order."""
    return sampling.hash_sample(Q._t(spark, d, "sentences").select("sentence_id", "doc_id"), "sentence_id", 100)


def dispersed_sample(spark, d):
    return sampling.per_group(Q._t(spark, d, "sentences").select("sentence_id", "source_id").filter("source_id is not null"), "source_id", "sentence_id", 3)


def quota_sample(spark, d):
    """A sampling operator: 1,000 sentences over the sources by size, one of each at least."""
    return sampling.quota_sample(Q._t(spark, d, "sentences").filter("source_id is not null").select("sentence_id", "source_id"), "source_id", "sentence_id", 1000)


def train_dev_split(spark, d):
    return sampling.train_dev(Q._t(spark, d, "distant_labeled").select("candidate_id"), "candidate_id")


def candidate_strengths(spark, d):
    """How well each candidate is backed: by text near the pair, by a claim or bridge, by the sentence."""
    t = Q._t(spark, d, "distant_labeled").filter("predicate is not null and tokens is not null and subject_token_start is not null and object_token_start is not null and subject_token_end is not null and object_token_end is not null")
    from kgloom.operators import relations

    w = relations.local_window(F.col("subject_token_start"), F.col("subject_token_end"), F.col("object_token_start"), F.col("object_token_end"), F.size("tokens"))
    t = t.withColumns({"local_hits": relations.trigger_hits(F.col("tokens"), w), "all_hits": relations.trigger_hits(F.col("tokens"), F.struct(F.lit(0).alias("s"), F.size("tokens").alias("e")))})
    local, sentence = F.array_contains("local_hits", F.col("predicate")), F.array_contains("all_hits", F.col("predicate"))
    structured = F.coalesce("exact_claim_match", F.lit(False)) | F.array_contains(F.coalesce("bridge_predicates", F.array().cast("array<string>")), F.col("predicate"))
    return t.select("candidate_id", F.when(local & structured, "strong").when(local | structured, "medium").when(sentence, "weak").otherwise("unknown").alias("strength"))


def entity_profiles(spark, d):
    """Surfaces of each entity, and its description."""
    e = table(spark, d, "entities")
    s = e.select("entity_id", F.explode(F.array_compact(F.array("canonical_name", "label_en", "label_zh"))).alias("surface")).unionByName(table(spark, d, "aliases").filter("entity_id is not null and alias is not null").select("entity_id", F.col("alias").alias("surface")))
    n = s.groupBy("entity_id").agg(F.countDistinct("surface").alias("n_surfaces"), F.min("surface").alias("first_surface"))
    text = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("description_en", "description_zh", "wikipedia_summary_en")])
    return e.join(n, "entity_id", "left").select("entity_id", "n_surfaces", "first_surface", F.md5(text).alias("description_digest"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"))


def span_conversion(spark, d):
    """Subject spans to characters and back to tokens."""
    t = Q._t(spark, d, "distant_labeled").filter("token_spans is not null and subject_token_start is not null and subject_token_end is not null").withColumn("c", spans.chars_of_tokens(F.col("token_spans"), F.col("subject_token_start"), F.col("subject_token_end"))).filter("c is not null")
    back = spans.tokens_of_chars(F.col("token_spans"), F.col("c.s"), F.col("c.e"))
    return t.select("candidate_id", F.col("c.s").alias("s"), F.col("c.e").alias("e"), back["s"].alias("token_s"), back["e"].alias("token_e"))


def linking_eval(spark, d):
    """The decisions over all mentions against the entities the tables know; one without has to come out as NIL."""
    m = Q._mentions(spark, d)
    keys = F.struct("doc_id", "sentence_id", F.col("s").alias("token_start"), F.col("e").alias("token_end"))
    gold = m.groupBy("mention_id").agg(F.min(keys).alias("k"), F.min("entity_id").alias("entity_id")).select("mention_id", "k.*", "entity_id")
    mentions = durable(Q._link_mentions(spark, d))
    found = linking.link_tops(mentions, Q._scored(spark, d, mentions))
    return metrics.link_scores(found.join(gold.drop("entity_id"), "mention_id"), gold)


def linking_tops(spark, d):
    """A report: the twenty surfaces most often linked, left to review and without an entity, by decision."""
    m = durable(Q._link_mentions(spark, d))  # once for the decisions and for what is counted
    n = m.select("mention_id", "text", "type").join(linking.link(m, Q._scored(spark, d, m)).select("mention_id", "decision"), "mention_id").groupBy("decision", "text", "type").agg(F.count("*").alias("n"))
    return top_k(n, ["decision"], [F.desc("n"), F.col("text"), F.col("type")], 20).select("decision", "text", "type", "n", "rank")


def linking_report(spark, d):
    m = Q._mentions(spark, d)
    return m.agg(F.count("*").alias("n_mentions"), F.count("entity_id").alias("n_linked"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("doc_id").alias("n_docs"), F.count_if(X.low_information(F.col("text")).isNotNull()).alias("n_skipped"))


def whole_graph(spark, d):
    """All nodes with their outgoing edges, also those without any."""
    n = graph.entity_nodes(table(spark, d, "entities")).select("id", "label")
    e = Q._edges(spark, d).select(F.col("source").alias("id"), F.col("id").alias("edge_id"), "target")
    return n.join(e, "id", "left").groupBy("id", "label").agg(F.count("edge_id").alias("n_out"), F.countDistinct("target").alias("n_targets"))


def literal_edges(spark, d):
    return Q._edges(spark, d).filter(F.col("target").startswith("literal:")).groupBy("target").agg(F.count("*").alias("n"))


def relation_support(spark, d):
    """For each relation: candidates, documents, and the share with an exact claim."""
    t = Q._t(spark, d, "distant_labeled").filter("predicate is not null")
    return t.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.coalesce("exact_claim_match", F.lit(False)).cast("double")), 6).alias("exact_share"))


def extracted_claims(spark, d):
    """The labels of all bags as predictions."""
    b = table(spark, d, "relation_bags").filter("bag_id is not null and trim(bag_id) <> ''").dropDuplicates(["bag_id"])
    p = b.select("bag_id", F.explode(F.array_distinct("label_names")).alias("relation"), F.lit(1.0).alias("probability"), F.sort_array(F.array_distinct(F.array_compact(F.transform("sentence_evidences", lambda x: x["sentence_id"])))).alias("supporting")).filter("relation is not null and relation <> 'NA'")
    return extract.extracted_claims(p, b.select("bag_id", "subject_id", "object_id", "subject_type", "object_type"))


def pair_fact_signals(spark, d):
    """Signals of the fact candidates of all labelled pairs, by name."""
    t = Q._t(spark, d, "distant_labeled").filter("subject_entity_id is not null and object_entity_id is not null and predicate is not null")
    p = t.select("candidate_id", F.col("subject_entity_id").alias("subject_id"), "predicate", F.col("object_entity_id").alias("object_id"), F.col("subject_resolution").alias("s_resolution"), F.col("object_resolution").alias("o_resolution"), F.coalesce(F.array_contains("positive_predicates", F.col("predicate")), F.lit(False)).alias("local"))
    c = extract.candidates_of_pairs(p, table(spark, d, "claims"))
    return c.select("candidate_id", F.array_join(F.transform("signals", lambda x: x["name"]), ",").alias("names"), F.round(facts.signal_sum(F.col("signals")), 6).alias("score_sum"))


QUERIES = {f.__name__: f for f in (label_distribution, hash_sample, dispersed_sample, quota_sample, train_dev_split, candidate_strengths, entity_profiles, span_conversion, linking_eval, linking_tops, linking_report, whole_graph, literal_edges, relation_support, extracted_claims, pair_fact_signals)}

_EV = "case relation " + " ".join(f"when '{p}' then '{v[0]}'" for p, v in K.EVENT_SPECS.items()) + " end"
_H = "md5('42|' || {0})"
SQL = {
    "label_distribution": f"""
with l as (select unnest(['O'{''.join(f", '{p}-{t}'" for t in K.MENTION_LABELS for p in 'BI')}]) as label), g as (select len(tokens) as n, s1, e1, t1, s2, e2, t2 from {S._LAB}),
x as (select 'B-' || t1 as label, 1 as c from g union all select 'B-' || t2, 1 from g union all select 'I-' || t1, e1 - s1 - 1 from g union all select 'I-' || t2, e2 - s2 - 1 from g union all select 'O', n - (e1 - s1) - (e2 - s2) from g)
select label, cast(coalesce(sum(c), 0) as bigint) as n from l left join x using (label) group by 1""",
    "hash_sample": f"select sentence_id, doc_id from {S.S} order by {_H.format('sentence_id')}, sentence_id limit 100",
    "dispersed_sample": f"select sentence_id, source_id from (select sentence_id, source_id, row_number() over (partition by source_id order by {_H.format('sentence_id')}, sentence_id) as r from {S.S} where source_id is not null) where r <= 3",
    "quota_sample": f"""
with s as (select sentence_id, source_id from {S.S} where source_id is not null), z as (select source_id, count(*) as n from s group by 1),
t as (select 1000 - sum(least(n, 1)) as spare, sum(greatest(n - 1, 0)) as rest from z), x as (select source_id, n, least(n, 1) as lo, greatest(n - 1, 0) as room, least(cast(greatest(n - 1, 0) as double), spare * greatest(n - 1, 0) / rest) as x, spare from z, t),
b as (select *, floor(x) as base from x), u as (select source_id, row_number() over (order by x - base desc, source_id) as r from b where base < room),
q as (select b.source_id, lo + base + case when r <= spare - (select sum(base) from b) then 1 else 0 end as quota from b left join u using (source_id))
select sentence_id, source_id from (select s.*, row_number() over (partition by source_id order by {_H.format('sentence_id')}, sentence_id) as k from s) join q using (source_id) where k <= quota""",
    "train_dev_split": f"select candidate_id, case when cast(('0x' || left({_H.format('candidate_id')}, 8)) as bigint) / 4294967296.0 < 0.2 then 'dev' else 'train' end as split from {S.DL}",
    "candidate_strengths": f"""
with w as (select candidate_id, tokens, ws, we from {S._WIN}),
h as (select candidate_id, list_transform(tokens[ws + 1:greatest(we, ws)], lambda w: {S._lemma('w')}) as l, list_transform(tokens, lambda w: {S._lemma('w')}) as a from w),
g as (select candidate_id, (select 1) as one, {S._HITS} as lh, {S._HITS.replace('list_has_any(l,', 'list_has_any(a,').replace('list_filter(l,', 'list_filter(a,')} as ah from h)
select candidate_id, case when list_contains(lh, predicate) and st then 'strong' when list_contains(lh, predicate) or st then 'medium' when list_contains(ah, predicate) then 'weak' else 'unknown' end as strength
from (select candidate_id, predicate, coalesce(exact_claim_match, false) or list_contains(coalesce(bridge_predicates, []), predicate) as st from {S.DL} where predicate is not null) join g using (candidate_id)""",
    "entity_profiles": """
with s as (select entity_id, unnest([canonical_name, label_en, label_zh]) as x from entities union all select entity_id, alias from aliases where entity_id is not null),
n as (select entity_id, count(distinct x) as n_surfaces, min(x) as first_surface from s where x is not null group by 1)
select entity_id, n_surfaces, first_surface, md5(concat_ws(' ', nullif(trim(description_en), ''), nullif(trim(description_zh), ''), nullif(trim(wikipedia_summary_en), ''))) as description_digest, coalesce(confidence, 0.75) as confidence from entities left join n using (entity_id)""",
    "span_conversion": f"""
select candidate_id, s, e, cast(list_min(i) as integer) as token_s, cast(list_max(i) + 1 as integer) as token_e from (
select candidate_id, s, e, list_filter(range(len(token_spans)), lambda k: token_spans[k + 1][1] < e and token_spans[k + 1][2] > s) as i
from (select candidate_id, token_spans, token_spans[subject_token_start + 1][1] as s, token_spans[subject_token_end][2] as e from {S.DL} where token_spans is not null and subject_token_start < subject_token_end) where s is not null and e is not null)""",
    "linking_report": f"""
select count(*) as n_mentions, count(entity_id) as n_linked, count(distinct entity_id) as n_entities, count(distinct doc_id) as n_docs,
  count(*) filter (t = '' or t in ({S._list(K.PRONOUNS)}) or t in ({S._list(K.GENERIC_PHRASES)}) or length(t) <= 1) as n_skipped from (select *, coalesce({S.NORMAL.format('text')}, '') as t from {S.MENTIONS_ONE})""",
    "whole_graph": f"with e as {S.EDGES} select n.id as id, n.label as label, count(e.id) as n_out, count(distinct target) as n_targets from {S.NODES} n left join e on n.id = e.source group by 1, 2",
    "literal_edges": f"with e as {S.EDGES} select target, count(*) as n from e where target like 'literal:%' group by 1",
    "relation_support": f"select predicate, count(*) as n, count(distinct doc_id) as n_docs, round(avg(cast(coalesce(exact_claim_match, false) as double)), 6) as exact_share from {S.DL} where predicate is not null group by 1",
    "extracted_claims": f"""
select 'claimcand_' || left(sha1(bag_id || '||' || relation), 16) as claim_candidate_id, bag_id, subject_id, relation as predicate, object_id, cast(1.0 as double) as probability, sup[1] as primary_sentence_id, cast(len(sup) as integer) as n_supporting, {_EV} as event_type_hint
from (select distinct on (bag_id) *, list_sort(list_distinct(list_filter(list_transform(sentence_evidences, lambda x: x.sentence_id), lambda x: x is not null))) as sup from relation_bags where bag_id is not null and trim(bag_id) <> '') b,
lateral (select unnest(list_distinct(label_names)) as relation) where relation is not null and relation <> 'NA'""",
    "pair_fact_signals": f"""
select candidate_id, array_to_string(list_filter([case when lo then 'pattern_match' end, case when al then 'wikidata_alignment' end, case when weak then 'link_quality' end], lambda x: x is not null), ',') as names,
  cast(round((case when lo then 0.35 else 0 end) + (case when al then 0.25 else 0 end) + (case when weak then -0.15 else 0 end), 6) as double) as score_sum
from (select candidate_id, coalesce(list_contains(positive_predicates, d.predicate), false) as lo, c.ids is not null as al, coalesce(subject_resolution, '') in ('unresolved', '') or coalesce(object_resolution, '') in ('unresolved', '') as weak
  from {S.DL} d left join {S._CLAIM_IDS} c on d.subject_entity_id = c.subject_id and {S.PRED('d.predicate')} = c.predicate and d.object_entity_id = c.object_id
  where subject_entity_id is not null and object_entity_id is not null and d.predicate is not null)""",
}
