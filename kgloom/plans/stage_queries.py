"""Queries over whole stages: mention decoding, pair windows, bag predictions, structured records, constraints, samples, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.operators import coref, mentions, model, relations, sampling, structured
from kgloom.plans import kg_queries as Q
from kgloom.plans import kg_sql as S
from kgloom.session import table


def decoded_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The decoding chain over the labels of all candidates, read as a model's inside labels."""
    words = mentions.alias_dictionary(mentions.dictionary_names(table(spark, d, "entities"), table(spark, d, "aliases")))
    s = Q._labels(spark, d, "text", "token_spans").filter("token_spans is not null and text is not null").filter(F.size("token_spans") == F.size("tokens"))
    s = s.select(F.col("candidate_id").alias("sentence_id"), "text", "tokens", "token_spans", F.transform("labels", lambda x: F.regexp_replace(x, "^B-", "I-")).alias("labels"), F.transform("tokens", lambda x: F.length(x) / F.lit(16.0)).alias("confidences"))
    return mentions.decode(s, words).select("sentence_id", "mention_type", "s", "e", "char_start", "char_end", "text")


def checked_labels(spark, d):
    """Labels of all candidates against the dictionary: how many stand and why others don't."""
    words = mentions.alias_dictionary(mentions.dictionary_names(table(spark, d, "entities"), table(spark, d, "aliases")))
    c = mentions.check_with_dictionary(Q._labels(spark, d).select(F.col("candidate_id").alias("sentence_id"), "tokens", "labels"), words)
    return c.select("sentence_id", "reason", "stage", "confidence")


def open_coref_targets(spark, d):
    """Anaphors that no labelled mention covers."""
    m = Q._mentions(spark, d).select("sentence_id", F.col("s").alias("token_start"), F.col("e").alias("token_end"))
    return coref.scan_targets(Q._coref_tokens(spark, d), m)


def pair_windows(spark, d):
    t = Q._t(spark, d, "distant_labeled").filter("tokens is not null and subject_token_start is not null and subject_token_end is not null and object_token_start is not null and object_token_end is not null")
    w = relations.crop_window(F.size("tokens"), F.col("subject_token_start"), F.col("subject_token_end"), F.col("object_token_start"), F.col("object_token_end"), 12)
    return t.select("candidate_id", w["s"].alias("window_start"), w["e"].alias("window_end"))


def _bags(spark, d):
    b = table(spark, d, "relation_bags").filter("bag_id is not null and trim(bag_id) <> ''")
    return b.groupBy("bag_id").agg(F.min_by(F.struct("allowed_predicates", "label_names", "sentence_evidences"), F.struct(F.hash("allowed_predicates", "label_names"), F.hash("sentence_evidences"))).alias("b")).select("bag_id", "b.*")


def masked_predictions(spark, d):
    """Predictions of all bags within their mask, with a threshold for each relation and three supporting sentences."""
    p = model.bag_predictions(relations.bag_scores(_bags(spark, d)), 0.5, {"INFLUENCED": 0.7, "WORKED_AT": 0.35}, 3)
    return p.select("bag_id", "relation", "probability", F.array_join("supporting", ",").alias("supporting"))


def dataset_report(spark, d):
    """Bags, evidence and labels of each split."""
    b = _bags(spark, d).withColumn("doc_id", F.regexp_replace("bag_id", r"(__|::|\|).*$", ""))
    s = relations.split_by_document(b)
    return s.groupBy("split").agg(F.count("*").alias("n_bags"), F.sum(F.coalesce(F.size(F.col("sentence_evidences")), F.lit(0))).alias("n_evidence"), F.count_if(F.coalesce(F.size("label_names"), F.lit(0)) <= 0).alias("n_without"))


def prediction_report(spark, d):
    """Predictions, bags and mean probability of each relation."""
    p = model.bag_predictions(relations.bag_scores(_bags(spark, d)))
    return p.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("bag_id").alias("n_bags"), F.round(F.avg("probability"), 6).alias("mean"))


def constraint_violations(spark, d):
    v = structured.constraint_violations(*[table(spark, d, n) for n in ("entities", "aliases", "claims")], Q._t(spark, d, "verified_events_text"))
    return v.groupBy("ordinal", "type", F.coalesce("class", F.lit("")).alias("class")).agg(F.count("*").alias("n"), F.min("subject").alias("first"))


def entity_records(spark, d):
    return structured.entity_records(table(spark, d, "entities"))


def claim_event_times(spark, d):
    return structured.claim_events(table(spark, d, "claims"), table(spark, d, "entities")).select("claim_id", "event_type", "location_id", "start", "end")


def summary_updates(spark, d):
    """Descriptions written over the summaries of the entities that have none."""
    e = table(spark, d, "entities")
    s = e.filter("wikipedia_summary_en is null and description_en is not null").select("entity_id", F.col("description_en").alias("wikipedia_summary_en"), F.lit("2030").alias("retrieved_at"), F.lit("rest").alias("source_name"))
    return structured.update_summaries(e, s).select("entity_id", "wikipedia_summary_en", "retrieved_at", "source_name")


def keyword_sample(spark, d):
    """A sampling operator: 60 sentences, ten with each of two words."""
    s = Q._t(spark, d, "sentences").filter("text is not null and source_id is not null").select("sentence_id", "source_id", "text")
    return sampling.keyword_sample(s, "source_id", "sentence_id", "text", {"machine": 10, "university": 10}, 60).select("sentence_id", "source_id")


def counted_split(spark, d):
    return sampling.counted_split(Q._t(spark, d, "distant_labeled").select("candidate_id"), "candidate_id")


def name_likeness(spark, d):
    """How alike each resolved alias is to the canonical name."""
    a = Q._t(spark, d, "aliases").filter("entity_id is not null and alias is not null").join(table(spark, d, "entities").select("entity_id", "canonical_name"), "entity_id")
    return a.select("alias_id", F.round(X.name_similarity(F.col("alias"), F.col("canonical_name")), 6).alias("likeness"))


def ordered_mentions(spark, d):
    """The place of each mention in its document: by sentence, token and id."""
    from pyspark.sql import Window as W

    m = Q._mentions(spark, d).filter("doc_id is not null").select("doc_id", "sentence_index_in_doc", "s", "mention_id").distinct()
    return m.select("doc_id", "mention_id", "s", F.row_number().over(W.partitionBy("doc_id").orderBy("sentence_index_in_doc", "s", "mention_id")).alias("place"))


def merged_tokens(spark, d):
    """Sentences with the tokens of the labelled pairs where there are any, else their own."""
    t = Q._t(spark, d, "distant_labeled").filter("sentence_id is not null and tokens is not null").groupBy("sentence_id").agg(F.min_by("tokens", "candidate_id").alias("t"))
    s = Q._t(spark, d, "sentences").select("sentence_id", "text").join(t, "sentence_id", "full_outer")
    return s.select("sentence_id", F.when(F.col("t").isNotNull(), F.size("t")).otherwise(F.size(X.tokens(F.coalesce("text", F.lit(""))))).alias("n_tokens"), F.col("t").isNotNull().alias("given"))


QUERIES = {f.__name__: f for f in (decoded_mentions, checked_labels, open_coref_targets, pair_windows, masked_predictions, dataset_report, prediction_report, constraint_violations, entity_records, claim_event_times, summary_updates, keyword_sample, counted_split, name_likeness, ordered_mentions, merged_tokens)}

_Q = lambda n: f"coalesce(json_extract_string(j, '$.{n}.value'), json_extract_string(j, '$.{n}'))"
_TIME = lambda c: f"(case when {c} is null or trim({c}) = '' then null when not regexp_matches({c}, '^[+-]?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then trim({c}) when substr(ltrim({c}, '+-'), 6, 2) = '00' or substr(ltrim({c}, '+-'), 9, 2) = '00' then left(ltrim({c}, '+-'), 4) else left(ltrim({c}, '+-'), 10) end)"
_BAG = "(select distinct on (bag_id) * from relation_bags where bag_id is not null and trim(bag_id) <> '')"
_SC = f"""(select bag_id, relation, sentence_id, max(w) as p from (select bag_id, allowed_predicates, relation, x.sentence_id as sentence_id, case x.weak_label when 'ds_strict' then 0.9 when 'manual_review' then 0.6 when 'hard_negative' then 0.1 else 0.4 end as w
  from (select bag_id, allowed_predicates, unnest(label_names) as relation, sentence_evidences from {_BAG}) b, lateral (select unnest(sentence_evidences) as x)) where sentence_id is not null and relation is not null and relation <> 'NA' and list_contains(allowed_predicates, relation) group by 1, 2, 3)"""
_ROLE = "(values " + ", ".join(f"({i}, '{v[0]}', '{v[1]}', '{v[2]}')" for i, v in enumerate(K.EVENT_SPECS.values(), 15)) + ") as er(ordinal, event_type, a, b)"
SQL = {
    "open_coref_targets": f"select * from ({S.SQL['coref_targets']}) t where not exists (select 1 from {S.MENTIONS_ONE} m where m.sentence_id = t.sentence_id and m.s = t.token_start and m.e = t.token_end)",
    "pair_windows": f"""
select candidate_id, cast(case when n <= 12 then 0 when r - l >= 12 then greatest(0, least(n, r) - 12) else greatest(0, least(n, greatest(0, l - (12 - (r - l)) // 2) + 12) - 12) end as integer) as window_start,
  cast(case when n <= 12 then n when r - l >= 12 then least(n, r) else least(n, greatest(0, l - (12 - (r - l)) // 2) + 12) end as integer) as window_end
from (select candidate_id, len(tokens) as n, least(subject_token_start, object_token_start) as l, greatest(subject_token_end, object_token_end) as r from {S.DL}
  where tokens is not null and subject_token_start is not null and subject_token_end is not null and object_token_start is not null and object_token_end is not null)""",
    "masked_predictions": f"""
select bag_id, relation, cast(max(p) as double) as probability, array_to_string(list(sentence_id order by p desc, sentence_id desc)[1:3], ',') as supporting from {_SC} group by 1, 2 having max(p) >= case relation when 'INFLUENCED' then 0.7 when 'WORKED_AT' then 0.35 else 0.5 end""",
    "prediction_report": f"select relation, count(*) as n, count(distinct bag_id) as n_bags, round(avg(cast(p as double)), 6) as mean from (select bag_id, relation, max(p) as p from {_SC} group by 1, 2 having max(p) >= 0.5) group by 1",
    "dataset_report": f"""
select case when u < 0.65 then 'train' when u < 0.85 then 'dev' else 'test' end as split, count(*) as n_bags, cast(sum(coalesce(len(sentence_evidences), 0)) as bigint) as n_evidence, count(*) filter (coalesce(len(label_names), 0) = 0) as n_without
from (select *, cast(('0x' || left(md5('42' || regexp_replace(bag_id, '(__|::|\\|).*$', '')), 8)) as bigint) / 4294967296.0 as u from {_BAG}) group by 1""",
    "constraint_violations": f"""
with e as (select *, {S.TYPE('entity_type')} as kind from entities), v as {S.V},
a as (select distinct entity_id from aliases where entity_id is not null and trim(alias) <> ''),
r as (
select o as ordinal, 'required_attribute' as type, c as class, entity_id as subject from e, (values (0, 'Person'), (1, 'Organization'), (2, 'Place'), (3, 'Work'), (4, 'Machine'), (5, 'Award')) as k(o, c) where kind = upper(c) and coalesce(trim(canonical_name), '') = ''
union all select 6, 'required_attribute', 'Event', event_candidate_id from v where coalesce(trim(event_candidate_id), '') = '' union all select 7, 'required_attribute', 'Event', event_candidate_id from v where coalesce(trim(event_type), '') = ''
union all select 8, 'unique_attribute', 'Entity', entity_id from e group by entity_id having count(*) > 1 union all select 9, 'unique_attribute', 'Event', event_candidate_id from v group by event_candidate_id having count(*) > 1
union all select 10, 'non_empty_array', 'Entity', entity_id from e where entity_id not in (select entity_id from a) union all select 11, 'non_empty_array', 'Entity', entity_id from e where coalesce(trim(source_record_id), '') = ''
union all select 12, 'value_range', 'Entity', entity_id from e where confidence < 0 or confidence > 1 union all select 13, 'value_range', 'Event', event_candidate_id from v where confidence < 0 or confidence > 1
union all select distinct 14, 'relation_domain_range_check', null, claim_id from claims c join e s on c.subject_id = s.entity_id join e o on c.object_id = o.entity_id
  where {S.PRED('predicate')} in (select predicate from {S.RELTYPES}) and not exists (select 1 from {S.RELTYPES} where rt.predicate = {S.PRED('c.predicate')} and rt.s_type = s.kind and rt.o_type = o.kind)
union all select ordinal, 'event_role_required', er.event_type, event_candidate_id from v join {_ROLE} on v.event_type = er.event_type
  where not list_contains(list_transform(list_filter(coalesce(roles, []), lambda x: x is not null), lambda x: x.role), a) or not list_contains(list_transform(list_filter(coalesce(roles, []), lambda x: x is not null), lambda x: x.role), b)
union all select 25, 'time_order_check', 'Event', event_candidate_id from v where coalesce(start_time_norm, '') <> '' and coalesce(end_time_norm, '') <> '' and start_time_norm > end_time_norm)
select cast(ordinal as integer) as ordinal, type, coalesce(class, '') as class, count(*) as n, min(subject) as first from r group by 1, 2, 3""",
    "claim_event_times": f"""
with q as (select claim_id, case when json_valid(qualifiers_json) then qualifiers_json end as j from {S.LC}), t as (select claim_id, coalesce({_TIME(_Q('start_time'))}, {_TIME(_Q('publication_date'))}, {_TIME(_Q('point_in_time'))}) as a, {_TIME(_Q('end_time'))} as b from q)
select claim_id, event_type, case when o_role in ('birth_place', 'death_place') then object_id end as location_id, a as start, b as "end" from ({S.SQL['claim_events']}) left join t using (claim_id)""",
    "entity_records": "select entity_id, coalesce(nullif(trim(label_zh), ''), nullif(trim(label_en), ''), nullif(trim(canonical_name), ''), entity_id) as canonical_name, case when trim(wikipedia_title_en) <> '' then 'http://dbpedia.org/resource/' || regexp_replace(trim(wikipedia_title_en), '\\s', '_', 'g') end as dbpedia_uri from entities",
    "summary_updates": "select entity_id, coalesce(wikipedia_summary_en, description_en) as wikipedia_summary_en, case when wikipedia_summary_en is null and description_en is not null then '2030' else retrieved_at end as retrieved_at, case when wikipedia_summary_en is null and description_en is not null then 'rest' else source_name end as source_name from entities",
    "counted_split": f"select candidate_id, case when r <= greatest(1, cast(floor(n * 0.2) as bigint)) then 'dev' else 'train' end as split from (select candidate_id, row_number() over (order by md5('42|' || candidate_id), candidate_id) as r, count(*) over () as n from {S.DL})",
    "ordered_mentions": f"select doc_id, mention_id, s, cast(row_number() over (partition by doc_id order by sentence_index_in_doc nulls first, s, mention_id) as integer) as place from (select distinct doc_id, sentence_index_in_doc, s, mention_id from {S.MENTIONS_ONE} where doc_id is not null)",
    "merged_tokens": f"""
with t as (select sentence_id, arg_min(tokens, candidate_id) as t from {S.DL} where sentence_id is not null and tokens is not null group by 1)
select coalesce(s.sentence_id, t.sentence_id) as sentence_id, cast(case when t is not null then len(t) else len({S.TOKENS.replace('text', "coalesce(s.text, '')", 1)}) end as integer) as n_tokens, t is not null as given from {S.S} s full join t on s.sentence_id = t.sentence_id""",
    "keyword_sample": f"""
with s as (select sentence_id, source_id, text, md5('42|' || sentence_id) as h, row_number() over (partition by source_id order by md5('42|' || sentence_id), sentence_id) as g from {S.S} where text is not null and source_id is not null),
a as (select * from s where contains(lower(text), 'machine') order by g, h, sentence_id limit 10), b as (select * from s where contains(lower(text), 'university') and sentence_id not in (select sentence_id from a) order by g, h, sentence_id limit 10),
r as (select * from s where sentence_id not in (select sentence_id from a) and sentence_id not in (select sentence_id from b) order by g, h, sentence_id limit 40)
select sentence_id, source_id from a union all select sentence_id, source_id from b union all select sentence_id, source_id from r""",
}
