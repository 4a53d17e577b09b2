"""SQL twins of the knowledge-graph queries, for DuckDB."""

from __future__ import annotations

import unicodedata

from kgloom.functions import constants as K

A = "(select distinct on (alias_id) * from aliases)"
V = "(select distinct on (event_candidate_id) * from verified_events_text)"
DL = "(select distinct on (candidate_id) * from distant_labeled)"
S = "(select distinct on (sentence_id) * from sentences)"
LC = "(select distinct on (claim_id) * from claims order by claim_id, retrieved_at desc)"
COLLAPSE = "trim(regexp_replace({0}, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"


def _compatible() -> str:
    """A text in compatibility form: single letters by translation, joined ones by replacement, then composition."""
    one = {chr(c): x for c in range(0xA0, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(x := unicodedata.normalize("NFKC", chr(c))) == 1 and x != unicodedata.normalize("NFC", chr(c))}
    text = f"translate({{0}}, '{''.join(one)}', '{''.join(one.values()).replace(chr(39), chr(39) * 2).replace('{', '{{').replace('}', '}}')}')"
    for c in "ﬀﬁﬂﬃﬄﬅﬆĲĳŀŉǄǅǆǇǈǉǊǋǌǱǲǳ…‥№™½¼¾":
        text = f"replace({text}, '{c}', '{unicodedata.normalize('NFKC', c).replace(chr(39), chr(39) * 2)}')"
    return f"replace(nfc_normalize({text}), '’', chr(39))"


COMPATIBLE = _compatible()
FOLDED = "replace(replace(lower(" + COMPATIBLE + "), 'ß', 'ss'), 'ς', 'σ')"
EXACT = COLLAPSE.replace("{0}", COMPATIBLE)
NORMAL = COLLAPSE.replace("{0}", "regexp_replace(trim(" + FOLDED + "), '''s$', '')")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map(column: str, pairs: dict, other: str) -> str:
    return "case " + " ".join(f"when {column} = '{a}' then '{b}'" for a, b in pairs.items()) + f" else {other} end"


def TYPE(c: str) -> str:
    return f"coalesce({_map(f'upper(trim({c}))', K.LABEL_TO_TYPE, 'null')}, 'CONCEPT')"


def PRED(c: str) -> str:
    p = f"upper(regexp_replace(trim({c}), '[- ]', '_', 'g'))"
    return _map(p, K.PREDICATE_ALIASES, p)


TOKENS = (
    r"regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*(?:''[sS])?|\p{Nd}+(?:\.\p{Nd}+)*|[^\p{L}\p{N}\p{M}\p{Pc}\s\x{00a0}\x{2000}-\x{200a}\x{200c}\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x0b]')"
)
_KEY = "layer_name || '::' || source || '::' || label || '::' || target || case when layer = 'event' then '' else '::' || left(sha1(extra), 12) end"


def _identity(rows: str) -> str:
    """Adds semantic_key and id, keeps the most confident row of each id."""
    return f"""(select distinct on (id) * from (select *, case layer when 'facts' then 'fact' when 'event' then 'event' else 'evidence' end || '::' || left(sha1(semantic_key), 20) as id
      from (select *, {_KEY} as semantic_key from (select *, case layer when 'facts' then 'FACT' when 'event' then 'EVENT_ARG' else 'EVIDENCE' end as layer_name from ({rows})))) order by id, coalesce(confidence, 0.0) desc)"""


def _facts(claims: str) -> str:
    return _identity(f"select subject_id as source, object_id as target, predicate as label, 'facts' as layer, coalesce(qualifiers_json, '') as extra, confidence from {claims} where subject_id is not null and object_id is not null")


_EVENTS = _identity(f"""
select event_candidate_id as source, r.entity_id as target, r.role as label, 'event' as layer, '' as extra, confidence from (select event_candidate_id, confidence, unnest(roles) as r from {V})
where r.entity_id is not null and r.entity_id <> '' and r.role is not null
union all select event_candidate_id, 'literal:time:' || left(sha1(start_time_norm), 20), 'start_time', 'event', '', confidence from {V} where start_time_norm is not null and start_time_norm <> ''""")
DEGREE = f"(select id, count(*) as degree from (select source as id from e union all select target from e) group by 1)"
NODES = """(select distinct on (id) * from (select entity_id as id, coalesce(nullif(trim(label_en), ''), nullif(trim(canonical_name), ''), nullif(trim(label_zh), ''), entity_id) as label, coalesce(entity_type, 'Entity') as type,
  coalesce(nullif(trim(description_en), ''), nullif(trim(description_zh), ''), nullif(trim(wikipedia_summary_en), '')) as description from entities))"""
MENTIONS = f"""(select distinct doc_id, sentence_id, sentence_index_in_doc, mention_id, entity_id, type, text, s, e from (
  select doc_id, sentence_id, sentence_index_in_doc, subject_mention_id as mention_id, subject_entity_id as entity_id, {TYPE('subject_entity_type')} as type, subject_text as text, subject_token_start as s, subject_token_end as e from {DL}
  union all select doc_id, sentence_id, sentence_index_in_doc, object_mention_id, object_entity_id, {TYPE('object_entity_type')}, object_text, object_token_start, object_token_end from {DL})
  where mention_id is not null and s is not null and e is not null)"""
MENTIONS_ONE = f"(select distinct on (sentence_id, mention_id, s, e, entity_id, type, text) * from {MENTIONS})"
SPECS = "(values " + ", ".join("(" + _list((p, *v)) + ")" for p, v in K.EVENT_SPECS.items()) + ") as spec(predicate, event_type, s_role, o_role, s_type, o_type)"
RELTYPES = "(values " + ", ".join(f"('{p}', '{s}', '{o}')" for p, (ss, os) in K.RELATION_TYPES.items() for s in ss for o in os) + ") as rt(predicate, s_type, o_type)"
_EVENT_FACTS = f"""(
with ev as (select *, {_map('event_type', K.EVENT_SYNONYMS, 'event_type')} as et from {V}),
j as (select event_candidate_id, predicate, spec.event_type, confidence,
  list_filter(coalesce(roles, []), lambda r: r.role = s_role and coalesce(r.entity_id, '') <> '')[1].entity_id as s,
  list_filter(coalesce(roles, []), lambda r: r.role = o_role and coalesce(r.entity_id, '') <> '')[1].entity_id as o, evidence from ev join {SPECS} on ev.et = spec.event_type where status = 'VERIFIED')
select event_candidate_id, evidence, predicate, case when event_type in ({_list(K.SYMMETRIC_EVENTS)}) and s > o then o else s end as subject_id,
  case when event_type in ({_list(K.SYMMETRIC_EVENTS)}) and s > o then s else o end as object_id, confidence from j where s is not null and o is not null)"""
_AGG = f"""(select subject_id, predicate, object_id, count(*) as n_evidence, round(least(1.0, max(sc) + least({K.FACT_BONUS_CAP}, {K.FACT_BONUS} * (count(*) - 1))), 6) as confidence, min(event_candidate_id) as prototype, arg_min(evidence, event_candidate_id) as evidence
  from (select *, coalesce(confidence, 0.0) as sc from {_EVENT_FACTS}) where sc >= {K.FACT_REVIEW} group by 1, 2, 3)"""
_EVIDENCE = _identity(f"select subject_id as source, object_id as target, predicate as label, 'evidence' as layer, coalesce(evidence.source_id, '') || '||' || coalesce(evidence.sentence_id, '') || '||||' || coalesce(evidence.text, '') as extra, confidence from {_AGG} where confidence >= {K.FACT_FINAL}")
EDGES = f"(select id, source, target, label, layer, semantic_key, confidence from {_facts(LC)} union all select id, source, target, label, layer, semantic_key, confidence from {_EVENTS} union all select id, source, target, label, layer, semantic_key, confidence from {_EVIDENCE})"
_NAMES = "(select distinct on (entity_id) entity_id, coalesce(nullif(trim(label_en), ''), nullif(trim(canonical_name), ''), nullif(trim(label_zh), ''), entity_id) as name from entities)"
EVENT_NODES = f"""(select id, type || ': ' || coalesce(a.name, h[1].entity_id, '') || coalesce(' -> ' || coalesce(b.name, h[2].entity_id), '') as label, type, cast(null as varchar) as description from (
  select event_candidate_id as id, coalesce(nullif(trim(event_type), ''), 'Event') as type, list_filter(coalesce(roles, []), lambda r: coalesce(r.entity_id, '') <> '') as h from {V}) left join {_NAMES} a on h[1].entity_id = a.entity_id left join {_NAMES} b on h[2].entity_id = b.entity_id)"""
ALL_NODES = f"(select * from {NODES} union all select * from {EVENT_NODES})"
E = f"with e as {EDGES} "
_WIN = f"""(select candidate_id, tokens, greatest(0, least(subject_token_start, object_token_start) - {K.WINDOW_MARGIN}) as ws, least(len(tokens), greatest(subject_token_end, object_token_end) + {K.WINDOW_MARGIN}) as we
  from {DL} where tokens is not null and subject_token_start is not null and object_token_start is not null and subject_token_end is not null and object_token_end is not null)"""


def _stem(w: str) -> str:
    return f"case when {w} like '%ied' and length({w}) > 4 then left({w}, length({w}) - 3) || 'y' when {w} like '%ing' and length({w}) > 6 then left({w}, length({w}) - 3) when {w} like '%ed' and length({w}) > 5 then left({w}, length({w}) - 2) when {w} like '%s' and length({w}) > 4 then left({w}, length({w}) - 1) else {w} end"


def _stems(c: str) -> str:
    return f"list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda w: {_stem('w')})"


#: Written out from the original's word lists and the dictionary forms of their words, not from the engine's rules.
_FORMS = """
bear bears bearing bore borne born|birth births birthed birthing|die dies died dying dieing|death deaths deathed deathing|dead|study studies studied studying|attend attends attended attending
educate educates educated educating|graduate graduates graduated graduating|matriculate matriculates matriculated matriculating|work works worked working|join joins joined joining
serve serves served serving|teach teachs teaches taught teaching|research researches researched researching|employ employs employed employing|appointment appointments appointmented appointmenting
author authors authored authoring|write writes wrote written writing|publish publishes published publishing|coauthor coauthors coauthored coauthoring|propose proposes proposed proposing
introduce introduces introduced introducing|devise devises devised devising|formulate formulates formulated formulating|present presents presented presenting|design designs designed designing
build builds built building|develop develops developed developing|invent invents invented inventing|award awards awarded awarding|receive receives received receiving|win wins won winning
honor honors honored honoring|elect elects elected electing|locate locates located locating|base bases based basing|situate situates situated situating|pass passes passed passing
fellow fellows fellowed fellowing|be am is are was were been being"""
_HELD = {
    "AUTHORED": "author write publish coauthor", "AWARDED": "award receive win honor elect", "BORN_IN": "bear birth", "DESIGNED": "design build develop invent", "DIED_IN": "die death dead",
    "LOCATED_IN": "locate base situate", "PROPOSED": "propose introduce devise formulate present", "STUDIED_AT": "study attend educate graduate matriculate", "WORKED_AT": "work join serve teach research employ appointment",
}


def _lemma(w: str) -> str:
    bare = f"regexp_replace(lower(trim({w})), '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]+$', '', 'g')"
    forms = [line.split() for line in _FORMS.strip().replace("\n", "|").split("|")]
    cases = " ".join(f"when {bare} in ({_list(f)}) then '{f[0]}'" for f in forms)
    return f"case {cases} else {bare} end"


_HITS = "list_filter([" + ", ".join(
    f"case when list_has_any(l, [{_list(ws.split())}])" + (" or contains(' ' || array_to_string(list_filter(l, lambda x: x <> ''), ' ') || ' ', ' pass away in ')" if p == "DIED_IN" else "") + f" then '{p}' end" for p, ws in _HELD.items()
) + "], lambda x: x is not null)"
_TRIGGERS = "(values " + ", ".join(f"('{p}', '{t}')" for p, ts in K.RELATION_PATTERNS.items() for t in ts) + ") as trg(predicate, trigger)"
_BAGROWS = f"""(select doc_id || '__' || subject_entity_id || '__' || object_entity_id as bag_id, doc_id, sentence_id, subject_mention_id, object_mention_id, coalesce(positive_predicates, []) as labels
  from {DL} where subject_entity_id is not null and object_entity_id is not null and doc_id is not null)"""
_BAGS = f"""(select bag_id, least({K.BAG_EVIDENCE}, count(distinct (sentence_id, subject_mention_id, object_mention_id))) as n_evidence,
  case when len(list_sort(list_distinct(flatten(list(labels))))) = 0 then ['NA'] else list_sort(list_distinct(flatten(list(labels)))) end as labels from {_BAGROWS} group by 1)"""
_INDEX = f"""(select distinct kind, key, entity_id from (
with n as (select distinct entity_id, entity_type, {EXACT.format('surface')} as x from (
  select entity_id, entity_type, unnest([canonical_name, label_en, label_zh]) as surface from entities
  union all select a.entity_id, entity_type, alias from aliases a join entities using (entity_id) where alias is not null) where surface is not null),
k as (
select 'exact' as kind, x as raw, entity_id from n
union all select 'normalized', x, entity_id from n
union all select 'surname', string_split(x, ' ')[-1], entity_id from n where entity_type = 'PERSON' and len(string_split(x, ' ')) >= 2 and length(string_split(x, ' ')[-1]) > 2 and regexp_full_match(string_split(x, ' ')[-1], '\\p{{L}}+')
union all select 'abbreviation', x, entity_id from n where entity_type = 'ORGANIZATION' and regexp_full_match(x, '[A-Z][A-Z0-9-]{{1,7}}')
union all select 'short_name', y, entity_id from (select *, trim(regexp_replace(x, '\\s*[,(].*$', '')) as y from n) where entity_type = 'ORGANIZATION' and y <> trim(x) and y <> ''
union all select 'place_variant', y, entity_id from (select *, trim(regexp_replace(trim(split_part(x, ',', 1)), '(?i)\\s+(city|town|district|borough|county|village|bridge)$', '')) as y from n)
  where entity_type = 'PLACE' and y <> trim(x) and y <> '')
select kind, case when kind = 'exact' then raw else {NORMAL.format('raw')} end as key, entity_id from k) where key <> '')"""
_SCORE = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in K.ALIAS_SCORES.items()) + " end"
_RECALL = f"""(select mention_id, entity_id, max(sc) as alias_score, max_by(kind, (sc, kind)) as source from (
  select mention_id, entity_id, kind, cast({_SCORE} as double) as sc from (
    select mention_id, kind, case when kind = 'exact' then {EXACT.format('text')} else {NORMAL.format('text')} end as key from mm, (values ('exact', ''), ('normalized', ''), ('surname', 'PERSON'), ('abbreviation', 'ORGANIZATION'), ('short_name', 'ORGANIZATION'), ('place_variant', 'PLACE')) as kk(kind, only_type)
    where text is not null and (only_type = '' or only_type = type)) join {_INDEX} using (kind, key)) group by 1, 2)"""
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]{{2,}}'), lambda x: not list_contains([{_list(K.SIMILARITY_STOP)}], x))"
_TERMS = f"(select k, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as term from (select k, {_WORDS} as w from {{0}}))"
_RUNS = """
with recursive t as (select candidate_id, unnest(tokens) as tok, unnest(range(len(tokens))) as i from {DL} where tokens is not null),
f as (select *, regexp_matches(tok, '^[A-Z][a-z]+') as ti, lower(tok) in ('and', 'of', 'the', 'for', 'in', 'on', 'to') as sm from t),
g as (select *, sum(case when not ti and not sm then 1 else 0 end) over (partition by candidate_id order by i rows unbounded preceding) as blk from f)
select candidate_id, cast(min(i) as integer) as s, cast(max(i) + 1 as integer) as e from g where ti group by candidate_id, blk having count(*) >= 2""".replace("{DL}", DL)
_SHORT = {"PERSON": "PER", "ORGANIZATION": "ORG", "PLACE": "LOC"}
_LAB = f"""(select candidate_id, tokens, subject_token_start as s1, subject_token_end as e1, {_map(TYPE('subject_entity_type'), _SHORT, TYPE('subject_entity_type'))} as t1,
  object_token_start as s2, object_token_end as e2, {_map(TYPE('object_entity_type'), _SHORT, TYPE('object_entity_type'))} as t2 from {DL}
  where tokens is not null and len(tokens) > 0 and subject_token_start is not null and object_token_start is not null and subject_token_end > subject_token_start and object_token_end > object_token_start
  and (subject_token_end <= object_token_start or object_token_end <= subject_token_start) and subject_token_end <= len(tokens) and object_token_end <= len(tokens))"""
_GOLD = f"(select distinct candidate_id as key, s, e, type from (select candidate_id, s1 as s, e1 as e, t1 as type from {_LAB} union all select candidate_id, s2, e2, t2 from {_LAB}))"
_FOUND = f"(select distinct candidate_id as key, s, e, 'PER' as type from ({_RUNS}) where candidate_id in (select candidate_id from {_LAB}))"
_PRF = "round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall, round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1"
_CLAIM_IDS = f"(select subject_id, {PRED('predicate')} as predicate, object_id, list_sort(list_distinct(list(claim_id))) as ids from claims where object_id is not null group by 1, 2, 3)"

SQL = {
    "orphan_objects": "select distinct object_id as entity_id from claims where object_id is not null and object_id not in (select entity_id from entities where entity_type in ('PERSON', 'PLACE'))",
    "latest_claims": f"select claim_id, subject_id, predicate, object_id, retrieved_at from {LC}",
    "upsert_labels": "with n as (select entity_id, min(alias) as label, max(alias_lang) as note from aliases where entity_id is not null group by 1) select coalesce(o.entity_id, n.entity_id) as entity_id, case when n.entity_id is not null then n.label else o.label_en end as label, coalesce(n.note, o.description_en) as note from entities o full join n on o.entity_id = n.entity_id",
    "frontier_expand": """
with recursive l as (select distinct subject_id, object_id from claims where object_id is not null),
r as (select distinct subject_id as entity_id, 0 as hop from claims where predicate = 'WORKED_WITH' union select object_id, hop + 1 from r join l on entity_id = subject_id where hop < 2)
select entity_id, min(hop) as hop from r group by 1""",
    "structured_checks": """
select 'blank_canonical_name' as "check", 'error' as level, entity_id as subject from entities where trim(coalesce(canonical_name, '')) = ''
union all select 'orphan_object', 'error', x from (select distinct object_id as x from claims where object_id is not null and object_id not in (select entity_id from entities))
union all select 'duplicate_alias', 'warning', min(alias_id) from (select distinct alias_id, entity_id, normalized_alias from aliases where entity_id is not null and normalized_alias is not null) group by entity_id, normalized_alias having count(*) > 1
union all select distinct 'time_format', 'warning', event_candidate_id from (select event_candidate_id, unnest([start_time_norm, end_time_norm]) as t from verified_events_text) where t is not null and t <> '' and length(t) not in (4, 10)
union all select distinct 'time_order', 'error', event_candidate_id from verified_events_text where start_time_norm <> '' and end_time_norm <> '' and left(end_time_norm, 4) < left(start_time_norm, 4)
union all select distinct 'confidence_range', 'error', claim_id from claims where confidence < 0 or confidence > 1""",
    "claim_records": "select distinct claim_id, sha1(coalesce(subject_id, 'None') || '|' || coalesce(predicate, 'None') || '|' || coalesce(object_id, 'None') || '|' || coalesce(statement_id, 'None')) as made_id from claims",
    "alias_records": f"""
select distinct on (entity_id, normalized_alias) entity_id, n as normalized_alias, alias, alias_lang from (
  select entity_id, alias, coalesce(alias_lang, '') as alias_lang, alias_id, lower({COLLAPSE.format('alias')}) as n, lower({COLLAPSE.format('canonical_name')}) as c
  from {A} join entities using (entity_id) where alias is not null) where n <> '' and n <> c order by entity_id, n, alias_id""".replace("distinct on (entity_id, normalized_alias)", "distinct on (entity_id, n)"),
    "grouped_records": f"select entity_id, min_by(alias, case when alias is not null then alias_id end) as alias, coalesce(array_to_string(list_sort(list_distinct(list(alias_lang) filter (alias_lang is not null))), ','), '') as langs from {A} where entity_id is not null group by 1",
    "job_ledger": "select cast(user_id as varchar) as job_key, max_by(event_type, (event_id, event_type)) as status, max(event_id) as updated_at from events group by 1",
    "constraint_counts": "select count(*) filter (coalesce(trim(canonical_name), '') = '') as n_0, count(*) filter (coalesce(trim(label_en), '') = '') as n_1, count(*) filter (coalesce(trim(description_en), '') = '') as n_2, count(*) filter (confidence < 0.5 or confidence > 1.0) as n_3 from entities",
    "graph_nodes": E + f"select * from {ALL_NODES} union all select distinct x, x, 'Placeholder', null from (select source as x from e union all select target from e) where x not in (select id from {ALL_NODES})",
    "fact_edges": f"select id, source, target, label, confidence from {_facts('claims')}",
    "event_edges": f"select id, source, target, label, semantic_key from {_EVENTS}",
    "node_degree": E + f"select * from {DEGREE}",
    "graph_stats": E + f"""select 'node_type' as section, type as key, count(*) as n from {ALL_NODES} group by 1, 2 union all select 'edge_label', label, count(*) from e group by 1, 2
union all select 'layer', case when layer in ('facts', 'event') then layer else 'evidence' end, count(*) from e group by 1, 2""",
    "hub_edges": E + f"""select hub, degree, u.id as edge_id, u.b as other from (select id as hub, degree from {DEGREE} order by degree desc, id limit 30)
join (select id, source as a, target as b from e union all select id, target, source from e where source <> target) u on hub = a""",
    "induced_edges": E + f", top as (select id from {DEGREE} order by degree desc, id limit 300) select id, source, target from e where source in (select id from top) and target in (select id from top)",
    "two_hop": f"""
with recursive e as {EDGES}, u as (select distinct a, b from (select source as a, target as b from e union all select target, source from e)),
r as (select entity_id as id, 0 as hop from entities where entity_type = 'AWARD' union select b, hop + 1 from r join u on id = a where hop < 2) select id, min(hop) as hop from r group by 1""",
    "adjacency_sets": """
with n as (select distinct * from (select subject_id as id, object_id as neighbour from claims where subject_id is not null and object_id is not null
  union all select object_id, subject_id from claims where subject_id is not null and object_id is not null))
select id, neighbour, count(*) over (partition by id) as n_neighbours from n""",
    "layer_edges": E + "select id, layer, a.canonical_name as source_name, label, b.canonical_name as target_name from e join entities a on source = a.entity_id join entities b on target = b.entity_id where layer in ('facts', 'evidence')",
    "event_network": E + f"select e.id as id, source, v.type as event_type, e.label as label, target from e join {EVENT_NODES} v on e.source = v.id where layer = 'event'",
    "evidence_edges": E + "select id, source, target, label, semantic_key, confidence from e where layer = 'evidence'",
    "event_nodes": f"select * from {EVENT_NODES}",
    "display_labels": E + "select label || ' [' || layer || ']' as display_label, count(*) as n from e group by 1",
    "two_hop_paths": E + """, u as (select id, source as a, target as b from e union all select id, target, source from e where source <> target),
one as (select 1 as hops, a as seed, id as edge_1, b as middle from u where a in (select entity_id from entities where entity_type = 'AWARD'))
select * from (select hops, seed, edge_1, middle, cast(null as varchar) as edge_2, cast(null as varchar) as far from one union all select 2, seed, edge_1, middle, u.id, u.b from one join u on middle = u.a where edge_1 <> u.id)
order by hops, seed, edge_1, edge_2 nulls first, far nulls first limit 180""",
    "type_audit": E + "select upper(regexp_replace(regexp_replace(label, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) as rel_type, layer, count(*) as n from e group by 1, 2",
    "fused_edges": f"""
with f as {_identity("select case when subject_id = 'QX100043' then 'QX_NEWER' else subject_id end as source, case when object_id = 'QX100043' then 'QX_NEWER' else object_id end as target, predicate as label, 'facts' as layer, coalesce(qualifiers_json, '') as extra, confidence from claims where subject_id is not null and object_id is not null")},
r as (select * from f where (source, label, target) not in (select (subject_id, predicate, object_id) from claims where object_id is not null and subject_id is not null and predicate = 'LOCATED_IN'))
select id, source, target, label, layer from r union all select id, source, target, label, layer from {_identity("select 'QX_A' as source, 'QX_B' as target, 'RELATED_TO' as label, 'correction' as layer, '' as extra, 1.0 as confidence")}""",
    "claim_alignment": f"""
select candidate_id, cast(coalesce(len(ids), 0) as integer) as n_claims, coalesce(array_to_string(ids, ','), '') as claim_ids
from {DL} d left join {_CLAIM_IDS} c on d.subject_entity_id = c.subject_id and d.predicate = c.predicate and d.object_entity_id = c.object_id
where subject_entity_id is not null and object_entity_id is not null and d.predicate is not null""",
    "trigger_matches": f"""
select candidate_id, cast(len(t) as integer) as n_triggers, array_to_string(t, ',') as triggers from (
select candidate_id, list_sort(list_distinct(list(trigger))) as t from (select candidate_id, predicate, case when len(tokens) > 0 then list_transform(tokens, lambda v: {_stem('lower(trim(v))')}) else {_stems('text')} end as st from {DL}
  where (subject_token_start is null or subject_token_end is null or object_token_start is null or object_token_end is null or greatest(0, object_token_start - subject_token_end, subject_token_start - object_token_end) <= 24) and subject_entity_id is not null and object_entity_id is not null and predicate is not null and text is not null)
join (select predicate, trigger, {_stems('trigger')} as ts from {_TRIGGERS}) using (predicate)
where contains(array_to_string(st, ' '), array_to_string(ts, ' ')) or regexp_matches(' ' || array_to_string(st, ' ') || ' ', ' ' || array_to_string(ts, ' (.* )?') || ' ') group by 1)""",
    "fact_aggregate": f"""
select subject_id, predicate, object_id, '' as qualifiers, n_evidence, confidence, case when confidence >= {K.FACT_FINAL} then 'FINAL' else 'REVIEW' end as status from (
select subject_id, predicate, object_id, count(*) as n_evidence, round(least(1.0, max(sc) + least({K.FACT_BONUS_CAP}, {K.FACT_BONUS} * (count(*) - 1))), 6) as confidence
from (select *, coalesce(confidence, 0.0) as sc from {_EVENT_FACTS}) where sc >= {K.FACT_REVIEW} group by 1, 2, 3)""",
    "fact_conflicts": f"select subject_id, predicate, count(distinct object_id) as n_objects, min(object_id) as first_object, max(object_id) as last_object from claims where predicate in ({_list(K.FUNCTIONAL)}) and coalesce(object_id, '') <> '' group by 1, 2 having count(distinct object_id) > 1",
    "signal_rollup": f"select event_type, s.name as signal, count(*) as n, round(sum(s.score), 6) as score_sum from (select event_type, unnest(signals) as s from {V}) where s.name is not null group by 1, 2",
    "fact_verdicts": f"""
select event_candidate_id, case when m in ('offline_event_projection', 'offline_pattern') then 'SUPPORTED' else 'UNCERTAIN' end as verdict, m as mode, round(sc + case when m in ('offline_event_projection', 'offline_pattern') then 0.25 else 0.0 end, 6) as score, 'VERIFIED' as status
from (select event_candidate_id, case when list_contains(n, 'event_verified') and list_contains(n, 'event_trigger_match') then 'offline_event_projection' when list_contains(n, 'pattern_match') then 'offline_pattern'
    when list_contains(n, 'wikidata_alignment') then 'offline_kb_alignment' else 'offline_abstain' end as m, coalesce(list_sum(list_transform(list_filter(signals, lambda x: x is not null), lambda x: coalesce(x.score, 0.0))), 0.0) as sc
  from (select *, list_transform(list_filter(signals, lambda x: x is not null), lambda x: x.name) as n from {V} where signals is not null))""",
    "event_fact_candidates": f"select event_candidate_id, subject_id, predicate, object_id, 'event_projection,event_verified,event_role_complete,event_trigger_match' as names, 'SUPPORTED' as verdict, cast(1.1 as double) as score, 'VERIFIED' as status from {_EVENT_FACTS}",
    "whole_facts": f"select 'fact_' || lpad(cast(row_number() over (order by subject_id, predicate, object_id) as varchar), 6, '0') as fact_id, subject_id, predicate, object_id, n_evidence, confidence, case when confidence >= {K.FACT_FINAL} then 'FINAL' else 'REVIEW' end as status, prototype, evidence.sentence_id as sentence_id from {_AGG}",
    "fact_evidence": f"select subject_id, predicate, object_id, event_candidate_id as candidate_id, evidence.sentence_id as sentence_id, cast(row_number() over (partition by subject_id, predicate, object_id order by event_candidate_id) as integer) as pos from {_EVENT_FACTS} where coalesce(confidence, 0.0) >= {K.FACT_REVIEW}",
    "distant_support": f"""
with c as (select subject_id, {PRED('predicate')} as predicate, object_id, count(distinct claim_id) as n, min(claim_id) as f, arg_min(nullif(trim(qualifiers_json), ''), case when trim(qualifiers_json) not in ('', '{{}}', 'null') then claim_id end) as q from claims where object_id is not null group by 1, 2, 3)
select candidate_id, coalesce(n, 0) as n_claims, f as first_claim, cast(case when n > 0 then 0.25 else 0.0 end as double) as support, q as qualifiers from {DL} d left join c on d.subject_entity_id = c.subject_id and {PRED('d.predicate')} = c.predicate and d.object_entity_id = c.object_id
where subject_entity_id is not null and object_entity_id is not null and d.predicate is not null""",
    "mention_pairs": f"""
with m as (select distinct sentence_id, mention_id, entity_id, type, s, e from {MENTIONS_ONE} where entity_id is not null),
p as (select a.type as s_type, b.type as o_type, greatest(b.s - a.e, a.s - b.e, 0) as d from m a join m b using (sentence_id) where a.mention_id <> b.mention_id and a.entity_id <> b.entity_id)
select s_type, o_type, r as relations, count(*) as n, cast(sum(d) as bigint) as total_distance from p join (select s_type, o_type, array_to_string(list_sort(list(predicate)), ',') as r from {RELTYPES} group by 1, 2) using (s_type, o_type)
where d <= {K.MAX_TOKEN_DISTANCE} group by 1, 2, 3""",
    "local_windows": f"select candidate_id, cast(ws as integer) as window_start, cast(we as integer) as window_end, coalesce(array_to_string(tokens[ws + 1:greatest(we, ws)], ' '), '') as window_text from {_WIN}",
    "trigger_hits": f"select candidate_id, coalesce(array_to_string({_HITS}, ','), '') as hits from (select candidate_id, list_transform(tokens[ws + 1:greatest(we, ws)], lambda w: {_lemma('w')}) as l from {_WIN})",
    "bag_merge": f"select bag_id, cast(n_evidence as bigint) as n_evidence, array_to_string(labels, ',') as labels from {_BAGS}",
    "na_downsample": f"""
with b as {_BAGS}, p as (select greatest(1, cast(floor(count(*) filter (labels <> ['NA']) * 3.0) as bigint)) as keep from b)
select bag_id, array_to_string(labels, ',') as labels from b where labels <> ['NA'] union all select bag_id, 'NA' from (select bag_id, row_number() over (order by md5('42' || bag_id)) as r from b where labels = ['NA']), p where r <= keep""",
    "class_weights": f"with b as {_BAGS}, n as (select count(*) as n from b) select label, round((max(n) - count(*)) / count(*), 6) as weight from (select unnest(labels) as label from b), n group by 1",
    "bag_split": f"select bag_id, case when u < 0.65 then 'train' when u < 0.85 then 'dev' else 'test' end as split from (select distinct bag_id, cast(('0x' || left(md5('42' || doc_id), 8)) as bigint) / 4294967296.0 as u from {_BAGROWS})",
    "vocabulary": f"select token, n, cast(row_number() over (order by token) + 1 as integer) as id from (select lower(t) as token, count(*) as n from (select unnest(tokens) as t from {DL}) where t is not null group by 1 having count(*) >= 2)",
    "exact_claim_pairs": f"""
select candidate_id as pair_id, coalesce(array_to_string(list_filter(ids, lambda x: not list_contains(list_filter([bridge_details.subject.bridge_claim_id, bridge_details.object.bridge_claim_id], lambda y: y is not null), x)), ','), '') as claim_ids
from {DL} d left join {_CLAIM_IDS} c on d.subject_entity_id = c.subject_id and {PRED('d.predicate')} = c.predicate and d.object_entity_id = c.object_id where subject_entity_id is not null and object_entity_id is not null""",
    "pair_positions": f"""
select candidate_id, cast(list_sum(list_transform(range(len(tokens)), lambda i: greatest(-40, least(40, i - subject_token_start)) + 41)) as bigint) as s_sum,
  cast(list_sum(list_transform(range(len(tokens)), lambda i: greatest(-40, least(40, i - object_token_start)) + 41)) as bigint) as o_sum,
  cast(list_sum(list_transform(range(len(tokens)), lambda i: case when i <= least(subject_token_start, object_token_start) then 1 when i < greatest(subject_token_start, object_token_start) then 2 else 3 end)) as bigint) as piece_sum
from {DL} where tokens is not null and len(tokens) > 0 and subject_token_start is not null and object_token_start is not null""",
    "review_queue": f"select candidate_id, weak_label, array_to_string(review_reasons, ',') as reasons from {DL} where len(coalesce(review_reasons, [])) > 0",
    "event_arguments": f"""
select event_candidate_id, event_type, status, cast(pos as integer) as pos, r.role as role, r.entity_id as entity_id, r.entity_type as entity_type, r.text as text
from (select event_candidate_id, event_type, status, unnest(roles) as r, unnest(range(len(roles))) as pos from {V}) where r is not null""",
    "event_verify": f"""
with sp as (select event_type, unnest([{{'role': s_role, 'type': s_type}}, {{'role': o_role, 'type': o_type}}]) as w from {SPECS}),
nd as (select event_type, list_sort(list(w.role)) as needed, list(w) as ws from sp group by 1),
e as (select v.*, list_filter(coalesce(roles, []), lambda r: r is not null and r.role is not null) as rr, nd.needed, nd.ws from {V} v left join nd on v.event_type = nd.event_type),
x as (select event_candidate_id, event_type, needed, list_filter(coalesce(needed, []), lambda n: not list_contains(list_transform(rr, lambda r: r.role), n)) as missing,
  list_sort(list_distinct(list_transform(list_filter(rr, lambda r: trim(coalesce(r.entity_id, '')) = ''), lambda r: r.role))) as em, confidence,
  coalesce(json_valid(review_reasons) and json_type(review_reasons) = 'OBJECT' and len(list_filter(json_keys(review_reasons), lambda k: json_extract_string(review_reasons, '$."' || k || '"') not in ('', 'null', 'false', '[]', '{{}}'))) > 0, false) as own,
  list_sort(list_distinct(list_transform(list_filter(rr, lambda r: len(list_filter(coalesce(ws, []), lambda w: w.role = r.role and w.type <> {TYPE('r.entity_type')})) > 0), lambda r: r.role))) as wr from e)
select event_candidate_id, event_type, coalesce(array_to_string(missing, ','), '') as missing, coalesce(array_to_string(em, ','), '') as empty, coalesce(array_to_string(wr, ','), '') as wrong_type,
  case when ok then 'VERIFIED' else 'REVIEW' end as verdict, case when ok then greatest(coalesce(confidence, 0.0), 0.85) else least(coalesce(confidence, 0.0), 0.49) end as confidence, case when ok then 'event_verified,event_role_complete' else '' end as signals
from (select *, len(missing) = 0 and len(em) = 0 and len(wr) = 0 and needed is not null and not own as ok from x)""",
    "event_facts": f"select event_candidate_id, predicate, subject_id, object_id from {_EVENT_FACTS}",
    "claim_events": f"""
select distinct claim_id, spec.event_type as event_type, s_role, subject_id, o_role, object_id from (
select claim_id, subject_id, object_id, a.entity_type as st, b.entity_type as ot, case when predicate = 'PROPOSED' and b.entity_type = 'MACHINE' then 'DESIGNED' else predicate end as pr
from claims join entities a on subject_id = a.entity_id join entities b on object_id = b.entity_id) c join {SPECS} on pr = spec.predicate and st = spec.s_type and ot = spec.o_type""",
    "event_support": f"""
select event_id, array_to_string(list_sort(list_distinct(list(candidate_id))), ',') as candidate_ids from
(select event_candidate_id as event_id, evidence.sentence_id as sentence_id, list_distinct(list_filter(list_transform(roles, lambda r: r.entity_id), lambda x: x is not null)) as a from {V} where roles is not null and evidence.sentence_id is not null)
join (select candidate_id, sentence_id, list_distinct(list_filter([subject_entity_id, object_entity_id], lambda x: x is not null)) as b from {DL}) using (sentence_id) where len(list_intersect(a, b)) >= 1 group by 1""",
    "coref_targets": f"""
with t as (select doc_id, sentence_id, sentence_index_in_doc as sentence_index, {TOKENS} as k from {S} where text is not null and doc_id is not null and sentence_index_in_doc is not null),
g as (select doc_id, sentence_id, sentence_index, unnest(list_concat(list_concat(list_transform(range(len(k)), lambda i: {{'s': i, 'n': 1, 'p': lower(k[i + 1])}}), list_transform(range(len(k)), lambda i: {{'s': i, 'n': 2, 'p': lower(array_to_string(k[i + 1:i + 2], ' '))}})),
  list_transform(range(len(k)), lambda i: {{'s': i, 'n': 3, 'p': lower(array_to_string(k[i + 1:i + 3], ' '))}}))) as x from t)
select doc_id, sentence_id, sentence_index, cast(x.s as integer) as token_start, cast(x.s + x.n as integer) as token_end, x.p as phrase from g
where (x.n = 1 and x.p in ({_list(K.PRONOUNS)})) or (x.n > 1 and x.p in ({_list(K.GENERIC_PHRASES)}))""",
    "bio_round_trip": f"select candidate_id, cast(2 as bigint) as n_spans, cast(s1 * 100 + e1 + s2 * 100 + e2 as bigint) as checksum from {_LAB} where not (t1 = t2 and false)",
    "title_runs": _RUNS,
    "paren_depths": f"""
with t as (select sentence_id, unnest(tk) as tok, unnest(range(len(tk))) as i from (select sentence_id, {TOKENS} as tk from {S} where text is not null)),
r as (select sentence_id, i, sum(case when tok in ('(', '[', '{{') then 1 when tok in (')', ']', '}}') then -1 else 0 end) over (partition by sentence_id order by i) as d from t),
f as (select sentence_id, d - least(0, min(d) over (partition by sentence_id order by i)) as depth from r)
select sentence_id, cast(max(depth) as bigint) as deepest from f group by 1 having max(depth) > 0""",
    "repeated_sentences": f"""
select doc_id, count(*) as n_kept from (select doc_id, text, lag(text) over (partition by doc_id order by sentence_index_in_doc, sentence_id) as b from {S} where doc_id is not null and text is not null) where b is null or b <> text group by 1""",
    "alias_index_sizes": f"select kind, count(*) as n, count(distinct entity_id) as n_entities from {_INDEX} group by 1",
    "alias_recall": f"with mm as (select distinct mention_id, text, type from {MENTIONS_ONE}) select mention_id, entity_id, source, alias_score from {_RECALL}",
    "tfidf_recall": f"""
with et as (select entity_id as k, canonical_name || coalesce(' ' || description_en, '') as text from entities), qt as (select alias_id as k, alias as text from {A} where alias is not null),
n as (select count(*) as n from et), df as (select term, count(distinct k) as df from {_TERMS.replace('{0}', 'et')} group by 1), idf as (select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from df, n),
ew as (select k, term, count(*) * max(idf) as w from {_TERMS.replace('{0}', 'et')} join idf using (term) group by 1, 2), qw as (select k, term, count(*) * max(idf) as w from {_TERMS.replace('{0}', 'qt')} join idf using (term) group by 1, 2),
en as (select k, sqrt(sum(w * w)) as z from ew group by 1), qn as (select k, sqrt(sum(w * w)) as z from qw group by 1),
sc as (select q.k as query_id, e.k as entity_id, round(sum(q.w / qn.z * (e.w / en.z)), 6) as score from qw q join ew e using (term) join en on en.k = e.k join qn on qn.k = q.k group by 1, 2)
select * from (select query_id, entity_id, score, row_number() over (partition by query_id order by score desc, entity_id) as rank from sc where score > 0) where rank <= {K.TFIDF_TOP_K}""",
    "link_gaps": f"""
select *, case when n_without >= 3 or n >= 8 then 'P0' when n_nil >= 3 or n_review >= 4 or n >= 4 then 'P1' else 'P2' end as priority from (
select trim(m.text) as text, type, count(*) as n, count(distinct m.doc_id) as n_docs, count(*) as n_without, count(*) as n_nil, cast(0 as bigint) as n_review, min(nullif(trim(s.text), '')) as sample_context from {MENTIONS_ONE} m left join {S} s using (sentence_id) where m.text is not null and trim(m.text) <> '' and entity_id is null group by 1, 2)
order by n_without desc, n desc, n_docs desc, text, type limit 50""",
    "link_gap_contexts": f"""
with r as (select trim(m.text) as text, type, m.doc_id as doc_id, nullif(trim(s.text), '') as context from {MENTIONS_ONE} m left join {S} s using (sentence_id) where m.text is not null and trim(m.text) <> '' and entity_id is null),
top as (select text, type from r group by 1, 2 order by count(*) desc, count(distinct doc_id) desc, text, type limit 50)
select text, type, cast(rank as integer) as rank, context from (select *, row_number() over (partition by text, type order by context) as rank from (select distinct text, type, context from r join top using (text, type) where context is not null)) where rank <= 3""",
    "span_prf": f"""
select type, tp, fp, fn, {_PRF} from (select coalesce(g.type, p.type) as type, count(*) filter (g.key is not null and p.key is not null) as tp, count(*) filter (g.key is null) as fp, count(*) filter (p.key is null) as fn
from {_GOLD} g full join {_FOUND} p on g.key = p.key and g.s = p.s and g.e = p.e and g.type = p.type group by 1)""",
    "type_confusion": f"select g.type as gold_type, p.type as found_type, count(*) as n from {_GOLD} g join {_FOUND} p on g.key = p.key and g.s = p.s and g.e = p.e group by 1, 2",
    "span_errors": f"""
with g as {_GOLD}, p as {_FOUND},
o as (select g.key, g.s, g.e, g.type, p.s as ps, p.e as pe, case when g.s = p.s and g.e = p.e and g.type = p.type then '0_correct' when g.s = p.s and g.e = p.e then '1_type'
  when p.s >= g.s and p.e <= g.e then '2_short' when p.s <= g.s and p.e >= g.e then '3_long' else '4_overlap' end as k from g join p on g.key = p.key and g.s < p.e and g.e > p.s)
select error, count(*) as n from (select coalesce(substr(min(k), 3), 'missed') as error from g left join o using (key, s, e, type) group by key, s, e, type) group by 1
union all select 'spurious', count(*) from p where not exists (select 1 from o where o.key = p.key and o.ps = p.s and o.pe = p.e) having count(*) > 0""",
    "confidence_buckets": f"select case when confidence >= 0.85 then 'high' when confidence >= 0.65 then 'medium' else 'low' end as bucket, count(*) as n, round(avg(confidence), 6) as mean from {V} where confidence is not null group by 1",
    "relation_prf": f"""
with p as (select distinct candidate_id as b, predicate as label from {DL} where predicate is not null), g as (select distinct candidate_id as b, unnest(positive_predicates) as label from {DL} where predicate is not null)
select label, tp, fp, fn, {_PRF} from (select coalesce(p.label, g.label) as label, count(*) filter (p.b is not null and g.b is not null) as tp, count(*) filter (g.b is null) as fp, count(*) filter (p.b is null) as fn from p full join g on p.b = g.b and p.label = g.label group by 1)""",
    "relation_summary": f"""
with p as (select distinct candidate_id as b, predicate as label from {DL} where predicate is not null), g as (select distinct candidate_id as b, unnest(positive_predicates) as label from {DL} where predicate is not null),
c as (select coalesce(p.label, g.label) as label, count(*) filter (p.b is not null and g.b is not null) as tp, count(*) filter (g.b is null) as fp, count(*) filter (p.b is null) as fn from p full join g on p.b = g.b and p.label = g.label group by 1),
r as (select label, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from (select unnest([{_list(sorted(K.RELATION_TYPES))}]) as label) left join c using (label)), q as (select *, {_PRF} from r)
select 'micro' as kind, {_PRF} from (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from r) union all select 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) from q""",
    "closed_gold": f"""
with g as (select candidate_id as b, predicate as label, case when weak_label = 'ds_strict' then 'positive' else 'negative' end as verdict from {DL} where predicate is not null and weak_label in ('ds_strict', 'hard_negative')),
p as (select distinct candidate_id as b, predicate as label from {DL} where predicate is not null and exact_claim_match)
select *, {_PRF} from (select count(*) filter (p.b is not null and verdict = 'positive') as tp, count(*) filter (p.b is not null and verdict = 'negative') as fp, count(*) filter (p.b is null and verdict = 'positive') as fn,
  count(*) filter (p.b is not null and verdict is null) as unjudged from p full join g on p.b = g.b and p.label = g.label)""",
    "label_counts": f"select coalesce(weak_label, 'UNKNOWN') as label, count(*) as n from {DL} group by 1",
    "top_mentions": f"select type, text, n, rank from (select *, row_number() over (partition by type order by n desc, text) as rank from (select type, text, count(*) as n from {MENTIONS_ONE} where text is not null group by 1, 2)) where rank <= 20",
}

_ANAPHORS = "(values " + ", ".join(f"('{p}', '{t}')" for p, ts in K.ANAPHOR_TYPES.items() for t in ts) + ") as an(phrase, type)"
SQL["coref_resolve"] = f"""
with t as (select *, sentence_id || ':' || token_start as target_id from ({SQL['coref_targets']})),
a as (select distinct doc_id, sentence_index_in_doc as si, s, entity_id, type from {MENTIONS_ONE} where entity_id is not null and doc_id is not null and sentence_index_in_doc is not null),
p as (select target_id, t.sentence_index - a.si as d, case when t.sentence_index = a.si then t.token_start - a.s else -a.s end as rk, entity_id
  from t join {_ANAPHORS} on t.phrase = an.phrase join a on t.doc_id = a.doc_id and a.type = an.type and t.sentence_index - a.si between 0 and {K.COREF_WINDOW} and (t.sentence_index > a.si or a.s < t.token_start)),
r as (select *, row_number() over w as n, lead(d) over w as d2, lead(rk) over w as rk2 from p window w as (partition by target_id order by d, rk, entity_id)),
x as (select t.*, r.d, r.entity_id as e, case when r.d is null then 'NO_COMPATIBLE_ANTECEDENT' when d2 = d and (d > 0 or rk2 = rk) then 'AMBIGUOUS_ANTECEDENT' else 'RULE_NEAREST_ANTECEDENT' end as reason from t left join r on t.target_id = r.target_id and r.n = 1)
select target_id, doc_id, sentence_index, token_start, phrase, case when reason like 'RULE%' then e end as entity_id, case when reason like 'RULE%' then d end as distance, reason from x"""
SQL["coref_report"] = f"""
with x as ({SQL['coref_resolve']}) select 'reason' as section, reason as key, count(*) as n from x group by 2 union all select 'phrase', phrase, count(*) from x group by 2
union all select 'distance', coalesce(cast(distance as varchar), ''), count(*) from x group by 2 union all select 'decision', case when entity_id is not null then 'LINKED' else 'UNRESOLVED' end, count(*) from x group by 2
union all select 'original', case when phrase in ({_list(K.PRONOUNS)}) then 'SKIPPED_PRONOUN' else 'SKIPPED_GENERIC' end, count(*) from x group by 2
union all select 'type', coalesce(entity_type, ''), count(*) from x join entities e on x.entity_id = e.entity_id group by 2"""
_TYP = "case when {0} >= s1 and {0} < e1 then t1 when {0} >= s2 and {0} < e2 then t2 end"
SQL["bio_legalize"] = f"""
with l as (select candidate_id, list_transform(range(len(tokens)), lambda i: {{'t': {_TYP.format('i')}, 'p': {_TYP.format('(i - 1)')}}}) as x from {_LAB})
select candidate_id, array_to_string(list_transform(x, lambda v: case when v.t is null then 'O' when v.p is null or v.p <> v.t then 'B-' || v.t else 'I-' || v.t end), ' ') as legal,
  cast(len(list_filter(x, lambda v: v.t is not null and (v.p is null or v.p <> v.t))) as bigint) as n_illegal from l"""
_SIM = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '''s\\b', '', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda w: length(w) > 1 and not list_contains([" + _list(K.SIMILARITY_STOP) + "], w)))"


def _link_words(c: str) -> str:
    t = f"regexp_replace({FOLDED.format(c)}, '([\\p{{L}}\\p{{N}}_])''s([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g')"
    return f"list_distinct(list_filter(string_split(trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) > 1 and not list_contains([{_list(K.LINK_STOP)}], w)))"


def _named(*cs: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif(trim({c}), '')" for c in cs) + ")"


def _over(a: str, b: str, least: int) -> str:
    return f"least(1.0, cast(len(list_intersect({a}, {b})) as double) / greatest({least}, least(len({a}), len({b}))))"


_LOW = COLLAPSE.format("regexp_replace(trim(lower(text)), '''s$', '')")
_ONCE = f"""(select *, case when t = '' then 'SKIPPED_LOW_INFORMATION' when t in ({_list(K.PRONOUNS)}) then 'SKIPPED_PRONOUN' when t in ({_list(K.GENERIC_PHRASES)}) then 'SKIPPED_GENERIC' when length(t) <= 1 then 'SKIPPED_LOW_INFORMATION' end as skip
  from (select *, coalesce({_LOW}, '') as t from (select *, row_number() over (partition by mention_id order by doc_id nulls first, sentence_index_in_doc nulls first, s, text nulls first, type) as k from {MENTIONS_ONE}) where k = 1))"""
_PROFILES = f"""(select entity_id, {TYPE('entity_type')} as etype, {_link_words("concat_ws(' ', coalesce(canonical_name, ''), about, array_to_string(surfaces, ' '))")} as words,
  greatest(0.1, least(1.0, greatest(0.0, least(1.0, coalesce(confidence, 0.75))) + least(cast(0.1 as double), len(list_distinct(list_transform(surfaces, lambda x: lower(x)))) / cast(120 as double)))) as prior,
  concat_ws(' ', {_named('canonical_name', 'label_en', 'label_zh')}, about, array_to_string(list_filter(dom, lambda x, i: list_position(dom, x) = i), ' '), array_to_string(more, ' ')) as text
  from (select *, list_concat(more, list_filter([nullif({COLLAPSE.format('canonical_name')}, ''), nullif({COLLAPSE.format('label_en')}, ''), nullif({COLLAPSE.format('label_zh')}, ''), nullif({COLLAPSE.format('wikipedia_title_en')}, '')], lambda x: x is not null)) as surfaces,
    {_named('description_en', 'description_zh', 'wikipedia_summary_en')} as about, list_transform(regexp_extract_all({_named('entity_type', 'description_en', 'description_zh', 'wikipedia_summary_en', 'canonical_name')}, '[A-Za-z][A-Za-z\\-]+')[1:24], lambda x: lower(x)) as dom
    from (select e.*, coalesce(m.more, []) as more from entities e left join (select entity_id, list_sort(list_distinct(list({COLLAPSE.format('alias')}))) as more from {A} where entity_id is not null and trim(alias) <> '' group by 1) m using (entity_id))))"""
_W = {k: f"cast({v} as double)" for k, v in K.LINK_WEIGHTS.items()}
_SCORED = f"""(with lm as materialized {_ONCE}, mm as (select mention_id, text, type from lm where skip is null), pr as materialized {_PROFILES},
j0 as materialized (select m.mention_id, coalesce(m.doc_id, '') as doc_id, m.text as text, m.type as type, m.e - m.s as n_words, m.doc_id as d, m.sentence_index_in_doc as si, m.s as s, coalesce(st.text, '') as context, coalesce(trim(dr.title), '') as title
  from lm m left join {S} st using (sentence_id) left join (select distinct on (doc_id) * from document_records) dr on m.doc_id = dr.doc_id where skip is null),
et as (select entity_id as k, text from pr), qt as (select mention_id as k, concat_ws(' ', nullif(trim(text), ''), nullif(trim(context), ''), nullif(trim(title), '')) as text from j0),
n as (select count(*) as n from et), e1 as materialized {_TERMS.replace('{0}', 'et')}, df as (select term, count(distinct k) as df from e1 group by 1), idf as materialized (select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from df, n),
ew as materialized (select k, term, count(*) * max(idf) as w from e1 join idf using (term) group by 1, 2), qw as materialized (select k, term, count(*) * max(idf) as w from {_TERMS.replace('{0}', 'qt')} join idf using (term) group by 1, 2),
en as (select k, sqrt(sum(w * w)) as z from ew group by 1), qn as (select k, sqrt(sum(w * w)) as z from qw group by 1),
sc as (select q.k as mention_id, e.k as entity_id, round(sum(q.w / qn.z * (e.w / en.z)), 6) as score from qw q join ew e using (term) join en on en.k = e.k join qn on qn.k = q.k group by 1, 2),
near as (select * from (select *, row_number() over (partition by mention_id order by score desc, entity_id) as rank from sc where score > 0) where rank <= {K.TFIDF_TOP_K}),
c as (select coalesce(r.mention_id, near.mention_id) as mention_id, coalesce(r.entity_id, near.entity_id) as entity_id, coalesce(r.source, 'tfidf') as source, coalesce(cast(r.alias_score as double), least(0.85, greatest(0.35, near.score))) as alias_score
  from {_RECALL} r full join near on r.mention_id = near.mention_id and r.entity_id = near.entity_id),
w as materialized (select *, {_link_words('context')} as nw, {_link_words('title')} as hw, trim(regexp_replace(regexp_replace({FOLDED.format('text')}, '([\\p{{L}}\\p{{N}}_])''s([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as surface from j0),
f as (select c.*, w.doc_id as doc_id, surface, n_words, d, si, s, case when type = etype then 1.0 when type = 'CONCEPT' and etype in ('MACHINE', 'WORK', 'AWARD') then 0.45 when type = 'ORGANIZATION' and etype = 'PLACE' then 0.3 else 0.0 end as ts,
  {_over('nw', 'words', 3)} as ctx, {_over('list_distinct(list_concat(hw, nw))', 'words', 2)} as topic, prior, len(list_intersect(hw, words)) > 0 as title_overlap from c join w using (mention_id) join pr using (entity_id)),
g as (select *, cast(round(cast(cast(greatest(0.0, least(1.0, {_W['alias']} * alias_score + {_W['context']} * ctx + {_W['type']} * ts + {_W['topic']} * topic + {_W['mention']} * 0.5 + {_W['prior']} * prior)) as varchar) as decimal(38, 20)), 6) as double) as local from f)
select * from (select *, row_number() over (partition by mention_id order by local desc, entity_id) as rank from g) where rank <= {K.LINK_TOP_K})"""
SQL["link_scored"] = f"select mention_id, doc_id, entity_id, source, cast(local as double) as local, cast(ts as double) as type_score from {_SCORED}"
SQL["link_decisions"] = f"""
with t as materialized (select * from {_SCORED}), an as (select doc_id, entity_id, count(*) as k from t where rank = 1 and local >= {K.ANCHOR_SCORE} group by 1, 2),
ex as (select doc_id, surface, arg_max(entity_id, (coalesce(d, ''), coalesce(si, -1), s, mention_id)) as xe from t where rank = 1 and source = 'exact' and local >= {K.LINK_REVIEW} group by 1, 2),
c as (select t.*, round(least(1.0, local + least({K.SUPPORT_CAP}, (case when xe = t.entity_id then {K.SUPPORT_SURFACE} else 0.0 end) + least({K.SUPPORT_ANCHOR_CAP}, {K.SUPPORT_ANCHOR} * coalesce(k, 0)) + (case when title_overlap then {K.SUPPORT_TITLE} else 0.0 end))), 6) as lc
  from t left join an using (doc_id, entity_id) left join ex using (doc_id, surface)),
r as (select *, row_number() over w as n, lead(lc) over w as second from c window w as (partition by mention_id order by lc desc, entity_id)), q as (select *, lc - coalesce(second, 0.0) as mg, source in ('exact', 'normalized') as whole from r where n = 1),
p as (select *, case when lc >= (case when n_words > 1 then case when whole then {K.LINK_MULTI} else {K.LINK_OTHER} end when (whole or source = 'surname') and ts = 1.0 and mg >= 0.2 then {K.LINK_EASY} else {K.LINK_SINGLE} end) then 'LINKED' when lc >= {K.LINK_REVIEW} then 'REVIEW' else 'NIL' end as pl from q),
v as (select *, case when second is not null and mg < {K.LINK_MARGIN} and lc >= {K.LINK_REVIEW} then 'REVIEW' when ts = 0 and pl = 'LINKED' then 'REVIEW' else pl end as decision from p)
select o.mention_id as mention_id, case when decision = 'LINKED' then v.entity_id end as entity_id, cast(coalesce(lc, 0.0) as double) as link_confidence, round(cast(mg as double), 6) as margin, coalesce(skip, decision, 'NIL') as decision from {_ONCE} o left join v on o.mention_id = v.mention_id"""
SQL["illegal_counts"] = f"""
with l as (select list_transform(range(len(tokens)), lambda i: {{'t': {_TYP.format('i')}, 'p': {_TYP.format('(i - 1)')}}}) as x from {_LAB}), n as (select len(list_filter(x, lambda v: v.t is not null and (v.p is null or v.p <> v.t))) as t, len(list_filter(x, lambda v: v.t is not null and v.p is not null and v.p <> v.t)) as c from l)
select cast(sum(t) as bigint) as n_tokens, cast(sum(c) as bigint) as n_transitions, count(*) filter (t > 0) as n_sequences from n"""
SQL["targeted_slices"] = f"""
with t as (select candidate_id as k, p as phrase from (select l.candidate_id, lower(d.text) as x from {_LAB} l join {DL} d using (candidate_id) where d.text is not null), (values ('university of'), ('machine'), ('no such phrase')) as ph(p) where contains(x, p)),
g as (select phrase, key, s, e, type from t join {_GOLD} on k = key), f as (select phrase, key, s, e, type from t join {_FOUND} on k = key),
a as (select coalesce(g.phrase, f.phrase) as phrase, count(*) filter (g.key is not null and f.key is not null) as tp, count(*) filter (g.key is null) as fp, count(*) filter (f.key is null) as fn from g full join f on g.phrase = f.phrase and g.key = f.key and g.s = f.s and g.e = f.e and g.type = f.type group by 1)
select phrase, n_texts, tp, fp, fn, {_PRF} from (select phrase, count(*) as n_texts from t group by 1) left join a using (phrase)"""
