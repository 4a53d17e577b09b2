"""Structured sources: bindings to records, upserts, the fetch ledger, frontier expansion, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.operators.relational import latest

#: relation: (property, reversed, event type); the public properties of the templates.
RELATION_TEMPLATES = {
    "BORN_IN": ("P19", False, "BirthEvent"), "DIED_IN": ("P20", False, "DeathEvent"), "STUDIED_AT": ("P69", False, "EducationEvent"), "WORKED_AT": ("P108", False, "EmploymentEvent"),
    "AUTHORED": ("P50", True, "PublicationEvent"), "PROPOSED": ("P61", True, "ProposalEvent"), "DESIGNED": ("P287", True, "DesignEvent"), "AWARDED": ("P166", False, "HonorEvent"), "LOCATED_IN": ("P159", False, None),
}
QUALIFIERS = {"P580": "start_time", "P582": "end_time", "P585": "point_in_time", "P577": "publication_date"}


def relation_query(relation: str, ids: list[str], limit: int, offset: int) -> str:
    """The SELECT text of one relation for some subjects: pages are ordered, so they are stable."""
    prop, flipped, _ = RELATION_TEMPLATES[relation]
    subject, object_ = ("?object", "?subject") if flipped else ("?subject", "?object")
    values = " ".join(f"wd:{i}" for i in ids)
    optional = " ".join(f"OPTIONAL {{ ?statement pq:{p} ?{n} . }}" for p, n in QUALIFIERS.items())
    return f"SELECT * WHERE {{ VALUES ?subject {{ {values} }} {subject} p:{prop} ?statement . ?statement ps:{prop} {object_} . {optional} }} ORDER BY ?subject ?statement LIMIT {limit} OFFSET {offset}"


def entity_query(ids: list[str], languages: tuple[str, ...] = ("en", "zh")) -> str:
    optional = " ".join(f'OPTIONAL {{ ?entity rdfs:label ?label_{x} . FILTER(LANG(?label_{x}) = "{x}") }} OPTIONAL {{ ?entity schema:description ?description_{x} . FILTER(LANG(?description_{x}) = "{x}") }}' for x in languages)
    return f"SELECT * WHERE {{ VALUES ?entity {{ {' '.join('wd:' + i for i in ids)} }} {optional} OPTIONAL {{ ?entity wdt:P31 ?instance . }} }} ORDER BY ?entity ?instance"


def alias_query(ids: list[str], languages: tuple[str, ...] = ("en", "zh")) -> str:
    return f"SELECT ?entity ?alias (LANG(?alias) AS ?lang) WHERE {{ VALUES ?entity {{ {' '.join('wd:' + i for i in ids)} }} ?entity skos:altLabel ?alias . FILTER(LANG(?alias) IN ({', '.join(repr(x) for x in languages)})) }} ORDER BY ?entity ?alias"


def binding_value(bindings: Column, name: str) -> Column:
    """The value of one variable of a bindings map<string,struct<value>>, ids cut from addresses."""
    v = F.try_element_at(bindings, F.lit(name))["value"]
    return F.nullif(F.trim(F.regexp_replace(v, r"^https?://www\.wikidata\.org/entity/", "")), F.lit(""))


def group_bindings(rows: DataFrame, key: str, single: list[str], many: list[str], order: str) -> DataFrame:
    """One row for each key: the first value that isn't null of each single column, sorted sets of the others."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in single]
    return rows.groupBy(key).agg(*firsts, *[F.sort_array(F.collect_set(c)).alias(c) for c in many])


def claim_id(subject: Column, predicate: Column, object_: Column, statement: Column) -> Column:
    """A hash of the four parts, a missing one written as the text None."""
    n = lambda c: F.coalesce(c, F.lit("None"))
    return F.sha1(F.concat_ws("|", n(subject), n(predicate), n(object_), n(statement)))


def alias_records(names: DataFrame) -> DataFrame:
    """(entity_id, alias, alias_lang, normalized_alias) from (entity_id, canonical_name, alias, alias_lang, pos): the first of each form, none equal to the canonical name."""
    from kgloom.operators.relational import first_rows

    n = names.withColumn("normalized_alias", X.simple_key(F.col("alias"))).filter("normalized_alias <> ''").filter(F.col("normalized_alias") != X.simple_key(F.col("canonical_name")))
    return first_rows(n.select("entity_id", "normalized_alias", "alias", "alias_lang", "pos"), ["entity_id", "normalized_alias"], ["pos"]).drop("pos")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """New rows over old ones; columns of keep_old fall back to the old value where the new one is null."""
    cols = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*cols).alias("_o")), new.select(key, F.struct(*cols).alias("_n"))
    j = o.join(n, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if c in keep_old else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return j.select(key, *[pick(c).alias(c) for c in cols]).select(*old.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Children of the given parents are replaced as a whole."""
    return old.join(parents.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def ledger(jobs: DataFrame) -> DataFrame:
    """The last state of each job of an append-only log (job_key, status, updated_at, ...)."""
    return latest(jobs, ["job_key"], ["updated_at", "status"])


def missing_objects(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Objects that no entity row describes."""
    return claims.filter("object_id is not null").select(F.col("object_id").alias("entity_id")).distinct().join(entities.select("entity_id"), "entity_id", "left_anti")


def expand(seeds: DataFrame, claims: DataFrame, hops: int = 2) -> DataFrame:
    """(entity_id, hop) reached from seeds along claims from subject to object."""
    from kgloom.session import durable

    links = claims.filter("object_id is not null").select("subject_id", "object_id").distinct()
    seen = seeds.select("entity_id", F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(links, front["entity_id"] == links["subject_id"]).select(F.col("object_id").alias("entity_id")).distinct()
        front = durable(nxt.join(seen, "entity_id", "left_anti").select("entity_id", F.lit(h).alias("hop")))
        seen = seen.unionByName(front)
    return seen


def batches(ids: DataFrame, size: int, key: str = "entity_id") -> DataFrame:
    """Adds a batch number of near `size` ids each, by hash: no sort of all ids."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)))


def validate(entities: DataFrame, aliases: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """(check, level, subject) of all violations."""
    blank = entities.filter(F.trim(F.coalesce("canonical_name", F.lit(""))) == "").select(F.lit("blank_canonical_name").alias("check"), F.lit("error").alias("level"), F.col("entity_id").alias("subject"))
    orphan = missing_objects(claims, entities).select(F.lit("orphan_object").alias("check"), F.lit("error").alias("level"), F.col("entity_id").alias("subject"))
    twice = aliases.filter("entity_id is not null and normalized_alias is not null").select("alias_id", "entity_id", "normalized_alias").distinct().groupBy("entity_id", "normalized_alias").agg(F.count("*").alias("n"), F.min("alias_id").alias("subject")).filter("n > 1").select(F.lit("duplicate_alias").alias("check"), F.lit("warning").alias("level"), "subject")
    times = events.select("event_candidate_id", F.explode(F.array("start_time_norm", "end_time_norm")).alias("t")).filter("t is not null and t <> '' and length(t) not in (4, 10)").select(F.lit("time_format").alias("check"), F.lit("warning").alias("level"), F.col("event_candidate_id").alias("subject")).distinct()
    order = events.filter("start_time_norm <> '' and end_time_norm <> '' and left(end_time_norm, 4) < left(start_time_norm, 4)").select(F.lit("time_order").alias("check"), F.lit("error").alias("level"), F.col("event_candidate_id").alias("subject")).distinct()
    rng = claims.filter("confidence < 0 or confidence > 1").select(F.lit("confidence_range").alias("check"), F.lit("error").alias("level"), F.col("claim_id").alias("subject")).distinct()
    return reduce(DataFrame.unionByName, [blank, orphan, twice, times, order, rng])


def compile_constraint(c: dict) -> Column:
    """A declared constraint as the condition that a violating row meets."""
    kind, attribute = c["type"], F.col(c.get("attribute", "entity_id"))
    if kind == "required_attribute":
        return F.coalesce(F.trim(attribute.cast("string")), F.lit("")) == ""
    if kind == "non_empty_array":
        return F.coalesce(F.size(attribute), F.lit(0)) <= 0
    if kind == "value_range":
        return (attribute < c["min"]) | (attribute > c["max"])
    if kind in ("time_order", "time_order_check"):
        start, end = F.col(c.get("start", c.get("start_attribute", ""))), F.col(c.get("end", c.get("end_attribute", "")))
        return (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "") & (start > end)
    if kind == "event_role_required":
        held = F.transform(F.filter(F.coalesce("roles", F.array()), lambda r: r.isNotNull()), lambda r: r["role"])
        return (F.col("event_type") == c["event_type"]) & (F.size(F.array_except(F.array(*[F.lit(r) for r in c["roles"]]), held)) > 0)
    raise ValueError(f"unknown constraint {kind}")


def ontology_constraints() -> list[dict]:
    """The 26 declared constraints: what every class must hold, what is unique, the ranges, and the roles of each type of event."""
    required = [{"type": "required_attribute", "class": c, "attribute": "canonical_name"} for c in ("Person", "Organization", "Place", "Work", "Machine", "Award")]
    required += [{"type": "required_attribute", "class": "Event", "attribute": a} for a in ("event_id", "event_type")]
    unique = [{"type": "unique_attribute", "class": c, "attribute": a} for c, a in (("Entity", "entity_id"), ("Event", "event_id"))]
    arrays = [{"type": "non_empty_array", "class": "Entity", "attribute": a} for a in ("aliases", "source_ids")]
    ranges = [{"type": "value_range", "class": c, "attribute": "confidence", "min": 0.0, "max": 1.0} for c in ("Entity", "Event")]
    roles = [{"type": "event_role_required", "event_type": v[0], "roles": [v[1], v[2]]} for v in K.EVENT_SPECS.values()]
    return [*required, *unique, *arrays, *ranges, {"type": "relation_domain_range_check"}, *roles, {"type": "time_order_check", "class": "Event", "start_attribute": "start_time", "end_attribute": "end_time"}]


def constraint_violations(entities: DataFrame, aliases: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """(ordinal, type, class, subject) of every violation of the declared constraints.

    Entities come with their aliases and sources as arrays of at most one element, as only
    their presence is asked for; claims are joined to the types of both ends once.
    """
    named = aliases.filter("entity_id is not null and trim(alias) <> ''").groupBy("entity_id").agg(F.min("alias").alias("_a"))
    e = entities.join(named, "entity_id", "left").select(
        F.col("entity_id").alias("subject"), "entity_id", X.entity_type(F.col("entity_type")).alias("kind"), "canonical_name", "confidence",
        F.array_compact(F.array("_a")).alias("aliases"), F.array_compact(F.array(F.nullif(F.trim("source_record_id"), F.lit("")))).alias("source_ids"),
    )
    v = events.select(F.col("event_candidate_id").alias("subject"), F.col("event_candidate_id").alias("event_id"), "event_type", "confidence", "roles", F.col("start_time_norm").alias("start_time"), F.col("end_time_norm").alias("end_time"))
    out = []
    for i, c in enumerate(ontology_constraints()):
        of = v if c.get("class") == "Event" or c["type"] == "event_role_required" else e
        if c.get("class") not in (None, "Entity", "Event"):
            of = of.filter(F.col("kind") == c["class"].upper())
        if c["type"] == "unique_attribute":
            bad = of.groupBy(c["attribute"]).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(c["attribute"]).alias("subject"))
        elif c["type"] == "relation_domain_range_check":
            t = entities.select("entity_id", X.entity_type(F.col("entity_type")).alias("t"))
            j = claims.select("claim_id", "subject_id", X.predicate(F.col("predicate")).alias("predicate"), "object_id").filter("object_id is not null")
            j = j.join(t.select(F.col("entity_id").alias("subject_id"), F.col("t").alias("s")), "subject_id").join(t.select(F.col("entity_id").alias("object_id"), F.col("t").alias("o")), "object_id")
            known = F.create_map(*[x for p, (ss, os) in K.RELATION_TYPES.items() for x in (F.lit(p), F.array(*[F.lit(f"{s}|{o}") for s in ss for o in os]))])
            allowed = F.try_element_at(known, F.col("predicate"))
            bad = j.filter(allowed.isNotNull() & ~F.array_contains(allowed, F.concat_ws("|", "s", "o"))).select(F.col("claim_id").alias("subject")).distinct()
        else:
            bad = of.filter(compile_constraint(c)).select("subject").distinct()
        out.append(bad.select(F.lit(i).alias("ordinal"), F.lit(c["type"]).alias("type"), F.lit(c.get("class") or c.get("event_type")).alias("class"), "subject"))
    return reduce(DataFrame.unionByName, out)


def entity_records(entities: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, dbpedia_uri): the first of the Chinese label, the English one, the name it is known by and the id; the address of its English article."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    title = some("wikipedia_title_en")
    return entities.select("entity_id", F.coalesce(some("label_zh"), some("label_en"), some("canonical_name"), F.col("entity_id")).alias("canonical_name"), F.when(title.isNotNull(), F.concat(F.lit("http://dbpedia.org/resource/"), F.regexp_replace(title, r"\s", "_"))).alias("dbpedia_uri"))


def claim_events(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of claims with their times and place.

    The start is that of the qualifiers (start_time, publication_date, point_in_time); a
    birth or death takes its place from the object. One row a claim and type of event.
    """
    from kgloom.operators.events import from_claims

    q = lambda n: X.wikidata_time(F.coalesce(F.get_json_object("qualifiers_json", f"$.{n}.value"), F.get_json_object("qualifiers_json", f"$.{n}")))
    times = claims.select("claim_id", F.coalesce(q("start_time"), q("publication_date"), q("point_in_time")).alias("start"), q("end_time").alias("end"), "retrieved_at")
    times = latest(times, ["claim_id"], ["retrieved_at"]).drop("retrieved_at")
    e = from_claims(claims, entities).join(times, "claim_id", "left")
    return e.withColumn("location_id", F.when(F.col("o_role").isin("birth_place", "death_place"), F.col("object_id")))


def update_summaries(entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries (entity_id, wikipedia_summary_en, retrieved_at, source_name) written over those of known entities; others are left out."""
    cols = ["wikipedia_summary_en", "retrieved_at", "source_name"]
    s = latest(summaries.select("entity_id", *cols), ["entity_id"], ["retrieved_at"]).select("entity_id", F.struct(*cols).alias("_s"))
    j = entities.join(s, "entity_id", "left")
    for c in cols:
        if c in entities.columns:
            j = j.withColumn(c, F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)))
    return j.select(*entities.columns)


def target_relations(requested: list[str] | None) -> list[str]:
    """Requested relations that the ontology and the triggers both know; any other is an error."""
    known = set(K.RELATION_TYPES) & set(K.TRIGGER_LEMMAS)
    bad = sorted(set(requested or known) - known)
    if bad:
        raise ValueError(f"relations without types or triggers: {', '.join(bad)}")
    return sorted(requested or known)
