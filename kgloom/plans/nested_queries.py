"""Queries over nested records (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import nested
from kgloom.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nested_leaves(table(spark, folder, "verified_events_text"), table(spark, folder, "claims"))


def p1_role_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of event roles with its parent links."""
    fields = ["role", "entity_id", "entity_type", "text", "mention_id"]
    nodes = nested.dewey_nodes(table(spark, folder, "verified_events_text").dropDuplicates(["event_candidate_id"]), "event_candidate_id", ["roles"], keep=None)
    return nested.schema_table(nodes, "roles[*]", fields).withColumn("ordinal", F.substring_index("dewey", ".", -1).cast("int"))


def p1_trigger_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of signal triggers."""
    return nested.trigger_table(table(spark, folder, "verified_events_text"))


def p1_qualifier_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of claim qualifiers."""
    return nested.qualifier_table(table(spark, folder, "claims"))


QUERIES = {"p1_found": p1_found, "p1_role_table": p1_role_table, "p1_trigger_table": p1_trigger_table, "p1_qualifier_table": p1_qualifier_table}

_INNER = "case when json_valid({0}) then case when json_type({0}) = 'VARCHAR' and json_valid(json_extract_string({0}, '$')) then json_extract_string({0}, '$') else {0} end end"
_LEAF = "t.type in ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT') and json_extract_string(t.value, '$') <> ''"
_PATH = "replace(substr(t.fullkey, 2), '\"', '')"

SQL = {
    "p1_found": f"""
with c as (select distinct claim_id, {_INNER.format('qualifiers_json')} as j from claims),
e as (select distinct event_candidate_id, s, i from (select event_candidate_id, unnest(signals) as s, unnest(range(len(signals))) as i from verified_events_text)),
d as (select distinct event_candidate_id, i, {_INNER.format('s.details')} as j from e)
select distinct 'claims' as tbl, claim_id as parent_id, 'qualifiers_json' || {_PATH} as path, json_extract_string(t.value, '$') as item from (select * from c where j is not null) c, json_tree(c.j) t where {_LEAF}
union all select distinct 'verified_events_text', event_candidate_id, 'signals[' || i || '].details' || {_PATH}, json_extract_string(t.value, '$')
  from (select * from d where j is not null) d, json_tree(d.j) t where {_LEAF} and (t.fullkey = '$.trigger' or t.fullkey like '$.trigger.%' or t.fullkey like '$.trigger[%')
union all select distinct 'verified_events_text', event_candidate_id, 'roles[' || i || '].role', r.role from (select event_candidate_id, unnest(roles) as r, unnest(range(len(roles))) as i from verified_events_text) where r.role is not null and r.role <> ''""",
    "p1_role_table": """
select event_candidate_id as record_id, '0.' || (i - 1) as dewey, '0' as parent_dewey, r.role as role, r.entity_id as entity_id,
       r.entity_type as entity_type, r.text as text, r.mention_id as mention_id, cast(i - 1 as integer) as ordinal
from (select event_candidate_id, unnest(roles) as r, unnest(range(1, len(roles) + 1)) as i
      from (select distinct on (event_candidate_id) * from verified_events_text))
""",
}
