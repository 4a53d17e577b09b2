"""Queries over pages and documents: main text, rule sentences, running numbers, document builder, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import splitter
from kgloom.functions import text as X
from kgloom.functions.pages import main_text_udf
from kgloom.operators.relational import latest, running_ids
from kgloom.plans.kg_queries import _edges, _nodes
from kgloom.session import table
from kgloom.sources import files


def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of pages made of each document, its lines as paragraphs, with navigation, notices and hidden nodes around them."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    t = latest(table(spark, d, "document_records").filter("clean_text is not null").select("doc_id", "clean_text", "processed_at"), ["doc_id"], ["processed_at"])
    page = F.concat(F.lit('<html><head><script>var a = 1;</script></head><body><nav class="menu"><a href="/">Home</a></nav><div class="cookie-banner">We use cookies</div><article><p>'), F.regexp_replace(esc(F.col("clean_text")), r"\n+", "</p><p>"), F.lit('</p></article><div style="display: none">hidden</div><footer>Terms</footer></body></html>'))
    return t.select("doc_id", F.md5(main_text_udf(page)).alias("digest"))


def rule_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = latest(table(spark, d, "document_records").select("doc_id", "clean_text", "processed_at"), ["doc_id"], ["processed_at"])
    return splitter.split_documents(t)


def numbered_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers over documents in order, without sorting all rows on one node."""
    s = table(spark, d, "sentences").select("doc_id", "sentence_index_in_doc", "sentence_id").filter("doc_id is not null and sentence_index_in_doc is not null").distinct()
    return running_ids(s, ["doc_id"], ["sentence_index_in_doc", "sentence_id"], "sent_").select("sentence_id", "id")


def built_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document rows with counts and language from the text."""
    t = latest(table(spark, d, "document_records").select("doc_id", "source_id", "title", "clean_text", "processed_at"), ["doc_id"], ["processed_at"])
    text = F.coalesce("clean_text", F.lit(""))
    return t.select("doc_id", "source_id", F.length(text).alias("char_count"), F.when(text == "", 0).otherwise(X.paragraph_count(text)).alias("paragraph_count"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("doc_id")).alias("title"))


def source_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, texts and characters by source and kind."""
    t = latest(table(spark, d, "document_records").select("doc_id", "source_id", "source_type", "clean_text", "processed_at"), ["doc_id"], ["processed_at"])
    return t.groupBy(F.coalesce("source_id", F.lit("UNKNOWN")).alias("source_id"), F.coalesce("source_type", F.lit("UNKNOWN")).alias("source_type")).agg(F.count("*").alias("n_docs"), F.count("clean_text").alias("n_texts"), F.coalesce(F.sum(F.length("clean_text")), F.lit(0)).alias("n_chars"))


def gephi_edges(spark: SparkSession, d: str) -> DataFrame:
    return files.gephi_tables(_nodes(spark, d), _edges(spark, d))[1]


def neo4j_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = files.neo4j_tables(_nodes(spark, d), _edges(spark, d))[0]
    return n.toDF("id", "name", "description", "label")


def neo4j_relationships(spark: SparkSession, d: str) -> DataFrame:
    e = files.neo4j_tables(_nodes(spark, d), _edges(spark, d))[1]
    return e.toDF("start", "end", "edge_id", "layer", "confidence", "type")


def gephi_nodes(spark: SparkSession, d: str) -> DataFrame:
    return files.gephi_tables(_nodes(spark, d), _edges(spark, d))[0]


QUERIES = {f.__name__: f for f in (html_main_text, rule_sentences, numbered_sentences, built_documents, source_profile, gephi_nodes, gephi_edges, neo4j_nodes, neo4j_relationships)}

from kgloom.plans.kg_sql import ALL_NODES, EDGES  # noqa: E402

_LD = "(select distinct on (doc_id) * from document_records order by doc_id, processed_at desc)"
SQL = {
    "numbered_sentences": "select sentence_id, 'sent_' || lpad(cast(row_number() over (order by doc_id, sentence_index_in_doc, sentence_id) as varchar), 6, '0') as id from (select distinct doc_id, sentence_index_in_doc, sentence_id from sentences where doc_id is not null and sentence_index_in_doc is not null)",
    "built_documents": f"""
select doc_id, source_id, cast(length(coalesce(clean_text, '')) as integer) as char_count, cast(len(list_filter(regexp_split_to_array(coalesce(clean_text, ''), '\\n\\s*\\n'), lambda p: trim(p) <> '')) as integer) as paragraph_count, coalesce(nullif(trim(title), ''), doc_id) as title from {_LD}""",
    "source_profile": f"select coalesce(source_id, 'UNKNOWN') as source_id, coalesce(source_type, 'UNKNOWN') as source_type, count(*) as n_docs, count(clean_text) as n_texts, cast(coalesce(sum(length(clean_text)), 0) as bigint) as n_chars from {_LD} group by 1, 2",
    "gephi_nodes": f"""with e as {EDGES}, g as (select id, count(*) as degree from (select source as id from e union all select target from e) group by 1)
select n.id as Id, n.label as Label, type, 'Entity;' || type as labels, coalesce(description, '') as description, case when n.id in (select entity_id from entities) then 'entity' else 'event' end as source_layer, coalesce(degree, 0) as degree from {ALL_NODES} n left join g on n.id = g.id""",
    "gephi_edges": f"with e as {EDGES} select id as Id, source as Source, target as Target, 'Directed' as Type, label as Label, label || ' [' || layer || ']' as display_label, layer as source_layer, coalesce(confidence, 1.0) as confidence, semantic_key, case when layer = 'event' then label else '' end as role from e",
    "neo4j_nodes": f"select id, label as name, coalesce(description, '') as description, upper(regexp_replace(type, '[^A-Za-z0-9_]+', '_', 'g')) as label from {ALL_NODES}",
    "neo4j_relationships": f"with e as {EDGES} select source as start, target as end, id as edge_id, layer, coalesce(confidence, 1.0) as confidence, upper(regexp_replace(regexp_replace(label, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) as type from e",
}
