"""The register of the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import boilerplate, canonical, encode, lookalike, packing, sentences, spam, splits
from kgloom.session import durable, table

#: Tokens a container holds.
CAPACITY = 2048


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.furniture(table(spark, folder, "document_records"))


def p2_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, folder, "document_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    values = canonical.open_values(table(spark, folder, "aliases"), table(spark, folder, "distant_labeled"))
    return canonical.canonical_values(values, table(spark, folder, "entities"), table(spark, folder, "aliases"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_documents(table(spark, folder, "relation_bags"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_bags(table(spark, folder, "relation_bags"), table(spark, folder, "split_targets")).drop("label_names")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    bags, targets = table(spark, folder, "relation_bags"), table(spark, folder, "split_targets")
    return splits.split_report(durable(splits.split_bags(bags, targets)), targets)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    aliases, rows = table(spark, folder, "aliases"), table(spark, folder, "sentences")
    return (
        aliases.select(F.lit("aliases.alias").alias("field"), F.col("alias_id").alias("id"), F.col("alias").alias("text"))
        .unionByName(aliases.select(F.lit("aliases.normalized_alias").alias("field"), F.col("alias_id").alias("id"), F.col("normalized_alias").alias("text")))
        .unionByName(rows.select(F.lit("sentences.text").alias("field"), F.col("sentence_id").alias("id"), "text"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(_texts(spark, folder))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_forms(_texts(spark, folder)).select("field", "id", "form").distinct()


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(_texts(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.all_units(table(spark, folder, "document_records"), table(spark, folder, "sentences"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoded(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return encode.round_trip(table(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(encode.token_counts(table(spark, folder, "documents")), CAPACITY)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_bodies, p3_found, p4_found, p4_splits, p4_shares, p5_found, p5_forms, p5_classes, p6_found, p7_ids, p7_round_trip, p8_packed, p9_found)}
_DOC = "nullif(case when regexp_full_match(t, 'doc[^0-9a-z]*0*[0-9]+') then 'doc_' || lpad(regexp_extract(t, '([1-9][0-9]*|0)$', 1), 8, '0') else t end, '')"
SQL: dict[str, str] = {
    "p4_found": f"""
with recursive n as (select lower(trim(doc_id)) as d, lower(trim(regexp_replace(trim(bag_id), '\\s*(?:__|::|\\|).*$', ''))) as b from relation_bags),
l as (select distinct a, b from (select (select {_DOC.replace('t,', 'd,').replace('(t', '(d').replace('else t', 'else d')}) as a, (select {_DOC.replace('t,', 'b,').replace('(t', '(b').replace('else t', 'else b')}) as b from n) where a is not null and b is not null and a <> b),
e as (select a, b from l union select b, a from l),
r as (select a as x, a as y from e union select r.x, e.b from r join e on r.y = e.a)
select x as doc_id, min(y) as group_id from r group by 1""",
}
