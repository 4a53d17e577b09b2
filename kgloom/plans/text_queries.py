"""Queries over the text functions: tokens, normal forms, shapes, classes, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.functions.timex import time_mentions_udf
from kgloom.operators import nested
from kgloom.session import table

_SQL_TOKEN = (
    r"[A-Za-z]+(?:-[A-Za-z]+)*(?:''[sS])?|\p{Nd}+(?:\.\p{Nd}+)*|[^\p{L}\p{N}\p{M}\p{Pc}\s\x{00a0}\x{2000}-\x{200a}\x{200c}\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x0b]"
)
_TOKENS = f"regexp_extract_all(text, '{_SQL_TOKEN}')"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.select("doc_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every token is the text under its span, and spans rise."""
    t = table(spark, d, "sentences").filter(F.col("text").isNotNull()).select("sentence_id", "text", X.tokens(F.col("text")).alias("tokens")).distinct()
    t = t.withColumn("spans", X.token_spans(F.col("text"), F.col("tokens")))
    wrong = F.size(F.filter(F.zip_with("tokens", "spans", lambda tok, s: F.substring(F.col("text"), s["s"] + 1, s["e"] - s["s"]) != tok), lambda x: x))
    return t.select("sentence_id", F.size("tokens").cast("bigint").alias("n_tokens"), wrong.cast("bigint").alias("n_wrong"))


def document_language(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "document_records").filter(F.col("clean_text").isNotNull())
    return t.select("doc_id", X.language(F.col("clean_text")).alias("inferred")).distinct()


def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "document_records").filter(F.col("clean_text").isNotNull())
    return t.select("doc_id", X.paragraph_count(F.col("clean_text")).cast("bigint").alias("n_paragraphs"), F.length("clean_text").cast("bigint").alias("n_chars")).distinct()


def whitespace_forms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sentences").filter(F.col("text").isNotNull())
    return t.select("sentence_id", F.md5(X.page_whitespace(F.col("text"))).alias("page_form"), F.length(X.page_whitespace(F.col("text"))).cast("bigint").alias("n_chars")).distinct()


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").filter(F.col("text").isNotNull()).select("sentence_id", F.explode(X.tokens(F.col("text"))).alias("token"))


def word_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).groupBy(X.word_shape(F.col("token")).alias("shape")).agg(F.count("*").alias("n"))


def token_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("token")
    flags = (X.is_roman(t), "roman"), (X.is_abbreviation(t), "abbreviation"), (X.has_model_number(t), "model_number")
    return _tokens(spark, d).agg(*[F.count_if(f).alias(f"n_{n}") for f, n in flags], F.count("*").alias("n_tokens"))


def stem_top(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most frequent stems (a top-k report)."""
    words = _tokens(spark, d).filter(F.col("token").rlike("^[A-Za-z]+$"))
    return words.groupBy(X.stem(F.col("token")).alias("stem")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stem").limit(50)


def low_information_mentions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "distant_labeled")
    m = t.select(F.col("subject_text").alias("m")).unionByName(t.select(F.col("object_text").alias("m")))
    return m.groupBy(F.coalesce(X.low_information(F.col("m")), F.lit("KEPT")).alias("class")).agg(F.count("*").alias("n"))


def anaphor_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pronouns of every sentence."""
    return _tokens(spark, d).filter(F.lower("token").isin(*K.PRONOUNS)).groupBy("sentence_id").agg(F.count("*").alias("n_pronouns"), F.min(F.lower("token")).alias("first_word"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Surname, short and place forms of the canonical names, by type."""
    e = table(spark, d, "entities")
    n, t = F.col("canonical_name"), F.col("entity_type")
    return e.select("entity_id", F.when(t == "PERSON", X.surname(n)).alias("surname"), F.when(t == "ORGANIZATION", X.org_short_name(n)).alias("short_name"), F.when(t == "PLACE", X.place_variant(n)).alias("place_variant"))


def entity_type_infer(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    return e.select("entity_id", X.infer_type(None, F.col("label_en"), F.col("description_en")).alias("inferred_type"))


def predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").groupBy(F.coalesce(X.predicate(F.col("predicate")), F.lit("UNKNOWN")).alias("predicate")).agg(F.count("*").alias("n"))


def normal_type_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "distant_labeled")
    return t.groupBy(X.entity_type(F.col("subject_entity_type")).alias("subject_type"), X.entity_type(F.col("object_entity_type")).alias("object_type")).agg(F.count("*").alias("n"))


def claim_times(spark: SparkSession, d: str) -> DataFrame:
    """The start times of each claim, wherever its qualifiers hold them, as a text, a number or the value of a record."""
    c = table(spark, d, "claims").select("claim_id", "qualifiers_json").distinct()
    n = nested.dewey_nodes(c, "claim_id", ["qualifiers_json"], {"qualifiers_json"}, ["qualifiers_json"])
    n = n.filter(F.col("kind").isin("string", "integer", "number") & F.col("schema_path").rlike(r"\.start_time(\[\*\])*(\.(value|time)(\[\*\])*)*$"))
    return n.select(F.col("record_id").alias("claim_id"), X.wikidata_time(F.col("value")).alias("start_time")).filter("start_time is not null").distinct()


def claim_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims")
    return c.select("claim_id", X.stable_id("fact", F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("edge_id")).distinct()


def alias_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Token overlap of each resolved alias with the canonical name."""
    a, e = table(spark, d, "aliases").filter("entity_id is not null and alias is not null").dropDuplicates(["alias_id"]), table(spark, d, "entities").select("entity_id", "canonical_name")
    j = a.join(e, "entity_id")
    return j.select("alias_id", F.round(X.jaccard(X.similarity_tokens(F.col("alias")), X.similarity_tokens(F.col("canonical_name"))), 6).alias("similarity"))


def time_mentions(spark: SparkSession, d: str) -> DataFrame:
    # every time expression holds a year: sentences without four digits in a row never reach Python
    s = table(spark, d, "sentences").select("sentence_id", "text").filter(F.col("text").rlike(r"(?U)\d{4}")).distinct()
    return s.select("sentence_id", F.posexplode(time_mentions_udf("text")).alias("pos", "t")).select("sentence_id", "pos", "t.*")


def time_type_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences")
    return s.select(F.explode("time_mentions").alias("t")).groupBy(F.col("t.type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("t.normalized").alias("n_values"))


def text_digest(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates of document texts by digest."""
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


QUERIES = {
    f.__name__: f
    for f in (tokenize_counts, token_spans, document_language, paragraph_counts, whitespace_forms, word_shapes, token_flags, stem_top, low_information_mentions, anaphor_tokens, name_variants, entity_type_infer, predicate_counts, normal_type_counts, claim_times, claim_stable_ids, alias_similarity, time_mentions, time_type_counts, text_digest)
}


def _type_case(text: str, words) -> str:
    return " ".join(f"when contains({text}, '{w}') then '{kind}'" for kind, keys in words for w in keys)


_PRED = "upper(regexp_replace(trim({0}), '[- ]', '_', 'g'))".format("predicate")
_ALIAS = "case " + " ".join(f"when {_PRED} = '{a}' then '{b}'" for a, b in K.PREDICATE_ALIASES.items()) + f" else {_PRED} end"
_TYPE = lambda c: "coalesce(case " + " ".join(f"when upper(trim({c})) = '{a}' then '{b}'" for a, b in K.LABEL_TO_TYPE.items()) + " end, 'CONCEPT')"
_SIM = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '''s\\b', '', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda w: length(w) > 1 and not list_contains([" + _list(K.SIMILARITY_STOP) + "], w)))"
_STEM = "case when w like '%ied' and length(w) > 4 then left(w, length(w) - 3) || 'y' when w like '%ing' and length(w) > 6 then left(w, length(w) - 3) when w like '%ed' and length(w) > 5 then left(w, length(w) - 2) when w like '%s' and length(w) > 4 then left(w, length(w) - 1) else w end"
_FLAT = f"(select sentence_id, unnest({_TOKENS}) as token from sentences where text is not null)"

SQL = {
    "tokenize_counts": f"select doc_id, cast(len({_TOKENS}) as bigint) as n_tokens from documents where text is not null",
    "token_spans": f"select distinct sentence_id, cast(len({_TOKENS}) as bigint) as n_tokens, cast(0 as bigint) as n_wrong from sentences where text is not null",
    "document_language": """
select distinct doc_id, case when h > 0 and h >= l * 0.2 then 'zh' when l > 0 then 'en' else 'unknown' end as inferred
from (select doc_id, length(regexp_replace(clean_text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) as h, length(regexp_replace(clean_text, '[^\\p{L}]', '', 'g')) as l
      from document_records where clean_text is not null)""",
    "paragraph_counts": r"""
select distinct doc_id, cast(len(list_filter(regexp_split_to_array(clean_text, '\n\s*\n'), lambda p: trim(p) <> '')) as bigint) as n_paragraphs, cast(length(clean_text) as bigint) as n_chars
from document_records where clean_text is not null""",
    "whitespace_forms": r"""
select distinct sentence_id, md5(f) as page_form, cast(length(f) as bigint) as n_chars
from (select sentence_id, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t\f\x0b]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as f from sentences where text is not null)""",
    "word_shapes": f"select regexp_replace(regexp_replace(regexp_replace(token, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g') as shape, count(*) as n from {_FLAT} group by 1",
    "token_flags": f"""
select count(*) filter (regexp_matches(token, '(?i)^(M|CM|D|CD|C|XC|L|XL|X|IX|V|IV|I)+$')) as n_roman,
       count(*) filter (regexp_matches(token, '^[A-Z][A-Z0-9-]{{1,7}}$')) as n_abbreviation,
       count(*) filter (regexp_matches(token, '[A-Za-z]') and regexp_matches(token, '[0-9]')) as n_model_number, count(*) as n_tokens from {_FLAT}""",
    "stem_top": f"select {_STEM} as stem, count(*) as n from (select lower(token) as w from {_FLAT} where regexp_matches(token, '^[A-Za-z]+$')) group by 1 order by n desc, stem limit 50",
    "low_information_mentions": f"""
select case when t = '' then 'SKIPPED_LOW_INFORMATION' when t in ({_list(K.PRONOUNS)}) then 'SKIPPED_PRONOUN' when t in ({_list(K.GENERIC_PHRASES)}) then 'SKIPPED_GENERIC'
            when length(t) <= 1 then 'SKIPPED_LOW_INFORMATION' else 'KEPT' end as class, count(*) as n
from (select coalesce(trim(regexp_replace(regexp_replace(trim(lower(m)), '''s$', ''), '[\\s\\x{{00a0}}]+', ' ', 'g')), '') as t
      from (select subject_text as m from distant_labeled union all select object_text from distant_labeled)) group by 1""",
    "anaphor_tokens": f"select sentence_id, count(*) as n_pronouns, min(lower(token)) as first_word from {_FLAT} where lower(token) in ({_list(K.PRONOUNS)}) group by 1",
    "name_variants": r"""
select entity_id,
  case when entity_type = 'PERSON' and len(string_split(canonical_name, ' ')) >= 2 and length(string_split(canonical_name, ' ')[-1]) > 2 and regexp_matches(string_split(canonical_name, ' ')[-1], '^\p{L}+$') then string_split(canonical_name, ' ')[-1] end as surname,
  case when entity_type = 'ORGANIZATION' and regexp_matches(canonical_name, '[,(]') then nullif(trim(regexp_replace(canonical_name, '\s*[,(].*$', '')), '') end as short_name,
  case when entity_type = 'PLACE' and bare <> canonical_name and bare <> '' then bare end as place_variant
from (select *, trim(regexp_replace(trim(split_part(canonical_name, ',', 1)), '(?i)\s+(city|town|district|borough|county|village|bridge)$', '')) as bare from entities)""",
    "entity_type_infer": f"select entity_id, case {_type_case('l', K.TITLE_WORDS)} {_type_case('x', K.DESCRIPTION_WORDS)} else 'Concept' end as inferred_type from (select entity_id, lower(coalesce(label_en, '')) as l, lower(coalesce(description_en, '')) as x from entities)",
    "predicate_counts": f"select coalesce({_ALIAS}, 'UNKNOWN') as predicate, count(*) as n from claims group by 1",
    "normal_type_counts": f"select {_TYPE('subject_entity_type')} as subject_type, {_TYPE('object_entity_type')} as object_type, count(*) as n from distant_labeled group by 1, 2",
    "claim_times": r"""
with c as (select distinct claim_id, case when json_valid(qualifiers_json) then case when json_type(qualifiers_json) = 'VARCHAR' and json_valid(json_extract_string(qualifiers_json, '$')) then json_extract_string(qualifiers_json, '$') else qualifiers_json end end as j from claims),
t as (select claim_id, trim(json_extract_string(t.value, '$')) as v from (select * from c where j is not null) c, json_tree(c.j) t
  where t.type in ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') and regexp_matches(t.fullkey, '\.start_time(\[\d+\])*(\.(value|time)(\[\d+\])*)*$'))
select distinct claim_id, case when not regexp_matches(v, '^[+-]?\d{4}-\d{2}-\d{2}') then v when substr(ltrim(v, '+-'), 6, 2) = '00' or substr(ltrim(v, '+-'), 9, 2) = '00' then left(ltrim(v, '+-'), 4) else left(ltrim(v, '+-'), 10) end as start_time
from t where v <> ''""",
    "claim_stable_ids": "select distinct claim_id, 'fact::' || left(sha1(coalesce(subject_id, '') || '||' || coalesce(predicate, '') || '||' || coalesce(object_id, '')), 20) as edge_id from claims",
    "alias_similarity": f"""
select alias_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as similarity
from (select alias_id, {_SIM.format('alias')} as a, {_SIM.format('canonical_name')} as b
      from (select distinct on (alias_id) * from aliases where entity_id is not null and alias is not null) join entities using (entity_id))""",
    "time_type_counts": "select t.type as type, count(*) as n, count(distinct t.normalized) as n_values from (select unnest(time_mentions) as t from sentences) group by 1",
    "text_digest": "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
}
