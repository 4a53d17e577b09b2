"""Column functions over text: tokens, spans, normal forms, shapes, stems and name parts.

All of them stay in the JVM but for `normal_alias`, `folded` and `exact_alias`, which need
Unicode normalisation or case folding, by an Arrow UDF on the texts that aren't ASCII. Null in, null out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import constants as K

#: ASCII words with hyphens and a possessive, numbers, or one mark; other letters make no token.
TOKEN = r"(?U)([A-Za-z]+(?:-[A-Za-z]+)*(?:'[sS])?|\d+(?:\.\d+)*|[^\w\s\p{N}])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def token_spans(text: Column, toks: Column) -> Column:
    """Half-open code-point spans of the tokens, found by one pass with a cursor."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc: Column, tok: Column) -> Column:
        at = F.locate_expr(tok, text, acc["at"]) if hasattr(F, "locate_expr") else F.call_function("locate", tok, text, acc["at"])
        end = (at + F.length(tok)).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct((at - 1).cast("int").alias("s"), (end - 1).cast("int").alias("e")))).alias("spans"))

    return F.aggregate(toks, start, step, lambda acc: acc["spans"])


def collapse(text: Column) -> Column:
    """One space between words, none around."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def page_whitespace(text: Column) -> Column:
    """No-break spaces as spaces, runs of blanks as one, at most one empty line."""
    t = F.regexp_replace(text, " ", " ")
    t = F.regexp_replace(t, r"[ \t\f\x0b]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def simple_key(text: Column) -> Column:
    return F.lower(collapse(text))


@F.pandas_udf(T.StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t).replace("’", "'").casefold() for t in texts], dtype=object)


def folded(text: Column) -> Column:
    """Compatibility form, case folded."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_fold_unicode(text))


@F.pandas_udf(T.StringType())
def _compose_unicode(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t).replace("’", "'") for t in texts], dtype=object)


def exact_alias(text: Column) -> Column:
    """Compatibility form in its own case, spaces collapsed."""
    return collapse(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_compose_unicode(text)))


def normal_alias(text: Column, ascii_only: bool = False) -> Column:
    """Compatibility form, case folded, without a final possessive, spaces collapsed."""
    low = F.lower(text) if ascii_only else folded(text)
    return collapse(F.regexp_replace(F.trim(low), r"'s$", ""))


def similarity_tokens(text: Column) -> Column:
    """Distinct words of two letters or more that aren't stop words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"'s\b", ""), r"[^a-z0-9一-鿿]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(t), " "), lambda w: (F.length(w) > 1) & ~w.isin(*K.SIMILARITY_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, .86 where one holds the other, else the larger of common words and common letters."""
    x, y = normal_alias(a), normal_alias(b)
    inside = x.contains(y) | y.contains(x)
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(inside, F.lit(0.86)).otherwise(F.greatest(jaccard(similarity_tokens(x), similarity_tokens(y)), _ratio(x, y)))


def language(text: Column) -> Column:
    """zh with a fifth of its letters in Han script, en with any letter, else unknown."""
    han, letters = F.regexp_count(text, F.lit(r"[一-鿿]")), F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when((han > 0) & (han >= letters * 0.2), "zh").when(letters > 0, "en").otherwise("unknown")


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""))


def word_shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"[A-Z]", "X"), r"[a-z]", "x"), r"[0-9]", "d")


def is_roman(token: Column) -> Column:
    return token.rlike(r"(?i)^(?=[MDCLXVI])(M|CM|D|CD|C|XC|L|XL|X|IX|V|IV|I)+$")


def is_abbreviation(token: Column) -> Column:
    return token.rlike(r"^[A-Z][A-Z0-9-]{1,7}$")


def has_model_number(token: Column) -> Column:
    return token.rlike("[A-Za-z]") & token.rlike("[0-9]")


def stem(word: Column) -> Column:
    """A light stem: -ied to -y, then -ing, -ed or -s cut where more than three letters stay."""
    w = F.lower(F.trim(word))
    n = F.length(w)
    return (
        F.when(w.endswith("ied") & (n > 4), F.concat(F.left(w, n - F.lit(3)), F.lit("y")))
        .when(w.endswith("ing") & (n > 6), F.left(w, n - F.lit(3)))
        .when(w.endswith("ed") & (n > 5), F.left(w, n - F.lit(2)))
        .when(w.endswith("s") & (n > 4), F.left(w, n - F.lit(1)))
        .otherwise(w)
    )


def stems(text: Column) -> Column:
    """The stems of the words of a text, with what follows an apostrophe."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:'[a-z0-9]+)?)"), 1), stem)


def lemma(word: Column) -> Column:
    """The base form of a word of the relation triggers; other words stand for themselves."""
    w = F.lower(F.regexp_replace(F.trim(word), r"(?U)^[^\w]+|[^\w]+$", ""))
    pairs = [F.lit(x) for kv in K.LEMMAS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), w), w)


def low_information(text: Column) -> Column:
    """Why a mention names nothing, or null."""
    t = F.coalesce(normal_alias(text, ascii_only=True), F.lit(""))
    return (
        F.when(t == "", "SKIPPED_LOW_INFORMATION")
        .when(t.isin(*K.PRONOUNS), "SKIPPED_PRONOUN")
        .when(t.isin(*K.GENERIC_PHRASES), "SKIPPED_GENERIC")
        .when(F.length(t) <= 1, "SKIPPED_LOW_INFORMATION")
    )


def surname(alias: Column) -> Column:
    last = F.element_at(F.split(collapse(alias), " "), -1)
    return F.when((F.size(F.split(collapse(alias), " ")) >= 2) & (F.length(last) > 2) & last.rlike(r"^\p{L}+$"), last)


def org_short_name(alias: Column) -> Column:
    short = F.trim(F.regexp_replace(alias, r"\s*[,(].*$", ""))
    return F.when((short != F.trim(alias)) & (short != ""), short)


def place_variant(alias: Column) -> Column:
    before = F.trim(F.substring_index(alias, ",", 1))
    bare = F.trim(F.regexp_replace(before, r"(?i)\s+(city|town|district|borough|county|village|bridge)$", ""))
    return F.when((bare != F.trim(alias)) & (bare != ""), bare)


def entity_type(raw: Column) -> Column:
    """One of the canonical types; unknown and null are CONCEPT."""
    pairs = [F.lit(x) for kv in K.LABEL_TO_TYPE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(raw))), F.lit("CONCEPT"))


def predicate(raw: Column) -> Column:
    p = F.upper(F.regexp_replace(F.trim(raw), "[- ]", "_"))
    pairs = [F.lit(x) for kv in K.PREDICATE_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), p), p)


def infer_type(instance_ids: Column | None, label: Column, description: Column, expected: Column | None = None) -> Column:
    """Instance ids, then words of the label, then words of the description, then what was expected, else Concept."""
    chain = []
    if instance_ids is not None:
        pairs = [F.lit(x) for kv in K.INSTANCE_TYPES.items() for x in kv]
        found = F.filter(F.transform(instance_ids, lambda q: F.try_element_at(F.create_map(*pairs), q)), lambda t: t.isNotNull())
        chain.append(F.try_element_at(found, F.lit(1)))
    for text, words in ((label, K.TITLE_WORDS), (description, K.DESCRIPTION_WORDS)):
        low = F.lower(F.coalesce(text, F.lit("")))
        case = None
        for kind, keys in words:
            for w in keys:
                case = F.when(low.contains(w), kind) if case is None else case.when(low.contains(w), kind)
        chain.append(case)
    if expected is not None:
        chain.append(expected)
    return F.coalesce(*chain, F.lit("Concept"))


def wikidata_time(text: Column) -> Column:
    """YYYY-MM-DD, or YYYY where month or day is unknown; the sign is dropped."""
    part = lambda k: F.regexp_extract(text, r"^[+-]?(\d{4})-(\d{2})-(\d{2})", k)
    return F.when(text.isNull(), None).when(part(1) == "", F.nullif(F.trim(text), F.lit(""))).when((part(2) == "00") | (part(3) == "00"), part(1)).otherwise(F.concat_ws("-", part(1), part(2), part(3)))


def stable_id(prefix: str, *parts: Column, size: int = 20, joiner: str = "||") -> Column:
    """prefix::hash of the parts, nulls as empty texts."""
    return F.concat(F.lit(prefix + "::"), F.left(F.sha1(F.concat_ws(joiner, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), F.lit(size)))


def clip_position(relative: Column, clip: int = 40) -> Column:
    """Relative token position as an index, 0 left for padding."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), relative)) + clip + 1


def token_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Tokens between two spans, 0 where they overlap."""
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))


def spans_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (e1 > s2)
