"""One form for texts that look the same (problem 5).

First the plain part: canonical composition, full-width and half-width forms, joined
letters, special spaces and hyphens, and invisible characters. Then script-aware repair of
look-alike letters: the dominant script of a token is that of its letters that no other
script imitates (of its text, where all could be either); letters of the other script are
substituted only in mixed-script tokens, and only when the result exists in the corpus
vocabulary. The vocabulary holds every token of one script in the same field; a result that
several spellings of the corpus agree on counts as existing too, so that two disguised
copies meet though no plain one exists.

ASCII texts are their own form and never leave the JVM; of the others only those that change
are kept, and in shuffles 16 bytes stand for a text. Case, accents and other letters stay:
they are visible.

Defined results: a null text has a null form, an empty one an empty form; rows repeated
with the same id count once; equal texts are no pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.session import durable, spread

# Letters of one script that look like letters of Latin, as in public confusables data.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜӀ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWI"))
GREEK = dict(zip("ονικαρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ", "ovikapuxABEZHIKMNOPTYXj"))
ARMENIAN = dict(zip("օսհոցզքյՕՍՏԼ", "ouhngqpjOUSL"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHJKLMPSTVWZR"))
SPACES = dict.fromkeys(map(ord, "               　"), " ")
HYPHENS = dict.fromkeys(map(ord, "‐‑"), "-")
INVISIBLE = dict.fromkeys(map(ord, "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"))

#: Compatibility forms that look like their plain letters: joined letters, wide and narrow forms, styled letters of formulas.
_COMPAT = {c: unicodedata.normalize("NFKC", chr(c)) for a, b in ((0xFB00, 0xFB07), (0xFB13, 0xFB18), (0xFF01, 0xFFEF), (0x132, 0x134), (0x1C7, 0x1CD), (0x1F1, 0x1F4), (0x1D400, 0x1D6A4), (0x1D7CE, 0x1D800)) for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"}
_PLAIN = _COMPAT | SPACES | HYPHENS | INVISIBLE
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")

LATIN, CYR, GRK, ARM, CHR = SCRIPTS = 1, 2, 3, 4, 5


def _maps() -> dict[tuple[int, int], dict[str, str]]:
    """Letters of one script that look like letters of another, by way of Latin."""
    maps: dict[tuple[int, int], dict[str, str]] = {}
    for s, to in ((CYR, CYRILLIC), (GRK, GREEK), (ARM, ARMENIAN), (CHR, CHEROKEE)):
        maps[s, LATIN] = to
        maps[LATIN, s] = {v: k for k, v in reversed(list(to.items()))}
    for s in SCRIPTS[1:]:
        for t in SCRIPTS[1:]:
            if s != t:
                maps[s, t] = {c: maps[LATIN, t][x] for c, x in maps[s, LATIN].items() if x in maps[LATIN, t]}
    return maps


MAPS = _maps()


@lru_cache(maxsize=20_000)
def script(ch: str) -> int:
    """The script of a letter that can be mistaken for one of another, or 0."""
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return LATIN if ch.isalpha() else 0
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return GRK
    if 0x400 <= c < 0x530:
        return CYR
    return ARM if 0x530 <= c < 0x590 else CHR if 0x13A0 <= c < 0x1400 else 0


def plain(text: str) -> str:
    """The text without what only the encoding tells apart."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_PLAIN))


def _substitute(token: str, to: int) -> str | None:
    """The token in one script; None where a letter has no look-alike there."""
    out = []
    for ch in unicodedata.normalize("NFD", token):
        s = script(ch)
        if s and s != to:
            ch = MAPS.get((s, to), {}).get(ch)
            if ch is None:
                return None
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=200_000)
def _sure(token: str) -> tuple[int, int]:
    """(scripts present as bits, script of the letters without look-alikes or 0) of a token."""
    present, sure = 0, [0] * (1 + len(SCRIPTS))
    for ch in unicodedata.normalize("NFD", token):
        s = script(ch)
        if s:
            present |= 1 << s
            if s == LATIN:
                twin = any(ch in MAPS[LATIN, t] for t in (CYR, GRK))
            else:
                twin = ch in MAPS[s, LATIN]
            sure[s] += not twin
    top = max(sure)
    return present, sure.index(top) if top else 0


def suspects(text: str) -> list[tuple[str, str]]:
    """(token, repaired) of the tokens that may hide look-alikes: mixed ones, and ones that
    consist of look-alikes only and stand in a text of another script."""
    tokens = _TOKEN.findall(text)
    votes, seen = [0] * (1 + len(SCRIPTS)), 0
    for t in tokens:
        present, sure = _sure(t)
        votes[sure] += bool(sure) * len(t)
        seen |= present
    if seen & (seen - 1) == 0:
        return []
    most = max(SCRIPTS, key=lambda s: votes[s])
    out = []
    for t in dict.fromkeys(tokens):
        present, sure = _sure(t)
        if not present or (present == 1 << (sure or most)):
            continue
        to = sure or most
        if present & (present - 1) == 0 and sure:
            continue  # one script for certain
        fixed = _substitute(t, to)
        if fixed is not None and fixed != t:
            out.append((t, fixed))
    return out


_FORM = T.StructType([
    T.StructField("form", T.StringType()),
    T.StructField("suspects", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("fixed", T.StringType())]))),
])


@F.pandas_udf(_FORM)
def _form(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        forms = [plain(t) for t in texts]
        yield pd.DataFrame({"form": forms, "suspects": [suspects(f) for f in forms]})


@F.pandas_udf(T.StringType())
def _repaired(form: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for f, pairs in zip(form, known):
        fixes = {p["token"]: p["fixed"] for p in pairs}
        out.append(_TOKEN.sub(lambda m, fixes=fixes: fixes.get(m.group(), m.group()), f))
    return pd.Series(out, dtype=object)


def _ascii(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def _mark(c: Column) -> Column:
    """What stands for a text in shuffles: 16 bytes."""
    return F.unhex(F.md5(c))


def _changed(texts: DataFrame) -> DataFrame:
    """(field, id, text, form, suspects) of the texts whose form differs, or may after repair; kept in the shared folder."""
    hard = spread(texts.filter(~_ascii(F.col("text")))).select("field", "id", "text", _form("text").alias("f")).select("field", "id", "text", "f.form", "f.suspects")
    return durable(hard.filter((F.col("form") != F.col("text")) | (F.size("suspects") > 0)))


def _repairs(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """(field, token, fixed) of the look-alike tokens whose repaired form the corpus knows.

    The vocabulary is every token of the texts without invisible characters and marks, and of
    the forms of the others, counted per partition before the shuffle.
    """
    pairs = changed.filter(F.size("suspects") > 0).select("field", F.explode("suspects").alias("s")).select("field", "s.token", "s.fixed").groupBy("field", "token", "fixed").agg(F.count("*").alias("n"))
    spellings = pairs.groupBy("field", "fixed").agg(F.count("*").alias("n_spellings"))
    plain_texts = texts.filter(~F.col("text").rlike("[\u0300-\u036f\\p{Cf}]")).select("field", "text")
    words = plain_texts.unionByName(changed.select("field", F.col("form").alias("text")))
    split = F.split(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " "), " ")
    vocabulary = words.select("field", F.explode(split).alias("fixed")).filter("fixed <> ''").groupBy("field", "fixed").agg(F.count("*").alias("n_rows"))
    exists = spellings.join(vocabulary, ["field", "fixed"], "left").filter(F.col("n_rows").isNotNull() | (F.col("n_spellings") > 1)).select("field", "fixed")
    return pairs.join(exists, ["field", "fixed"]).select("field", "token", "fixed")


def _fixed(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """(field, id, text, form) of the changed texts with their look-alikes repaired."""
    doubtful = changed.filter(F.size("suspects") > 0)
    known = _repairs(texts, changed)
    rows = doubtful.withColumn("at", F.struct("id", _mark(F.col("text")))).select("field", "at", F.explode("suspects").alias("s")).select("field", "at", "s.token")
    fixes = rows.join(known, ["field", "token"]).groupBy("field", "at").agg(F.collect_set(F.struct("token", "fixed")).alias("known"))
    own = doubtful.select("field", "id", "text", "form", F.struct("id", _mark(F.col("text"))).alias("at"))
    none = F.array().cast("array<struct<token:string,fixed:string>>")
    repaired = own.join(fixes, ["field", "at"], "left").select("field", "id", "text", _repaired("form", F.coalesce("known", none)).alias("form"))
    return changed.filter(F.size("suspects") == 0).select("field", "id", "text", "form").unionByName(repaired)


def canonical_forms(texts: DataFrame) -> DataFrame:
    """(field, id, text, form) of rows (field, id, text); form is the consistent text."""
    texts = texts.filter(F.col("text").isNotNull()).select("field", "id", "text")
    easy = texts.filter(_ascii(F.col("text"))).select("field", "id", "text", F.col("text").alias("form"))
    changed = _changed(texts)
    hard = spread(texts.filter(~_ascii(F.col("text")))).select("field", "id", "text", _form("text").alias("f"))
    same = hard.filter((F.col("f.form") == F.col("text")) & (F.size("f.suspects") == 0)).select("field", "id", "text", F.col("text").alias("form"))
    return easy.unionByName(same).unionByName(_fixed(texts, changed))


def _classes(texts: DataFrame) -> DataFrame:
    """(field, form, text, id) of all rows whose form at least one disguised text has; form and text stand as 16 bytes."""
    texts = texts.filter(F.col("text").isNotNull()).select("field", "id", "text")
    fixed = durable(_fixed(texts, _changed(texts)).select("field", "id", _mark(F.col("text")).alias("text"), _mark(F.col("form")).alias("form")).filter("text <> form"))
    forms = fixed.select("field", "form").distinct()
    # all other texts are their own form; a disguised one can't be the form of another
    others = texts.select("field", "id", _mark(F.col("text")).alias("form")).join(forms, ["field", "form"], "left_semi")
    return fixed.unionByName(others.withColumn("text", F.col("form"))).select("field", "form", "text", "id").distinct()


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b, of rows whose texts differ and have one form.

    Rows with equal texts are no pair, so a text that a third of the rows share costs
    nothing by itself: pairs are formed between the different texts of one form, and only
    then are they joined to the rows that hold them. `lookalike_classes` gives the same links
    without writing them out.
    """
    hit = durable(_classes(texts))
    variants = hit.select("field", "form", "text").distinct()
    a, b = variants.withColumnRenamed("text", "text_a"), variants.withColumnRenamed("text", "text_b")
    pairs = a.join(b, ["field", "form"]).filter("text_a < text_b")
    left = hit.select("field", F.col("text").alias("text_a"), F.col("id").alias("id_1"))
    right = hit.select("field", F.col("text").alias("text_b"), F.col("id").alias("id_2"))
    both = pairs.select("field", "text_a", "text_b").join(left, ["field", "text_a"]).join(right, ["field", "text_b"]).filter("id_1 <> id_2")
    return both.select("field", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(field, id, class_id, n_texts, n_links) of every row that looks like a different one.

    class_id is the least id of the class, n_texts the different texts in it, n_links the
    rows that hold another text than this one.
    """
    hit = durable(_classes(texts))
    per_text = hit.groupBy("field", "form", "text").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    per_form = per_text.groupBy("field", "form").agg(F.sum("n").alias("total"), F.count("*").alias("n_texts"), F.min("least").alias("class_id")).filter("n_texts > 1")
    sizes = per_text.select("field", "form", "text", "n").join(per_form, ["field", "form"])
    return hit.join(sizes, ["field", "form", "text"]).select("field", "id", "class_id", "n_texts", (F.col("total") - F.col("n")).alias("n_links"))
