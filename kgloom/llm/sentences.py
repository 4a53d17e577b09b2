"""Sentence units across languages and scripts (problem 6).

The character-property rules of Unicode sentence breaking: terminators of all scripts
(full stops of Latin, CJK, Devanagari, Arabic, Ethiopic and others, the Greek question
mark), closing marks that belong to the sentence before, and what may start the next one.
On them lie the suppressions: abbreviations by language and kind (titles, what stands before a
name unless a word that starts sentences follows, references before a number, suffixes that
end a sentence only before a capital), initials, ordinals, decimals and list numbers; direct
speech stays in its sentence. The language is that of the common words before the mark, else
after it, of two alike that of the record; where no word tells, the tables of all languages
are read.

A line break ends a unit, except in wrapped text (`wrapped`), where only a blank line does.
A `piece` is what an earlier splitter left: a quotation open at its end or start is taken as
open.

Defined results: null, empty and blank texts have no unit; offsets are code points, half
open, without outer white space; repeated rows give one set of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import spread

# Abbreviations by language, lower case, without their last full stop.
#: Never the end of a sentence: a name or the rest of a phrase follows.
TITLES = {
    "en": "eg ie",
    "de": "fr hr",
    "fr": "m mm me st",
    "es": "d sr ej",
    # in no language a word that may end a sentence
    "": "dr dra prof mr mrs ms messrs mx capt lt sgt maj cf vs viz e.g i.e vgl bzw u.a d.h z.b z.t o.ä i.d.r mme mlle mgr p.ex c.-à-d sra srta dª p.ej "
    "т.е т.к т.н проф акад доц им ул см ср напр др.г д-р г-н г-жа κ κα δρ δηλ π.χ βλ د م أ डॉ श्री",
}
#: Not the end unless a word that commonly starts a sentence follows.
BEFORE_NAME = {
    "en": "st col gen rev hon gov sen rep pres pt mt ft approx ca c al incl resp",
    "de": "st ca incl resp c al approx",
    "fr": "env av apr c al ca d",
    "es": "st ca av ee aprox incl al c",
    "": "",
}
#: The same, with a capital at least: short forms within names of institutions, honours and machines.
IN_NAME = frozenset("univ uni acad inst soc roy natl nat nat'l dept comp diff lab coll up ord pr ee bros".split())
#: Not the end before a number (or, for months, a number): references, numbers, dates.
BEFORE_NUMBER = {
    "en": "no nos nr n vol vols fig figs p pp pg ch chap sec sect art par para eq ed eds ver v op fn jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr bd abs kap s abb tab fig vol art p b d r jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "n nº no nos art chap fig p pp vol t tab éd janv févr avr juil sept oct nov déc",
    "es": "núm num nº n art cap pág págs p pp tom t fig vol ed ene feb mar abr jun jul ago sept oct nov dic",
    "": "рис стр табл гл т с № σελ αρ ص पृ",
}
#: The end only before a capital (or a caseless letter): what may close a sentence as well.
BEFORE_CAPITAL = frozenset("etc usw co ltd inc corp jr sr esq a.m p.m u.s u.k e.u d.c ph.d b.a m.a ee.uu jh jhd n.chr v.chr т.д т.п др г гг в вв руб κ.λπ κ.ά".split())
#: Words that tell the languages of Latin script apart.
COMMON = {
    "en": "the of and to in is was that for it he she with as his her on be at by had not are but from they this have were which an its their or who them",
    "de": "der die das und ist nicht ein eine zu den von mit dem des im war sich auf für als wurde nach bei er sie es am vom zur zum seine ihre auch",
    "fr": "le les des et est une un dans pour par sur au que qui il elle du ne pas fut sa son ses aux avec se ce cette était",
    "es": "el los las y en que una por con para del se su fue al lo como más sus era este esta desde",
}
#: Words that, with a capital, commonly start a sentence and are no part of a name.
STARTERS = {
    "en": "the it he she they we you this that these those there then later but and if when while after before in on at by for with as his her its their our what who how why where no nor so yet however thus also a an some many most all both each every once since until although though because i my your nobody everyone another",
    "de": "der die das den dem des ein eine einen er sie es wir ihr ich dann danach später aber und wenn als nach vor in im am auf bei mit für sein seine ihre dieser diese dieses niemand doch auch so wie was wer warum",
    "fr": "il elle ils elles on nous vous je ce cette ces cela puis ensuite mais et si quand après avant dans en au aux pour avec sa son ses leur leurs une un les des personne aussi ainsi comment pourquoi que qui",
    "es": "él ella ellos ellas yo nosotros este esta estos estas eso luego después pero y si cuando antes en con para por su sus un una los las el nadie también así cómo qué quién",
    "": "",
}
for _t in (TITLES, BEFORE_NAME, BEFORE_NUMBER, COMMON, STARTERS):
    for _k in _t:
        _t[_k] = frozenset(_t[_k].split())
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner jh jahrhundert jhd".split()
#: Small words that begin a name at the start of a sentence.
PARTICLES = frozenset("de von van du di da del della le la der den ter ten zu".split())

FULL = "。！？｡．।॥።፧፨؟۔။"
CLOSERS = ")]}）］】〕’'\"”»」』›"
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", '"': '"'}
_CLOSE = frozenset("”»」』›\"")

_EVENT = re.compile(rf"[.!?…]+|[{FULL}]+[.!?…]*|;;?|[“”„«»「」『』‹›\"]")
#: A text without a match is one unit: no mark is followed by anything that could start another.
_MARKS = re.escape(CLOSERS + "".join(_OPEN))
_INNER = re.compile(rf"[.!?…;]+[{_MARKS}\s]*\s[^\s]|[.!?…][{_MARKS}]*[^\W\d_a-zß-öø-ÿ]|[.!?…;][{_MARKS}]+[^\s{_MARKS}]|[{FULL}]+[^\s{FULL}{re.escape(CLOSERS)}]|[{FULL}][{_MARKS}]*\s*\S")
_WORD = re.compile(r"(?:[^\W\d_]|['’\-.](?=[^\W_])|(?<=[^\W\d_])\.\s(?=[^\W\d_]\.?$))*[^\W\d_]$")
_NEXT = re.compile(r"\s*([(\[¿¡\"“„«「『‹—–\-*•]*\s*)([^\W\d_]+|\d+|\S)?")
_NUMBER_START = re.compile(r"\s*(?:[(\[]?\d{1,3}(?:\.\d{1,3})*|[ivxlc]{1,5}|[A-Za-z])$")
_MONTH = re.compile(r"\s+(?:%s)\b" % "|".join(MONTHS), re.I)
_SPACED_ABBREVIATION = re.compile(r"(?:^|[\s(\[,;:\"“„«])((?:[^\W\d_]{1,2}\.\s?)+[^\W\d_]{1,2})$")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def _word_before(text: str, start: int, at: int) -> tuple[str, str]:
    """The word that ends at `at` as it stands, and with its spaced letters joined ("u. a" -> "u.a")."""
    i = at
    while i > start and (text[i - 1].isalpha() or text[i - 1] in "'’ª-" or (text[i - 1] == "." and i - 2 >= start and text[i - 2].isalpha() and i < at) or "̀" <= text[i - 1] <= "ͯ" or "ऀ" <= text[i - 1] <= "ॿ"):
        i -= 1
    word = text[i:at]
    m = _SPACED_ABBREVIATION.search(text, max(start, at - 16), at)
    return word, (re.sub(r"\s", "", m.group(1)) if m else word)


_LATIN_WORD = re.compile(r"[a-zà-ÿœ]+")


#: Characters after a mark that are read for the language.
AHEAD = 60


def language_of(texts: tuple[str, ...], said: str | None) -> str:
    """The language of the first of these texts that has common words of one; of two alike, the one the record says; "" for any."""
    for text in texts:
        ws = _LATIN_WORD.findall(text.lower())
        votes = {k: sum([w in common for w in ws]) for k, common in COMMON.items()}
        most = max(votes.values())
        best = [k for k, n in votes.items() if n == most]
        if most and len(best) == 1:
            return best[0]
        if most and said in best:
            return said
    return ""


@lru_cache(maxsize=None)
def tables(language: str) -> tuple[frozenset, frozenset, frozenset, frozenset]:
    """The tables of a language, or of all of them for ""."""
    some = [language] if language else list(COMMON)
    return tuple(frozenset().union(t[""], *[t[k] for k in some]) for t in (TITLES, BEFORE_NAME, BEFORE_NUMBER, STARTERS))


def caseless_gap(first: str, gap: bool) -> bool:
    return not gap and first.isalpha() and not first.isupper()


def _breaks(text: str, start: int, mark: int, end: int, stop: int, run: str, quoted: bool, said: str | None = None) -> bool:
    """Whether a sentence ends at `end`, after a mark at `mark`, within text[start:stop]."""
    m = _NEXT.match(text, end, stop)
    lead, follow = m.group(1), m.group(2)
    if not follow and not lead.strip():
        return False  # the end of the line ends it anyway
    gap = end < stop and text[end].isspace()
    first = follow[0] if follow else ""
    dash = lead.lstrip()[:1]
    if dash in ("—", "–") and quoted:
        return False  # «...» — said he
    if run[0] == "…" and caseless_gap(first, gap):
        return False  # an ellipsis within a sentence of a script without capitals
    if run[0] in FULL:
        if first in ",，、;；:：" and first:
            return False
        return not (quoted and (first in "とってな" and first))
    if first and not (first.isalnum()):
        return gap and first not in ",;:.!?…)]}，、；：%/&=+)）"
    upper, caseless = first.isupper() or first.istitle(), first.isalpha() and not first.isupper() and not first.islower()
    digit = first.isdigit()
    if not gap and not lead:
        # right after the mark: only a capital or a caseless letter after a finished word
        if not (upper or caseless):
            return False
        if run == "." and not quoted:
            before = text[mark - 1 : mark]
            if "ሀ" <= before <= "፿" or not (before.islower() or before.isdigit() or before in ")]\"”»%" or (before.isalpha() and not before.isupper())):
                return False
    if run in (".", ";") and not quoted:
        if run == ";":
            before = text[mark - 1 : mark]
            return bool("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿") and (upper or digit or caseless)
        before = text[mark - 1 : mark] if mark > start else ""
        if "ሀ" <= before <= "፿":
            return False
        if before.isdigit():
            head = text[start:mark]
            if len(head) < 10 and _NUMBER_START.match(head):
                return False  # a list number
            i = mark
            while i > start and text[i - 1].isdigit():
                i -= 1
            if mark - i <= 2 and _MONTH.match(text, end, stop):
                return False  # an ordinal of a date or century
        elif before.isalpha() or before in "ª'’" or "ऀ" <= before <= "ॿ":
            word, joined = _word_before(text, start, mark)
            low, whole = word.lower().replace("’", "'"), joined.lower()
            if len(low) <= 7 or "." in whole:
                # sentences of several languages may share a line: what is before the mark speaks first, then what follows
                titles, names, numbers, starters = tables(language_of((text[start:mark], text[end : min(stop, end + AHEAD)]), said))
                starts = upper and not (len(follow) > 1 and follow.isupper()) and follow.lower() in starters
            if len(low) > 7 and "." not in whole or (whole in BEFORE_CAPITAL or low in BEFORE_CAPITAL) and low not in titles:
                pass
            else:
                if len(word) == 1 and "a" <= word <= "z":
                    if not starts or whole != low:
                        return False  # "u. a.", "o. t."
                elif len(word) == 1 and (word.isupper() or "ऀ" <= word <= "ॿ") and not (len(text[start:mark].strip()) > 1 and text[mark - 2] == "."):
                    if not starts:
                        return False  # an initial
                elif word[:1].isupper() and low in IN_NAME:
                    if not starts:
                        return False
                elif low in titles or whole in titles or ((low in names or whole in names) and not starts):
                    if low not in numbers or not (word[:1].islower() and len(low) == 1 and upper):
                        return False
                if digit and low in numbers:
                    return False
                if len(low) <= 5 and word.istitle() and low in ("chap", "fig", "vol", "no", "nr", "art") and not upper:
                    return False
    if upper or caseless:
        return True
    if digit:
        return True
    if follow and follow in PARTICLES and run[0] in ".!?" and gap:
        rest = text[m.end(2) : m.end(2) + 2]
        if len(rest) == 2 and rest[0] == " " and rest[1].isupper():
            return True  # after a quotation, too: speech that opens a sentence was seen before
    return False


def units(text: str, start: int, stop: int, piece: bool = False, language: str | None = None) -> list[tuple[int, int]]:
    """Sentence units of text[start:stop], which is one line or one wrapped block; language: as its record says."""
    out: list[tuple[int, int]] = []
    begin = start  # of the current sentence
    quote = ""  # the closing mark waited for
    quote_at = -1
    events = list(_EVENT.finditer(text, start, stop))
    if piece:
        for m in events:
            g = m.group()
            if g in _OPEN or g in _CLOSE:
                p = m.start()
                if (g in "”»」』›") or (g == '"' and p > start and not text[p - 1].isspace() and text[p - 1] not in "([—–" and (p + 1 >= stop or text[p + 1].isspace())):
                    quote, quote_at = g, start - 1
                break
    skip = start
    for m in events:
        p, g = m.start(), m.group()
        if p < skip:
            continue
        if g in _OPEN or g in _CLOSE:
            if quote:
                if g != quote:
                    continue
                opened, quote = quote_at, ""
                q = p - 1
                while q > begin and text[q].isspace():
                    q -= 1
                if text[q] not in ".!?…" and text[q] not in FULL:
                    continue
                end = p + 1
                while end < stop and text[end] in CLOSERS and text[end] not in "'\"":
                    end += 1
                if end < stop and text[end] in ".!?…" + FULL:
                    continue  # the mark after the quotation decides
                lead = text[begin:opened].strip() if opened >= begin else "x"
                if not lead and opened >= begin:
                    n = _NEXT.match(text, end, stop).group(2)
                    if n and not n[0].isupper() and not n[0].isdigit():
                        continue  # speech first, then who says it
                if _breaks(text, begin, q, end, stop, text[q], True, language):
                    out.append((begin, end))
                    begin = end
                continue
            close = _OPEN.get(g)
            if close is None:
                continue
            if g == "“" and "”" not in text[p:stop] and not piece:
                continue
            if piece or text.find(close, p + 1, stop) >= 0:
                if g == "»":
                    continue
                quote, quote_at = close, p
            continue
        if quote:
            continue
        end = m.end()
        while end < stop and text[end] in CLOSERS:
            if text[end] == '"' and end + 1 < stop and not text[end + 1].isspace() and text[end + 1] not in CLOSERS:
                break  # it opens the next sentence
            end += 1
        if end == m.end() and end < stop and text[end].isspace():
            k = end
            while k < stop and text[k] in "    ":
                k += 1
            if k < stop and text[k] in ")]»›" and g not in ".;":
                end = k + 1
        if g == ";;":
            continue
        if _breaks(text, begin, p, end, stop, g if g[0] in FULL else (g if g in (".", ";") else g[0] * 2), False, language):
            out.append((begin, end))
            begin = end
        skip = end
    out.append((begin, stop))
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def sentence_units(text: str | None, wrapped: bool = False, piece: bool = False, language: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of all units of one text."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    at = 0
    if wrapped:
        for m in _BLANK.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
    elif "\n" in text or "\r" in text or " " in text or " " in text:
        for line in text.splitlines(keepends=True):
            spans.append((at, at + len(line)))
            at += len(line)
    else:
        spans.append((0, len(text)))
    out = []
    for a, b in spans:
        a, b = _trim(text, a, b)
        if a == b:
            continue
        if _INNER.search(text, a, b) is None:
            out.append((a, b))
            continue
        for x, y in units(text, a, b, piece, language):
            x, y = _trim(text, x, y)
            if x < y:
                out.append((x, y))
    return out


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wrapped, piece = batch.column("text").to_pylist(), batch.column("wrapped").to_pylist(), batch.column("piece").to_pylist()
        languages = batch.column("language").to_pylist()
        rows, starts, ends = [], [], []
        for i, t in enumerate(texts):
            for a, b in sentence_units(t, wrapped[i], piece[i], languages[i]):
                rows.append(i)
                starts.append(a)
                ends.append(b)
        index = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("tbl").take(index), batch.column("row_id").take(index), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["tbl", "row_id", "offset_start", "offset_end"],
        )


def split_texts(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, offset_start, offset_end) from rows (tbl, row_id, text, wrapped, piece, language); distinct."""
    texts = texts.filter(F.col("text").isNotNull()).select("tbl", "row_id", "text", "wrapped", "piece", "language")
    return spread(texts).mapInArrow(_split_batches, "tbl string, row_id string, offset_start int, offset_end int").distinct()


def all_units(records: DataFrame, sentences: DataFrame) -> DataFrame:
    """Units of document_records.clean_text and of sentences.text; where records name a language, it decides if the text doesn't."""
    said = F.lower(F.left(F.trim("language"), F.lit(2))) if "language" in records.columns else F.lit(None).cast("string")
    docs = records.select(F.lit("document_records").alias("tbl"), F.col("doc_id").alias("row_id"), F.col("clean_text").alias("text"), F.coalesce(F.col("source_type") == "pdf", F.lit(False)).alias("wrapped"), F.lit(False).alias("piece"), said.alias("language"))
    rows = sentences.select(F.lit("sentences").alias("tbl"), F.col("sentence_id").alias("row_id"), "text", F.lit(False).alias("wrapped"), F.lit(True).alias("piece"), F.lit(None).cast("string").alias("language"))
    return split_texts(docs.unionByName(rows))
