"""Rule sentences of clean page text, as a table function.

Blocks between blank lines are headings, contents or prose. Neighbouring headings make one
sentence, closed with a full stop. A block of lines that aren't wrapped prose is cut into
them, headings before a body first. Prose is scanned for boundaries: strong marks always end a
sentence, a full stop unless it stands in a number, next to another one, after an abbreviation
or an initial, or before a small letter. Sentences are cleaned of section numbers, reference
marks, blanks around marks and letters torn off their words. Those without content and repeats
of the sentence before are dropped. Offsets are those of the clean text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kgloom.functions import constants as K
from kgloom.session import spread

_BLOCK = re.compile(r"[^\n]+(?:\n(?!\n)[^\n]+)*")
_LINE = re.compile(r"[^\n]+")
_STRONG = "。！？；!?;"
_CLOSE = "\"'”’)]}"
_MARKS = re.compile(r"[.!?;:。！？；：]")
_ENDING = re.compile(r"[.!?;:。！？；：][\"'”’)\]}]*$")
_SECTION = re.compile(K.SECTION_PREFIX, re.I)
_LEADING, _TRAILING, _ONLY, _NUMBERED = (re.compile(x) for x in (K.LEADING_REFERENCES, K.TRAILING_REFERENCES, K.ONLY_REFERENCES, K.NUMBERED))
_HEADING_WORD = re.compile(r"[A-Za-z0-9一-鿿&+'’-]+")
_NAME_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)?")
#: Blanks around quotations and marks, in the order they are mended.
_SPACING = tuple(
    (re.compile(a), b)
    for a, b in (
        (r"\s+", " "), (r'(?<=\w)("[^"]+")', r" \1"), (r'("[^"]+")(?=\w)', r"\1 "), (r'([,.;:!?])("[^"]+")', r"\1 \2"), (r"([“‘([{])\s+", r"\1"),
        (r"\s+([,.;:!?%)\]}”’])", r"\1"), (r"\s+([\"'])(?=\s|$|[,.;:!?%)\]}])", r"\1"),
    )
)


def discard(s: str) -> bool:
    """Whether a sentence carries no content."""
    marks = _MARKS.search(s) is not None
    if len(s) < 4 or _ONLY.fullmatch(s) or not re.search(r"[A-Za-z0-9一-鿿]", s) or re.fullmatch(r"\d+(?:\.\d+)*", s) or s.startswith(K.SKIPPED_STARTS):
        return True
    if (not marks and len(_NUMBERED.findall(s)) >= 3) or (len(s) <= 80 and any(m in s for m in K.SOURCE_MARKS)):
        return True
    words = _NAME_WORD.findall(s)
    if not marks and len(s) <= 60 and 0 < len(words) <= 8 and all(w[0].isupper() for w in words):
        return True  # a run of names
    if len(s) <= 36 and ":" in s and not re.search(r"\d{4}", s):
        return True  # a label
    return re.fullmatch(r"[A-Z][A-Za-z'’\-]+,\s*(?:[A-Z]\.\s*){1,3}", s) is not None  # a surname with initials


def is_heading(block: str) -> bool:
    t = _SECTION.sub("", re.sub(r"\s+", " ", block).strip()).strip()
    return 0 < len(t) <= 100 and _MARKS.search(t) is None and 1 <= len(_HEADING_WORD.findall(t)) <= 12


def is_contents(block: str) -> bool:
    return len(_NUMBERED.findall(block)) >= 2 and len(_MARKS.findall(block)) <= 2


def mend_letters(text: str) -> str:
    """Joins single letters to the words they were torn off."""
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        w, follow = words[i], words[i + 1] if i + 1 < len(words) else ""
        torn = re.fullmatch("[A-Za-z]", w) and re.fullmatch("[a-z]+", follow)
        if torn and ((w.islower() and w not in K.LETTER_WORDS) or (w.isupper() and w not in K.LETTER_NAMES and (len(follow) == 1 or len(follow) >= 4))):
            out.append(w + follow)
            i += 2
        else:
            out.append(w)
            i += 1
    return " ".join(w for w in out if w).strip()


def clean(text: str) -> str:
    """A sentence without section number, reference marks and stray blanks."""
    t = _TRAILING.sub(r"\1", _LEADING.sub("", _SECTION.sub("", text).strip()))
    for pattern, to in _SPACING:
        t = pattern.sub(to, t)
    return mend_letters(t)


def closed(text: str) -> str:
    """A heading with a full stop of its script."""
    if not text or _ENDING.search(text):
        return text
    return text + ("。" if re.search("[一-鿿]", text) else ".")


def lines_of(text: str, at: int) -> list[tuple[str, int]]:
    """The parts (text, start) that a block is read in: entries of contents, headings before a body, single lines, or the whole block."""
    whole = [(text, at)]
    if is_contents(text):
        starts = [m.start(1) for m in re.finditer(r"(?:^|\s)(\d+(?:\.\d+)+|\d+)\s+[A-Z]", text)]
        parts = [(text[a:b].strip(), at + a) for a, b in zip(starts, [*starts[1:], len(text)])]
        return [p for p in parts if p[0]] if len(starts) >= 2 else whole
    lines = [m for m in _LINE.finditer(text) if m.group().strip()]
    if len(lines) < 2:
        return whole
    pairs = [(a.group().strip(), b.group().strip()) for a, b in zip(lines, lines[1:])]
    soft = sum(a[-1] in ",-–(" or (a[-1] not in ".!?;:。！？；：" and b[0].islower()) for a, b in pairs)
    if soft >= max(1, len(lines) // 2) or sum(len(m.group()) for m in lines) > 80 * len(lines):
        return whole  # wrapped prose
    heads = 0
    for m, follow in zip(lines, [*lines[1:], None]):
        if not is_heading(m.group()):
            break
        gap = text[m.end() : follow.start()] if follow else ""
        if follow and "\n" in gap and gap.replace("\n", "") and len(_HEADING_WORD.findall(m.group().strip())) == 1:
            return whole  # the start of a sentence, cut off by a hard wrap
        heads += 1
    if 0 < heads < len(lines):
        return [(m.group(), at + m.start()) for m in lines[:heads]] + [(text[lines[heads].start() : lines[-1].end()], at + lines[heads].start())]
    return [(m.group(), at + m.start()) for m in lines]


def collapsed(text: str, at: int) -> tuple[str, list[int]]:
    """The text with single blanks, none beside marks, and where each character stood."""
    chars: list[str] = []
    places: list[int] = []
    gap = -1
    for i, c in enumerate(text):
        if c.isspace():
            if chars and gap < 0:
                gap = at + i
            continue
        if gap >= 0:
            if chars[-1] not in "\"'“‘([{" and c not in ",.;:!?%)]}\"'”’":
                chars.append(" ")
                places.append(gap)
            gap = -1
        chars.append(c)
        places.append(at + i)
    return "".join(chars), places


def ends(text: str, i: int) -> bool:
    """Whether the mark at i ends a sentence."""
    if text[i] in _STRONG:
        return True
    before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
    if text[i] != "." or (before.isdigit() and after.isdigit()) or before == "." or after == ".":
        return False
    m = re.search(r"([A-Za-z][A-Za-z.\-]{0,23})[.!?;:]?$", text[max(0, i - 24) : i + 1])
    if m and m.group(1).strip(".").lower() in K.ABBREVIATIONS:
        return False
    follow = next((c for c in text[i + 1 :] if not c.isspace() and c not in _CLOSE), "")
    if not follow:
        return True
    return not ((before.isupper() and follow.isupper()) or re.match(r"\s*[A-Za-z]\.", text[i + 1 :]) or follow.islower())


def prose(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Sentences of a part of a block."""
    if "\n" in text:
        parts = lines_of(text, at)
        if len(parts) > 1 and any(is_heading(t) for t, _ in parts[:-1]):
            for t, a in parts:
                yield from prose(t, a)
            return
    flat, places = collapsed(text, at)
    begin, i = 0, 0
    while i < len(flat):
        if not ends(flat, i):
            i += 1
            continue
        while i + 1 < len(flat) and flat[i + 1] in _CLOSE:
            i += 1
        while begin <= i and flat[begin].isspace():
            begin += 1
        if begin <= i:
            yield clean(flat[begin : i + 1]), places[begin], places[i] + 1
        begin = i = i + 1
    while begin < len(flat) and flat[begin].isspace():
        begin += 1
    if begin < len(flat):
        rest = clean(flat[begin:])
        yield (closed(rest) if is_heading(rest) else rest), places[begin], places[-1] + 1


def _heading(parts: list[re.Match]) -> Iterator[tuple[str, int, int]]:
    """One sentence of neighbouring headings."""
    said, first, last = [], None, 0
    for m in parts:
        t = m.group()
        a, b = m.start() + len(t) - len(t.lstrip()), m.end() - (len(t) - len(t.rstrip()))
        t = t.strip()
        if (number := _SECTION.match(t)) is not None:
            t, a = t[number.end() :], a + number.end()
        if t := clean(t):
            said.append(t)
            first, last = a if first is None else first, b
    if said:
        yield closed(clean(" ".join(said))), first, last


def rule_sentences(text: str | None) -> Iterator[tuple[int, str, int, int]]:
    """(index from 1, sentence, start, end) of one text."""
    n, last, k = 0, "", 0
    found = list(_BLOCK.finditer(text or ""))
    while k < len(found):
        heads = k
        while heads < len(found) and is_heading(found[heads].group()):
            heads += 1
        if heads > k:
            some = _heading(found[k:heads])
            k = heads
        else:
            m = found[k]
            some = (x for t, a in lines_of(m.group(), m.start()) for x in prose(t, a))
            k += 1
        for s, a, b in some:
            if s != last and not discard(s):
                last = s
                n += 1
                yield n, s, a, b


_OUT = StructType([StructField("doc_id", StringType()), StructField("sentence_index", IntegerType()), StructField("text", StringType()), StructField("offset_start", IntegerType()), StructField("offset_end", IntegerType())])


def split_documents(documents: DataFrame, key: str = "doc_id", text: str = "clean_text") -> DataFrame:
    """One row a sentence; no shuffle beyond one that fills idle cores."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = [(d, *s) for d, t in zip(rows.doc_id, rows.text) for s in rule_sentences(t)]
            yield pd.DataFrame(out, columns=_OUT.names)

    return spread(documents.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, _OUT)
