"""Pages of repeated keywords, links or product tags (problem 9).

Each text is cut into blocks of about 1,000 characters; the compression ratio of a block is
held against the usual ratio of blocks of its length, script and language, counted over all
blocks of the corpus that have sentence marks. A text most of which lies in blocks far more
redundant than usual is a suspect. What confirms it is a low density of sentences: text in
units that end in a sentence mark and read as a sentence, not as a run of short items, links
or tags. Two kinds of page hide their redundancy: link lists, whose addresses differ (they
are compressed once more with every word of their link units masked), and stuffed sentences
with marks in place, which must be extremely redundant and repeat one phrase within single
sentences; machine logs and refrains repeat only from sentence to sentence.

Two passes over the texts, the first for the usual ratios (a small table, whatever the
corpus), the second for the decision; nothing but doc_ids is shuffled.

Defined results: null and blank texts are never flagged; all others are measured whole,
however short or long; a null, blank or unknown language is one of its own; repeated rows
give one id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.session import spread

BLOCK = 1000
#: A block this much below the usual ratio of its kind is redundant; extreme where stuffed sentences must show it.
REDUNDANT, EXTREME = 0.82, 0.72
#: Short texts vary more: below FIRM characters the limit falls by up to LOOSE.
FIRM, LOOSE = 200, 0.2
#: Share of a text that must lie in such blocks.
MOSTLY = 0.5
#: Most sentence share of a page of lists; share of link units that makes a link list.
PROSE, LINKS = 0.4, 0.5
#: Share of sentences that repeat a phrase within themselves, on a stuffed page.
STUFFED = 0.35
#: Blocks of a kind from which its usual ratio counts; characters for each sentence mark, at most, of blocks that count.
SEEN, MARKED = 20, 250

SCRIPTS = (
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]+")),
    ("han", re.compile(r"[぀-ヿ㐀-鿿가-힯]+")),
    ("cyrillic", re.compile(r"[Ѐ-ӿ]+")),
    ("greek", re.compile(r"[Ͱ-Ͽ]+")),
    ("arabic", re.compile(r"[؀-ۿ]+")),
    ("indic", re.compile(r"[ऀ-෿]+")),
    ("ethiopic", re.compile(r"[ሀ-፿]+")),
)
_UNIT = re.compile(r"[^\n]*?(?:[.!?;;](?=[\s\"'»”“’)\]]|$)[\"'»”’)\]]*|[。！？｡।॥።؟፧…]+[」』”’»）)]*|\n|$)")
_MARK = re.compile(r"[.!?;。！？｡।॥።؟፧…;][\"'»”’」』）)\]\s]*$")
_STOP = re.compile(r"[.!?;。！？।።؟…](?=[\s\"'»”“’)\]]|$)|[。！？।።؟…]")
#: Every link unit holds one of these.
_LINK_SIGNS = ("http", "www.", "<a", "](", "#", "sku")
_LINK = re.compile(r"https?://|www\.|<a\s|\]\(|#\w|\bSKU\b", re.I)
_LINK_RUN = re.compile(r"(?:https?://|www\.)\S+|#\w+|<[^>]*>|\]\([^)]*\)", re.I)
#: Lines of contents: a title, leaders, a page.
_CONTENTS = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|\t\d+\s*$")
_NUMBERED = re.compile(r"^\s*(?:\[\d+\]|\d+[.)]\s)")
_ITEM = re.compile(r"[,;|•·/、，؛፣]|\s[-–—]\s")
_WORD = re.compile(r"\w+", re.U)
#: A run of one character is damage, not a keyword.
_RUN = re.compile(r"(.)\1{19,}")


def script_of(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin" if SCRIPTS[0][1].search(text) else "other"
    counts = []
    for i, (name, p) in enumerate(SCRIPTS):
        n = sum(map(len, p.findall(text)))
        if n * 2 >= len(text):
            return name  # no other can have more
        counts.append((n, -i))
    n, i = max(counts)
    return SCRIPTS[-i][0] if n else "other"


def blocks(text: str) -> list[str]:
    """Consecutive blocks of near BLOCK characters that cover the text."""
    n = max(1, round(len(text) / BLOCK))
    at = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def units(text: str) -> list[str]:
    """Lines and sentences that cover the text, without outer white space."""
    return [u for m in _UNIT.finditer(text) if (u := m.group().strip())]


def _is_prose(unit: str, spaced: bool) -> bool:
    if not _MARK.search(unit):
        return False
    items = [x for x in _ITEM.split(unit) if x.strip()]
    if spaced:
        words = len(_WORD.findall(unit))
        return words >= 2 and not (len(items) >= 7 and words / len(items) < 4.5)
    return len(unit) >= 6 and not (len(items) >= 7 and len(unit) / len(items) < 8)


def weight(block: str) -> tuple[int, int, float]:
    """(characters, bin of its size, compression ratio) of a block."""
    raw = block.encode("utf-8", "replace")
    return len(block), int(math.log2(max(1, len(raw))) * 2), len(zlib.compress(raw, 6)) / max(1, len(raw))


def law(size_bin: int) -> float:
    """The ratio of a kind of block seen too seldom: a smooth law of its length."""
    return 1.02 - 0.09 * (size_bin / 2 - 5.5)


class Usual:
    """Usual ratios by script, language and size of block, else by script and size, else the law."""

    def __init__(self, rows: list[tuple[str, str | None, int, float, int]]):
        self.of = {(s, k, b): r for s, k, b, r, n in rows if n >= SEEN}

    def ratio(self, script: str, language: str, size_bin: int) -> float:
        got = self.of.get((script, language, size_bin)) or self.of.get((script, None, size_bin))
        return got or law(size_bin)

    def redundant(self, text: str, script: str, language: str, below: tuple[float, ...]) -> tuple[float, ...]:
        """Shares of the text that lie in blocks below these parts of the usual ratio."""
        shares, total = [0] * len(below), 0
        for b in blocks(text):
            n, size_bin, ratio = weight(b)
            total += n
            part = ratio / self.ratio(script, language, size_bin) + LOOSE * max(0.0, 1 - n / FIRM)
            for i, limit in enumerate(below):
                if part < limit:
                    shares[i] += n
        return tuple(x / max(1, total) for x in shares)


def measures(text: str, spaced: bool) -> tuple[float, float, float, str]:
    """(share of sentences, share of link units, share of sentences that repeat a phrase, link units with their words masked)."""
    prose = links = total = stuffed = sentences = 0
    masked = []
    for u in units(text):
        n = len(u)
        link = _LINK.search(u)
        if not link and (_CONTENTS.search(u) or _NUMBERED.match(u)):
            continue  # contents and numbered references speak neither way
        total += n
        reads = _is_prose(u, spaced)
        if link:
            run = sum(len(x) for x in _LINK_RUN.findall(u))
            if run * 3 >= n or u.count("|") >= 3 or not reads:
                links += n
                masked.append(_WORD.sub("w", u))
                continue
        if reads:
            prose += n
            sentences += 1
            words = [w for w in _WORD.findall(u.lower()) if len(w) > 2]
            stuffed += any(k > 1 for k in Counter(zip(words, words[1:])).values())
    return prose / total if total else 1.0, links / total if total else 0.0, stuffed / sentences if sentences >= 3 else 0.0, "\n".join(masked)


def is_spam(text: str, language: str, usual: Usual, redundant: float = REDUNDANT, extreme: float = EXTREME) -> bool:
    """Whether a text is mostly keywords, links or tags."""
    text = _RUN.sub(r"\1\1\1", text)
    script = script_of(text)
    low = text.lower()
    much, most = usual.redundant(text, script, language, (redundant, extreme))
    if much < MOSTLY and not any(x in low for x in _LINK_SIGNS):
        return False
    prose, links, stuffed, masked = measures(text, script != "han")
    if prose < PROSE and (much >= MOSTLY or (links >= LINKS and usual.redundant(masked, "latin", language, (redundant,))[0] >= MOSTLY)):
        return True
    return most >= MOSTLY and stuffed >= STUFFED


_BLOCK = T.StructType([T.StructField("script", T.StringType()), T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("ratios", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_BLOCK)
def _weights(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for t in texts:
            t = _RUN.sub(r"\1\1\1", t)
            seen = [weight(b) for b in blocks(t) if len(_STOP.findall(b)) * MARKED >= len(b)]
            out.append((script_of(t), [b for _, b, _ in seen], [r for _, _, r in seen]))
        yield pd.DataFrame(out, columns=_BLOCK.names)


def language(c: Column) -> Column:
    """Two letters, or an empty text for none."""
    two = F.lower(F.left(F.trim(c), F.lit(2)))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise("")


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    return spread(documents.filter(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text", language(lang).alias("lang")))


def usual_ratios(documents: DataFrame) -> Usual:
    """The usual ratio for each kind of block, over all blocks of the corpus that have sentence marks.

    At most (scripts) x (codes of two letters) x (bins of the logarithm of a block's length)
    rows reach the driver, whatever the corpus.
    """
    b = _texts(documents).select("lang", _weights("text").alias("w")).select("lang", "w.script", F.explode(F.arrays_zip("w.bins", "w.ratios")).alias("x"))
    b = b.select("script", "lang", F.col("x.bins").alias("size_bin"), F.col("x.ratios").alias("ratio"))
    # blocks are counted once by their rounded ratio, so both tables come from small counts
    b = b.groupBy("script", "lang", "size_bin", F.round("ratio", 3).alias("ratio")).agg(F.count("*").alias("n"))
    rows = b.groupBy("script", "lang", "size_bin").agg(F.collect_list(F.struct("ratio", "n")).alias("of")).collect()
    kinds: dict[tuple[str, str | None, int], Counter] = {}
    for r in rows:
        for k in ((r.script, r.lang, r.size_bin), (r.script, None, r.size_bin)):
            own = kinds.setdefault(k, Counter())
            for x in r.of:
                own[x.ratio] += x.n
    out = []
    for k, own in kinds.items():
        n, half, at = sum(own.values()), 0, 0.0
        for at, m in sorted(own.items()):
            half += m
            if half * 2 >= n:
                break
        out.append((*k, at, n))
    return Usual(out)


def spam_pages(documents: DataFrame, redundant: float = REDUNDANT, extreme: float = EXTREME) -> DataFrame:
    """doc_id of the pages that are mostly keywords, links or tags; distinct."""
    shared = documents.sparkSession.sparkContext.broadcast(usual_ratios(documents))

    @F.pandas_udf(T.BooleanType())
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([is_spam(t, k, shared.value, redundant, extreme) for t, k in zip(texts, languages)], dtype=bool)

    return _texts(documents).filter(found("text", "lang")).select("doc_id").distinct()
